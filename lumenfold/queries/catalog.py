"""Queries of the catalog's own operators, each with the same query in SQL."""

from . import aggregates, changes, complete, further, joins, ordered, plans, readers, scalars  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
