"""Column functions on tag maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_present(tags: Column, *keys: str) -> Column:
    """Value of the first key that is present; a present null or blank value wins."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(tags, key), tags[key]).otherwise(out)
    return out


def merge_missing(tags: Column, other: Column, prefix: str = "") -> Column:
    """``tags`` with the entries of ``other`` (of the key prefix) whose key is absent."""
    absent = F.map_filter(other, lambda k, v: k.startswith(prefix) & ~F.map_contains_key(tags, k))
    return F.when(other.isNull(), tags).when(tags.isNull(), other).otherwise(F.map_concat(tags, absent))


def missing_tags(proposed: Column, present: Column) -> Column:
    """Proposed Category/Value tags of which neither the tag nor its category is present."""
    categories = F.transform(present, lambda t: F.regexp_replace(t, r"/[^/]*$", ""))
    return F.filter(
        F.array_except(proposed, present),
        lambda t: ~F.array_contains(categories, F.regexp_replace(t, r"/[^/]*$", "")),
    )
