"""Queries of the package against their SQL; those without SQL give rows, and the same ones again."""

import pytest
from compare import assert_same, database

from lumenfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data_dir, name):
    if name in queries.SQL:
        assert_same(spark, data_dir, queries.QUERIES[name], queries.SQL[name], database(data_dir))
    else:
        rows = sorted(map(repr, queries.QUERIES[name](spark, data_dir).collect()))
        assert rows and rows == sorted(map(repr, queries.QUERIES[name](spark, data_dir).collect()))
