"""Every query of the catalog against its SQL; those without SQL give rows, and the same ones again."""

import pytest
from compare import assert_same, database

from lumenfold.queries import catalog, problems

QUERIES = {**catalog.QUERIES, **problems.QUERIES}
SQL = {**catalog.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def db(data_dir):
    return database(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, db, name):
    if name in SQL:
        assert_same(spark, data_dir, QUERIES[name], SQL[name], db)
    else:
        rows = sorted(map(repr, QUERIES[name](spark, data_dir).collect()))
        assert rows and rows == sorted(map(repr, QUERIES[name](spark, data_dir).collect()))


def test_entry_names_are_complete():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names
    assert set(entry.oracle_sql()) <= names
