"""Compares a query's result with its SQL on the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def database(folder: str):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else path
        db.execute(f"create view {path.stem} as select * from '{source}'")
    return db


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else float(value)
        if isinstance(value, (list, tuple)):
            return tuple(map(plain, value))
        return value if value is None or isinstance(value, (int, str, bool)) else str(value)

    return sorted(columns), sorted((tuple(plain(row[n]) for n in order) for row in rows), key=repr)


def assert_same(spark, folder, query, sql, db=None):
    df = query(spark, folder)
    cursor = (db or database(folder)).execute(sql)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
