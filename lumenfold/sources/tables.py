"""Versioned tables of the catalog and scans of servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


def write_snapshot(tables: dict[str, DataFrame], path: str, version: int = SCHEMA_VERSION) -> None:
    """Writes each table and a meta table with the schema version."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.createDataFrame([("schema_version", str(version))], "key string, value string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str, name: str, least_version: int = SCHEMA_VERSION) -> DataFrame:
    """A table of a snapshot; refuses one of an older schema."""
    rows = spark.read.parquet(f"{path}/meta").where("key = 'schema_version'").take(1)
    version = int(rows[0]["value"]) if rows else 0
    if version < least_version:
        raise ValueError(f"snapshot {path} has schema {version}, {least_version} is needed")
    return spark.read.parquet(f"{path}/{name}")


def migrate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks added as nulls of the given types."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def read_server(
    spark: SparkSession, url: str, source: str, key: str | None = None, low: int | None = None, high: int | None = None, parts: int = 32, **options: str
) -> DataFrame:
    """A table or query of a server by JDBC; filters are pushed down, rows are fetched 5 000 at a time.

    With a whole-number ``key`` and its bounds the read is ``parts`` tasks, each of a
    stretch of the key; rows outside the bounds are read by the first and last of them.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", "5000")
    reader = reader.option("dbtable", f"({source}) AS part" if source.lstrip().lower().startswith("select") else source)
    if key is not None:
        if low is None or high is None or low >= high or parts < 1:
            raise ValueError("a key needs bounds, low below high, and at least one part")
        reader = reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
