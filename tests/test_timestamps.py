from datetime import UTC, datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.operators.timestamps import normalise_candidates, parsed


def utc(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp())


CASES = [
    ("2021:07:04 10:20:30", utc(2021, 7, 4, 10, 20, 30), False),
    ("2021-07-04T10:20:30Z", utc(2021, 7, 4, 10, 20, 30), True),
    ("2021-07-04 10:20:30.999", utc(2021, 7, 4, 10, 20, 30), False),
    ("2021/07/04 10:20:30", utc(2021, 7, 4, 10, 20, 30), False),
    ("2021-07-04T10:20:30+0530", utc(2021, 7, 4, 4, 50, 30), True),
    ("2021-07-04T10:20:30-03", utc(2021, 7, 4, 13, 20, 30), True),
    ("2021-07-04 10:20:30 UTC", utc(2021, 7, 4, 10, 20, 30), True),
    ("Sun, 04 Jul 2021 10:20:30 +0200", utc(2021, 7, 4, 8, 20, 30), True),
    ("04-Jul-2021 10:20:30", utc(2021, 7, 4, 10, 20, 30), False),
    ("4 Jul 2021, 12:05:06 AM", utc(2021, 7, 4, 0, 5, 6), False),
    ("4 Jul 2021, 12:05:06 PM", utc(2021, 7, 4, 12, 5, 6), False),
    ("20210704T102030Z", utc(2021, 7, 4, 10, 20, 30), True),
    ("20210704_102030", utc(2021, 7, 4, 10, 20, 30), False),
    ("20210704102030", utc(2021, 7, 4, 10, 20, 30), False),
    ("1625394030", 1625394030, True),
    ("1625394030999", 1625394030, True),
    ("  2021-07-04 10:20:30  ", utc(2021, 7, 4, 10, 20, 30), False),
    ("2020-02-29 00:00:00", utc(2020, 2, 29), False),
]
UNREADABLE = [
    None, "", "   ", "--", "null", "0000:00:00 00:00:00", "2021-02-29 10:00:00", "2021-13-01 10:00:00",
    "2021-07-04 24:00:00", "2021-07-04 10:60:00", "2021-07-04 10:20:60", "2021-07", "T10:20:30", "2021-07-04",
    "13 Jul 2021, 13:05:06 PM", "2021-07-04T10:20:30+25:00", "x" * 10_000,
]


def test_spellings(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES)], "n int, text string")
    found = {r["n"]: r["p"] for r in df.select("n", parsed(F.col("text")).alias("p")).collect()}
    for n, (text, secs, fixed) in enumerate(CASES):
        assert found[n] is not None, text
        assert (found[n]["secs"], found[n]["fixed"]) == (secs, fixed), text


def test_unreadable(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(UNREADABLE)], "n int, text string")
    assert df.select(parsed(F.col("text")).alias("p")).where("p is not null").count() == 0


def candidates(spark, rows):
    schema = "candidate_id bigint, asset_id bigint, tz_name string, local_date_time string, date_time_original string"
    return spark.createDataFrame(rows, schema)


def test_zones_gaps_and_overlaps(spark):
    rows = [
        (1, None, "Europe/Paris", "2021-03-28 02:30:00", None),  # never shown
        (2, None, "Europe/Paris", "2021-10-31 02:30:00", None),  # shown twice
        (3, None, " europe/paris ", "2021-10-31 03:30:00", None),
        (4, None, "America/New York", "2021-07-04 10:00:00", None),
        (5, None, "GMT+05:45", "2021-07-04 10:00:00", "--"),
        (6, None, "unknown", "2021-07-04 10:00:00", None),
        (7, None, None, "2021-07-04 10:00:00", None),
        (8, None, None, "2021-07-04 10:00:00", "2021-07-04T10:00:00Z"),
        (9, 77, "Asia/Tokyo", None, "null"),
        (9, 77, "Asia/Tokyo", None, "null"),
        (10, 78, "Asia/Tokyo", None, None),
        (11, None, "Australia/Lord_Howe", "2021-04-04 01:45:00", None),  # half-hour overlap
    ]
    assets = spark.createDataFrame([(77, "2021:07:04 10:00:00"), (77, "2021:07:04 10:00:00"), (78, None)], "id bigint, taken_at string")
    found = rows_of(normalise_candidates(candidates(spark, rows), assets))
    assert found == {
        (3, utc(2021, 10, 31, 2, 30)),
        (4, utc(2021, 7, 4, 14)),
        (5, utc(2021, 7, 4, 4, 15)),
        (8, utc(2021, 7, 4, 10)),
        (9, utc(2021, 7, 4, 1)),
    }


def test_empty_tables(spark):
    assets = spark.createDataFrame([], "id bigint, taken_at string")
    assert normalise_candidates(candidates(spark, []), assets).count() == 0


@pytest.mark.parametrize("zone", ["Europe/London", "Australia/Sydney", "America/Sao_Paulo", "Pacific/Apia", "Asia/Kathmandu"])
def test_against_zone_rules(spark, zone):
    """Round trip over a year of half hours: the clock shows each local time once, never or twice."""
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    zone_info, start = ZoneInfo(zone), datetime(2011, 12, 1)
    walls = [start + timedelta(minutes=30 * n) for n in range(0, 48 * 366, 7)]
    rows = [(n, None, zone, w.strftime("%Y-%m-%d %H:%M:%S"), None) for n, w in enumerate(walls)]
    assets = spark.createDataFrame([], "id bigint, taken_at string")
    found = dict(rows_of(normalise_candidates(candidates(spark, rows), assets)))
    for n, wall in enumerate(walls):
        instants = {
            int(wall.replace(tzinfo=zone_info, fold=fold).timestamp())
            for fold in (0, 1)
            if datetime.fromtimestamp(wall.replace(tzinfo=zone_info, fold=fold).timestamp(), zone_info).replace(tzinfo=None) == wall
        }
        assert found.get(n) == (instants.pop() if len(instants) == 1 else None), wall
