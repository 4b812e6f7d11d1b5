import random

from conftest import rows_of

from lumenfold.llm.golden import dominance_layers, golden_records, layers_in_order

RECORD = (
    "id bigint, source string, path string, bytes bigint, format string, width int, height int, taken_at string, "
    "taken_src string, exif_fields int, gps_lat double"
)


def brute_layers(points, most):
    left, out, layer = dict(points), {}, 1
    while left:
        front = [k for k, p in left.items() if layer == most or not any(q != p and all(x >= y for x, y in zip(q, p)) for q in left.values())]
        for k in front:
            out[k] = layer
            del left[k]
        layer = min(layer + 1, most)
    return out


def test_layers_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(n % 5, n, [rng.randrange(4) for _ in range(3)]) for n in range(300)]
    want = {}
    for g in range(5):
        want |= brute_layers([(n, tuple(d)) for gg, n, d in rows if gg == g], 4)
    frame = spark.createDataFrame(rows + rows[:30], "grp bigint, id bigint, dims array<bigint>")
    assert dict(rows_of(dominance_layers(frame), "id", "layer")) == want
    assert dict(rows_of(dominance_layers(frame, hot_group=16), "id", "layer")) == want


def test_equal_points_share_a_layer():
    assert layers_in_order([(2, 2), (2, 2), (1, 1), (1, 1), (0, 5)], 4) == [1, 1, 2, 2, 1]


def record(number, source="google", size=1, fmt="jpg", dims=(10, 10), taken=None, src=None, fields=None, lat=None):
    return (number, source, f"/p/{number}", size, fmt, *dims, taken, src, fields, lat)


def run(spark, clusters, membership, records, **options):
    return golden_records(
        spark.createDataFrame(clusters, "id bigint, confidence double"),
        spark.createDataFrame(membership, "cluster_id bigint, asset_id bigint, path string"),
        spark.createDataFrame(records, RECORD),
        **options,
    )


def test_survivor_date_and_fill(spark):
    records = [
        record(1, "originals", 9, "dng", (30, 20), None, None, 5),
        record(2, "icloud", 8, "jpg", (30, 10), "2020-01-01T00:00:00", "json", 4, 48.0),
        record(3, "google", 7, "jpg", (None, 20), "2020-01-01T00:00:00", "exif", None, 47.0),
        record(4, "google", 7, "jpg", (None, 20), "2020-01-01T00:00:00", "exif", None),
        record(4, "google", 7, "jpg", (None, 20), "2020-01-01T00:00:00", "exif", None),
        record(5, "google", 1, "heic", (1, 1), "2020-01-01T00:00:00", None, 1),
    ]
    membership = [(10, 1, "x"), (10, 2, "x"), (10, 3, "x"), (10, 4, "x"), (10, 4, "x"), (10, 77, "x"), (11, 5, "x"), (None, 5, "x"), (12, 78, "x")]
    found = run(spark, [(10, 0.1), (10, 0.1), (11, None), (12, None), (13, None)], membership, records)
    assert rows_of(found) == {(10, 1, 3), (11, 5, 5), (12, None, None), (13, None, None)}
    filled = run(spark, [(10, 0.1)], membership, records, fields=("taken_at", "gps_lat", "path"))
    assert rows_of(filled, "keep_asset_id", "gps_lat", "path") == {(1, 48.0, "/p/1")}


def test_empty(spark):
    assert run(spark, [], [], []).count() == 0


def test_fields_come_from_the_true_layer(spark):
    rng = random.Random(3)
    records, membership = [], []
    for number in range(240):
        lat = float(number) if number % 60 > 40 and rng.random() < 0.4 else None
        # Many layers; records of lower layers have more exif fields than some of higher layers.
        rank = number % 60
        size, exif = 100 - rank + rng.randrange(3), max(0, 60 - rank + rng.randrange(12))
        records.append(record(number, "google", size, "jpg", (10 + (60 - rank) // 4, 10), fields=exif, lat=lat))
        membership.append((number // 60 if number < 180 else 2, number, "x"))
    want = {}
    for g in range(3):
        ids = [n for c, n, _ in membership if c == g]
        dims = {n: (records[n][9], records[n][5] * records[n][6], records[n][3], 0, 1) for n in ids}
        layers = brute_layers(dims.items(), 10**9)
        assert max(layers.values()) > 8
        best = sorted(ids, key=lambda n: (layers[n], [-d for d in dims[n]], n))
        want[g] = (best[0], next((records[n][10] for n in best if records[n][10] is not None), None))
    for hot_group in (16, 5_000):
        found = run(spark, [(0, 1.0), (1, 1.0), (2, 1.0)], membership, records, fields=("gps_lat",), hot_group=hot_group)
        assert {c: (k, lat) for c, k, lat in rows_of(found, "cluster_id", "keep_asset_id", "gps_lat")} == want


def test_a_deeper_layer_with_more_fields_does_not_fill_first(spark):
    records = [record(n, size=100 - n, dims=(1, 1), fields=50 - n) for n in range(3)]
    # Layer 4: one record with few fields but large; layers 4 to 9: records with more fields.
    records += [record(10, size=97, dims=(1, 1), fields=1, lat=4.0)]
    records += [record(20 + n, size=90 - n, dims=(1, 1), fields=40 - n) for n in range(6)]
    records += [record(30, size=80, dims=(1, 1), fields=30, lat=9.0)]
    membership = [(1, r[0], "x") for r in records]
    for hot_group in (4, 5_000):
        found = run(spark, [(1, 1.0)], membership, records, fields=("gps_lat",), hot_group=hot_group)
        assert rows_of(found, "keep_asset_id", "gps_lat") == {(0, 4.0)}


def test_recent_records_fill_before_older_ones(spark):
    """Neither of two records that lose to the survivor is better in all else; the more recent one is in a better layer than a third."""
    schema = "id bigint, source string, path string, bytes bigint, format string, width int, height int, taken_at string, taken_src string, exif_fields int, gps_lat double, mtime double"
    keep = (1, "originals", "/a", 100, "raw", 10, 10, None, None, 50, None, 100.0)
    old = (2, "google", "/b", 50, "jpg", 5, 5, None, None, 20, 2.0, 50.0)
    recent = (3, "google", "/c", 40, "jpg", 5, 5, None, None, 10, 3.0, 200.0)
    frame = spark.createDataFrame([keep, old, recent], schema)
    clusters, linked = spark.createDataFrame([(7,)], "id bigint"), spark.createDataFrame([(7, n) for n in (1, 2, 3)], "cluster_id bigint, asset_id bigint")
    assert rows_of(golden_records(clusters, linked, frame, fields=("gps_lat",)), "keep_asset_id", "gps_lat") == {(1, 3.0)}
    assert rows_of(golden_records(clusters, linked, frame.drop("mtime"), fields=("gps_lat",)), "keep_asset_id", "gps_lat") == {(1, 2.0)}
