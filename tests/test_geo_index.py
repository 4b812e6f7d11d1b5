import math
import random

from conftest import rows_of

from lumenfold.operators import geo_index
from lumenfold.operators.geo_index import cover_ring, near_pairs, near_sites, points_in_regions

POINT = "id bigint, lat double, lon double"
RING = "array<struct<lat:double,lon:double>>"


def metres(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    half = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(half)))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(1)
    centres = [(48.2, 16.3), (-89.9999, 10.0), (89.99995, -170.0), (0.5, 179.9999), (0.0, -180.0)]
    rows = []
    for n in range(400):
        lat, lon = rng.choice(centres)
        rows.append((n, max(-90.0, min(90.0, lat + rng.uniform(-4e-4, 4e-4))), ((lon + rng.uniform(-4e-4, 4e-4) + 180) % 360) - 180))
    rows += [(400, 48.2, None), (401, None, None), (402, 0.0, 0.0), (403, 95.0, 10.0), (404, float("nan"), 1.0)]
    rows += [(405, 48.2, 16.3), (406, 48.2, 16.3), (407, 48.2, 16.3), (405, 48.2, 16.3)]
    valid = {r[0]: r[1:] for r in rows if r[1] is not None and r[2] is not None and abs(r[1]) <= 90 and not (r[1] == 0 == r[2])}
    want = {(a, b) for a in valid for b in valid if a < b and metres(valid[a], valid[b]) <= 20}
    assert len(want) > 50
    assert rows_of(near_pairs(spark.createDataFrame(rows, POINT), "id", "lat", "lon", 20.0)) == want


def test_hot_site_is_one_class(spark):
    rows = [(n, 10.0, 20.0) for n in range(300)] + [(1000, 10.00005, 20.0)]
    members, links = near_sites(spark.createDataFrame(rows, POINT), "id", "lat", "lon", 20.0)
    assert rows_of(links) == {(0, 1000)}
    assert members.where("site = 0").count() == 300


def test_hot_cells_are_cut_into_blocks(spark, monkeypatch):
    from lumenfold.operators import skew

    original = skew.blocked_join
    monkeypatch.setattr(geo_index, "blocked_join", lambda p, b, k: original(p, b, k, per_block=7))
    rows = [(n, 10.0 + n * 1e-6, 20.0) for n in range(60)]
    found = rows_of(near_pairs(spark.createDataFrame(rows, POINT), "id", "lat", "lon", 3.0))
    assert found == {(a, b) for a in range(60) for b in range(60) if a < b and metres(rows[a][1:], rows[b][1:]) <= 3.0}


def inside(x, y, ring):
    odd, (x1, y1) = False, ring[-1]
    for x2, y2 in ring:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        x1, y1 = x2, y2
    return odd


def regions():
    rng = random.Random(2)
    out = []
    for n in range(12):
        cx, cy, size = rng.uniform(-180, 180), rng.uniform(-60, 60), rng.choice([0.01, 0.5, 8.0])
        ring = [(cx + size * rng.uniform(0.4, 1) * math.cos(a), cy + size * rng.uniform(0.4, 1) * math.sin(a)) for a in (k * 0.5 for k in range(12))]
        if n % 2:
            ring = ring[::-1]
        if n % 3 == 0:
            ring = ring + ring[:1]
        out.append((n, ring))
    return out


def test_points_in_regions_against_brute_force(spark):
    rng = random.Random(3)
    shapes = regions()
    rows = []
    for n in range(600):
        _, ring = rng.choice(shapes)
        x, y = rng.choice(ring)
        rows.append((n, max(-90, min(90, y + rng.uniform(-3, 3))), ((x + rng.uniform(-3, 3) + 180) % 360) - 180))
    table = [(n, [{"lat": y, "lon": x} for x, y in ring]) for n, ring in shapes]
    table += [(100, None), (101, []), (102, [{"lat": 1.0, "lon": 1.0}])]
    want = {(p, n) for p, lat, lon in rows for n, ring in shapes for turn in (0, 360, -360) if inside(lon + turn, lat, ring)}
    found = points_in_regions(
        spark.createDataFrame(rows + [(999, None, 1.0)], POINT), "id", "lat", "lon",
        spark.createDataFrame(table, f"region_id bigint, ring {RING}"), "region_id", "ring",
    )
    assert want and rows_of(found) == want


def test_regions_by_shuffle_give_the_same(spark, monkeypatch):
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2.0}, {"lat": 2.0, "lon": 1.0}]
    shapes = spark.createDataFrame([(1, ring)], f"region_id bigint, ring {RING}")
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.9, 0.1)], POINT)
    args = (points, "id", "lat", "lon", shapes, "region_id", "ring")
    sent = rows_of(points_in_regions(*args))
    monkeypatch.setattr(geo_index, "RANGES_BROADCAST", 0)
    assert rows_of(points_in_regions(*args)) == sent == {(1, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], POINT)
    shapes = spark.createDataFrame([], f"region_id bigint, ring {RING}")
    assert near_pairs(none, "id", "lat", "lon", 20.0).count() == 0
    assert points_in_regions(none, "id", "lat", "lon", shapes, "region_id", "ring").count() == 0


def test_cover_holds_every_inner_point():
    rng = random.Random(4)
    for _, ring in regions():
        ranges = cover_ring(ring)
        for _ in range(60):
            x, y = (sum(v) / 3 for v in zip(*rng.sample(ring, 3)))
            if not inside(x, y, ring):
                continue
            cx, cy = math.floor((x + 540) / geo_index._UNIT), math.floor((y + 540) / geo_index._UNIT)
            code = sum(((cx >> b) & 1) << (2 * b) | ((cy >> b) & 1) << (2 * b + 1) for b in range(24))
            assert any(low <= code <= high for low, high, _ in ranges)
