import random

from conftest import rows_of

from lumenfold.operators.trips import simplify, stops_and_trips

SCHEMA = "device_id string, at double, lat double, lon double"
DEG = 1 / 111_195.0


def stay(t, n, step, lat, lon=10.0, seed=0):
    rng = random.Random(seed)
    return [(t + k * step, lat + rng.uniform(-30, 30) * DEG, lon + rng.uniform(-30, 30) * DEG) for k in range(n)]


def move(t, n, step, lat, metres=1000):
    return [(t + k * step, lat + k * metres * DEG, 10.0) for k in range(n)]


def run(spark, pings, device="d"):
    rows = [(device, float(t), la, lo) for t, la, lo in pings]
    return stops_and_trips(spark.createDataFrame(rows, SCHEMA))


def kinds(df):
    return {(k, int(s), int(e)) for k, s, e in rows_of(df, "kind", "start_s", "end_s")}


def test_stop_trip_stop(spark):
    pings = stay(0, 10, 300, 50.0) + move(3000, 6, 120, 50.01) + stay(4000, 8, 300, 50.08, seed=1)
    assert kinds(run(spark, pings)) == {("stop", 0, 2700), ("stop", 4000, 6100), ("trip", 2700, 4000)}


def test_noise_repeats_and_wild_fixes(spark):
    pings = stay(0, 10, 300, 50.0)
    dirty = pings + pings[:4] + [(1000, 57.0, 10.0), (1300, 0.0, 0.0), (1310, None, 10.0), (1320, 50.0, None)]
    assert kinds(run(spark, dirty)) == {("stop", 0, 2700)}


def test_silence_ends_stops_and_trips(spark):
    gap = 4 * 3600 + 1
    pings = stay(0, 6, 300, 50.0) + stay(1500 + gap, 6, 300, 50.2, seed=2)
    assert kinds(run(spark, pings)) == {("stop", 0, 1500), ("stop", 1500 + gap, 3000 + gap)}
    exact = stay(0, 6, 300, 50.0) + stay(1500 + gap - 1, 6, 300, 50.2, seed=2)
    assert ("trip", 1500, 1500 + gap - 1) in kinds(run(spark, exact))


def test_short_stay_is_no_stop(spark):
    assert kinds(run(spark, move(0, 5, 60, 50.0) + stay(400, 4, 300, 50.1) + move(1500, 5, 60, 50.11))) == set()


def test_distance_and_long_spans(spark):
    pings, t = [], 0
    for n in range(30):
        pings += stay(t, 8, 300, 50.0 + n * 0.05, seed=n)
        t += 8 * 300 + 3600
    df = run(spark, pings)
    assert df.where("kind = 'stop'").count() == 30 and df.where("kind = 'trip'").count() == 29
    for (metres,) in rows_of(df.where("kind = 'trip'"), "distance_m"):
        assert 5_300 < metres < 5_800


def test_hot_device_is_spread_and_empty_is_empty(spark):
    rows = [("hot", float(day * 86_400 + k * 300), 50.0, 10.0) for day in range(40) for k in range(10)]
    rows += [(None, 0.0, 50.0, 10.0), ("hot", None, 50.0, 10.0)]
    df = stops_and_trips(spark.createDataFrame(rows, SCHEMA))
    assert df.count() == 40
    assert stops_and_trips(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simplify_keeps_far_points():
    import numpy as np

    t = np.arange(11.0)
    x = np.where(t == 5, 500.0, 0.0)
    assert simplify(t, x, np.zeros(11), 75.0)[0] == 0 and 5 in simplify(t, x, np.zeros(11), 75.0)
    assert simplify(t, np.zeros(11), np.zeros(11), 75.0) == [0, 10]


def test_long_spans_are_cut_at_long_steps_without_effect(spark, monkeypatch):
    from lumenfold.operators import trips

    pings, t = [], 0
    for n in range(12):
        pings += stay(t, 30, 60, 50.0 + n * 0.05, seed=n)
        t += 30 * 60
        pings += move(t, 8, 90, 50.002 + n * 0.05, 600)
        t += 8 * 90
        if n % 5 == 4:
            t += 5 * 3600
    pings += [(pings[40][0] + 1, 57.0, 10.0), (pings[200][0] + 1, 57.0, 10.0)]
    rows = {(k, int(s), int(e), p, round(d)) for k, s, e, p, d in rows_of(run(spark, pings), "kind", "start_s", "end_s", "pings", "distance_m")}
    monkeypatch.setattr(trips, "CHUNK", 25)
    cut = {(k, int(s), int(e), p, round(d)) for k, s, e, p, d in rows_of(run(spark, pings), "kind", "start_s", "end_s", "pings", "distance_m")}
    assert {r[:4] for r in cut} == {r[:4] for r in rows} and len(rows) > 15
    for one, two in zip(sorted(rows), sorted(cut)):
        assert abs(one[4] - two[4]) <= 0.05 * max(one[4], 1)


def test_a_silence_on_the_way_is_no_stop(spark):
    pings = stay(0, 8, 300, 50.0) + [(2400 + k * 300 + (5000 if k > 2 else 0), 50.004 + k * 228 * DEG, 10.0) for k in range(6)]
    pings += stay(10_000, 8, 300, 50.02, seed=3)
    assert kinds(run(spark, pings)) == {("stop", 0, 2100), ("stop", 10_000, 12_100), ("trip", 2100, 10_000)}


def test_stops_come_from_the_simplified_path(spark):
    pings = stay(0, 10, 300, 50.0) + move(3000, 6, 120, 50.01) + stay(4000, 8, 300, 50.08, seed=1)
    rows = spark.createDataFrame([("d", float(t), la, lo) for t, la, lo in pings], SCHEMA)
    assert kinds(stops_and_trips(rows, tolerance_m=1e12)) == set()
    assert {k for k, _, _ in kinds(stops_and_trips(rows, slow_mps=1e-9))} == set()


def test_stretches_do_not_change_the_rows(spark, monkeypatch):
    from lumenfold.operators import trips

    pings, t = [], 0
    for n in range(6):
        pings += stay(t, 60, 30, 50.0 + n * 0.05, seed=n) + move(t + 1800, 10, 60, 50.002 + n * 0.05, 500)
        t += 2400
    whole = kinds(run(spark, pings))
    monkeypatch.setattr(trips, "STRETCH", 7)
    assert kinds(run(spark, pings)) == whole and len(whole) == 11


def test_runs_against_brute_force():
    """The run that is found lies within the radius of its centre, and neither end can move on."""
    import numpy as np

    from lumenfold.operators.trips import Runs

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(5, 40))
        lat, lon = 50 + np.cumsum(rng.normal(0, 40, n)) * DEG, 10 + np.cumsum(rng.normal(0, 40, n)) * DEG
        runs = Runs(lat, lon, 150.0)
        a, b = runs.longest(0, n - 1, 0)
        assert runs.fits(a, b)
        assert b == n - 1 or not (runs.away(a, b, b + 1) <= 150 and runs.fits(a, b + 1))
        assert a == 0 or not (runs.away(a, b, a - 1) <= 150 and runs.fits(a - 1, b))


def test_a_slow_wanderer_is_closed_after_its_stops(spark, monkeypatch):
    """Without any long step a span is closed after an ended stop; its rows stay the same."""
    from lumenfold.operators import trips

    pings, t, lat = [], 0, 50.0
    for n in range(5):
        pings += stay(t, 40, 60, lat, seed=n)
        t += 40 * 60
        pings += [(t + k * 60, lat + k * 140 * DEG, 10.0) for k in range(1, 15)]
        t, lat = t + 15 * 60, lat + 15 * 140 * DEG
    whole = kinds(run(spark, pings))
    monkeypatch.setattr(trips, "CHUNK", 50)
    assert kinds(run(spark, pings)) == whole and len(whole) == 9
