"""Small fixtures of the core operators: nulls, ties, boundaries, empty tables."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.functions import dates, geo, hashing, maps, media, text
from lumenfold.operators import merge, robust, rules, sessionize
from lumenfold.operators.asof import bracket, locate, nearest
from lumenfold.operators.components import components
from lumenfold.operators.decide import decide_clusters
from lumenfold.operators.place import place_items
from lumenfold.operators.range_join import block_pairs, near_pairs_in_time, range_join
from lumenfold.operators.skew import blocked_join
from lumenfold.operators.tiered import classify_files, roll_up

LIBRARY = "asset_id bigint, filename string, size_bytes bigint, checksum string"
INBOUND = "path string, filename string, size_bytes bigint, checksum string"


def test_duplicate_tiers(spark):
    library = spark.createDataFrame(
        [(1, "a", 10, "x"), (2, "a", 10, "y"), (3, "b", 10, None), (4, "c", 5, "z"), (5, "d", None, None)], LIBRARY
    )
    inbound = spark.createDataFrame(
        [("1", "a", 10, "y"), ("2", "a", 10, "q"), ("3", "b", 10, "q"), ("4", "new", 9, "z"), ("5", "c", 6, "q"), ("6", "e", 1, None), ("7", "d", None, None)],
        INBOUND,
    )
    verify = dict(rows_of(classify_files(inbound, library), "path", "verdict"))
    assert verify == {"1": "exact", "2": "name-only", "3": "likely", "4": "no-match", "5": "name-only", "6": "no-match", "7": "name-only"}
    assert dict(rows_of(classify_files(inbound, library, "thorough"), "path", "match_id"))["4"] == 4
    assert dict(rows_of(classify_files(inbound, library, "fast"), "path", "verdict"))["2"] == "likely"
    assert roll_up(classify_files(inbound.limit(0), library)).count() == 4
    with pytest.raises(ValueError):
        classify_files(inbound, library, "other")


def test_blocked_join_equals_a_join(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([(rng.randrange(3), n) for n in range(60)] + [(None, 99)], "k int, a int")
    right = spark.createDataFrame([(rng.randrange(3), n) for n in range(60)] + [(None, 99)], "k int, b int")
    assert rows_of(blocked_join(left, right, ["k"], per_block=4), "k", "a", "b") == rows_of(left.join(right, "k"), "k", "a", "b")


def test_range_join_boundaries(spark):
    rng = random.Random(9)
    values = [rng.uniform(-50, 50) for _ in range(80)] + [0.0, 3.0, -3.0]
    one = spark.createDataFrame([(n, v) for n, v in enumerate(values)] + [(999, None)], "a int, va double")
    two = one.select(F.col("a").alias("b"), F.col("va").alias("vb"))
    want = {(i, j) for i, v in enumerate(values) for j, w in enumerate(values) if abs(v - w) <= 3}
    assert rows_of(range_join(one, two, "va", "vb", 3), "a", "b") == want
    pairs = near_pairs_in_time(one, "a", "va", 3)
    assert rows_of(pairs) == {(i, j) for i, j in want if i < j}


def test_blocks_over_the_cap_are_left_out_whole(spark):
    rows = spark.createDataFrame([(n, "big" if n < 6 else "small") for n in range(9)] + [(20, None)], "id int, k string")
    assert rows_of(block_pairs(rows, "id", F.array("k"), 5)) == {(6, 7), (6, 8), (7, 8)}


def test_bracket_and_locate(spark):
    fixes = spark.createDataFrame([("d", 0, 10.0, 20.0), ("d", 4000, 10.01, 20.0), ("d", 40_000, 50.0, 20.0), ("d", 80_000, 50.0, 20.0)], "d string, t bigint, lat double, lon double")
    targets = spark.createDataFrame([("d", 1, 100), ("d", 2, 2000), ("d", 3, 20_000), ("d", 4, 4000), ("d", 5, 45_000), ("d", 6, 82_000), ("e", 7, 5)], "d string, id int, t bigint")
    found = {r["id"]: r for r in locate(bracket(targets, fixes, ["d"])).collect()}
    assert (found[1]["lat"], found[1]["confidence"]) == (10.0, "high")
    assert abs(found[2]["lat"] - 10.005) < 1e-9 and found[2]["confidence"] == "medium"
    assert found[3]["confidence"] is None and found[4]["after"]["t"] == 4000
    assert found[5]["lat"] == 50.0 and found[5]["confidence"] == "medium"
    assert found[6]["confidence"] == "medium" and found[7]["lat"] is None
    near = rows_of(nearest(bracket(targets, fixes, ["d"]), 300), "id")
    assert near == {(1,), (4,)}


def test_components_of_a_long_chain(spark):
    names = list(range(120))
    random.Random(1).shuffle(names)
    edges = list(zip(names, names[1:])) + [(500, 501), (7, 7), (None, 1)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "a int, b int"), "a", "b")))
    assert {found[n] for n in range(120)} == {0} and found[501] == 500 and 7 in found


def test_bracket_spans_slots_and_matches_brute_force(spark):
    rng = random.Random(7)
    fixes = [(rng.choice("ab"), rng.randrange(0, 400_000), rng.random(), 1.0) for _ in range(60)] + [("a", None, 1.0, 1.0), (None, 5, 1.0, 1.0)]
    targets = [(rng.choice("abc"), n, rng.randrange(0, 400_000)) for n in range(200)] + [("a", 900, fixes[0][1])]
    df = bracket(
        spark.createDataFrame(targets, "d string, id int, t bigint"), spark.createDataFrame(fixes, "d string, t bigint, lat double, lon double"), ["d"], slot=5_000
    )
    found = {r["id"]: (r["before"] and r["before"]["t"], r["after"] and r["after"]["t"]) for r in df.collect()}
    for d, n, t in targets:
        times = [x for k, x, _, _ in fixes if k == d and x is not None]
        assert found[n] == (max((x for x in times if x < t), default=None), min((x for x in times if x >= t), default=None))


def test_components_in_small_lots(spark):
    rng = random.Random(5)
    for nodes, count in ((60, 50), (400, 380), (200, 600)):
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)] + [(0, n) for n in range(0, nodes, 9)]
        group = list(range(nodes))

        def top(n):
            while group[n] != n:
                n = group[n]
            return n

        for a, b in edges:
            a, b = top(a), top(b)
            group[max(a, b)] = min(a, b)
        linked = {n for a, b in edges if a != b for n in (a, b)}
        frame = spark.createDataFrame(edges, "a int, b int").repartition(3)
        assert dict(rows_of(components(frame, "a", "b", task_edges=15))) == {n: top(n) for n in linked}


def test_unique_match(spark):
    from lumenfold.queries.joins import unique_match

    faces = spark.createDataFrame([(1, "a", 10, 100), (2, "a", 10, 500), (3, "b", 11, None), (4, "c", None, 100), (5, "d", 12, 7)], "id int, filename string, size bigint, at bigint")
    known = spark.createDataFrame(
        [(51, "x", 10, 103), (52, "a", 10, 900), (53, "b", 11, 5), (54, "d", 12, 7), (55, "d", 12, 8)], "asset_id int, filename string, size bigint, epoch bigint"
    )
    assert rows_of(unique_match(faces, known, 5)) == {(1, 51), (2, 52), (3, 53)}


def test_event_sweep_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows, t, lat = [], 0, 0.0
    for n in range(300):
        t += rng.choice([60, 600, 20_000])
        lat += rng.choice([0.0, 0.01, 0.1])
        rows.append(("k", n, t, lat, 5.0))
    rows.append(("k", 900, None, 1.0, 1.0))
    found = sessionize.event_sweep(spark.createDataFrame(rows, "k string, id int, t bigint, lat double, lon double"), ["k"])
    want, event = {}, []

    def close():
        if len(event) >= 3:
            want.update({m[1]: event[0][1] for m in event})

    import math

    for row in rows[:-1]:
        if event:
            mean = sum(m[3] for m in event) / len(event)
            if row[2] - event[-1][2] > 14_400 or math.radians(abs(row[3] - mean)) * 6371 > 5:
                close()
                event = []
        event.append(row)
    close()
    assert dict(rows_of(found, "id", "event")) == want


def test_runs_and_intervals(spark):
    cues = ["a", "a", "a", "", "", "b", "b", None, None, "b"]
    rows = spark.createDataFrame([("f", n, c) for n, c in enumerate(cues)], "f string, n int, cue string")
    assert rows_of(sessionize.repeated_runs(rows, ["f"], "n", "cue", 2).where("in_loop"), "n") == {(1,), (2,), (6,)}
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 5.0, 6.0), ("a", 5.5, 5.6)], "k string, s double, e double")
    assert rows_of(sessionize.merge_intervals(spans, ["k"], "s", "e")) == {("a", 0.0, 3.0), ("a", 5.0, 6.0)}
    silent = spark.createDataFrame([("a", 2.0, 3.0, 10.0), ("b", None, None, 4.0)], "k string, s double, e double, total double")
    assert rows_of(sessionize.gaps_between(silent, ["k"], "s", "e", "total", 0.2)) == {("a", 0.0, 2.2), ("a", 2.8, 10.0), ("b", 0.0, 4.0)}


def test_robust_statistics(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4, 5, 1000)] + [("b", 9), ("b", 1), ("c", None)], "k string, x bigint")
    assert rows_of(robust.fenced_bounds(rows, ["k"], "x")) == {("a", 1, 5), ("b", 1, 9)}
    assert rows_of(robust.index_percentile(rows, ["k"], "x", 0.9)) == {("a", 1000), ("b", 9)}
    seen = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 3, "y"), ("a", 4, "x"), ("a", 5, None)], "k string, n int, v string")
    assert rows_of(robust.first_seen_mode(seen, ["k"], "v", ["n"]), "k", "mode") == {("a", "y")}
    votes = spark.createDataFrame([("p", 1)] * 3 + [("p", 2)] * 2 + [("q", 1)] * 2, "k string, c int")
    assert rows_of(robust.vote(votes, ["k"], "c"), "k", "winner") == {("p", 1), ("q", None)}
    assert rows_of(robust.dominant(votes, ["k"], "c")) == {("p", None), ("q", 1)}


def test_placement(spark):
    trips = spark.createDataFrame([("near", 0, 100, 10.0, 10.0, 1.0), ("plain", 0, 100, None, None, 0.0), ("late", 500, 600, 10.0, 10.0, 1.0), ("void", None, None, 1.0, 1.0, 1.0)], "trip string, start bigint, end bigint, trip_lat double, trip_lon double, radius_km double")
    items = spark.createDataFrame([(1, 50, 10.0, 10.0), (2, 50, 40.0, 10.0), (3, 110, 10.2, 10.0), (4, None, 1.0, 1.0), (5, 9_000_000, 10.0, 10.0), (6, 50, None, None)], "id int, t bigint, lat double, lon double")
    found = {r["id"]: (r["verdict"], r["basis"], r["trip"]) for r in place_items(items, trips, gap=20).collect()}
    assert found[1] == ("matched", "geo", "near") and found[2] == ("matched", "date-only", "plain")
    assert found[3] == ("extends", "geo", "near") and found[4] == ("new", "none", None)
    assert found[5] == ("new", "geo", None) and found[6] == ("matched", "date-only", "near")


BASE = dict(source="icloud", format="jpg", media_type="image", width=40, height=30, bytes=100, exif_fields=3, phash=0, epoch=1000, gps_lat=None, gps_lon=None, stem="a", burst_uuid=None, edited=False, clip_cos_sim=None)
ROWS = "cluster_id bigint, id bigint, source string, format string, media_type string, width int, height int, bytes bigint, exif_fields int, phash bigint, epoch bigint, gps_lat double, gps_lon double, stem string, burst_uuid string, edited boolean, clip_cos_sim double"


@pytest.mark.parametrize(
    ("change", "decision"),
    [
        ({}, "auto"),
        ({"burst_uuid": "u"}, "kept_all"),
        ({"edited": True}, "review"),
        ({"width": 60, "height": 20}, "review"),
        ({"source": "originals", "bytes": 1, "exif_fields": -60}, "review"),
        ({"phash": 0x3FF}, "review"),
        ({"phash": 0x3FF, "clip_cos_sim": 0.99}, "auto"),
        ({"epoch": 9000, "stem": "b"}, "review"),
        ({"phash": None}, "review"),
    ],
)
def test_decision_guards(spark, change, decision):
    names = [c.split()[0] for c in ROWS.split(", ")]
    one, two = {**BASE, "cluster_id": 1, "id": 1, "exif_fields": 9}, {**BASE, "cluster_id": 1, "id": 2, **change}
    if "clip_cos_sim" in change:
        one["clip_cos_sim"] = change["clip_cos_sim"]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in (one, two)], ROWS)
    assert rows_of(decide_clusters(frame), "cluster_id", "decision") == {(1, decision)}


def test_after_images(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 2), (None, 7)], "k string, v int")
    assert rows_of(merge.insert_absent(target, new, ["k"])) == {("a", 1, False), ("b", 2, False), ("c", 2, True), (None, 7, True)}
    changes = spark.createDataFrame([("b", 5, 1), ("b", 4, 2), ("d", 1, 1)], "k string, v int, at int")
    assert rows_of(merge.upsert(target, changes, ["k"], ["at"])) == {("a", 1), ("b", 4), ("d", 1)}
    plan = merge.sync_plan(target, new.where("k is not null").groupBy("k").agg(F.max("v").alias("v")), "k", "v")
    assert rows_of(plan) == {("a", "create"), ("b", "update"), ("c", "delete")}


def test_rules_reach_a_fixpoint(spark):
    media_rows = spark.createDataFrame(
        [("/f", "/f/IMG_20240415_120000.jpg", {"EXIF:Model": "x"}, 48.0, -2.0), ("/f", "/f/b.jpg", {"EXIF:DateTimeOriginal": "2024:04:15 12:00:00"}, None, None)],
        "folder string, path string, tags map<string,string>, notes_lat double, notes_lon double",
    )
    after, written = rules.apply_to_fixpoint(media_rows)
    tags = {r["path"]: r["tags"] for r in after.collect()}["/f/IMG_20240415_120000.jpg"]
    assert tags["XMP:DateTimeOriginal"] == "2024:04:15 12:00:00" and tags["XMP:GPSLongitudeRef"] == "W"
    assert written.count() == 5
    assert rules.pending(rules.resolve(rules.evaluate(after)), written).where("tier = 'high'").count() == 0


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    assert one(spark, text.normalized_stem(F.lit("/x/IMG_1234(2)-Edited.JPG")), text.extension(F.lit("/x/a.b/C")), text.parent_dir(F.lit("a.jpg"))) == ("img_1234", "", "")
    assert one(spark, text.is_invented_cue(F.lit(" Thanks for\twatching!! ")), text.is_invented_cue(F.lit("♪ ♪")), text.is_invented_cue(F.lit("hello"))) == (True, True, False)
    looped = "go " * 6 + "home"
    assert one(spark, text.collapse_word_runs(F.lit(looped)), text.collapse_word_runs(F.lit("no,  no, no"))) == ("go home", "no,  no, no")
    assert one(spark, text.format_cue_time(F.lit(59.9996)), text.excerpt(F.lit("one two three"), 9)) == ("00:01:00,000", "one two…")
    assert one(spark, text.join_make_model(F.lit("Canon"), F.lit("CANON R5")), text.join_make_model(F.lit(" "), F.lit(None).cast("string"))) == ("CANON R5", None)
    assert one(spark, text.marker_key(F.lit("mine\n  key: ab \n"), "key:"), text.marker_key(F.lit("key:  "), "key:")) == ("ab", None)


def test_other_functions(spark):
    stamp = F.to_timestamp(F.lit("2024-04-29 10:00:00"))
    later = F.to_timestamp(F.lit("2024-05-03 10:00:00"))
    assert one(spark, dates.date_range_name(stamp, later), dates.event_name(F.lit(None).cast("string"), F.lit("Chile"), stamp, stamp)) == ("29 Apr – 3 May 2024", "Chile — 29 Apr 2024")
    assert one(spark, dates.format_offset(F.lit(-12600)), dates.has_zone_suffix(F.lit("2024 +02:00")), dates.has_zone_suffix(F.lit(None).cast("string"))) == ("-03:30", True, False)
    assert one(spark, geo.hemisphere(F.lit(5.0), F.lit("S")), geo.hemisphere(F.lit(-5.0), F.lit("S"))) == (-5.0, -5.0)
    tags = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("x"))
    assert one(spark, maps.first_present(tags, "a", "b"), maps.first_present(tags, "z", "b")) == (None, "x")
    assert one(spark, media.hash_from_hex(media.hash_to_hex(F.lit(-5).cast("bigint"))), media.hamming(F.lit(7), F.lit(0))) == (-5, 3)
    swapped = hashing.patch_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert one(spark, hashing.patch_hash(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))))[0] == one(spark, swapped)[0]
    assert one(spark, media.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), media.target_bitrate(F.lit(10.0), F.lit(10.0), F.lit(1.0))) == (None, 500_000)


def test_perceptual_hash_and_word_ratio(spark):
    import numpy as np

    pixels = np.random.default_rng(0).uniform(0, 255, 1024)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ pixels.reshape(32, 32) @ basis.T)[:8, :8].ravel()
    want = 0
    for bit in low > np.median(low[1:]):
        want = want << 1 | int(bit)
    frame = spark.createDataFrame([(pixels.tolist(), "a b c", "a c d"), ([1.0], None, "x"), (None, "", "")], "p array<double>, x string, y string")
    got = frame.select(media.perceptual_hash(F.col("p")).alias("h"), media.word_ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert got[0]["h"] & (2**64 - 1) == want and got[1]["h"] is None and got[2]["h"] is None
    assert got[0]["r"] == 0.667 and got[1]["r"] is None and got[2]["r"] == 1.0


def test_siblings_and_bloat_rules(spark):
    fix = lambda n: {"EXIF:DateTimeOriginal": f"2024:04:15 12:{n:02d}:00", "Composite:GPSLatitude": str(48 + n / 1000), "Composite:GPSLongitude": "-2.0"}
    rows = [("/f", f"/f/{n}.jpg", fix(n), None, None) for n in range(0, 50, 10)]
    rows += [("/f", "/f/lost.jpg", {"EXIF:DateTimeOriginal": "2024:04:15 12:11:00"}, None, None), ("/g", "/g/alone.jpg", {"EXIF:DateTimeOriginal": "2024:04:15 12:11:00"}, None, None)]
    video = {"QuickTime:CompressorID": "avc1", "QuickTime:ImageWidth": "100", "QuickTime:ImageHeight": "100", "QuickTime:VideoFrameRate": "10"}
    rows += [("/v", "/v/fat.mp4", {**video, "Composite:AvgBitrate": "20000"}, None, None), ("/v", "/v/worse.mp4", {**video, "File:FileSize": "50000", "QuickTime:Duration": "1"}, None, None)]
    rows += [("/v/Edits", "/v/Edits/fat.mp4", {**video, "Composite:AvgBitrate": "20000"}, None, None), ("/v", "/v/odd.mp4", {**video, "QuickTime:Duration": "0"}, None, None)]
    media_rows = spark.createDataFrame(rows, "folder string, path string, tags map<string,string>, notes_lat double, notes_lon double")
    found = {(r, p, f): v for r, p, f, v in rows_of(rules.evaluate(media_rows), "rule", "path", "field", "value")}
    assert found[("gps-from-siblings", "/f/lost.jpg", "GPSLatitude")] == "48.010000"
    assert found[("bloat-candidate", "/v/fat.mp4", "Bloat")] == "fat" and found[("bloat-candidate", "/v/worse.mp4", "Bloat")] == "obscene"
    assert not any(p in ("/g/alone.jpg", "/v/Edits/fat.mp4", "/v/odd.mp4") and r != "gps-anchor" for r, p, _ in found)


def test_plans(spark):
    from lumenfold.plans import catalog as plans

    files = spark.createDataFrame([("a", 5, None), ("b", 6, "Z1"), ("c", 7, None), ("d", None, None)], "path string, local_s bigint, clip_zone string")
    none = F.lit(None)
    files = files.withColumns({"utc_s": none.cast("bigint"), "folder_zone": F.lit("ZF"), "override_zone": none.cast("string")})
    library = spark.createDataFrame([("b", 2, False), ("c", 3, True)], "path string, id bigint, dated boolean")
    assert rows_of(plans.date_plan(files, library), "path", "mode", "zone") == {("a", "insert", "ZF"), ("b", "update", "Z1")}
    plan = plans.date_plan(files, library, retime=True)
    dates_now = spark.createDataFrame([(2, None, "old"), (3, 1, "old"), (4, 9, None)], "id bigint, local_s bigint, zone string")
    assert rows_of(plans.apply_date_plan(dates_now, plan)) == {(2, 6, "old", True), (3, 7, "ZF", True), (4, 9, None, False)}
    with pytest.raises(ValueError):
        plans.sweep_ids(dates_now, "id", 0.5, True, "merge")
    with pytest.raises(ValueError):
        plans.sweep_ids(dates_now, "id", 0.95, False, "keep_all")


def test_values_at_against_sorted_lists(spark, monkeypatch):
    from lumenfold.operators import robust

    rng = random.Random(11)
    rows = [(rng.choice("abc"), rng.choice([None, rng.gauss(0, 1) ** 5, float(rng.randrange(4))])) for _ in range(900)] + [("d", None), ("e", 7.0), ("f", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double")
    lists = {k: sorted(v for q, v in rows if q == k and v is not None and v == v) for k in "abcde"}
    for ranges, hot in ((1, 10), (7, 10), (256, 10), (256, 10_000)):
        monkeypatch.setattr(robust, "RANGES", ranges)
        monkeypatch.setattr(robust, "HOT_ROWS", hot)
        for q in (0.0, 0.5, 0.9, 1.0):
            want = {(k, v[min(len(v) - 1, int(q * len(v)))]) for k, v in lists.items() if v}
            assert rows_of(robust.index_percentile(frame, ["k"], "v", q)) == want
        bounds = {k: (low, high) for k, low, high in rows_of(robust.fenced_bounds(frame.where("not isnan(v)"), ["k"], "v"))}
        for k, v in lists.items():
            if not v:
                assert k not in bounds
                continue
            q1, q3 = v[len(v) // 4], v[3 * len(v) // 4]
            kept = [x for x in v if len(v) < 4 or q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)] or v
            assert bounds[k] == (min(kept), max(kept))
