"""Rules of folders, trips of a library, merged clusters, notes, names and registered functions, against plain expectations."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.functions import catalog, dates, registration, text, video
from lumenfold.operators import library, rules
from lumenfold.session import observed
from lumenfold.sources.files import sibling_telemetry

MEDIA = (
    "folder string, path string, tags map<string,string>, notes_lat double, notes_lon double, notes_path string, notes_zone string,"
    " notes_tags array<string>, notes_suggest boolean"
)


def findings(spark, rows, tracks=None, schema=MEDIA):
    width = len(schema.split(", "))
    frame = spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)
    return {(r, p, f): (t, v) for r, t, p, f, v in rows_of(rules.evaluate(frame, tracks=tracks), "rule", "tier", "path", "field", "value")}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_pairs_tracks_and_zones(spark):
    rows = [
        ("/f", "/f/VID_20240101_120000_00_007.insv", {}),
        ("/f", "/f/LRV_20240101_120000_11_007.lrv", {}),
        ("/f", "/f/PRO_LRV_20240101_120000_11_007.lrv", {}),
        ("/f", "/f/a.jpg", {"EXIF:DateTimeOriginal": "2024:07:01 12:00:00"}, None, None, "/f/TRIP.md", "Europe/Berlin", ["Family", "Gear/Camera/X"]),
        ("/f", "/f/b.jpg", {"EXIF:DateTimeOriginal": "2024:07:01 12:00:00+02:00"}, None, None, "/f/TRIP.md", "Europe/Berlin", [" "]),
        ("/f", "/f/c.jpg", {"EXIF:DateTimeOriginal": "2024:07:01 13:00:00", "EXIF:OffsetTimeOriginal": "+03:00"}),
        ("/f", "/f/d.jpg", {"EXIF:DateTimeOriginal": "2024:07:01 12:00:00"}),
    ]
    t = 1_719_828_000  # 2024-07-01 10:00 UTC
    tracks = spark.createDataFrame([("/f", t + 100, 50.5, -1.25), ("/f", t - 200, 51.0, 1.0), ("/f", t + 9_000, 1.0, 1.0)], "folder string, t bigint, lat double, lon double")
    got = findings(spark, rows, tracks)
    assert got[("lens-pair", rows[0][1], "Pair")] == ("high", rows[1][1]) and got[("lens-pair", rows[1][1], "Pair")][1] == rows[0][1]
    assert not any(r == "lens-pair" and "PRO" in p for r, p, _ in got)
    for name in "abc":
        assert got[("gps-from-track", f"/f/{name}.jpg", "GPSLatitude")] == ("high", "50.500000")
        assert got[("gps-from-track", f"/f/{name}.jpg", "GPSLongitudeRef")][1] == "W"
    assert ("gps-from-track", "/f/d.jpg", "GPSLatitude") not in got
    assert got[("zone-suffix", "/f/a.jpg", "DateTimeOriginal")][1] == "2024:07:01 12:00:00+02:00"
    assert not any(r == "zone-suffix" and p != "/f/a.jpg" for r, p, _ in got)
    assert got[("tags-from-notes", "/f/a.jpg", "HierarchicalSubject")][1] == "Family" and ("tags-from-notes", "/f/b.jpg", "Subject") not in got


def test_zone_guess_and_missing_tags(spark):
    def at(lat, lon):
        return {"Composite:GPSLatitude": str(lat), "Composite:GPSLongitude": str(lon), "EXIF:Model": "Cam"}

    tags = ["Gear/Camera/Other", "x"]
    rows = [("/b", f"/b/IMG_{n}.jpg", at(52.5, 13.4), None, None, "/b/TRIP.md", None, tags) for n in range(4)]
    rows += [("/b", f"/b/DSC{n}.jpg", at(35.7, 139.7), None, None, "/b/TRIP.md", None, tags) for n in range(2)]
    rows += [("/c", f"/c/{n}.jpg", at(52.5, 13.4) if n < 3 else at(35.7, 139.7), None, None, "/c/TRIP.md", None, tags, False) for n in range(5)]
    rows += [("/d", "/d/1.jpg", at(52.5, 13.4), 40.7, -74.0, "/d/TRIP.md"), ("/e", "/e/1.jpg", at(52.5, 13.4), None, None, "/e/TRIP.md", "Asia/Tokyo", [])]
    got = findings(spark, rows)
    zones = {p: v for (r, p, f), (_, v) in got.items() if r == "zone-guess"}
    assert zones == {"/b/TRIP.md": "Europe/Berlin", "/d/TRIP.md": "America/New_York"}
    lacking = {p: v for (r, p, f), (_, v) in got.items() if r == "tags-missing"}
    assert lacking == {"/b/TRIP.md": "Events/b|Source/DSC|Source/IMG", "/e/TRIP.md": "Events/e|Gear/Camera/Cam"}


def test_camera_drift_and_kept_sources(spark):
    def shot(model, minute, **more):
        return {"EXIF:DateTimeOriginal": f"2024:04:15 {12 + minute // 60:02d}:{minute % 60:02d}:00", "EXIF:Model": model, **more}

    rows = [("/g", f"/g/a{n}.jpg", shot("A", n, **({"EXIF:GPSLatitude": "1"} if n == 0 else {}))) for n in range(3)]
    rows += [("/g", f"/g/b{n}.jpg", shot("B", 60 + n)) for n in range(5)] + [("/g", "/g/c0.jpg", shot("C", 600))]
    fat = {"QuickTime:CompressorID": "avc1", "QuickTime:ImageWidth": "100", "QuickTime:ImageHeight": "100", "QuickTime:VideoFrameRate": "10", "Composite:AvgBitrate": "20000"}
    rows += [("/v", "/v/a.mp4", fat), ("/v", "/v/DJI_1.mp4", fat), ("/v", "/v/IMG_20240101.mp4", fat), ("/v", "/v/a.mts", fat), ("/v/Raw1", "/v/Raw1/a.mp4", fat)]
    rows += [("/v", "/v/b.mp4", {**fat, "QuickTime:CompressorID": "apch avc1"}), ("/v", "/v/c.mp4", {**fat, "EXIF:Make": "Insta360"})]
    got = findings(spark, rows)
    moved = {p: v for (r, p, f), (_, v) in got.items() if r == "camera-drift"}
    assert moved == {f"/g/b{n}.jpg": f"2024:04:15 11:{59 + n if n < 1 else 0:02d}:00" if n < 1 else f"2024:04:15 12:{n - 1:02d}:00" for n in range(5)}
    assert {p for (r, p, f) in got if r == "bloat-candidate"} == {"/v/a.mp4"}


def test_siblings_tell_their_tier(spark):
    def fix(minute):
        return {"EXIF:DateTimeOriginal": f"2024:04:15 12:{minute:02d}:00", "Composite:GPSLatitude": str(48 + minute / 1000), "Composite:GPSLongitude": "-2.0"}

    rows = [("/f", f"/f/{n}.jpg", fix(n)) for n in range(0, 50, 10)] + [("/f", "/f/near.jpg", {"EXIF:DateTimeOriginal": "2024:04:15 12:11:00"})]
    rows += [("/f", "/f/late.jpg", {"EXIF:DateTimeOriginal": "2024:04:15 13:50:00"})]
    got = findings(spark, rows)
    assert got[("gps-from-siblings", "/f/near.jpg", "GPSLatitude")][0] == "high"
    assert got[("gps-from-siblings", "/f/late.jpg", "GPSLatitude")] == ("medium", "48.040000")


def test_trip_library(spark):
    day = 86_400
    rows = [(n, n * 600, 50.0 + n / 1000, 8.0, "p") for n in range(5)]
    rows += [(10 + n, 30 * day + n * 600, 10.0 + n / 100, 8.0, "p") for n in range(4)]
    rows += [(20, None, 1.0, 1.0, "p"), (21, 60 * day, None, None, "p"), (30, 90 * day, 0.5, 0.5, "p")]
    assets = spark.createDataFrame(rows, "id int, t bigint, lat double, lon double, owner string")
    albums = spark.createDataFrame([("trip", n) for n in range(5)] + [("void", 20), ("trip", 99), ("trip", 0)], "name string, id int")
    found = {r["source"]: r for r in library.trip_library(albums, assets, ["owner"]).collect()}
    assert set(found) == {"album", "cluster"} and found["album"]["name"] == "trip" and found["album"]["assets"] == 5
    event = found["cluster"]
    assert (event["name"], event["start"], event["end"], event["assets"]) == ("10", 30 * day, 30 * day + 1800, 4)
    assert abs(event["lat"] - 10.015) < 1e-9 and abs(event["radius_km"] - 1.668) < 0.01


def test_centroid_radius_counts_repeated_places(spark):
    rows = [("a", 0.0, 0.0)] * 3 + [("a", 0.0, 4.0), ("a", None, 1.0), ("b", 1.0, 1.0)]
    found = {r["k"]: r for r in library.centroid_radius(spark.createDataFrame(rows, "k string, lat double, lon double"), ["k"]).collect()}
    assert (found["a"]["lon"], found["a"]["n"], found["b"]["radius_km"]) == (1.0, 4, 0.0) and abs(found["a"]["radius_km"] - 333.6) < 0.1


def test_merge_into_clusters(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "node bigint, component bigint")
    old = spark.createDataFrame([(70, 1), (50, 2), (60, 7), (60, 6), (50, 2)], "cluster_id bigint, asset_id bigint")
    after, gone = library.merge_into_clusters(groups, old, 1000)
    assert rows_of(after) == {(50, 1), (50, 2), (50, 3), (1008, 8), (1008, 9), (60, 6), (60, 7)} and rows_of(gone) == {(70,)}


def test_notes_and_paths(spark):
    note = "---\ntrip: x\n---\n\n# Title\n\n_made by the scan_\n\nFirst line\nsecond\n\n\n_kept words_\n"
    assert one(spark, text.notes_body(F.lit(note), "scan"), text.notes_body(F.lit(""), "scan"), text.notes_body(F.lit("plain"), "scan")) == (
        "First line\nsecond\n\n_kept words_", "", "plain",
    )
    assert one(spark, text.rewrite_paths(F.lit('{"a":"/t/old/x","b":"/older/old"}\n/old'), {"old": "n$w"}))[0] == '{"a":"/t/n$w/x","b":"/older/n$w"}\n/n$w'
    files = spark.createDataFrame([("/a/1.MP4",), ("/a/2.MP4",), ("/a/3.MP4",)], "path string")
    side = spark.createDataFrame([("/a/1.srt",), ("/a/1.SRT",), ("/a/2.srt",), ("/a/3.Srt",)], "path string")
    assert rows_of(sibling_telemetry(files, side)) == {("/a/1.MP4", "/a/1.SRT"), ("/a/2.MP4", "/a/2.srt")}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024:04:15 12:00:00", (1_713_182_400, "local")),
        ("2024:04:15 12:00:00+02:00", (1_713_175_200, "utc")),
        ("2024:04:15 12:00:00 -03:30", (1_713_195_000, "utc")),
        ("1904:01:01 00:00:00", None),
        ("0000:00:00 00:00:00", None),
        ("2024-04-15 12:00:00", None),
        (None, None),
    ],
)
def test_tag_time(spark, raw, want):
    got = one(spark, dates.tag_time(F.lit(raw).cast("string")))[0]
    assert (tuple(got) if got else None) == want


def test_capture_and_names(spark):
    none = F.lit(None).cast("bigint")
    tag = dates.tag_time(F.lit("2024:04:15 12:00:00"))
    assert tuple(one(spark, dates.capture_time(none, tag, F.lit(5), none))[0]) == (1_713_182_400, "embedded", "local")
    assert tuple(one(spark, dates.capture_time(F.lit(7), tag, none, none))[0])[1:] == ("telemetry", "utc")
    assert one(spark, dates.date_key(F.lit("/x/VID_20240415_1.mp4")), dates.date_key(F.lit("/x/a.mp4")), dates.date_key(F.lit("20240415-x.mp4"), True)) == ("20240415", None, "202404")
    text_of = lambda v: F.lit(v).cast("string")
    names = [(None, "l2d-20C", None), ("Own", "FC3582", None), (None, None, "DJIMavic3Cine"), (None, "", "Lavf60"), (None, "FCX", None)]
    got = [tuple(one(spark, catalog.device(*map(text_of, n)))[0]) for n in names]
    assert got == [("DJI", "Mavic 3"), ("Own", "Mini 3 Pro"), ("DJI", "Mavic 3 Cine"), (None, None), ("DJI", "FCX")]
    assert one(spark, catalog.clamp_language(text_of("cy"), ("en", "de")), catalog.clamp_language(text_of(None), ("en",)), catalog.clamp_language(text_of("cy"), ())) == ("en", None, "cy")


def test_video_functions(spark):
    yes = video.needs_transcode(F.lit("h264"), F.lit(None).cast("string"), F.lit("MP4"), F.lit(720))
    no = video.needs_transcode(F.lit("h264"), F.lit("aac"), F.lit("mp4"), F.lit(None).cast("int"))
    assert one(spark, yes, no, video.format_bitrate(F.lit(1_500_000)), video.format_bitrate(F.lit(1500))) == (False, True, "1.5 Mbps", "2 kbps")
    assert one(spark, video.psnr_verdict(F.lit(30.0)), video.psnr_verdict(F.lit(24.9)), video.psnr_verdict(F.lit(None).cast("double"))) == ("ok", "fail", "unknown")
    box = one(spark, video.corner_box(F.lit(0.5), F.lit(0.25), F.lit(0.5)))[0]
    assert tuple(box) == (0.25, 0.5, 0.75, 1.0) and one(spark, video.corner_box(F.lit(0.5), F.lit(0.5), F.lit(0.0)))[0] is None


def test_registered_functions_and_measures(spark):
    registration.register(spark)
    spark.createDataFrame([(1, "1\n00:00:01,500 --> 00:00:02,000\nhi\nyou\n\n2\n\n3\n00:00:03,000 --> 00:00:04,000\nx"), (2, None)], "id int, body string").createOrReplaceTempView("lf_texts")
    found = spark.sql("SELECT id, cue, start_s, end_s, c.body AS said FROM lf_texts, LATERAL lf_cues(lf_texts.body) c")
    assert rows_of(found) == {(1, 1, 1.5, 2.0, "hi\nyou"), (1, 2, 3.0, 4.0, "x")}
    assert spark.sql("SELECT lf_file_name('/a/b.c'), lf_bits_apart(7, 0), round(lf_km(0, 0, 0, 1), 2)").first()[:] == ("b.c", 3, 111.19)
    rows, seen = observed(spark.range(10), "progress", rows=F.count(F.lit(1)), largest=F.max("id"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "largest": 9}
