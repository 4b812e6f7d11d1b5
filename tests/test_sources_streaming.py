import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.operators.sessionize import event_sweep
from lumenfold.sources import files, tables
from lumenfold.streaming import jobs

SRT = """1
00:00:00,000 --> 00:00:00,033
<font size="28">FrameCnt: 1
2024-04-15 10:00:00.123
[iso : 100] [shutter : 1/500.0] [fnum : 2.8] [latitude: 0.000000] [longitude: 0.000000] [rel_alt: 1.200 abs_alt: 55.5]</font>

2
00:00:01,500 --> 00:00:01,533
[latitude: 48.5] [longitude: -2.25] [abs_alt: 60]


"""


def test_telemetry(spark):
    frames = files.telemetry_frames(spark.createDataFrame([("a", SRT), ("b", ""), ("c", None)], "path string, body string"))
    rows = {r["frame"]: r for r in frames.where("path = 'a'").collect()}
    assert len(rows) == 2 and rows[1]["lat"] is None and rows[1]["iso"] == 100 and rows[1]["shutter"] == "1/500.0"
    assert rows[2]["offset_s"] == 1.5 and rows[1]["abs_alt"] == 55.5
    fix = {r["path"]: r for r in files.first_fix(frames).collect()}["a"]
    assert (fix["lat"], fix["lon"], fix["altitude"], fix["at"].hour) == (48.5, -2.25, 60.0, 10)


def test_gpx_and_notes(spark):
    gpx = '<gpx xmlns:x="y"><x:trkpt lat="1.5" lon="2.5"><x:time>2024-04-15T10:00:00Z</x:time></x:trkpt><trkpt lat="1" lon="2"></trkpt></gpx>'
    points = files.track_points(spark.createDataFrame([("a", gpx)], "path string, body string")).collect()
    assert len(points) == 1 and points[0]["lat"] == 1.5 and points[0]["at"].hour == 10
    note = "---\ntrip: 'Old Pier'\nlocation:\n  name: X\ntags: [A, B/C]\n---\n\n# Title\nnot: a field"
    fields = rows_of(files.front_matter(spark.createDataFrame([("a", note), ("b", "# none")], "path string, body string")))
    assert fields == {("a", "trip", "Old Pier"), ("a", "location.name", "X"), ("a", "tags", "[A, B/C]")}
    notes = spark.createDataFrame([("/t/README.md",), ("/t/TRIP.md",), ("/u/README.md",), ("/u/x.md",)], "path string")
    assert rows_of(files.preferred_notes(notes)) == {("/t", "/t/TRIP.md"), ("/u", "/u/README.md")}


def test_listing_and_sidecars(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "sub/c.mov", ".audit/d.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"xx")
    found = {r["path"].rsplit("/", 1)[1] for r in files.list_media(spark, str(tmp_path)).collect()}
    assert found == {"a.JPG", "c.mov"}
    media = spark.createDataFrame([("/p/a.jpg", {"XMP:A": "1"}), ("/p/b.jpg", {})], "path string, tags map<string,string>")
    side = spark.createDataFrame([("/p/a.xmp", {"XMP:A": "2", "XMP:B": "3", "EXIF:C": "4"})], "path string, tags map<string,string>")
    merged = {r["path"]: r["tags"] for r in files.merge_sidecars(media, side).collect()}
    assert merged == {"/p/a.jpg": {"XMP:A": "1", "XMP:B": "3"}, "/p/b.jpg": {}}
    shots = spark.createDataFrame([("/p/a.jpg",), ("/p/averyveryverylongname_1.jpg",), ("/p/z.jpg",)], "path string")
    jsons = spark.createDataFrame([("/p/a.jpg.supplemental-metadata.json",), ("/p/a.jpg.json",), ("/p/averyveryverylongname.json",)], "path string")
    assert rows_of(files.companion_json(shots, jsons)) == {("/p/a.jpg", "/p/a.jpg.json"), ("/p/averyveryverylongname_1.jpg", "/p/averyveryverylongname.json")}


def test_snapshot_version(spark, tmp_path):
    tables.write_snapshot({"assets": spark.range(3)}, str(tmp_path), version=2)
    assert tables.read_snapshot(spark, str(tmp_path), "assets").count() == 3
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, str(tmp_path), "assets", least_version=3)
    assert tables.migrate(spark.range(1), {"id": "bigint", "x": "string"}).columns == ["id", "x"]


def test_registration_stream_runs_again_without_effect(spark, tmp_path):
    source, ledger = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    schema = "path string, bytes bigint, mtime double"
    (source / "1.json").write_text("\n".join(json.dumps({"path": p, "bytes": 1, "mtime": m}) for p, m in (("a", 1.0), ("a", 1.0), ("b", 99.0))))
    for name, rows in (("0", []), ("2", [("a", 1.0), ("c", 2.0)])):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "bytes": 1, "mtime": m}) for p, m in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        jobs.register_stream(spark, stream, ledger, str(tmp_path / "cp"), 10, 100).awaitTermination()
    assert rows_of(spark.read.parquet(ledger), "path") == {("a",), ("c",)}
    assert spark.read.parquet(ledger).count() == 2


def test_state_and_replay(spark):
    assets = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    state = spark.createDataFrame([("a", "w", "1"), ("b", "w", "0"), ("c", "w", None)], "key string, worker string, version string")
    assert rows_of(jobs.work_due(assets, state, "w", "1")) == {("b",), ("c",)}
    with pytest.raises(ValueError):
        jobs.prune_state(state, assets.where("false"))
    entries = spark.createDataFrame([("a", "x", None), ("b", None, None)], "key string, content string, synced_hash string")
    after, target = jobs.replay(entries, spark.createDataFrame([("a", "old"), ("z", "kept")], "key string, content string"))
    assert rows_of(target) == {("a", "x"), ("b", None), ("z", "kept")}
    assert rows_of(jobs.replay(after, target)[1]) == rows_of(target)


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    start = 1_700_000_000
    rows = [("k", n, start + n * 600 + (50_000 if n > 20 else 0), 10.0 + 0.001 * n, 5.0) for n in range(40)] + [("k", 99, start + 900_000, 0.0, 0.0)]
    batch = event_sweep(spark.createDataFrame(rows, "k string, id int, t bigint, lat double, lon double"), ["k"])
    want = {s for (s,) in rows_of(batch.groupBy("event").agg(F.count("id").alias("n")), "n")}
    source = tmp_path / "in"
    source.mkdir()
    frame = spark.createDataFrame(rows, "k string, id int, t bigint, lat double, lon double").select("k", F.timestamp_seconds("t").alias("t"), "lat", "lon")
    frame.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    found = jobs.stream_sessions(stream, "k", 14_400)
    query = found.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {s for (s,) in rows_of(spark.table("sessions"), "size")} == want


def test_late_points_do_not_move_an_event_back(spark, tmp_path):
    start = 1_700_000_000
    source = tmp_path / "in"
    source.mkdir()
    schema = "k string, t timestamp, lat double, lon double"
    batches = [[(0, 10.0), (6000, 10.0)], [(3000, 10.0), (12_000, 10.0)], [(900_000, 10.0)]]
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([("k", start + t, lat, 5.0) for t, lat in batch], "k string, t bigint, lat double, lon double")
        rows.select("k", F.timestamp_seconds("t").alias("t"), "lat", "lon").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = jobs.stream_sessions(stream, "k", 14_400).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        query.option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).selectExpr("unix_seconds(end)", "size")) == {(start + 12_000, 4)}


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path, data_dir):
    events = spark.read.parquet(f"{data_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = tmp_path / "in"
    events.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    query = jobs.window_counts(stream, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows_of(spark.table("days"), "start", "event_type", "n") == rows_of(jobs.window_counts(events, "1 day"), "start", "event_type", "n")


def test_front_matter_with_nested_and_listed_fields(spark):
    note = "---\ntrip: 'A b'\nlocation:\n  name: X\n  coords: [1.5, -2]\ntags:\n  - One\n  - \"Two\"\nempty:\nlast: 1\n---\nbody: no\n"
    frame = spark.createDataFrame([("a", note), ("b", "no fences"), ("c", None), ("d", "---\nx: 1\n")], "path string, body string")
    assert rows_of(files.front_matter(frame)) == {
        ("a", "trip", "A b"), ("a", "location.name", "X"), ("a", "location.coords", "[1.5, -2]"), ("a", "tags", "[One, Two]"), ("a", "last", "1")
    }


def test_server_reads_ask_for_bounds(spark):
    for key, low, high in (("id", None, 5), ("id", 5, 5)):
        with pytest.raises(ValueError):
            tables.read_server(spark, "jdbc:x", "assets", key, low, high)
