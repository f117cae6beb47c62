from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.sources import files, sinks
from siftwork.streaming import incremental as I


def test_tree(spark, tmp_path, rows):
    for name, text in {"src/a.ts": b"const a = 1;\n", "src/b.py": b"x", "node_modules/c.ts": b"x", "src/d.min.js": b"x", "e.css": b"\xff{}"}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    got = files.read_tree(spark, f"{tmp_path}/repo")
    assert rows(got, "path", "size", "language") == [("./e.css", 3, None), ("./src/a.ts", 13, "typescript")]


def test_batches_exports_backups(spark, tmp_path, rows):
    v = spark.createDataFrame([(f"v{i}", [1.0, float(i)], "f", None, 1, 2, "Function", "rust", 1.0, ["a"], "h", datetime(2024, 1, 1), datetime(2024, 1, 2)) for i in range(25)], files.VECTOR_SCHEMA)
    base = f"file://{tmp_path}"
    sinks.write_batches(v.coalesce(1), f"{base}/b", 10)
    assert len(list((tmp_path / "b").glob("part-*.json"))) == 3
    for n, p in enumerate(sorted((tmp_path / "b").glob("part-*.json"))):
        p.rename(tmp_path / "b" / f"batch_{n:06d}.json")
    assert rows(files.read_batches(spark, f"{base}/b")) == rows(v)
    for fmt in ("csv", "json", "parquet"):
        sinks.export(v, f"{base}/{fmt}", fmt)
    assert spark.read.option("header", True).csv(f"{base}/csv").columns == list(sinks.CSV_COLUMNS)
    assert files.read_table(spark, f"{base}/parquet", files.VECTOR_SCHEMA).count() == 25
    assert files.read_table(spark, f"{base}/nothing", files.VECTOR_SCHEMA).count() == 0
    b = sinks.Backups(spark, base)
    assert b.list() == []
    b.create(v, "old", at=0)
    b.create(v.limit(3), "new", at=1e6)
    assert [i["name"] for i in b.list()] == ["new", "old"] and b.restore("new").count() == 3
    assert b.cleanup(5, now=1e6) == ["old"] and [i["name"] for i in b.list()] == ["new"]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    assert '"name": "a"' in sinks.report_json(df)
    assert sinks.report_text("T", df) == "T\n=\nname: a, n: 1\nname: b, n: None\n"
    assert sinks.report_text("T", df, markdown=True).splitlines()[2:] == ["| name | n |", "|---|---|", "| a | 1 |", "| b |  |"]
    times = spark.createDataFrame([(datetime(2024, 1, 1),)], T.StructType([T.StructField("last_modified", T.TimestampType())]))
    assert sinks.is_fresh(times, datetime(2024, 1, 2)).first()["fresh"] and not sinks.is_fresh(times, datetime(2023, 1, 2)).first()["fresh"]


def test_snapshots(spark, rows):
    s = "path string, hash string, content string"
    a = spark.createDataFrame([("a", "1", "x\ny\ny"), ("b", "1", "q"), ("c", "1", None)], s)
    b = spark.createDataFrame([("a", "2", "x\ny\nz"), ("c", "1", None), ("d", "1", "n\nm")], s)
    assert rows(files.snapshot_changes(a, b)) == [("a", "modified"), ("b", "deleted"), ("d", "added")]
    assert rows(files.line_changes(a, b)) == [("a", 1, 1), ("b", 0, 1), ("d", 2, 0)]


def test_streams(spark, tmp_path, rows):
    events = spark.createDataFrame([(i, f"2024-01-01 {h:02d}:10:00", "a", 1.0, i % 2) for i, h in enumerate([0, 0, 1, 1, 5, 9])], "event_id long, t string, event_type string, value double, user_id int").withColumn("ts", F.to_timestamp("t"))
    assert [(r["n"], r["total"]) for r in I.event_windows(events).orderBy("start").collect()] == [(2, 2.0), (2, 2.0), (1, 1.0), (1, 1.0)]
    assert sorted(r["n"] for r in I.user_sessions(events).collect()) == [1] * 6
    for k in range(3):
        events.where(F.col("event_id").between(2 * k, 2 * k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = I.event_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 5, "the last window is still open"
    log = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.col("event_id").cast("string").alias("state"))
    base = f"file://{tmp_path}/run"
    for _ in range(2):
        I.keep_index(spark, log, base, "key", "offset", "state").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/sink"), "key", "offset") == [("0", 0), ("0", 2), ("0", 4), ("1", 1), ("1", 3), ("1", 5)]
