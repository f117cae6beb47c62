"""Queries that run a stream over all data at hand, and their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions.paths import normal_path
from siftwork.runtime import new_folder, table
from siftwork.streaming import incremental as I


def _stream(spark, folder, name):
    """The table as a stream of its files, four for each micro-batch. A file source reads folders: the table is written in several files of the shared folder."""
    schema, path = table(spark, folder, name).schema, new_folder(spark, "stream")
    table(spark, folder, name).repartition(8).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def _times(spark, path: str, known: set[str], at: int) -> int:
    """Give the files of a folder that aren't known yet rising times of change, in the order of their names: a file source reads them in that order."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in sorted((s.getPath() for s in fs.listStatus(jpath) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        if f.getName() not in known:
            known.add(f.getName())
            fs.setTimes(f, at, -1)
            at += 1000
    return at


def _event_stream(spark, folder):
    """The events as a stream of files in the order of their time, and at last one event without a type or user, a month later, which closes all windows."""
    path, known = new_folder(spark, "stream"), set()
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    events.repartitionByRange("ts").write.parquet(path)
    at = _times(spark, path, known, 1_700_000_000_000)
    end = (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")
    spark.read.parquet(path).agg(end).select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(path)
    _times(spark, path, known, at)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(spark, df, mode="append"):
    """Run a stream over what there is into a table of the shared folder."""
    base = new_folder(spark, "out")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def stream_index(spark, folder):
    """File metadata as a stream into a change run: each state of each file that was new when it came, once."""
    files = _stream(spark, folder, "file_metadata").select(normal_path("path").alias("path"), "revision", F.lower("hash").alias("hash"))
    base = new_folder(spark, "index")
    I.keep_index(spark, files, base, "path", "revision", "hash").awaitTermination()
    sink = spark.read.parquet(f"{base}/sink")
    return sink.groupBy("key").agg(F.max_by("state", "offset").alias("hash")).select(F.col("key").alias("path"), "hash")


def stream_windows(spark, folder):
    """Hourly counts and sums of events by type, each written when its window closes."""
    w = _drain(spark, I.event_windows(_event_stream(spark, folder))).where("event_type IS NOT NULL")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_once(spark, folder):
    """All events, each id once, as a stream that sees every file twice; an id is forgotten two hours after it was seen."""
    s = _event_stream(spark, folder).where("event_id IS NOT NULL")
    return _drain(spark, I.once(s.unionByName(s))).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_sessions(spark, folder):
    """Sessions of each user without a gap over half an hour, each written when it can't grow any more."""
    s = _drain(spark, I.user_sessions(_event_stream(spark, folder))).where("user_id IS NOT NULL")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_response_hits(spark, folder):
    """Hits and misses of a stateful response cache after all events."""
    s = _stream(spark, folder, "events").select(F.sha2(F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")), 256).alias("prompt_hash"))
    base = new_folder(spark, "hits")

    def batch(df, n):
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/data")

    I.response_hits(s).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/data").groupBy("prompt_hash").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"))


QUERIES = {f.__name__: f for f in (stream_index, stream_windows, stream_once, stream_sessions, stream_response_hits)}
_N = "'.' || list_aggregate(list_transform(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), lambda s: '/' || s), 'string_agg', '')"
ORACLES = {
    "stream_index": f"SELECT {_N} AS path, arg_max(lower(hash), revision) AS hash FROM file_metadata WHERE path IS NOT NULL AND hash IS NOT NULL AND revision IS NOT NULL GROUP BY 1",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_once": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, s.n",
    "stream_response_hits": "SELECT sha256(event_type || ':' || json_extract_string(props, '$.k')) AS prompt_hash, count(*) - 1 AS hits, 1::BIGINT AS misses FROM events GROUP BY 1",
}
