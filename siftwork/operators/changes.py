"""Processing only new or changed records: change capture over a log, with per-partition offsets and a write-ahead batch plan.

The records form a log of keyed events. A key's events lie in one partition, chosen by its hash. An event has a
position, at which it came into its partition, and an offset, which rises with each state of its key. A run goes
through three steps:

1. ``plan``: of each partition the log is read from the position on that the last committed batch reached; the latest
   state of every key found there is compared with what the sink holds of it. The states that differ are written as a
   numbered batch plan, and with it the position that each partition has then been read to. Nothing is processed before
   both are complete.
2. ``apply``: the batch's records are processed from the written plan and appended to the sink, which drops every
   (key, offset) that it holds already.
3. ``commit``: the batch is marked as done, and its positions hold from then on.

A run that finds a plan without its mark replays that plan instead of making one: rows that a failed run had already
written are recognised by key and offset, rows it had not are written now. So no record is skipped and none is
repeated. Events at the very position reached are read again, as others may have come at the same one; the sink knows
them. Events without a position are read by every plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions.paths import normal_path
from siftwork.runtime import exists, keep

#: Partitions of the log. It is fixed for a log's life, since the offsets of a partition go with it.
LOG_PARTITIONS = 64


def partition_of(key: Column, partitions: int = LOG_PARTITIONS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def change_log(df: DataFrame, key: Column, offset: Column, state: Column, tie: Column | None = None, partitions: int = LOG_PARTITIONS, position: Column | None = None) -> DataFrame:
    """Events ``part, key, offset, state, tie, position`` of the rows that have a key, an offset and a state.

    Rows without one of them (a failed read) can't tell a state and are left out of the log. ``position`` must not
    fall within a partition as events are added; without it every plan reads the whole log.
    """
    tie = F.lit(None).cast("string") if tie is None else tie
    position = F.lit(None) if position is None else position
    events = df.select(key.alias("key"), offset.cast("long").alias("offset"), state.cast("string").alias("state"), tie.alias("tie"), position.cast("long").alias("position"))
    return events.where("key IS NOT NULL AND offset IS NOT NULL AND state IS NOT NULL").select(partition_of(F.col("key"), partitions).alias("part"), "*")


def latest(log: DataFrame) -> DataFrame:
    """``part, key, offset, state``: of every key the event of greatest offset; among equals the greatest (tie, state). And the greatest ``position`` of all its events.

    Late and repeated events change nothing. The aggregate combines before the shuffle, so a key with
    any number of events costs each task one row.
    """
    top = F.max(F.struct("offset", "tie", "state")).alias("top")
    return log.groupBy("part", "key").agg(top, F.max("position").alias("position")).select("part", "key", "top.offset", "top.state", "position")


def differing(news: DataFrame, done: DataFrame) -> DataFrame:
    """Of the latest events those that ``done`` (``key``, ``state``, and ``offset`` if known; one row for each key) doesn't hold in the same state.

    With an offset, events that came late, after a later state of their key was done, are not among them.
    """
    offset = F.col("offset") if "offset" in done.columns else F.lit(None).cast("long")
    held = done.select("key", F.col("state").alias("held"), offset.alias("held_at"), F.lit(True).alias("known"))
    new = F.col("known").isNull() | (~F.col("state").eqNullSafe(F.col("held")) & F.coalesce(F.col("offset") > F.col("held_at"), F.lit(True)))
    return news.join(held, "key", "left").where(new).select("part", "key", "offset", "state")


def pending(log: DataFrame, done: DataFrame) -> DataFrame:
    """``differing`` of the whole log."""
    return differing(latest(log), done)


#: Batches after which a commit writes the states of all keys anew, so that a plan reads one row for each key and the batches since.
SNAPSHOT_EVERY = 16
_STATES = "key string, state string, offset long"


@dataclass
class ChangeRun:
    """One consumer of a change log, with its plans, positions and sink below ``folder``."""

    spark: SparkSession
    folder: str
    snapshot_every: int = SNAPSHOT_EVERY

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch:08d}"

    def _plan_path(self, batch: int) -> str:
        return self._path("plans", batch)

    def _marked(self, batch: int, mark: str) -> bool:
        return exists(self.spark, f"{self.folder}/{mark}/{batch:08d}/_SUCCESS")

    def _last(self, kind: str) -> int:
        """The greatest number of what is complete of a kind, or -1."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        whole = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and exists(self.spark, f"{self.folder}/{kind}/{n}/_SUCCESS")]
        return max(whole, default=-1)

    def last_batch(self) -> int:
        """The greatest number of a complete plan, or -1."""
        return self._last("plans")

    def unfinished(self) -> int | None:
        """The batch that is planned and not committed, if any."""
        last = self.last_batch()
        return last if last >= 0 and not self._marked(last, "commits") else None

    def sink(self) -> DataFrame | None:
        """What has been processed: ``part, key, offset, state`` and the batch; None before the first run."""
        path = f"{self.folder}/sink"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def adopt(self, states: DataFrame) -> None:
        """Begin with what was processed before there was this run: ``key``, ``state``, and ``offset`` if known."""
        offset = F.col("offset") if "offset" in states.columns else F.lit(None)
        states.select("key", "state", offset.cast("long").alias("offset")).write.mode("overwrite").parquet(self._path("states", 0))

    def done(self) -> DataFrame:
        """The state of each key that the sink holds at its greatest offset, and that offset: of the newest snapshot and the batches since."""
        held, snapshot = self.sink(), self._last("states")
        # snapshot n holds all batches below n
        parts = [self.spark.read.schema(_STATES).parquet(self._path("states", snapshot))] if snapshot >= 0 else []
        if held is not None:
            parts.append(held.where(F.col("batch") >= max(snapshot, 0)).select("key", "state", "offset"))
        if not parts:
            return self.spark.createDataFrame([], _STATES)
        if len(parts) == 1 and held is None:
            return parts[0]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # what was adopted without an offset comes before all that the log tells
        top = F.max(F.struct(F.coalesce("offset", F.lit(-(1 << 62))).alias("at"), "state", "offset")).alias("top")
        return rows.groupBy("key").agg(top).select("key", "top.state", "top.offset")

    def snapshot(self) -> None:
        """Write the states of all keys after the last batch, for later plans to start from."""
        self.done().write.mode("overwrite").parquet(self._path("states", self.last_batch() + 1))

    def plan(self, log: DataFrame, done: DataFrame | None = None) -> tuple[int, DataFrame]:
        """The number and rows of the batch to process: the unfinished one, or a new one written ahead."""
        open_batch = self.unfinished()
        if open_batch is not None:
            return open_batch, self.read_plan(open_batch)
        batch = self.last_batch() + 1
        reached = self.offsets()
        beyond = log if batch == 0 else log.join(reached, "part", "left").where("until IS NULL OR position IS NULL OR position >= until").drop("until")
        # one pass over the log serves the plan and the positions
        news = keep(latest(beyond), "news")
        now = news.groupBy("part").agg(F.max("position").alias("until")).where("until IS NOT NULL")
        now.unionByName(reached).groupBy("part").agg(F.max("until").alias("until")).coalesce(1).write.mode("overwrite").parquet(self._path("offsets", batch))
        differing(news, self.done() if done is None else done).write.mode("overwrite").parquet(self._plan_path(batch))
        return batch, self.read_plan(batch)

    def read_plan(self, batch: int) -> DataFrame:
        return self.spark.read.schema("part int, key string, offset long, state string").parquet(self._plan_path(batch))

    def offsets(self) -> DataFrame:
        """``part``, ``until``: the position that the committed batches read each partition to; no row where they read none."""
        last = self.last_batch()
        if last >= 0 and not self._marked(last, "commits"):
            last -= 1
        if last < 0:
            return self.spark.createDataFrame([], "part int, until long")
        return self.spark.read.schema("part int, until long").parquet(self._path("offsets", last))

    def apply(self, batch: int, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Process the plan's rows with ``work`` (it keeps the four columns) and append what the sink lacks."""
        rows = self.read_plan(batch)
        rows = work(rows) if work else rows
        if self.sink() is not None:
            held = self.sink().where(F.col("batch") >= max(self._last("states"), 0))
            rows = rows.join(held.select("key", "offset").distinct(), ["key", "offset"], "left_anti")
        rows.dropDuplicates(["key", "offset"]).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/sink")

    def commit(self, batch: int) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch:08d}")
        if (batch + 1) % self.snapshot_every == 0:
            self.snapshot()

    def run(self, log: DataFrame, work: Callable[[DataFrame], DataFrame] | None = None) -> int:
        batch, _ = self.plan(log)
        self.apply(batch, work)
        self.commit(batch)
        return batch


def file_log(metadata: DataFrame) -> DataFrame:
    """The change log of scanned files: key is the normal path, the offset its revision, the state its hash in lower case, the position the microsecond at which it was received."""
    return change_log(metadata, normal_path("path"), F.col("revision"), F.lower("hash"), F.col("received_at"), position=F.unix_micros(F.col("received_at").cast("timestamp")))


def recorded_states(cache: DataFrame, runs: DataFrame) -> DataFrame:
    """``key``, ``state`` as the last succeeded run that handled a file left it.

    Rows without a run, of a run that isn't known or did not succeed, don't count. Rows without a
    time come before all others. A row without a hash records that the file's state is unknown.
    """
    good = runs.where(F.col("status") == "succeeded").select("run_id").distinct()
    rows = cache.select(normal_path("path").alias("key"), "last_analyzed", F.lower("file_hash").alias("state"), "run_id").where("key IS NOT NULL")
    top = F.max(F.struct("last_analyzed", "state")).alias("top")
    return rows.join(good, "run_id", "left_semi").groupBy("key").agg(top).select("key", "top.state")


def drop_repeated(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; a null key is a key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
