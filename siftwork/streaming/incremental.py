"""Structured Streaming forms of incremental work: an index kept up from a stream of files, windows over events, a stateful response cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwork.operators.changes import ChangeRun, change_log


def keep_index(spark: SparkSession, stream: DataFrame, folder: str, key: str, offset: str, state: str):
    """Process the new states of a stream of records once each, into the sink of a change run below ``folder``.

    Every micro-batch becomes a batch plan of the run: a restarted stream that gets a batch again finds its rows in the
    sink by key and offset. Gives a query that ends with the data at hand.
    """
    run = ChangeRun(spark, folder)

    def batch(df: DataFrame, _: int) -> None:
        # a plan left by a failed run goes first
        left = run.unfinished()
        if left is not None:
            run.apply(left)
            run.commit(left)
        run.run(change_log(df, F.col(key).cast("string"), F.col(offset), F.col(state).cast("string")))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of events for each type and window; events later than ``late`` are dropped with their closed window. Batch and stream alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, id_col: str = "event_id", within: str = "2 hours") -> DataFrame:
    """Each id once, if its repeats come within the time given."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([id_col])


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events without a gap longer than ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def response_hits(requests: DataFrame) -> DataFrame:
    """For each prompt hash and micro-batch: hits and misses so far; the first request of a hash is a miss."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, misses = state.get if state.exists else (0, 0)
        for frame in frames:
            new = 0 if misses else 1
            hits, misses = hits + len(frame) - min(new, len(frame)), misses + min(new, len(frame))
        state.update((hits, misses))
        yield pd.DataFrame({"prompt_hash": [key[0]], "hits": [hits], "misses": [misses]})

    return requests.groupBy("prompt_hash").applyInPandasWithState(count, "prompt_hash string, hits long, misses long", "hits long, misses long", "update", GroupStateTimeout.NoTimeout)
