"""Greedy leader clustering as a fixpoint over the pairs that are similar.

In input order, an item that no cluster has taken becomes a leader and takes every later free item
that is similar to it. The same, without an order of execution: an item is a leader if all smaller
neighbours are known not to be leaders, and a member of its smallest leader otherwise. Each round
settles all items whose smaller neighbours are settled; the rounds are as many as the longest
falling chain of undecided neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.runtime import discard, keep


def leader_clusters(items: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """``id, leader``: the leader of each item of ``items`` (``id``); a leader is its own. ``pairs`` has ``a < b``.

    Each round is written to the shared folder, so a lost executor costs one round at most. Raises if the
    rounds don't suffice.
    """
    edges = keep(pairs.select("a", "b").distinct(), "edges")
    state = keep(items.select("id").distinct().withColumn("state", F.lit(0)), "leaders")  # 0 undecided, 1 leader, 2 taken
    for _ in range(rounds):
        smaller = edges.join(state.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.max(F.when(F.col("state") == 1, 1).otherwise(0)).alias("near_leader"), F.max(F.when(F.col("state") == 0, 1).otherwise(0)).alias("near_open"))
        decided = F.when(F.col("state") != 0, F.col("state")).when(F.col("near_leader") == 1, 2).when(F.coalesce("near_open", F.lit(0)) == 0, 1).otherwise(0)
        before, state = state, keep(state.join(smaller, state["id"] == smaller["b"], "left").select("id", decided.alias("state")), "leaders")
        discard(before)
        if state.where("state = 0").isEmpty():
            break
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    leaders = state.where("state = 1").select(F.col("id").alias("a"))
    taken = edges.join(leaders, "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    return state.join(taken, state["id"] == taken["b"], "left").select("id", F.when(F.col("state") == 1, F.col("id")).otherwise(F.col("leader")).alias("leader"))
