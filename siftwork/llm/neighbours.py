"""The most similar vectors of every vector, over balanced posting lists (``siftwork.operators.lists``).

1. Centroids of equal share are fitted on a bounded sample and linked to a graph that each task has in memory.
2. A vector is replicated to the lists of the centroids that the graph's walk finds and whose distance is within a ratio of the
   nearest one's: one list in a cluster's core, several at its boundary. The same ratio prunes what it is looked for in.
3. Within a list (of a crowded one, within two of its blocks) all vectors are compared, and the best of all lists of a vector are kept.

Vectors that are equal number by number form one class, which goes to the lists once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators import ann, lists
from siftwork.operators.lists import LISTS, RATIO, SAMPLE, CentroidGraph, balanced_centroids, usable  # noqa: F401
from siftwork.runtime import keep

#: Vectors nearest to each centroid, as aimed at.
LIST_SIZE = lists.LIST_SIZE
#: The cosine that a search without ``min_cosine`` uses the lists for: what is less alike is too seldom in a common list.
NEAR = 0.85


def current_entries(df: DataFrame, dim: int, vectors: bool = True) -> DataFrame:
    """Of each id the row of greatest ``updated_at`` (a null comes first; of equals the greatest vector hash), if its embedding is usable: ``id, class_a, class_b`` and, with ``vectors``, ``embedding``.

    An id whose current embedding is unusable has no row, even if an older one was usable. Null ids name no entry.
    """
    ok = usable(F.col("embedding"), dim)
    e = F.when(ok, F.col("embedding"))
    rows = df.where("id IS NOT NULL").select("id", "updated_at", ok.alias("ok"), F.xxhash64(e).alias("class_a"), F.xxhash64(F.lit(1), e).alias("class_b"), *[e.alias("embedding")] * vectors)
    kept = ["ok", "class_a", "class_b", *["embedding"] * vectors]
    top = F.max_by(F.struct(*kept), F.struct("updated_at", "class_a", "class_b"))
    return rows.groupBy("id").agg(top.alias("top")).where("top.ok").select("id", *[f"top.{c}" for c in kept[1:]])


def class_neighbours(entries: DataFrame, index: lists.Index, dim: int, k: int, min_cosine: float) -> DataFrame:
    """``a_a, a_b, b_a, b_b, cosine``: for each class of equal vectors the ``k`` most similar other classes of at least ``min_cosine`` that share a list."""
    found = lists.nearest_in_lists(lists.post(entries, index, dim), dim, k, min_cosine)
    once = found.groupBy("a_a", "a_b", "b_a", "b_b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a_a", "a_b").orderBy(F.desc("cosine"), "b_a", "b_b"))
    return once.withColumn("__n", rank).where(F.col("__n") <= k).drop("__n")


def all_class_neighbours(entries: DataFrame, near: DataFrame, dim: int, k: int) -> DataFrame:
    """As ``class_neighbours`` without a least cosine: ``near`` for the classes that have ``k`` there, and for all others the ``k`` most similar of all classes, by comparing them with every one."""
    key = F.struct("class_a", "class_b")
    classes = keep(entries.groupBy("class_a", "class_b").agg(F.first("embedding").alias("v")).select(key.alias("id"), "v"), "classes")
    full = near.groupBy(F.struct(F.col("a_a").alias("class_a"), F.col("a_b").alias("class_b")).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
    # one more, as each finds itself
    found = ann.against_all(classes.join(full, "id", "left_anti"), classes, dim, ann.scan_top(k + 1)).where("a <> b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    found = found.withColumn("n", rank).where(F.col("n") <= k).select(F.col("a.class_a").alias("a_a"), F.col("a.class_b").alias("a_b"), F.col("b.class_a").alias("b_a"), F.col("b.class_b").alias("b_b"), F.col("score").alias("cosine"))
    kept = near.join(full.select("id.*").withColumnsRenamed({"class_a": "a_a", "class_b": "a_b"}), ["a_a", "a_b"], "left_semi")
    return kept.unionByName(found)


def neighbours(df: DataFrame, k: int = 5, min_cosine: float | None = 0.85, dim: int = 64, most_lists: int = LISTS, ratio: float = RATIO, sample: int = SAMPLE, list_size: int = LIST_SIZE) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``, ``rank``: for every current entry its ``k`` most similar entries of at least ``min_cosine``; with None its ``k`` most similar, however far.

    Ties are ranked by the neighbour's id. Equal vectors are each other's first neighbours; of a class of equal
    vectors only the ``k + 1`` least ids can be anyone's neighbour, so a class of any size adds ``k`` rows for each of its
    members. The search is approximate: a pair is missed if no list holds both (see the README for the recall measured).
    With None, entries for which the lists don't give ``k`` of NEAR and more are compared with all, exactly.
    Unusable vectors, null ids: see ``current_entries``. An empty table gives an empty result; other columns aren't read.
    """
    out = "id string, neighbour string, cosine double, rank int"
    least = NEAR if min_cosine is None else min_cosine
    index = lists.fit(df, dim, least, sample=sample, list_size=list_size, ratio=ratio, lists=most_lists)
    if index is None:
        return df.sparkSession.createDataFrame([], out)
    entries = current_entries(df, dim)
    if min_cosine is None:
        entries = keep(entries, "entries")
    classes = keep(class_neighbours(entries, index, dim, k, least), "neighbours")
    if min_cosine is None:
        classes = keep(all_class_neighbours(entries, classes, dim, k), "neighbours")
    members = current_entries(df, dim, vectors=False)
    place = F.row_number().over(Window.partitionBy("class_a", "class_b").orderBy("id"))
    targets = members.withColumn("__n", place).where(F.col("__n") <= k + 1).drop("__n").select(F.col("class_a").alias("b_a"), F.col("class_b").alias("b_b"), F.col("id").alias("neighbour"))
    same = members.join(targets, (F.col("class_a") == F.col("b_a")) & (F.col("class_b") == F.col("b_b"))).where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    reached = classes.join(targets, ["b_a", "b_b"]).select("a_a", "a_b", "neighbour", "cosine")
    other = members.join(reached, (F.col("class_a") == F.col("a_a")) & (F.col("class_b") == F.col("a_b"))).select("id", "neighbour", "cosine")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return same.unionByName(other).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", F.least("cosine", F.lit(1.0)).alias("cosine"), "rank")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``id_a, id_b`` of the entries of which at least one is the other's neighbour, each pair once, the lesser id first."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
