"""Filling containers of fixed capacity with texts, by bulk-synchronous best fit.

Sizes and gaps are whole numbers from 1 to the capacity. Sorted by size, equal documents form a
run, and so do equal gaps; the state that all tasks would have to agree on after each round is
therefore two run-length lists, of at most ``capacity`` sizes and of gaps whose number the
capacity bounds as well, however many documents there are. A round takes the largest size left,
sweeps to the successor gap (the least that holds it), gives the run's documents to the run's
containers by rank, puts the changed gaps back, and repeats; what finds no gap opens containers.
It equals best-fit decreasing over the single documents. Only the runs go through the driver. The
documents get their rank within their size, and with it their container, where they are.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.tokens import BYTE_BPE, encode_texts
from siftwork.runtime import keep


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, first container, documents for each container) by size and rank; number of containers."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    gaps: dict[int, deque[tuple[int, int]]] = {}
    order: list[int] = []
    rows: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = deque()
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap = capacity
                first, n = opened, -(-left // (gap // size))
                opened += n
            each = gap // size
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            rows.append((size, rank, first, each))
            put(gap - each * size, first, full)
            if rest:
                put(gap - rest * size, first + full, 1)
            put(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + taken, left - taken
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), opened


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """``id_col``, ``piece INT``, ``first INT``, ``size INT``, ``container LONG``: which part of an item lies where.

    An item above the capacity is cut into full pieces and one rest; no other item is divided. Items
    of size 0 or of null size keep their row, with a null container. Equal sizes are ranked by id,
    rows with equal or null ids in any order among themselves; each row counts as an item of its own.
    An empty table gives an empty table. Two shuffles of the narrow rows; a size that a third of the
    rows share is spread over all tasks.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    items = (
        sizes.select(F.col(id_col).alias("__id"), F.coalesce(F.col(size_col).cast("int"), F.lit(0)).alias("__n"))
        .select("__id", "__n", F.explode(piece).alias("piece"))
        .select("__id", "piece", (F.col("piece") * capacity).cast("int").alias("first"), F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity).cast("int").alias("size"), F.monotonically_increasing_id().alias("__row"))
    )
    items = keep(items, "pack")
    filled = items.where("size > 0").withColumn("__lot", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))
    runs = filled.groupBy("size", "__lot").agg(F.count("*").alias("__n"))
    counts = {r["size"]: r["n"] for r in runs.groupBy("size").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    table, _ = plan(counts, capacity)

    before = runs.select("size", "__lot", (F.sum("__n").over(Window.partitionBy("size").orderBy("__lot")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("size", "__lot").orderBy("__id", "piece", "__row")) - 1
    ranked = filled.withColumn("__within", within).join(before, ["size", "__lot"]).select("__id", "piece", "first", "size", (F.col("__before") + F.col("__within")).alias("__rank"))
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = np.asarray(b.column("size"), dtype=np.int64), np.asarray(b.column("__rank"), dtype=np.int64)
            row = table[np.searchsorted(keys, size * (1 << 44) + rank, side="right") - 1]
            container = row[:, 2] + (rank - row[:, 1]) // row[:, 3]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("piece"), b.column("first"), b.column("size"), pa.array(container)], names=[id_col, "piece", "first", "size", "container"])

    kind = sizes.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, first int, size int, container long")
    none = items.where("size = 0").select(F.col("__id").alias(id_col), "piece", "first", "size", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none)


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``pack`` over the token counts of the texts. Null and empty texts have no tokens, and thus no container."""
    return pack(encode_texts(df, id_col, text_col, vocabulary, counts_only=True), id_col, "n_tokens", capacity)
