"""Locality-sensitive hashing of vectors by signs of projections: signatures, bucket join, exact and approximate top-k.

The planes come from an integer formula, so that any engine gives the same signatures. The index is a
table (table_id, bucket, id), derived from the vectors; adding, replacing and deleting vectors are
operations on the vectors' table alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.vectors import METRICS
from siftwork.operators import lists
from siftwork.runtime import keep, spread

#: The factors of the planes' formula (see ``planes``).
PLANE_FACTORS = (7919, 104729, 1299709, 1103515245, 12345)
TABLES, BITS = 12, 5
#: Buckets of each table that an approximate search looks into: its own and those across the nearest planes.
PROBES = 12
#: Queries that go to every task as one matrix; more take several passes.
MATRIX_QUERIES = 4096
#: Vectors that go to every task as one matrix when all are compared with all; more take several passes.
SLICE = 65_536
#: Rows and columns of a block of similarities, and what float accuracy may be off.
BLOCK, WIDTH, OFF = 512, 4096, 1e-5


def planes(dim: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """``tables x bits x dim`` numbers in [-0.5, 0.5): the scrambled number of (table, bit, dimension) over 2^31."""
    a, b, c, m, s = PLANE_FACTORS
    t, i, d = np.meshgrid(np.arange(tables, dtype=np.int64), np.arange(bits, dtype=np.int64), np.arange(dim, dtype=np.int64), indexing="ij")
    x = ((t + 1) * a + (i + 1) * b + (d + 1) * c) % (1 << 31)
    for _ in range(2):
        x = (x * m + s) % (1 << 31)
    return x / float(1 << 31) - 0.5


def signatures(df: DataFrame, id_col: str, vector_col: str, dim: int, tables: int = TABLES, bits: int = BITS, probes: int = 1) -> DataFrame:
    """``id, table_id INT, bucket LONG``: bit i of a table's bucket tells on which side of its i-th plane the vector lies.

    With ``probes`` over 1 so many buckets of each table: its own, then those whose other bits have the least sum of
    squared distances to their planes.

    Vectors that are null, of another dimension or hold a null have no signature. One matrix product for each Arrow batch.
    """
    p = planes(dim, tables, bits).reshape(tables * bits, dim).T
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
    probes = min(probes, 1 << bits)
    flips = np.arange(1 << bits if probes > 1 else 1, dtype=np.int64)
    flipped = (flips[:, None] >> np.arange(bits) & 1).astype(np.float64).T
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("__v").flatten(), dtype=np.float64).reshape(-1, dim)
            off = (x @ p).reshape(len(x), tables, bits)
            bucket = ((off >= 0) * weights).sum(2)
            if probes > 1:
                least = np.argsort(off**2 @ flipped, axis=2, kind="stable")[:, :, :probes]
                bucket = bucket[:, :, None] ^ flips[least]
            at = pa.array(np.repeat(np.arange(len(x)), tables * probes))
            yield pa.RecordBatch.from_arrays([b.column("__id").take(at), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), len(x))), pa.array(bucket.ravel())], names=["id", "table_id", "bucket"])

    whole = df.where((F.size(vector_col) == dim) & F.forall(vector_col, lambda v: v.isNotNull()))
    return whole.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).mapInArrow(run, f"id {kind}, table_id int, bucket long")


def bucket_stats(index: DataFrame) -> DataFrame:
    """One row: ids, buckets, mean and upper median of the bucket sizes."""
    sizes = index.groupBy("table_id", "bucket").agg(F.count("*").alias("n"))
    # the sizes' own histogram is small: the median needs no sort of all buckets
    spread = sizes.groupBy("n").agg(F.count("*").alias("buckets"))
    total = spread.agg(F.sum("buckets").alias("all")).select("all")
    upto = F.sum("buckets").over(Window.orderBy("n"))
    median = spread.select("n", upto.alias("upto")).join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median_size"))
    return index.agg(F.countDistinct("id").alias("ids")).join(sizes.agg(F.count("*").alias("buckets"), F.avg("n").alias("mean_size"))).join(median)


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id``: the ids that share a bucket with a query in any table, each once."""
    q = queries.select(F.col("id").alias("query"), "table_id", "bucket")
    return index.join(q, ["table_id", "bucket"]).select("query", "id").distinct()


def _similarities(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The similarity of each row of ``q`` (m, dim) with each of ``x`` (n, dim), as the metric's column does it; a vector with numbers that aren't finite has none (-inf)."""
    with np.errstate(invalid="ignore", over="ignore"):
        score = _measured(metric, x, q)
    score[:, ~np.isfinite(x).all(1)] = -np.inf
    score[~np.isfinite(q).all(1)] = -np.inf
    return score


def _measured(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric in ("cosine", "dot"):
        # the last digits of a product depend on where in the matrix a vector stands; equal vectors must tie
        s = np.round(q @ x.T, 12)
        if metric == "dot":
            return s
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return np.round(np.clip(np.divide(s, n, out=np.zeros_like(s), where=n > 0), -1, 1), 12)
    if metric == "jaccard":
        has, asked = (x > 0).astype(np.float64), (q > 0).astype(np.float64)
        both = asked @ has.T
        either = asked.sum(1)[:, None] + has.sum(1) - both
        return np.divide(both, either, out=np.ones_like(both), where=either > 0)
    if metric == "euclidean":
        return np.exp(-np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in q]))
    if metric == "manhattan":
        return 1 / (1 + np.stack([np.abs(x - one).sum(1) for one in q]))
    raise KeyError(metric)


def _plain(vectors: DataFrame, column: str, dim: int | None) -> DataFrame:
    known = F.forall(column, lambda v: v.isNotNull())
    return vectors.where(known if dim is None else known & (F.size(column) == dim))


class _Best:
    """The ``k`` best rows of each query so far, with all that equal the last of them."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.rows = 0

    def add(self, asked: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.held.append((asked, score, ids))
        self.rows += len(asked)
        if self.rows > 1_000_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.held:
            return None
        asked, score = (np.concatenate([h[n] for h in self.held]) for n in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self.held])
        order = np.lexsort((-score, asked))
        asked, score = asked[order], score[order]
        first = np.searchsorted(asked, asked)
        last = np.minimum(first + self.k - 1, np.searchsorted(asked, asked, side="right") - 1)
        keep = np.flatnonzero(score >= score[last] - 1e-12)
        self.held = [(asked[keep], score[keep], ids.take(pa.array(order[keep])))]
        self.rows = len(keep)
        return self.held[0]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", least: float | None = None, block: int = MATRIX_QUERIES) -> DataFrame:
    """``query, id, score, rank``: for each query the ``k`` nearest of all vectors but itself; ties by id.

    ``queries`` (``query``, ``qv``) is a stated set. They go to every task as matrices of about ``block`` queries, one pass over
    the vectors for each; a task gives its own best ``k`` (with ties) of each query before the shuffle. A metric that was
    registered is no matrix product: its pairs are scored by its column, in passes likewise. Vectors of another length than a
    query's have no score with it.
    """
    spark = vectors.sparkSession
    asked_all = _plain(queries.where("query IS NOT NULL").select("query", "qv"), "qv", None)
    blocks = max(1, -(-asked_all.count() // block))
    kind, query_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    built_in = metric in ("cosine", "dot", "euclidean", "manhattan", "jaccard")
    parts = []
    for nth in range(blocks):
        some = asked_all if blocks == 1 else asked_all.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == nth)
        if built_in:
            held = some.toArrow().combine_chunks()  # about `block` rows
            found = _plain(vectors.select("id", "v"), "v", None).mapInArrow(_scan_queries(held, k, metric, least), f"query {query_kind}, id {kind}, score double")
        else:
            found = vectors.select("id", "v").join(F.broadcast(some), F.col("id") != F.col("query")).select("query", "id", METRICS[metric].similarity(F.col("qv"), F.col("v")).alias("score")).where("score IS NOT NULL")
            found = found if least is None else found.where(F.col("score") >= least)
        parts.append(found if blocks == 1 else keep(top_per(found, "query", k), "pass"))
    if blocks == 1:
        return top_per(parts[0], "query", k)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """Ids, dimension and matrix of the vectors of one length, WIDTH rows of ``id``, ``v`` at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, WIDTH):
            at = pa.array(np.arange(start, min(start + WIDTH, whole.num_rows)))
            ids, given = whole.column("id").take(at), whole.column("v").take(at)
            sizes = np.diff(np.asarray(given.offsets))
            for dim in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == dim))
                yield ids.take(rows), dim, np.asarray(given.take(rows).flatten(), dtype=np.float64).reshape(len(rows), dim)


def similarity_rows(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", block: int = MATRIX_QUERIES) -> DataFrame:
    """``query, id, score``: the rows of the similarity matrix that belong to a stated set of queries, 1 for a vector with itself.

    As many rows as vectors times queries, by its definition. One pass over the vectors for about ``block`` queries.
    """
    asked_all = _plain(queries.where("query IS NOT NULL").select("query", "qv"), "qv", None)
    blocks = max(1, -(-asked_all.count() // block))
    kind, query_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    out = None
    for nth in range(blocks):
        held = asked_all.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == nth).toArrow().combine_chunks()  # about `block` rows

        def run(batches: Iterator[pa.RecordBatch], held: pa.Table = held) -> Iterator[pa.RecordBatch]:
            if not held.num_rows:
                return
            names, given = held.column("query").combine_chunks(), held.column("qv").combine_chunks()
            lengths = np.diff(np.asarray(given.offsets))
            for own, dim, x in _by_length(batches):
                which = np.flatnonzero(lengths == dim)
                for first in range(0, len(which), 64):
                    some = which[first : first + 64]
                    q = np.asarray(given.take(pa.array(some)).flatten(), dtype=np.float64).reshape(-1, dim)
                    score = _similarities(metric, x, q)
                    r, c = np.nonzero(score > -np.inf)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some[r])), own.take(pa.array(c)), pa.array(score[r, c])], names=["query", "id", "score"])

        part = _plain(vectors.select("id", "v"), "v", None).mapInArrow(run, f"query {query_kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.when(F.col("query") == F.col("id"), 1.0).otherwise(F.col("score")))


def _scan_queries(held: pa.Table, k: int, metric: str, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each query of ``held`` the best ``k`` of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held.num_rows:
            return
        names, given = held.column("query").combine_chunks(), held.column("qv").combine_chunks()
        lengths = np.diff(np.asarray(given.offsets))
        place: dict[object, list[int]] = {}
        for n, name in enumerate(names.to_pylist()):
            place.setdefault(name, []).append(n)
        groups = {dim: (which := np.flatnonzero(lengths == dim), np.asarray(given.take(pa.array(which)).flatten(), dtype=np.float64).reshape(-1, dim)) for dim in np.unique(lengths)}
        best = _Best(k)
        for own, dim, x in _by_length(batches):
            if dim not in groups:
                continue
            which, q = groups[dim]
            at = {int(n): r for r, n in enumerate(which)}
            itself = np.array([(at[n], column) for column, name in enumerate(own.to_pylist()) for n in place.get(name, ()) if n in at], dtype=np.int64).reshape(-1, 2)
            for first in range(0, len(q), BLOCK):
                score = _similarities(metric, x, q[first : first + BLOCK])
                r, c = itself[(itself[:, 0] >= first) & (itself[:, 0] < first + len(score))].T
                score[r - first, c] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                r, c = np.nonzero((score >= floor[:, None] - 1e-12) & (score > -np.inf) & (score >= (-np.inf if least is None else least)))
                best.add(which[first + r], score[r, c], own.take(pa.array(c)))
        top = best.shrink()
        if top is not None:
            asked, score, ids = top
            for start in range(0, len(asked), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(asked[part])), ids[part], pa.array(score[part])], names=["query", "id", "score"])

    return run


def score_pairs(pairs: DataFrame, dim: int) -> DataFrame:
    """``pairs`` (``a``, ``b``, vectors ``av``, ``bv`` of ``dim`` numbers) with their cosine as ``score``, by whole Arrow batches."""
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(c).flatten(), dtype=np.float64).reshape(-1, dim) for c in ("av", "bv"))
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            score = np.clip(np.divide(np.einsum("nd,nd->n", x, y), n, out=np.zeros(len(x)), where=n > 0), -1, 1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "score"])

    return pairs.select("a", "b", "av", "bv").mapInArrow(run, f"{kinds}, score double")


def top_per(scored: DataFrame, key: str, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", n.cast("long")).where(F.col("rank") <= k)


def approximate_topk(vectors: DataFrame, queries: DataFrame, dim: int, k: int, least: float = 0.7, tables: int = TABLES, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """As ``exact_topk`` by cosine among the candidates in the ``probes`` buckets of each table that are nearest to the query, of at least ``least``."""
    index = signatures(vectors, "id", "v", dim, tables, bits)
    asked = signatures(queries, "query", "qv", dim, tables, bits, probes)
    pairs = candidates(index, asked).where("query <> id").select(F.col("query").alias("a"), F.col("id").alias("b"))
    scored = score_pairs(pairs.join(vectors.select(F.col("id").alias("b"), F.col("v").alias("bv")), "b").join(queries.select(F.col("query").alias("a"), F.col("qv").alias("av")), "a"), dim)
    return top_per(scored.where(F.col("score") >= least).withColumnsRenamed({"a": "query", "b": "id"}), "query", k)


def similar_pairs(vectors: DataFrame, dim: int, threshold: float, strict: bool = True, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """``a, b, score`` (a < b) of the pairs that share a bucket and whose cosine exceeds (or reaches) the threshold."""
    index = signatures(vectors, "id", "v", dim, tables, bits)
    x, y = index.alias("x"), index.alias("y")
    pairs = x.join(y, (F.col("x.table_id") == F.col("y.table_id")) & (F.col("x.bucket") == F.col("y.bucket"))).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    va, vb = vectors.select(F.col("id").alias("a"), F.col("v").alias("av")), vectors.select(F.col("id").alias("b"), F.col("v").alias("bv"))
    scored = score_pairs(pairs.join(va, "a").join(vb, "b"), dim)
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)


Scan = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def scan_least(threshold: float) -> Scan:
    """Rows, columns and cosines of all unit vectors ``x`` and ``y`` of cosine ``threshold`` and more. ``narrow``: ``y`` as floats."""

    def scan(x: np.ndarray, y: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = x.astype(np.float32)
        for start in range(0, len(y), WIDTH):
            s = few @ narrow[start : start + WIDTH].T
            r, c = np.divmod(np.flatnonzero(s >= threshold - OFF), s.shape[1])
            rows.append(r)
            columns.append(start + c)
        r, c = np.concatenate(rows), np.concatenate(columns)
        score = np.clip(np.einsum("nd,nd->n", x[r], y[c]), -1, 1)
        hit = score >= threshold
        return r[hit], c[hit], score[hit]

    return scan


def scan_top(k: int) -> Scan:
    """As ``scan_least`` for the ``k`` greatest cosines of each row, with all that equal the last of them."""

    def best(r: np.ndarray, s: np.ndarray, floor: np.ndarray, off: float) -> np.ndarray:
        order = np.lexsort((-s, r))
        nth = np.arange(len(r)) - np.searchsorted(r[order], r[order])
        last = order[nth == k - 1]
        floor[r[last]] = s[last]
        return np.flatnonzero(s >= floor[r] - off)

    def scan(x: np.ndarray, y: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        few, floor = x.astype(np.float32), np.full(len(x), -3, np.float32)
        r, c, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        for start in range(0, len(y), WIDTH):
            s = few @ narrow[start : start + WIDTH].T
            if not start and s.shape[1] > k:
                floor = np.partition(s, -k, axis=1)[:, -k].copy()
            at = np.flatnonzero(s >= (floor - OFF)[:, None])
            more = np.divmod(at, s.shape[1])
            r, c, v = np.concatenate([r, more[0]]), np.concatenate([c, start + more[1]]), np.concatenate([v, s.ravel()[at]])
            left = best(r, v, floor, OFF)
            r, c, v = r[left], c[left], v[left]
        score = np.clip(np.einsum("nd,nd->n", x[r], y[c]), -1, 1)
        left = best(r, score, np.full(len(x), -3.0), 1e-12)
        return r[left], c[left], score[left]

    return scan


def against_all(asked: DataFrame, entries: DataFrame, dim: int, scan: Scan, once: bool = False, slice_size: int = SLICE) -> DataFrame:
    """``a, b, score``: what ``scan`` finds for each vector of ``asked`` (``id``, ``v``) among all of ``entries``. Exact: no index, nothing is left out.

    ``entries`` go to the tasks in slices of about ``slice_size``, one pass over ``asked`` for each, so that driver and tasks
    hold one slice at a time; the work is the product of both counts. ``scan_top`` finds its best in each slice.
    With ``once``, ``asked`` being ``entries``, each pair comes once and no vector with itself.
    """
    spark = entries.sparkSession
    n = entries.count()
    slices = max(1, -(-n // slice_size))
    place = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    entries = keep(entries.select("id", "v", place), "entries")
    asked = spread(entries if once else keep(asked.select("id", "v", place), "asked"))
    kinds = ", ".join(f"{c} {df.schema['id'].dataType.simpleString()}" for c, df in (("a", asked), ("b", entries)))
    parts = []
    for nth in range(slices):
        held = entries.where(F.col("slice") == nth).select("id", "v").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((held.column("id").combine_chunks(), _units(held.column("v").combine_chunks(), dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, nth=nth) -> Iterator[pa.RecordBatch]:
            names, y = shared.value
            narrow = y.astype(np.float32)
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(start, BLOCK)
                    r, c, score = scan(_units(b.column("v"), dim), y, narrow)
                    at = pa.array(r)
                    same = np.asarray(b.column("slice"))[r] == nth
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), names.take(pa.array(c)), pa.array(score), pa.array(same)], names=["a", "b", "score", "same"])

        rows = asked.where(F.col("slice") >= nth) if once else asked
        found = rows.mapInArrow(run, f"{kinds}, score double, same boolean")
        parts.append(keep((found.where(~F.col("same") | (F.col("a") < F.col("b"))) if once else found).drop("same"), "pass"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], f"{kinds}, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_similar_pairs(vectors: DataFrame, dim: int, threshold: float, strict: bool = True, slice_size: int = SLICE) -> DataFrame:
    """``a, b, score`` (a < b) of all pairs whose cosine exceeds (or reaches) the threshold: the exact form of ``similar_pairs``.

    Equal vectors are one class, compared once. Vectors are of ``dim`` numbers, not all zero; null ids name no entry.
    """
    members = keep(vectors.where("id IS NOT NULL").select("id", "v", F.xxhash64("v").alias("class_a"), F.xxhash64(F.lit(1), "v").alias("class_b")), "members")
    key = F.struct("class_a", "class_b")
    classes = members.groupBy("class_a", "class_b").agg(F.first("v").alias("v")).select(key.alias("id"), "v")
    found = against_all(classes, classes, dim, scan_least(threshold), once=True, slice_size=slice_size)
    found = found.where(F.col("score") > threshold if strict else F.col("score") >= threshold)
    x, y = (members.select(key.alias(name), F.col("id").alias(f"{name}_id")) for name in "ab")
    other = found.join(x, "a").join(y, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "score")
    same = x.join(y, F.col("a") == F.col("b")).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.lit(1.0).alias("score"))
    return other.unionByName(same) if threshold < 1 or not strict else other


def similar_classes(vectors: DataFrame, dim: int, threshold: float, strict: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``members`` (``id``, ``first``: the least id with the same vector) and ``pairs`` (``a``, ``b``, ``score``, a < b) of such first ids whose cosine exceeds (or reaches) the threshold.

    Equal vectors are one class, compared once, however many they are: their links among each other are what ``first`` says,
    and those with others are those of their first. By posting lists, whose work grows with the vectors and the length of a
    list; a pair is missed if no list holds both (see the README for the recall measured). With ``exact`` all are compared with
    all. Vectors are of ``dim`` numbers, not all zero; null ids name no entry.
    """
    v = F.col("v").cast("array<float>")
    members = keep(vectors.where("id IS NOT NULL").select("id", v.alias("embedding"), F.xxhash64(v).alias("class_a"), F.xxhash64(F.lit(1), v).alias("class_b")), "members")
    classes = members.groupBy("class_a", "class_b").agg(F.min("id").alias("first"), F.first("embedding").alias("embedding"))
    firsts = keep(classes.select("class_a", "class_b", "first"), "firsts")
    if exact:
        by_id = classes.select(F.col("first").alias("id"), F.col("embedding").alias("v"))
        pairs = against_all(by_id, by_id, dim, scan_least(threshold), once=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    else:
        index = lists.fit(members, dim, threshold)
        if index is None:
            pairs = firsts.sparkSession.createDataFrame([], f"a {(kind := vectors.schema['id'].dataType.simpleString())}, b {kind}, score double")
        else:
            found = lists.alike_in_lists(lists.post(classes, index, dim), dim, threshold)
            one, other = (firsts.select(F.col("class_a").alias(f"{n}_a"), F.col("class_b").alias(f"{n}_b"), F.col("first").alias(n)) for n in "xy")
            joined = found.withColumnsRenamed({"a_a": "x_a", "a_b": "x_b", "b_a": "y_a", "b_b": "y_b"}).join(one, ["x_a", "x_b"]).join(other, ["y_a", "y_b"])
            pairs = joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("cosine", F.lit(1.0)).alias("score"))
    pairs = pairs.where(F.col("score") > threshold if strict else F.col("score") >= threshold)
    return members.select("id", "class_a", "class_b").join(firsts, ["class_a", "class_b"]).select("id", "first"), pairs


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, score``: the pairs of ``similar_classes``, and each further copy with the first of its class."""
    copies = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return pairs.select("a", "b", "score").unionByName(copies)


def combined_score(similarity: Column, rerank: Column) -> Column:
    return similarity * 0.4 + rerank * 0.6


def combined_confidence(similarity: Column, rerank: Column) -> Column:
    """High when the two scores agree and are high."""
    return (1.0 - F.abs(similarity - rerank)) * 0.3 + (similarity + rerank) / 2.0 * 0.7
