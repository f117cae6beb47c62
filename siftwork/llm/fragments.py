"""Near-duplicate records with small edits, by min-max hashing.

A record's set of word runs is hashed by K functions, of each of which both the least and the greatest
value are kept: two nearly independent signature values for one evaluation, so K functions give 2K rows
to band. Records that agree in a whole band are candidates; the true share of common runs then decides.
Records with the same set form one class from the start: classes are compared, not records, and a class
of any size costs one representative. A bucket that very many different sets share (a licence, a template
that all begin with) gives no pairs; its classes are compared by their rarest runs, which is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.runtime import keep, spread

#: Classes in a bucket above which its pairs are looked for by rare runs.
CROWDED = 1000
_WORDS = re.compile(r"[a-z0-9_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class RunHasher:
    """The set of a text's runs of ``run`` successive words as sorted 64-bit hashes."""

    def __init__(self, run: int) -> None:
        if not 1 <= run <= len(_MIX):
            raise ValueError(f"runs of 1 to {len(_MIX)} words are possible")
        self.run = run
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text.lower())
        n = len(words) - self.run + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.run):
                x = h[k : k + n] * _MIX[k]
                out = (out ^ (x ^ (x >> np.uint64(29)))) * _MIX[-1 - k] + np.uint64(k + 1)
            out ^= out >> np.uint64(32)
            out *= _MIX[0]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def hash_functions(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``count`` functions x -> a x + b modulo 2^64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def min_max_signature(runs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each function the least and the greatest value over the set, side by side."""
    out = np.empty((len(a), 2), np.uint64)
    with np.errstate(over="ignore"):
        if len(runs) * len(a) <= 1 << 16:
            values = runs[None, :] * a[:, None] + b[:, None]
            out[:, 0], out[:, 1] = values.min(1), values.max(1)
        else:
            for k in range(len(a)):
                values = runs * a[k] + b[k]
                out[k] = values.min(), values.max()
    return out.ravel()


def _set_key(runs: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(runs.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def near_duplicates(df: DataFrame, id_col: str, text: Column, run: int = 5, threshold: float = 0.8, rows: int = 4, bands: int = 50, name: str = "near", crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """``members`` (``id``, ``class_a LONG, class_b LONG``) and ``pairs`` of classes (``a_*``, ``b_*``, ``share``) with at least ``threshold`` of the union in common.

    Every record with at least one run of words is a member of exactly one class, that of its set of runs;
    null texts and texts with too few words are in none. Repeated rows are one member; an id with several
    texts is a member of several classes. Pairs of different classes come out once. A pair of similarity s
    is found with probability 1 - (1 - s^rows)^bands: with 4 rows and 50 bands 0.999 at 0.6 and more
    above. ``rows`` must be even; a band takes ``rows / 2`` functions, a minimum and a maximum of each.
    Whole texts are hashed. A bucket's pairs come from an equi-join, and repeated pairs are dropped before any text is
    read again. Classes that lie in a bucket of more than ``crowded`` ones are compared among each other by ``rare_pairs``.
    """
    if rows % 2:
        raise ValueError("a band takes minimum and maximum of each of its functions")
    a, b = hash_functions(rows // 2 * bands)
    kind = df.schema[id_col].dataType
    given = df.select(F.col(id_col).alias("id"), text.alias("__text")).where("__text IS NOT NULL")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = RunHasher(run), set()
        for batch in batches:
            source, k1, k2, sizes, sent, ends = [], [], [], [], [], [0]
            for at, t in enumerate(batch.column("__text").to_pylist()):
                runs = hasher(t)
                if not len(runs):
                    continue
                x, y = _set_key(runs)
                source.append(at)
                k1.append(x)
                k2.append(y)
                sizes.append(len(runs))
                # a class sends its bands once from each task, not once from each record
                if (x, y) not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add((x, y))
                    banded = min_max_signature(runs, a, b).reshape(bands, rows)
                    sent.append(np.array([xxhash.xxh64_intdigest(banded[k].tobytes(), seed=k) for k in range(bands)], dtype=np.uint64).view(np.int64))
                ends.append(len(sent) * bands)
            flat = np.concatenate(sent) if sent else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(source, pa.int64())), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["id", "class_a", "class_b", "size", "bands"],
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("class_a", T.LongType()), T.StructField("class_b", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    hashed = keep(spread(given).mapInArrow(keyed, schema), name)
    members = hashed.select("id", "class_a", "class_b").distinct()
    # one shuffle serves to drop repeats, and both sides of the join; a class goes by half of its key here, which the texts settle
    exploded = hashed.select("class_a", "size", F.explode("bands").alias("bucket")).repartition("bucket")
    bucketed = exploded.groupBy("bucket", "class_a").agg(F.first("size").alias("size"))
    # how many share a bucket is counted where its rows lie for the join anyway
    counted = bucketed.withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    one, other = counted.where(F.col("n") <= crowded).alias("x"), counted.where(F.col("n") <= crowded).alias("y")
    alike = F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size")  # else the union is too large
    near = one.join(other, F.col("x.bucket") == F.col("y.bucket")).where((F.col("x.class_a") < F.col("y.class_a")) & alike).select(F.col("x.class_a").alias("one"), F.col("y.class_a").alias("other")).distinct()
    # it asks for the same columns and rows as the join does, so that it shares its shuffle
    left_over = counted.where((F.col("n") > crowded) & (F.col("size") > 0) & F.col("bucket").isNotNull() & F.col("class_a").isNotNull()).select(F.col("class_a").alias("one"), F.lit(None).cast("long").alias("other")).distinct()
    found = keep(near.unionByName(left_over), f"{name}-candidates")
    candidates, left_over = found.where("other IS NOT NULL"), found.where("other IS NULL").select(F.col("one").alias("class_a"))
    if not left_over.isEmpty():
        candidates = keep(candidates.unionByName(rare_pairs(given, members, left_over, run, threshold)).distinct(), f"{name}-candidates")

    # a text of each class that has a candidate
    wanted = candidates.select(F.col("one").alias("class_a")).unionByName(candidates.select(F.col("other").alias("class_a"))).distinct()
    chosen = members.join(wanted, "class_a", "left_semi").groupBy("class_a", "class_b").agg(F.min("id").alias("id"))
    texts = given.join(chosen, "id").select("class_a", "class_b", "__text").distinct()
    left = texts.select(F.col("class_a").alias("one"), F.col("class_b").alias("a_b"), F.col("__text").alias("a_text"))
    right = texts.select(F.col("class_a").alias("other"), F.col("class_b").alias("b_b"), F.col("__text").alias("b_text"))
    compared = candidates.join(left, "one").join(right, "other").select(F.col("one").alias("a_a"), "a_b", F.col("other").alias("b_a"), "b_b", "a_text", "b_text")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(run)
        sets: dict[str, np.ndarray] = {}

        def runs_of(text: str) -> np.ndarray:
            if text not in sets:
                if len(sets) > 2000:
                    sets.clear()
                sets[text] = hasher(text)
            return sets[text]

        for batch in batches:
            shares = np.zeros(batch.num_rows)
            for k, (x, y, a2, b2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a_text", "b_text", "a_b", "b_b")))):
                p, q = runs_of(x), runs_of(y)
                if _set_key(p)[1] == a2 and _set_key(q)[1] == b2:  # else another text of the same id
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    shares[k] = common / (len(p) + len(q) - common)
            hit = pa.array(np.flatnonzero(shares >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("a_a", "a_b", "b_a", "b_b")] + [pa.array(shares).take(hit)], names=["a_a", "a_b", "b_a", "b_b", "share"])

    pairs = compared.mapInArrow(share, "a_a long, a_b long, b_a long, b_b long, share double")
    return members, pairs.dropDuplicates(["a_a", "a_b", "b_a", "b_b"])


def rare_pairs(given: DataFrame, members: DataFrame, classes: DataFrame, run: int, threshold: float) -> DataFrame:
    """``one``, ``other``: the pairs of ``classes`` (``class_a``) that may share ``threshold`` of their union; none that does is left out.

    With all runs in one order, two such sets have one of the first n - ceil(threshold * n) + 1 runs of each in common. In the
    order from the rarest run on, these are what a set hardly shares with others, so a common head makes no pairs.
    """
    wanted = members.join(classes, "class_a", "left_semi").groupBy("class_a").agg(F.min("id").alias("id"))
    texts = given.join(wanted, "id").select("class_a", "__text").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(run)
        for b in batches:
            source, ends, flat = [], [0], []
            for at, (key, t) in enumerate(zip(b.column("class_a").to_pylist(), b.column("__text").to_pylist())):
                runs = hasher(t)
                if len(runs) and _set_key(runs)[0] == key:  # else another text of the same id
                    source.append(at)
                    flat.append(runs.view(np.int64))
                    ends.append(ends[-1] + len(runs))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("class_a").take(pa.array(source, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["class_a", "runs"])

    sets = keep(texts.mapInArrow(hashed, "class_a long, runs array<long>").dropDuplicates(["class_a"]), "sets")
    each = sets.select("class_a", F.explode("runs").alias("run"))
    common = each.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    # runs that only one set has come before all others
    size, least = F.size("runs"), F.ceil(F.size("runs") * F.lit(threshold) - 1e-9)
    ranked = each.join(common, "run").groupBy("class_a").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("shared"))
    first = sets.join(ranked, "class_a").select("class_a", size.alias("size"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), size - least + 1 - (size - F.size("shared"))).cast("int")).alias("first"))
    rare = keep(first.select("class_a", "size", F.explode("first.run").alias("run")), "rare")
    x, y = rare.alias("x"), rare.alias("y")
    alike = F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size")
    return x.join(y, F.col("x.run") == F.col("y.run")).where((F.col("x.class_a") < F.col("y.class_a")) & alike).select(F.col("x.class_a").alias("one"), F.col("y.class_a").alias("other")).distinct()


def expand(members: DataFrame, pairs: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """The pairs of different ids, the lesser first: across paired classes and within each class."""
    m = members
    left = m.select(F.col("id").alias("__x"), F.col("class_a").alias("a_a"), F.col("class_b").alias("a_b"))
    right = m.select(F.col("id").alias("__y"), F.col("class_a").alias("b_a"), F.col("class_b").alias("b_b"))
    across = pairs.select("a_a", "a_b", "b_a", "b_b").join(left, ["a_a", "a_b"]).join(right, ["b_a", "b_b"]).where("__x <> __y").select("__x", "__y")
    within = m.alias("p").join(m.alias("q"), ["class_a", "class_b"]).where("p.id < q.id").select(F.col("p.id").alias("__x"), F.col("q.id").alias("__y"))
    return across.unionByName(within).select(F.least("__x", "__y").alias(a_col), F.greatest("__x", "__y").alias(b_col)).distinct()


def class_links(members: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """One row for each record: its class, the members of the class and the number of other classes that it is linked with."""
    ends = pairs.select(F.col("a_a").alias("class_a"), F.col("a_b").alias("class_b")).unionAll(pairs.select(F.col("b_a").alias("class_a"), F.col("b_b").alias("class_b")))
    links = ends.groupBy("class_a", "class_b").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class_a", "class_b").agg(F.count("*").alias("members"))
    known = sizes.join(links, ["class_a", "class_b"], "left")
    return members.join(known, ["class_a", "class_b"]).select(F.col("id").alias(id_col), F.format_string("%016x%016x", "class_a", "class_b").alias("class_id"), "members", F.coalesce("links", F.lit(0)).alias("links"))


def fragment_text() -> Column:
    """A fragment's signature (null as empty), a line break and its content; null without a content."""
    return F.when(F.col("code_content").isNotNull(), F.concat(F.coalesce("function_signature", F.lit("")), F.lit("\n"), F.col("code_content")))


def similar_fragments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``near_duplicates`` of code fragments: three-word runs, at least 0.6 in common."""
    return near_duplicates(df, "fragment_id", fragment_text(), run=3, threshold=0.6, name="fragments")
