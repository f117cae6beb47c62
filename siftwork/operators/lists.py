"""Balanced posting lists: an index of vectors for searches among all of them.

1. Centroids: a bounded sample is clustered top-down into parts of equal size. Means are then drawn towards what is nearest to
   them; a centroid that has come to hold too much is halved, and one that holds next to nothing goes.
2. Graph: each centroid is linked with its nearest; a search starts from the best of a few hubs and walks the links, all vectors
   of a batch at once. Each task has the graph in memory.
3. Lists: the ratio of a centroid's distance to that of the nearest one selects the lists of a vector: one in a cluster's core,
   several at its boundary. It is found in them, and what is like it is looked for in them.
4. Cells: a list that the sample shows to be longer than CELL is compared in blocks, so a task never holds more than two blocks,
   however many vectors a topic has or however long lists grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of the sample that centroids and graph are fitted on, at most, and for each thousand vectors.
SAMPLE, FOR_EACH = 262_144, 32
#: Vectors that are nearest to each centroid, as aimed at, and centroids at most (8 MB of 64 numbers, which a task holds).
LIST_SIZE, CENTROIDS = 2000, 32_768
#: How much farther than the nearest centroid one may be whose list a vector goes to, and the lists of a vector at most.
RATIO, LISTS = 1.06, 8
#: Share of the distance at which a neighbour may be that a list may be farther, whatever the ratio says: a vector right at its centroid needs more than a share of next to nothing.
SLACK = 0.1
#: Vectors of a list that a task compares at once; longer lists are compared in blocks.
CELL = 16_384
#: How much more or less than its share a centroid may hold of the sample before it is halved or goes, and rounds of that.
CROWDED, IDLE, ROUNDS = 1.4, 0.5, 4
#: Centroids up to which the walk on the graph finds nearly all nearest ones; among more, all are compared, which costs no more.
WALKED = 1024


def _halves(x: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Two means of ``x``."""
    c = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(rounds):
        near = x @ (c[0] - c[1]) > (c[0] @ c[0] - c[1] @ c[1]) / 2
        if near.all() or not near.any():
            c = x[rng.choice(len(x), 2, replace=False)]
            continue
        c = np.stack([x[near].mean(0), x[~near].mean(0)])
    return c


def _units_of(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _owners(sample: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(sample[k : k + 512] @ c.T).argmax(1) for k in range(0, len(sample), 512)])


def _drawn(sample: np.ndarray, c: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each centroid at the mean of what is nearest to it."""
    n = np.bincount(owner, minlength=len(c))
    means = np.zeros_like(c)
    np.add.at(means, owner, sample)
    c = c.copy()
    c[n > 0] = means[n > 0] / n[n > 0, None]
    return _units_of(c)


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """About ``count`` unit centroids: the sample is halved along its two-means axis at the median, again and again; after the means are taken crowded ones are halved and idle ones dropped."""
    rng = np.random.default_rng(seed)
    parts, out = [(np.arange(len(sample)), count)], []
    while parts:
        rows, want = parts.pop()
        x = sample[rows]
        if want <= 1 or len(rows) < 8:
            out.append(x.mean(0))
            continue
        c = _halves(x, rng)
        first = want // 2
        order = np.argsort(-(x @ (c[0] - c[1])), kind="stable")
        cut = len(rows) * first // want
        parts += [(rows[order[:cut]], first), (rows[order[cut:]], want - first)]
    c = _units_of(np.stack(out))
    for _ in range(2):
        c = _drawn(sample, c, _owners(sample, c))
    share = len(sample) / len(c)
    for _ in range(ROUNDS if len(c) > 1 else 0):
        owner = _owners(sample, c)
        n = np.bincount(owner, minlength=len(c))
        crowded = np.flatnonzero(n > max(CROWDED * share, 8))
        if not len(crowded):
            break
        idle = np.flatnonzero(n < IDLE * share)
        idle = idle[np.argsort(n[idle], kind="stable")][: len(crowded)]
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(n)
        halves = [_halves(sample[order[ends[k] - n[k] : ends[k]]], rng, 4) for k in crowded]
        c = np.concatenate([np.delete(c, np.concatenate([crowded, idle]), axis=0), _units_of(np.concatenate(halves))])
        c = _drawn(sample, c, _owners(sample, c))
    return c.astype(np.float32)


@dataclass
class CentroidGraph:
    """Centroids with links to their nearest, and hubs to start from."""

    centroids: np.ndarray
    links: np.ndarray
    hubs: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = 24, seed: int = 2) -> CentroidGraph:
        n = len(centroids)
        # with more centroids a walk is longer, and each step must see more
        degree = min(degree if n <= 1024 else degree + 8, max(n - 1, 0))
        links = np.zeros((n, degree), np.int32)
        for k in range(0, n if degree else 0, 256):
            s = centroids[k : k + 256] @ centroids.T
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -2
            links[k : k + 256] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        hubs = np.random.default_rng(seed).permutation(n)[: max(1, min(n, int(8 * np.sqrt(n))))]
        return cls(centroids, links, np.sort(hubs).astype(np.int32))

    def nearest(self, x: np.ndarray, k: int, beam: int = 24, hops: int | None = None, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``k`` nearest centroids that the walk finds, nearest first, and their cosines.

        Of the ``beam`` best that a row has seen, each hop opens the ``width`` best that aren't open yet, until all are
        open (or for ``hops``). Among more than WALKED centroids even that misses many, so there all are compared.
        """
        if hops is None and len(self.centroids) > WALKED:
            return self.nearest_of_all(x, k)
        beam = max(beam, k)
        hub_sims = x @ self.centroids[self.hubs].T
        first = min(beam, len(self.hubs))
        top = np.argpartition(-hub_sims, first - 1, axis=1)[:, :first]
        ids, sims = np.full((len(x), beam), self.hubs[0]), np.full((len(x), beam), -2, np.float32)
        ids[:, :first], sims[:, :first] = self.hubs[top], np.take_along_axis(hub_sims, top, 1)
        opened = sims < -1.5
        going, hop = np.arange(len(x) if self.links.shape[1] else 0), 0
        while len(going) and (hops is None or hop < hops):
            hop += 1
            i, s, o = ids[going], sims[going], opened[going]
            closed = np.where(o, -3, s)
            best = np.argpartition(-closed, min(width, beam) - 1, axis=1)[:, :width]
            np.put_along_axis(o, best, True, 1)
            more = self.links[np.take_along_axis(i, best, 1)].reshape(len(going), -1)
            found = np.matmul(self.centroids[more], x[going][:, :, None])[:, :, 0]
            i, s, o = np.concatenate([i, more], 1), np.concatenate([s, found], 1), np.concatenate([o, np.zeros(more.shape, bool)], 1)
            # of what was seen twice, the one that is open stays
            order = np.argsort(i.astype(np.int64) * 2 + ~o, axis=1)
            i, s, o = (np.take_along_axis(v, order, 1) for v in (i, s, o))
            twice = i[:, 1:] == i[:, :-1]
            s[:, 1:][twice], o[:, 1:][twice] = -2, True
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            ids[going], sims[going], opened[going] = (np.take_along_axis(v, top, 1) for v in (i, s, o))
            # a row goes on as long as it has seen something among its best that isn't open
            going = going[~opened[going].all(1)]
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def nearest_of_all(self, x: np.ndarray, k: int, group: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """As ``nearest``, among all centroids: the nearest are in the ``k`` groups of the greatest maxima."""
        n = len(self.centroids)
        groups = -(-n // group)
        s = np.full((len(x), groups * group), -2, np.float32)
        np.matmul(x, self.centroids.T, out=s[:, :n])
        s = s.reshape(len(x), groups, group)
        most = min(k, groups)
        best = np.argpartition(-s.max(2), most - 1, axis=1)[:, :most]
        ids = (best[:, :, None] * group + np.arange(group)).reshape(len(x), -1)
        sims = np.take_along_axis(s, best[:, :, None], 1).reshape(len(x), -1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def usable(embedding: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers that aren't all zero. Never null."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(embedding) == dim) & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit(column: pa.Array, dim: int) -> np.ndarray:
    return _units(_raw(column, dim)).astype(np.float32)


@dataclass
class Index:
    """The graph of the centroids, and into how many blocks each list is cut."""

    graph: CentroidGraph
    blocks: np.ndarray
    ratio: float
    lists: int
    slack: float

    def select(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists: of each vector those whose centroid is within the ratio, or the slack, of the nearest one."""
        ids, sims = self.graph.nearest(x, min(self.lists, len(self.graph.centroids)))
        distance = np.sqrt(np.maximum(2 - 2 * sims, 0))
        row, nth = np.nonzero(distance <= np.maximum(self.ratio * distance[:, :1], distance[:, :1] + self.slack) + 1e-6)
        return row, ids[row, nth].astype(np.int32)


def fit(df: DataFrame, dim: int, least: float, id_col: str = "id", vector_col: str = "embedding", sample: int = SAMPLE, list_size: int = LIST_SIZE, ratio: float = RATIO, lists: int = LISTS, cell: int = CELL) -> Index | None:
    """An index for searches of cosine ``least`` and more, fitted on the rows whose id has the least hashes; None without usable vectors.

    The count of the rows reads no column, the sample one pass; at most ``sample`` vectors go to the driver.
    """
    n = df.count()
    if not n:
        return None
    count = max(1, min(CENTROIDS, n // list_size))
    sample = min(sample, max(8, FOR_EACH * n // 1000, FOR_EACH * count))
    rows = df.where(F.col(id_col).isNotNull())
    # a share of the rows first, so that the ordering sees about as many rows as the sample has, however many there are
    if n > 2 * sample:
        rows = rows.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(n // sample)) == 0)
    rows = rows.where(usable(F.col(vector_col), dim))
    chosen = rows.select(F.xxhash64(id_col, F.lit(11)).alias("h"), F.col(vector_col).alias("v")).orderBy("h").limit(sample).select("v").toArrow()
    if not chosen.num_rows:
        # a share without a usable vector: all rows are looked at
        chosen = df.where(F.col(id_col).isNotNull()).where(usable(F.col(vector_col), dim)).select(F.col(vector_col).alias("v")).limit(sample).toArrow()
    if not chosen.num_rows:
        return None
    # copies are one vector in the lists
    x = np.unique(unit(chosen.column("v").combine_chunks(), dim), axis=0)
    index = Index(CentroidGraph.build(balanced_centroids(x, max(1, min(count, len(x) // 8)))), np.ones(1, np.int64), ratio, lists, SLACK * float(np.sqrt(max(0.0, 2 - 2 * least))))
    held = np.bincount(np.concatenate([index.select(x[k : k + 4096])[1] for k in range(0, len(x), 4096)]), minlength=len(index.graph.centroids))
    index.blocks = np.maximum(1, -(-held * n // (chosen.num_rows * cell)))
    return index


def post(classes: DataFrame, index: Index, dim: int) -> DataFrame:
    """``list, cell, block, class_a, class_b, vector``: each class of equal vectors (``class_a, class_b, embedding``) in the cells of its lists, once from each task.

    A list of b blocks has the cells of all pairs of blocks; a class lies in one block, by its hash, and goes to that block's cells.
    """
    shared = classes.sparkSession.sparkContext.broadcast(index)  # CENTROIDS bounds its size

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            # a class goes to its lists once from each task, however many members it has there
            if len(seen) > 1_000_000:
                seen.clear()
            keys = list(zip(whole.column("class_a").to_pylist(), whole.column("class_b").to_pylist()))
            whole = whole.take(pa.array([n for n, key in enumerate(keys) if key not in seen and not seen.add(key)], pa.int64()))
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                raw = _raw(b.column("embedding"), dim)
                row, where = at.select(_units(raw).astype(np.float32))
                blocks = at.blocks[where]
                own = np.asarray(b.column("class_b"))[row] % blocks
                # the cell of blocks i <= j is i * blocks + j
                more = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(more)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(own[more], other), np.maximum(own[more], other)
                out, source = low * blocks[more] + high, row[more]
                take = pa.array(source)
                vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(source), [None, pa.py_buffer(np.ascontiguousarray(raw[source]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[more]), pa.array(out.astype(np.int32)), pa.array(own[more].astype(np.int32)), b.column("class_a").take(take), b.column("class_b").take(take), vectors],
                    names=["list", "cell", "block", "class_a", "class_b", "vector"],
                )

    return classes.select("class_a", "class_b", "embedding").mapInArrow(assign, "list int, cell int, block int, class_a long, class_b long, vector binary")


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _compared(search: Callable[[np.ndarray, np.ndarray, np.ndarray | None], Iterator[Found]], dim: int) -> Callable[[pa.Table], pa.Table]:
    """A function of a cell that compares its vectors by ``search`` (of the unit vectors in float and in double accuracy, and their blocks) and gives the pairs of classes found."""

    def run(t: pa.Table) -> pa.Table:
        keys = np.stack([np.asarray(t.column("class_a")), np.asarray(t.column("class_b"))], 1)
        once = np.unique(keys, axis=0, return_index=True)[1]
        if len(once) < t.num_rows:
            t = t.take(pa.array(once))
        x = _units(np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float32).reshape(t.num_rows, dim))
        block = np.asarray(t.column("block"))
        # a cell of two blocks compares each with the other; what is alike within one is found in that one's own cell
        block = block if len(np.unique(block)) > 1 else None
        found = list(search(x.astype(np.float32), x, block))
        r, o, c = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        a, b = np.asarray(t.column("class_a")), np.asarray(t.column("class_b"))
        return pa.table({"a_a": a[r], "a_b": b[r], "b_a": a[o], "b_b": b[o], "cosine": c.astype(np.float64)})

    return run


_PAIR = "a_a long, a_b long, b_a long, b_b long, cosine double"


def nearest_in_lists(posted: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """``a_a, a_b, b_a, b_b, cosine``: for each class, and each cell that it lies in, the ``k`` most similar other classes there of at least ``least``."""

    def search(x: np.ndarray, exact: np.ndarray, block: np.ndarray | None) -> Iterator[Found]:
        for start in range(0, len(x), 512):
            s = x[start : start + 512] @ x.T
            s[np.arange(len(s)), np.arange(start, start + len(s))] = -2
            if block is not None:
                s[block[start : start + 512, None] == block] = -2
            r, o = np.nonzero(s >= least - 1e-4)
            # numbers of float accuracy are settled in double accuracy
            c = np.einsum("nd,nd->n", exact[start + r], exact[o])
            order = np.lexsort((o, -c, r))
            r, o, c = r[order], o[order], c[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            hit = (nth < k) & (c >= least - 1e-12)
            yield start + r[hit], o[hit], c[hit]

    return posted.groupBy("list", "cell").applyInArrow(_compared(search, dim), _PAIR)


def alike_in_lists(posted: DataFrame, dim: int, least: float) -> DataFrame:
    """``a_a, a_b, b_a, b_b, cosine``: the pairs of classes of at least ``least`` that share a list, each pair once, the class of lesser hash first."""

    def search(x: np.ndarray, exact: np.ndarray, block: np.ndarray | None) -> Iterator[Found]:
        # rows come in the order of their classes, so the later one is the greater
        for start in range(0, len(x), 512):
            s = x[start : start + 512] @ x[start:].T
            s[np.tril_indices(len(s), 0, s.shape[1])] = -2
            if block is not None:
                s[block[start : start + 512, None] == block[start:]] = -2
            r, o = np.nonzero(s >= least - 1e-4)
            c = np.einsum("nd,nd->n", exact[start + r], exact[start + o])
            hit = c >= least - 1e-7
            yield start + r[hit], start + o[hit], c[hit]

    def ordered(t: pa.Table) -> pa.Table:
        return _compared(search, dim)(t.sort_by([("class_a", "ascending"), ("class_b", "ascending")]))

    found = posted.groupBy("list", "cell").applyInArrow(ordered, _PAIR)
    return found.groupBy("a_a", "a_b", "b_a", "b_b").agg(F.max("cosine").alias("cosine"))
