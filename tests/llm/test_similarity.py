from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm import fragments, neighbours

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("updated_at", T.TimestampType()), T.StructField("cosine", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], datetime(2024, 1, d), "extra") for i, v, d in rows], SCHEMA)


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for a, i in enumerate(ids):
        near = sorted(((-round(s[a, b], 9), j) for b, j in enumerate(ids) if j != i and s[a, b] >= least))
        out[i] = [j for _, j in near[:k]]
    return out


def groups(rng, n, dim, spread):
    out = {}
    for g in range(n // 6):
        c = rng.normal(size=dim)
        for m in range(rng.integers(1, 12)):
            out[f"v{g:03d}_{m:02d}"] = c + rng.normal(size=dim) * spread * rng.random()
    return out


def test_recall_and_ranks(spark):
    rng = np.random.default_rng(5)
    v = groups(rng, 1800, 16, 0.5)
    df = table(spark, [(i, x, 1) for i, x in v.items()])
    got = {}
    for r in neighbours.neighbours(df, 5, 0.85, 16, list_size=60).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(v, 5, 0.85)
    pairs = {(i, j) for i, js in want.items() for j in js}
    found = {(i, j) for i, js in got.items() for j in js}
    assert len(pairs) > 1000 and len(pairs & found) / len(pairs) >= 0.97


def test_every_entry_has_its_nearest_however_far(spark, tmp_path):
    from siftwork.llm import queries

    rng = np.random.default_rng(4)
    v = groups(rng, 300, 64, 1.0) | {f"c{n}": np.arange(64) - 20.0 for n in range(4)} | {f"w{n}": rng.normal(size=64) for n in range(60)}
    table(spark, [(i, x, 2) for i, x in v.items()] + [("w0", None, 1), ("z", None, 1)]).write.parquet(f"{tmp_path}/vectors.parquet")
    got = {}
    for r in queries.p1_neighbours(spark, str(tmp_path)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(v, 5, -1)
    assert set(got) == set(v) and all(len(js) == 5 for js in got.values())
    assert sum(len(set(want[i]) & set(got[i])) for i in v) >= 0.995 * 5 * len(v)
    # fewer entries than asked for, one pass for each small slice
    few = table(spark, [(i, v[i], 1) for i in list(v)[:4]])
    assert neighbours.neighbours(few, 5, None, 64).count() == 12
    entries = neighbours.current_entries(table(spark, [(i, x, 1) for i, x in v.items()]), 64)
    vectors = entries.select("id", entries.embedding.alias("v"))
    from siftwork.operators import ann

    found = ann.against_all(vectors, vectors, 64, ann.scan_top(6), slice_size=50)
    assert found.where("a = b").count() == len(v)
    best = {}
    for r in found.where("a <> b").collect():
        best.setdefault(r["a"], []).append((-round(r["score"], 9), r["b"]))
    assert {i: [j for _, j in sorted(js)[:5]] for i, js in best.items()} == want


def test_current_rows_and_unusable_vectors(spark):
    a = [1.0, 0, 0, 0]
    rows = [("a", [0, 1, 0, 0], 1), ("a", a, 3), ("a", a, 3), ("b", a, 1), ("b", None, 2), ("c", [1, 0.01, 0, 0], 1), ("d", [0, 0, 0, 0], 1), ("e", [1, 0], 1), ("f", [1, float("nan"), 0, 0], 1), ("g", [1, float("inf"), 0, 0], 1), ("h", [1, None, 0, 0], 1), (None, a, 1)]
    df = table(spark, rows)
    got = neighbours.neighbour_pairs(neighbours.neighbours(df, 5, 0.85, 4)).collect()
    assert [tuple(r) for r in got] == [("a", "c")]
    assert neighbours.neighbours(df.limit(0), 5, 0.85, 4).count() == 0
    assert neighbours.neighbours(df.where("id = 'd'"), 5, 0.85, 4).count() == 0


def test_copies_and_ties(spark):
    v = {f"c{n:02d}": [1.0, 2.0, 3.0, 0.0] for n in range(12)} | {"x": [1.0, 2.0, 3.1, 0.0], "y": [0.0, 0.0, 0.0, 1.0]}
    df = table(spark, [(i, x, 1) for i, x in v.items()])
    got = {}
    for r in neighbours.neighbours(df, 5, 0.85, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == {i: js for i, js in brute(v, 5, 0.85).items() if js}
    assert got["c03"] == ["c00", "c01", "c02", "c04", "c05"]


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.balanced_centroids(x, 300)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert len(c) == 300 and sizes.max() < 6 * sizes.mean()
    ids, sims = neighbours.CentroidGraph.build(c).nearest(x[:2000], 4)
    exact = np.argsort(-(x[:2000] @ c.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, exact)]) / 4 > 0.85
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_nearest_centroids_among_many():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(5000, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[:400] + rng.normal(size=(400, 64)).astype(np.float32) * 0.15
    for some, least in ((c, 1.0), (c[:900], 0.95), (c[:3], 1.0), (c[:1], 1.0)):
        k = min(neighbours.LISTS, len(some))
        ids, sims = neighbours.CentroidGraph.build(some).nearest(x, k)
        exact = np.argsort(-(x @ some.T), axis=1)[:, :k]
        assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, exact)]) / k >= least
        assert ids.shape == (400, k) and (np.diff(sims, axis=1) <= 1e-6).all()


def runs_of(text, run):
    import re

    w = re.findall(r"[a-z0-9_]+", text.lower())
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}


def edits(rng, n):
    words = [f"w{k}" for k in range(400)]
    out = {}
    for g in range(n):
        base = list(rng.choice(words, rng.integers(5, 120)))
        for m in range(rng.integers(1, 5)):
            t = list(base)
            for _ in range(rng.integers(0, 6)):
                t[rng.integers(0, len(t))] = str(rng.choice(words))
            out[g * 10 + m] = " ".join(t)
    return out


@pytest.mark.parametrize(("run", "threshold"), [(3, 0.6), (5, 0.8)])
def test_all_near_pairs(spark, run, threshold):
    texts = edits(np.random.default_rng(run), 150)
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    members, pairs = fragments.near_duplicates(df, "k", F.col("t"), run, threshold)
    got = {tuple(r) for r in fragments.expand(members, pairs, "a", "b").collect()}
    sets = {k: runs_of(t, run) for k, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert len(want) > 30 and got == want


@pytest.mark.parametrize(("run", "threshold", "crowded"), [(3, 0.6, 5), (5, 0.8, 5), (3, 0.6, 1)])
def test_crowded_buckets_lose_no_pair(spark, run, threshold, crowded):
    rng = np.random.default_rng(run)
    head = " ".join(f"h{k}" for k in range(60))
    texts = {k: f"{head} {t}" for k, t in edits(rng, 60).items()} | {9000 + k: " ".join(f"n{k}_{j}" for j in range(9)) for k in range(20)} | {9100: head, 9101: head + " x y z"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    members, pairs = fragments.near_duplicates(df, "k", F.col("t"), run, threshold, crowded=crowded)
    got = {tuple(r) for r in fragments.expand(members, pairs, "a", "b").collect()}
    sets = {k: runs_of(t, run) for k, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert len(want) > 50 and got == want


def test_a_common_head_makes_no_pairs(spark):
    head = " ".join(f"h{k}" for k in range(60))
    texts = {k: head + " " + " ".join(f"b{k}_{j}" for j in range(60)) for k in range(400)}
    df = spark.createDataFrame(list(texts.items()), "id long, __text string")
    members = df.select("id", F.col("id").alias("class_a"), F.col("id").alias("class_b"))
    hasher = fragments.RunHasher(3)
    keys = {k: fragments._set_key(hasher(t))[0] for k, t in texts.items()}
    members = spark.createDataFrame([(k, v) for k, v in keys.items()], "id long, class_a long")
    assert fragments.rare_pairs(df, members, members.select("class_a"), 3, 0.6).count() == 0


def test_fragment_edges(spark):
    body = "return alpha + beta + gamma; done now"
    data = [(1, body, "f(a)", "z"), (1, body, "f(a)", "z"), (2, body.upper(), "f(a)", "z"), (3, None, "f(a)", "z"), (4, "", None, "z"), (5, "one two", None, "z"), (6, "日本語 テキスト", None, "z"), (7, body, None, "z"), (8, "word " * 50000, None, "z"), (9, "word " * 3, None, "z")]
    df = spark.createDataFrame(data, "fragment_id long, code_content string, function_signature string, bands string")
    members, pairs = fragments.similar_fragments(df)
    got = {tuple(r) for r in fragments.expand(members, pairs, "fragment_a", "fragment_b").collect()}
    assert got == {(1, 2), (1, 7), (2, 7), (8, 9)}
    classes = {r["fragment_id"]: (r["members"], r["links"]) for r in fragments.class_links(members, pairs, "fragment_id").collect()}
    assert classes == {1: (2, 1), 2: (2, 1), 7: (1, 1), 8: (2, 0), 9: (2, 0)}
    members, pairs = fragments.similar_fragments(df.limit(0))
    assert members.count() == 0 and fragments.expand(members, pairs, "a", "b").count() == 0


def test_min_max_is_unbiased():
    rng = np.random.default_rng(4)
    a, b = fragments.hash_functions(400)
    both = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    x = np.concatenate([both, rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
    y = np.concatenate([both, rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
    same = fragments.min_max_signature(x, a, b) == fragments.min_max_signature(y, a, b)
    assert abs(same.mean() - 120 / 200) < 0.06
