import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import ann, cache, changes, clusters, scanners
from siftwork.operators import search as S


def test_planes_are_fixed():
    p = ann.planes(8, 2, 3)
    assert p.shape == (2, 3, 8) and p.min() >= -0.5 and p.max() < 0.5
    assert np.array_equal(p, ann.planes(8, 2, 3)) and len(np.unique(p)) > 40


def vectors(spark, values):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None) for k, v in values.items()], "id long, v array<double>")


def test_signatures_and_candidates(spark):
    rng = np.random.default_rng(0)
    v = {k: rng.normal(size=8) for k in range(30)} | {30: None, 31: [1.0, 2.0]}
    s = ann.signatures(vectors(spark, v), "id", "v", 8)
    got = {(r["id"], r["table_id"]): r["bucket"] for r in s.collect()}
    p = ann.planes(8)
    assert set(k for k, _ in got) == set(range(30))
    for (k, t), bucket in got.items():
        assert bucket == sum(1 << i for i in range(ann.BITS) if p[t, i] @ v[k] >= 0)
    c = {(r["query"], r["id"]) for r in ann.candidates(s, s.where("id = 3")).collect()}
    assert c == {(3, k) for k in range(30) if any(got[3, t] == got[k, t] for t in range(ann.TABLES))}
    st = ann.bucket_stats(s).first()
    sizes = sorted(r["count"] for r in s.groupBy("table_id", "bucket").count().collect())
    assert (st["ids"], st["buckets"], st["median_size"]) == (30, len(sizes), sizes[len(sizes) // 2])


def test_exact_and_approximate_topk(spark):
    v = {1: [1, 0, 0], 2: [0, 1, 0], 3: [0.5, 0.5, 0], 4: [1, 0, 0], 5: [0, 0, 0]}
    df = vectors(spark, v)
    q = df.where("id = 1").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    got = [(r["id"], round(r["score"], 6)) for r in ann.exact_topk(df, q, 2).orderBy("rank").collect()]
    assert got == [(4, 1.0), (3, 0.707107)]
    assert ann.exact_topk(df.limit(0), q, 2).count() == 0
    near = ann.approximate_topk(df, q, 3, 5, least=0.9)
    assert [r["id"] for r in near.collect()] == [4]


def test_approximate_topk_finds_nine_of_ten(spark):
    rng = np.random.default_rng(8)
    df = vectors(spark, dict(enumerate(rng.normal(size=(1500, 64)))))
    q = df.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    want = {(r["query"], r["id"]) for r in ann.exact_topk(df, q, 10, "cosine", 0.3).collect()}
    got = {(r["query"], r["id"]) for r in ann.approximate_topk(df, q, 64, 10, least=0.3).collect()}
    assert len(want) > 500 and len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize(("threshold", "slice_size"), [(0.9, 1000), (0.75, 130)])
def test_all_similar_pairs_equal_brute_force(spark, threshold, slice_size):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0.2, 0.9, (150, 1)), base[:20], base[:3]])
    v = dict(enumerate(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in v for b in v if a < b and u[a] @ u[b] > threshold}
    got = [(r["a"], r["b"]) for r in ann.all_similar_pairs(vectors(spark, v), 64, threshold, slice_size=slice_size).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # buckets lose some of them
    assert {(r["a"], r["b"]) for r in ann.similar_pairs(vectors(spark, v), 64, threshold, bits=12).collect()} < want


def skewed(n, seed, dim=64):
    """Vectors of which a third crowd around one topic, some in pairs that are alike, some equal."""
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(40, dim))
    x = topics[np.where(rng.random(n) < 0.33, 0, rng.integers(0, 40, n))] * 0.9 + rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 4] = x[: n // 4] + rng.normal(size=(n // 4, dim)) * rng.uniform(0.05, 0.9, (n // 4, 1))
    x[-n // 20 :] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.9])
def test_similar_classes_find_nearly_all_in_short_lists(spark, monkeypatch, threshold):
    from siftwork.operators import lists

    x = skewed(4000, 1)
    df = spark.createDataFrame([(n, [float(e) for e in v]) for n, v in enumerate(x)] + [(None, [1.0] * 64)], "id long, v array<float>")
    monkeypatch.setattr(lists.fit, "__defaults__", (*lists.fit.__defaults__[:2], lists.SAMPLE, 100, *lists.fit.__defaults__[4:6], 150))
    members, pairs = ann.similar_classes(df, 64, threshold)
    _, every = ann.similar_classes(df, 64, threshold, exact=True)
    got, want = ({(r["a"], r["b"]) for r in p.collect()} for p in (pairs, every))
    assert got <= want and len(got) >= 0.95 * len(want) > 400
    assert all(a < b for a, b in got)
    first = {r["id"]: r["first"] for r in members.collect()}
    assert len(first) == 4000 and first[3999] == 0 and sum(k != v for k, v in first.items()) == 200
    assert {(r["a"], r["b"]) for r in ann.linked(members, pairs).where("score = 1").collect()} >= {(0, k) for k in range(3800, 4000)}


def test_centroids_hold_about_their_share():
    from siftwork.operators import lists

    x = np.unique(skewed(20_000, 2), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = lists.balanced_centroids(x[np.random.default_rng(0).permutation(len(x))[:6400]], 200)
    held = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert 180 <= len(c) <= 260 and held.max() < 3.5 * held.mean(), held.max() / held.mean()


def test_a_crowded_list_is_compared_in_blocks(spark):
    from siftwork.operators import lists

    x = skewed(3000, 3)
    df = spark.createDataFrame([(n, [float(e) for e in v]) for n, v in enumerate(x)], "id long, embedding array<float>").select("id", "embedding", F.xxhash64("embedding").alias("class_a"), F.xxhash64(F.lit(1), "embedding").alias("class_b"))
    found = {}
    for cell in (100_000, 250):
        index = lists.fit(df, 64, 0.8, list_size=1500, cell=cell)
        posted = lists.post(df, index, 64)
        sizes = [r["count"] for r in posted.groupBy("list", "cell").count().collect()]
        pairs = lists.alike_in_lists(posted, 64, 0.8).select("a_a", "b_a").collect()
        near = lists.nearest_in_lists(posted, 64, 3, 0.8).select("a_a", "b_a").distinct().collect()
        found[cell] = max(sizes), sorted(map(tuple, pairs)), sorted(map(tuple, near))
    assert found[250][0] < 800 < found[100_000][0], "a cell holds two blocks at most"
    assert found[250][1] == found[100_000][1] and len(found[250][1]) > 500
    assert set(found[100_000][2]) <= set(found[250][2])


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan", "jaccard"])
def test_exact_topk_in_blocks_of_queries(spark, metric):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6))
    x[50:60] = x[0]
    df = vectors(spark, dict(enumerate(x)) | {400: None, 401: [1.0]})
    q = df.where("id % 2 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    got, again = ([(r["query"], r["id"], r["rank"]) for r in ann.exact_topk(df, q, 3, metric, block=b).orderBy("query", "rank").collect()] for b in (4096, 30))
    assert got == again and len(got) == 600
    m = ann.METRICS[metric].similarity
    pairs = df.join(q, F.size("v") == F.size("qv")).where("id <> query").select("query", "id", m(F.col("qv"), F.col("v")).alias("score"))
    assert got == [(r["query"], r["id"], r["rank"]) for r in ann.top_per(pairs.withColumn("score", F.round("score", 10)), "query", 3).orderBy("query", "rank").collect()]
    assert ann.similarity_rows(df, q, metric, block=30).count() == 200 * 400


def test_many_exact_queries_need_no_cross_join(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(n, [float(e) for e in v]) for n, v in enumerate(rng.normal(size=(5000, 4)))], "id long, v array<double>")
    found = ann.exact_topk(df, df.select(F.col("id").alias("query"), F.col("v").alias("qv")), 200)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == 5000 * 200


def test_pair_queries_equal_brute_force(spark, tmp_path):
    from siftwork.plans import vectors as P

    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.6]).astype(np.float32)
    rows = [(f"v{n:03d}", [float(e) for e in e], 1) for n, e in enumerate(x)] + [(None, [1.0] * 64, 1), ("v000", None, 0)]
    spark.createDataFrame(rows, "id string, embedding array<float>, updated_at long").write.parquet(f"{tmp_path}/vectors.parquet")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(f"v{a:03d}", f"v{b:03d}") for a in range(240) for b in range(a + 1, 240) if u[a] @ u[b] >= 0.8}
    got = {(r["a"], r["b"]) for r in P.vec_semantic_duplicates(spark, str(tmp_path)).collect()}
    assert len(want) > 60 and got == want


def sequential_leaders(n, edges):
    leader = {}
    for i in range(n):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, n):
            if j not in leader and (i, j) in edges:
                leader[j] = i
    return leader


@pytest.mark.parametrize("seed", range(4))
def test_leader_clusters(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 20)
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25}
    items = spark.createDataFrame([(i,) for i in range(n)], "id long")
    pairs = spark.createDataFrame(list(edges) or [(0, 1)], "a long, b long")
    got = {r["id"]: r["leader"] for r in clusters.leader_clusters(items, pairs).collect()}
    assert got == sequential_leaders(n, edges or {(0, 1)})


def test_blocks():
    code = "function a(x) {\n  return 1 + 2 + 3 + 4 + 5;\n}\nconst b = (y) => {\n  if (y) { z(); }\n  return y;\n};\nfunction tiny() {\n}\n"
    got = [(b["function_name"], b["line_start"], b["line_end"]) for b in scanners.blocks(code, 30)]
    assert got == [("a", 1, 3), ("b", 4, 7)]
    assert list(scanners.blocks("", 30)) == []
    assert [scanners.function_name(x) for x in ("function testFunc() {", "const myFunc = () => {", "  methodName(): void {")] == ["testFunc", "myFunc", "methodName"]


def test_patterns_and_routes():
    kinds = [p["kind"] for p in scanners.patterns("let x = load()?.await?;\nmatch Ok(x) {\n Ok(v) => v,\n}\nif let Some(y) = z {\n}\n")]
    assert kinds[:1] == ["error_handling_pattern"] and "match_error_handling" in kinds and "if_let_pattern" in kinds
    text = "const r: Routes = [\n{\npath: 'a',\ncomponent: A,\ncanActivate: [g, h],\n},\n{\npath: 'b',\nredirectTo: 'a',\n},\n];\n{\npath: 'c',\n},"
    got = list(scanners.routes(text))
    assert [(r["route"], r["component"], r["guards"], r["redirect_to"]) for r in got] == [("a", "A", ["g", "h"], None), ("b", "", [], "a")]


def test_manifest(spark):
    text = '[package]\nname = "p"\n[dependencies]\na = "1"\nb = { path = "../b", optional = true }\nc = { git = "u", features = ["f"] }\n[features]\ndefault = ["x"]\nx = []\n[lib]\nname = "l"\n[[bin]]\nname = "t"\n[workspace]\nmembers = ["m"]\n'
    df = spark.createDataFrame([("k", text), ("bad", "= ="), ("none", None)], "path string, content string")
    r = scanners.scan(df, scanners.manifest, "path", "content").collect()
    assert len(r) == 1
    r = r[0]
    assert (r["package_name"], r["version"], r["edition"], r["members"]) == ("p", "0.1.0", "2021", ["m"])
    assert [(d["name"], d["source"], d["optional"]) for d in r["dependencies"]] == [("a", "registry", False), ("b", "path", True), ("c", "git", False)]
    assert [(f["name"], f["is_default"]) for f in r["features"]] == [("default", False), ("x", True)]
    assert {(t["kind"], t["name"]) for t in r["targets"]} == {("bin", "t"), ("lib", "l")}


def sequential_pack(rows, budget):
    room = budget - budget // 20
    out, seen, used = [], set(), 0
    for i, file, score, tokens in sorted(rows, key=lambda r: (-r[2], r[0])):
        if file in seen or score < 0.1 or not tokens:
            continue
        seen.add(file)
        if used + tokens > room:
            if room - used > 0:
                out.append((i, room - used, True))
            break
        used += tokens
        out.append((i, tokens, False))
    return out


@pytest.mark.parametrize("budget", [40, 300, 1500, 20000])
def test_budget(spark, budget):
    rng = random.Random(budget)
    given = [(i, f"f{rng.randint(0, 12)}", round(rng.random(), 1), "x" * rng.randint(0, 900)) for i in range(60)]
    df = spark.createDataFrame(given, "id long, file string, score double, text string")
    got = [(r["id"], r["tokens"], r["cut"]) for r in S.pack_budget(df, "id", "file", "text", "score", budget).orderBy(F.desc("score"), "id").collect()]
    assert got == sequential_pack([(i, f, s, -(-len(t) * 2 // 9)) for i, f, s, t in given], budget)


def test_relevance(spark):
    df = spark.createDataFrame([("testFunction",), ("getUserData",), ("unrelated",)], "n string")
    got = [[r[0] for r in df.select(S.name_relevance(F.col("n"), p)).collect()] for p in ("testFunction", "test", "user")]
    assert got == [[1.0, 0, 0], [0.8, 0, 0], [0, 0.6, 0]]
    s = spark.range(1).select(ann.combined_score(F.lit(0.8), F.lit(0.9)).alias("s")).first()["s"]
    assert 0.8 < s < 0.9
    f = spark.createDataFrame([("a", "Rust", "Function", "/src/x", 3.0), ("b", "go", "Function", "/src/spec", 3.0), ("c", None, None, None, None)], "id string, language string, code_type string, file_path string, complexity double")
    assert [r["id"] for r in f.where(S.Filters(languages=["RUST"], least_complexity=1).condition()).collect()] == ["a"]
    assert f.where(S.Filters().condition()).count() == 3
    assert spark.range(1).select(S.lexical_score("", F.lit("a"), F.lit("b"))).first()[0] is None


def test_cache_tables(spark, tmp_path, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "X"), ("d", "4")], "path string, hash string")
    assert rows(cache.stale(old, now, "path", "hash"), "path", "reason") == [("b", "changed"), ("c", "deleted")]
    assert rows(cache.to_analyse(now, old, "path", "hash"), "path", "change_type") == [("b", "Modified"), ("d", "Created")]
    assert rows(cache.upsert(old, now, "path")) == [("a", "1"), ("b", "X"), ("c", None), ("d", "4")]
    t = cache.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.delete(old, "path") == 0 and not t.clear(True)
    t.write(old)
    t.upsert(now, "path")
    assert t.read().count() == 4 and t.read(1).count() == 3
    t.delete(now.where("path = 'a'"), "path")
    assert t.read().count() == 3
    assert not t.clear() and t.clear(confirm=True) and t.read().count() == 0
    assert t.prune(1) == [1, 2, 3] and t.versions() == [4]
    c = spark.createDataFrame([("p", 3, 1), ("q", 1, 1), ("r", 1, 2)], "h string, hits int, at int")
    assert rows(cache.evict(c, 2, "hits", ["at", "h"]), "h") == [("p",), ("r",)]
    hits = cache.hit_rate(cache.lookup(spark.createDataFrame([("p",), ("z",)], "h string"), c.withColumn("response", F.lit("x")), "h")).first()
    assert (hits["hits"], hits["misses"], hits["hit_rate"]) == (1, 1, 0.5)


LOG = "path string, revision long, hash string"


def log_of(spark, data):
    df = spark.createDataFrame(data, LOG)
    return changes.change_log(df, F.col("path"), F.col("revision"), F.col("hash"))


def test_change_log_skips_unreadable_rows(spark, rows):
    log = log_of(spark, [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, None), (None, 1, "x"), ("b", None, "x")])
    assert rows(changes.latest(log), "key", "offset", "state") == [("a", 2, "y")]
    assert changes.latest(log.limit(0)).count() == 0


def test_runs_neither_skip_nor_repeat(spark, tmp_path, rows):
    run = changes.ChangeRun(spark, f"file://{tmp_path}/run")
    first = log_of(spark, [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")])
    batch, plan = run.plan(first)
    assert batch == 0 and plan.count() == 3

    # the run fails after it wrote a part of its batch
    part = run.read_plan(0).where("key = 'a'").withColumn("batch", F.lit(0))
    part.write.mode("append").parquet(f"{run.folder}/sink")
    again, plan = run.plan(log_of(spark, [("a", 1, "x"), ("b", 2, "y")]))
    assert again == 0 and plan.count() == 3, "the unfinished plan is replayed, whatever the log says now"
    run.apply(again)
    run.apply(again)
    run.commit(again)
    assert rows(run.sink(), "key", "offset") == [("a", 1), ("b", 1), ("c", 1)]

    second = log_of(spark, [("a", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("d", 1, "z")])
    assert run.run(second) == 1
    assert rows(run.read_plan(1), "key", "offset") == [("b", 2), ("d", 1)]
    assert rows(run.done(), "key", "state") == [("a", "x"), ("b", "y"), ("c", "x"), ("d", "z")]
    assert run.run(log_of(spark, [("b", 1, "x")])) == 2, "a late state of a key changes nothing"
    assert run.read_plan(2).count() == 0
    assert {r["until"] for r in run.offsets().collect()} <= {1, 2}


def positioned(spark, data):
    df = spark.createDataFrame(data, LOG + ", at long")
    return changes.change_log(df, F.col("path"), F.col("revision"), F.col("hash"), position=F.col("at"))


@pytest.mark.parametrize("crash", ["after the plan", "half an apply", "after the apply", "before the plan is whole"])
def test_a_crash_at_any_step_loses_and_repeats_nothing(spark, tmp_path, rows, crash):
    run = changes.ChangeRun(spark, f"file://{tmp_path}/run")
    data = [("a", 1, "x", 10), ("b", 1, "x", 11), ("c", 1, "x", 12)]
    assert run.run(positioned(spark, data)) == 0
    data += [("a", 2, "y", 20), ("d", 1, "x", 21), ("e", 1, "x", 22)]
    log = positioned(spark, data)
    batch, plan = run.plan(log)
    assert (batch, rows(plan, "key", "offset")) == (1, [("a", 2), ("d", 1), ("e", 1)])
    if crash == "before the plan is whole":
        import os

        os.remove(f"{tmp_path}/run/plans/batch=00000001/_SUCCESS")
    if crash == "half an apply":
        plan.where("key = 'd'").withColumn("batch", F.lit(1)).write.mode("append").parquet(f"{run.folder}/sink")
    if crash == "after the apply":
        run.apply(1)
    # another process takes up the folder; more has come meanwhile
    run = changes.ChangeRun(spark, run.folder)
    more = [*data, ("f", 1, "x", 30), ("a", 3, "z", 31)]
    assert run.run(positioned(spark, more)) == 1
    if crash != "before the plan is whole":
        assert rows(run.read_plan(1), "key", "offset") == [("a", 2), ("d", 1), ("e", 1)]
        assert run.run(positioned(spark, more)) == 2
        assert rows(run.sink(), "key", "offset") == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1)]
    assert rows(run.done(), "key", "state") == [("a", "z"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x"), ("f", "x")]
    assert run.sink().groupBy("key", "offset").count().where("count > 1").isEmpty()


def test_a_plan_reads_each_partition_from_where_the_last_one_ended(spark, tmp_path, rows):
    run = changes.ChangeRun(spark, f"file://{tmp_path}/run", snapshot_every=2)
    keys = [f"k{n}" for n in range(200)]
    run.run(positioned(spark, [(k, 1, "x", 100 + n) for n, k in enumerate(keys)]))
    ends = dict(rows(run.offsets(), "part", "until"))
    assert len(ends) > 40 and max(ends.values()) == 299 and min(ends.values()) < 299
    # what lies before a partition's end isn't looked at any more; what lies at it is, and what has no position
    part_of = dict(rows(changes.latest(positioned(spark, [(k, 1, "x", 1) for k in keys])), "key", "part"))
    behind, at = [k for n, k in enumerate(keys) if 100 + n < ends[part_of[k]]][:1], [k for n, k in enumerate(keys) if 100 + n == ends[part_of[k]]][:1]
    run.run(positioned(spark, [(behind[0], 2, "y", 100), (at[0], 2, "y", ends[part_of[at[0]]]), ("new", 1, "x", None)]))
    assert rows(run.read_plan(1), "key") == sorted([(at[0],), ("new",)])
    # the snapshot that followed holds all keys once, and later runs go on from it
    assert run._last("states") == 2 and run.done().count() == 201
    assert run.run(positioned(spark, [(k, 1, "x", 1000) for k in keys] + [("last", 1, "x", 1001)])) == 2
    assert rows(run.read_plan(2), "key") == [("last",)]
    assert run.done().count() == 202 and run.run(positioned(spark, []).limit(0)) == 3 and run.read_plan(3).count() == 0


def test_a_run_adopts_what_was_recorded_before(spark, tmp_path, rows):
    run = changes.ChangeRun(spark, f"file://{tmp_path}/run")
    run.adopt(spark.createDataFrame([("a", "x"), ("b", None), ("gone", "x")], "key string, state string"))
    assert run.run(positioned(spark, [("a", 4, "x", 1), ("b", 1, "x", 2), ("c", 1, "x", 3)])) == 0
    assert rows(run.read_plan(0), "key") == [("b",), ("c",)]
    assert rows(run.done(), "key", "state") == [("a", "x"), ("b", "x"), ("c", "x"), ("gone", "x")]


def test_recorded_states(spark, rows):
    cache_rows = [("a", "X1", 1, 1), ("./a", "x2", 2, 2), (".\\a", "x3", 3, 3), ("b", None, 1, 1), ("c", "z", 5, None), (None, "q", 1, 1)]
    c = spark.createDataFrame(cache_rows, "path string, file_hash string, n int, run_id long").withColumn("last_analyzed", F.timestamp_seconds("n"))
    runs = spark.createDataFrame([(1, "succeeded"), (1, "succeeded"), (2, "succeeded"), (3, "failed"), (4, None)], "run_id long, status string")
    done = changes.recorded_states(c, runs)
    assert rows(done, "key", "state") == [("./a", "x2"), ("./b", None)]
    log = changes.file_log(spark.createDataFrame([("a", 1, "X2", 1), ("b", 1, "h", 1), ("d", 1, "h", 1)], "path string, revision int, hash string, n int").withColumn("received_at", F.timestamp_seconds("n")))
    assert rows(changes.pending(log, done), "key") == [("./b",), ("./d",)]
