"""Queries over vectors and embeddings. Searches take every row whose id is divisible by 20 as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import ann, clusters
from siftwork.runtime import table

DIM, TOP = 64, 10


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _entries(spark, folder) -> DataFrame:
    """The current vector of each id that has 64 finite numbers, not all zero."""
    v = table(spark, folder, "vectors").groupBy("id").agg(F.max_by("embedding", "updated_at").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where((F.size("v") == DIM) & finite & F.exists("v", lambda x: x != 0))


def _queries(spark, folder) -> DataFrame:
    return _vectors(spark, folder).where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))


def _topk(metric):
    def run(spark, folder):
        found = ann.exact_topk(_vectors(spark, folder), _queries(spark, folder), TOP, metric)
        return found.select("query", "id", F.round("score", 5).alias("score"))

    run.__name__ = f"vec_{metric}_topk"
    return run


def vec_normalized(spark, folder):
    """Each vector by all normalisations: one row for each position."""
    v = F.col("v")
    z = F.arrays_zip(*[F.transform(f(v), lambda x: F.round(x, 6)).alias(n) for n, f in (("l2", V.l2_normalize), ("l1", V.l1_normalize), ("minmax", V.minmax_normalize), ("zscore", V.zscore_normalize))])
    return _vectors(spark, folder).select("id", F.posexplode(z).alias("n", "z")).select("id", F.col("n").cast("long").alias("n"), "z.l2", "z.l1", "z.minmax", "z.zscore")


def vec_distances(spark, folder):
    """All metrics' distances between each vector and the query of its block of twenty."""
    q = _queries(spark, folder)
    pairs = _vectors(spark, folder).withColumn("query", F.col("id") - F.col("id") % 20).join(q, "query")
    return pairs.select("id", *[F.round(m.distance(F.col("qv"), F.col("v")), 5).alias(n) for n, m in V.METRICS.items() if n in ("cosine", "euclidean", "manhattan", "dot", "jaccard")])


def vec_threshold_search(spark, folder):
    found = ann.exact_topk(_vectors(spark, folder), _queries(spark, folder), TOP, "cosine", 0.3)
    return found.select("query", "id", F.round("score", 5).alias("score"))


def vec_filtered_after_limit(spark, folder):
    """A label filter that comes after the limit: it may leave fewer rows than there are."""
    v = _vectors(spark, folder)
    found = ann.exact_topk(v, _queries(spark, folder), TOP)
    wanted = v.select(F.col("id").alias("query"), F.col("label").alias("wanted"))
    return found.join(v.select("id", "label"), "id").join(wanted, "query").where("label = wanted").select("query", "id", "rank")


def vec_similarity_rows(spark, folder):
    """The rows of the similarity matrix that belong to the queries, 1 on the diagonal."""
    return ann.similarity_rows(_vectors(spark, folder), _queries(spark, folder)).select("query", "id", F.round("score", 5).alias("score"))


def vec_average_similarity(spark, folder):
    """Mean similarity of the pairs among the hundred least ids (a bounded sample by definition)."""
    first = _vectors(spark, folder).orderBy("id").limit(100)
    a, b = first.select(F.col("id").alias("a"), F.col("v").alias("av")), first.select(F.col("id").alias("b"), F.col("v").alias("bv"))
    return a.join(b, F.col("a") < F.col("b")).agg(F.round(F.coalesce(F.avg(V.cosine(F.col("av"), F.col("bv"))), F.lit(0.0)), 6).alias("average"))


def vec_signatures(spark, folder):
    return ann.signatures(_vectors(spark, folder), "id", "v", DIM)


def vec_bucket_stats(spark, folder):
    return ann.bucket_stats(ann.signatures(_vectors(spark, folder), "id", "v", DIM))


def vec_candidates(spark, folder):
    index = ann.signatures(_vectors(spark, folder), "id", "v", DIM)
    return ann.candidates(index, index.where("id % 20 = 0")).groupBy("query").agg(F.count("*").alias("n"))


def vec_ann_topk(spark, folder):
    found = ann.approximate_topk(_vectors(spark, folder), _queries(spark, folder), DIM, TOP, least=0.3)
    return found.select("query", "id", F.round("score", 5).alias("score"))


def vec_duplicate_pairs(spark, folder):
    """The pairs of entries of cosine above 0.9, equal vectors standing as the first of them, to which the others are linked."""
    return ann.linked(*ann.similar_classes(_entries(spark, folder), DIM, 0.9)).select("a", "b", F.round("score", 5).alias("score"))


def vec_semantic_duplicates(spark, folder):
    """The pairs of entries of cosine 0.8 and more, equal vectors standing as the first of them, to which the others are linked."""
    return ann.linked(*ann.similar_classes(_entries(spark, folder), DIM, 0.8, strict=False)).select("a", "b", F.round("score", 5).alias("score"))


def vec_leader_clusters(spark, folder):
    """The leader of each entry. Equal vectors have one leader, so the first of them is clustered for all."""
    members, pairs = ann.similar_classes(_entries(spark, folder), DIM, 0.75)
    found = clusters.leader_clusters(members.select(F.col("first").alias("id")), pairs)
    return members.join(found.select(F.col("id").alias("first"), "leader"), "first").select("id", "leader")


def vec_cluster_sizes(spark, folder):
    """Clusters of two and more, numbered by their leader."""
    c = vec_leader_clusters(spark, folder).groupBy("leader").agg(F.count("*").alias("members"))
    return c.where("members > 1")


def vec_quantized(spark, folder):
    """Eight-bit quantisation: scale and greatest error of each vector."""
    q = _vectors(spark, folder).select("id", "v", V.int8_quantize(F.col("v")).alias("q"))
    error = F.array_max(F.zip_with("v", "q.codes", lambda x, c: F.abs(x.cast("double") - c * F.col("q.scale"))))
    return q.select("id", F.round("q.scale", 8).alias("scale"), (error <= F.col("q.scale") * 0.5000001).alias("within_half"))


def vec_store_stats(spark, folder):
    """Counts of the vectors by language and by kind, and in all."""
    v = table(spark, folder, "vectors")
    g = v.groupingSets([[F.col("language")], [F.col("code_type")], []], F.col("language"), F.col("code_type")).agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    return g.select("language", "code_type", "n", "files")


def vec_by_file(spark, folder):
    return table(spark, folder, "vectors").groupBy("file_path").agg(F.countDistinct("id").alias("ids"))


def vec_current(spark, folder):
    """Upsert: of each id the row last updated; of rows updated at once the one of greatest hash."""
    v = table(spark, folder, "vectors")
    top = F.max_by(F.struct("file_path", "hash", "line_start"), F.struct("updated_at", "hash"))
    return v.groupBy("id").agg(top.alias("t")).select("id", "t.file_path", "t.hash", "t.line_start")


def vec_deleted_by_file(spark, folder):
    """What is left after the vectors of changed files are deleted."""
    m = table(spark, folder, "file_metadata").where("revision > 1").select(F.col("path").alias("file_path")).distinct()
    return table(spark, folder, "vectors").join(m, "file_path", "left_anti").groupBy("language").agg(F.count("*").alias("n"))


_LOCAL = [f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith("vec_")]
QUERIES = {f.__name__: f for f in [*map(_topk, ("cosine", "euclidean", "manhattan", "dot", "jaccard")), *_LOCAL]}

_D = lambda v: f"list_transform({v}, lambda x: x::DOUBLE)"
_ALL = f"SELECT vec_id AS id, {_D('embedding')} AS v, label FROM embeddings"
_ASKED = "SELECT id AS query, v AS qv FROM e WHERE id % 20 = 0"
_SIM = {
    "cosine": "list_cosine_similarity(qv, v)",
    "euclidean": "exp(-list_distance(qv, v))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(qv, v), lambda z: abs(z[1] - z[2]))))",
    "dot": "list_inner_product(qv, v)",
    "jaccard": "len(list_filter(list_zip(qv, v), lambda z: z[1] > 0 AND z[2] > 0)) / len(list_filter(list_zip(qv, v), lambda z: z[1] > 0 OR z[2] > 0))",
}
_PAIRED = f"WITH e AS ({_ALL}), q AS ({_ASKED}), s AS (SELECT query, id, label, §1 AS score FROM e, q WHERE id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s §2)"


def _paired(score: str, where: str = "") -> str:
    return _PAIRED.replace("§1", score).replace("§2", where)


_a, _b, _c, _m, _s = ann.PLANE_FACTORS
def _index(bits: int) -> str:
    return f"""planes AS (SELECT t, i, list(((x * {_m} + {_s}) % 2147483648) / 2147483648.0::DOUBLE - 0.5::DOUBLE ORDER BY d) AS p FROM
        (SELECT t, i, d, (((t + 1) * {_a} + (i + 1) * {_b} + (d + 1) * {_c}) % 2147483648 * {_m} + {_s}) % 2147483648 AS x FROM range({ann.TABLES}) a(t), range({bits}) b(i), range({DIM}) c(d)) GROUP BY t, i),
        sig AS (SELECT id, t::INT AS table_id, sum(CASE WHEN list_inner_product(v, p) >= 0 THEN (1 << i) ELSE 0 END)::BIGINT AS bucket FROM e, planes GROUP BY id, t)"""


_INDEX = _index(ann.BITS)
_ENTRIES = f"SELECT id, {_D('v')} AS v FROM (SELECT id, arg_max(struct_pack(e := embedding), updated_at).e AS v FROM vectors GROUP BY id) WHERE len(v) = {DIM} AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_CLASSES = f"WITH e AS ({_ENTRIES}), f AS (SELECT id, v, min(id) OVER (PARTITION BY v) AS first FROM e), c AS (SELECT id, v FROM f WHERE id = first), copies AS (SELECT first AS a, id AS b, 1.0::DOUBLE AS score FROM f WHERE id <> first), scored AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS score FROM c x JOIN c y ON x.id < y.id)"
#: The buckets of a query, nearest first: its own with each set of bits flipped, by the sum of squared distances to their planes.
_PROBED = f"""offs AS (SELECT id, t, list(list_inner_product(v, p) ORDER BY i) AS o FROM e, planes WHERE id % 20 = 0 GROUP BY id, t),
        flips AS (SELECT id, t, f, list_sum(list_transform(range({ann.BITS}), lambda i: CASE WHEN (f >> i) & 1 = 1 THEN o[i + 1] * o[i + 1] ELSE 0 END)) AS cost, list_sum(list_transform(range({ann.BITS}), lambda i: CASE WHEN o[i + 1] >= 0 THEN 1 << i ELSE 0 END))::BIGINT AS own FROM offs, range({1 << ann.BITS}) k(f)),
        probed AS (SELECT id, t::INT AS table_id, xor(own, f::BIGINT) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY cost, f) AS n FROM flips) WHERE n <= {ann.PROBES})"""
_STD = "sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v))"
ORACLES = {f"vec_{n}_topk": _paired(s) + f" SELECT query, id, round(score, 5) + 0 AS score FROM r WHERE rank <= {TOP}" for n, s in _SIM.items()} | {
    "vec_threshold_search": _paired(_SIM["cosine"], "WHERE score >= 0.3") + f" SELECT query, id, round(score, 5) + 0 AS score FROM r WHERE rank <= {TOP}",
    "vec_filtered_after_limit": _paired(_SIM["cosine"]) + f" SELECT query, r.id, rank FROM r JOIN e ON e.id = query AND e.label = r.label WHERE rank <= {TOP}",
    "vec_similarity_rows": f"WITH e AS ({_ALL}), q AS ({_ASKED}) SELECT query, id, CASE WHEN id = query THEN 1.0::DOUBLE ELSE round(list_cosine_similarity(qv, v), 5) + 0 END AS score FROM e, q",
    "vec_average_similarity": f"WITH e AS (SELECT * FROM ({_ALL}) ORDER BY id LIMIT 100) SELECT round(coalesce(avg(list_cosine_similarity(a.v, b.v)), 0), 6) AS average FROM e a JOIN e b ON a.id < b.id",
    "vec_distances": f"WITH e AS ({_ALL}), q AS ({_ASKED}) SELECT id, round(greatest(1 - {_SIM['cosine']}, 0), 5) + 0 AS cosine, round(list_distance(qv, v), 5) AS euclidean, round(list_sum(list_transform(list_zip(qv, v), lambda z: abs(z[1] - z[2]))), 5) AS manhattan, round(2 - 2 * list_inner_product(qv, v), 5) + 0 AS dot, round(1 - {_SIM['jaccard']}, 5) AS jaccard FROM e JOIN q ON query = id - id % 20",
    "vec_normalized": f"WITH e AS ({_ALL}), k AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n2, list_sum(list_transform(v, lambda x: abs(x))) AS n1, list_min(v) AS lo, list_max(v) AS hi, list_avg(v) AS m FROM e), z AS (SELECT *, {_STD} AS sd FROM k) SELECT id, unnest(range(len(v))) AS n, unnest(list_transform(v, lambda x: round(x / n2, 6) + 0)) AS l2, unnest(list_transform(v, lambda x: round(x / n1, 6) + 0)) AS l1, unnest(list_transform(v, lambda x: round((x - lo) / (hi - lo), 6))) AS minmax, unnest(list_transform(v, lambda x: round((x - m) / sd, 6) + 0)) AS zscore FROM z",
    "vec_signatures": f"WITH e AS ({_ALL}), {_INDEX} SELECT id, table_id, bucket FROM sig",
    "vec_bucket_stats": f"WITH e AS ({_ALL}), {_INDEX}, n AS (SELECT count(*) AS n FROM sig GROUP BY table_id, bucket) SELECT (SELECT count(DISTINCT id) FROM sig) AS ids, count(*) AS buckets, avg(n) AS mean_size, list_sort(list(n))[count(*) // 2 + 1] AS median_size FROM n",
    "vec_candidates": f"WITH e AS ({_ALL}), {_INDEX} SELECT q.id AS query, count(DISTINCT s.id) AS n FROM sig q JOIN sig s ON s.table_id = q.table_id AND s.bucket = q.bucket WHERE q.id % 20 = 0 GROUP BY q.id",
    "vec_ann_topk": f"WITH e AS ({_ALL}), {_INDEX}, {_PROBED}, c AS (SELECT DISTINCT q.id AS query, s.id AS id FROM probed q JOIN sig s ON s.table_id = q.table_id AND s.bucket = q.bucket AND s.id <> q.id), s AS (SELECT query, c.id, list_cosine_similarity(x.v, y.v) AS score FROM c JOIN e x ON x.id = query JOIN e y ON y.id = c.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.3) SELECT query, id, round(score, 5) + 0 AS score FROM r WHERE rank <= {TOP}",
    "vec_duplicate_pairs": _CLASSES + " SELECT a, b, round(score, 5) + 0 AS score FROM scored WHERE score > 0.9 UNION ALL SELECT * FROM copies",
    "vec_semantic_duplicates": _CLASSES + " SELECT a, b, round(score, 5) + 0 AS score FROM scored WHERE score >= 0.8 UNION ALL SELECT * FROM copies",
    "vec_quantized": f"WITH e AS ({_ALL}), k AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM e) SELECT id, round(s, 8) AS scale, list_max(list_transform(v, lambda x: abs(x - round(x / s) * s))) <= s * 0.5000001::DOUBLE AS within_half FROM k",
    "vec_store_stats": "SELECT language, code_type, count(*) AS n, count(DISTINCT file_path) AS files FROM vectors GROUP BY GROUPING SETS ((language), (code_type), ())",
    "vec_by_file": "SELECT file_path, count(DISTINCT id) AS ids FROM vectors GROUP BY file_path",
    "vec_current": "SELECT id, t.file_path AS file_path, t.hash AS hash, t.line_start AS line_start FROM (SELECT id, arg_max(struct_pack(file_path := file_path, hash := hash, line_start := line_start), struct_pack(u := updated_at, h := hash)) AS t FROM vectors GROUP BY id)",
    "vec_deleted_by_file": "SELECT language, count(*) AS n FROM vectors WHERE file_path NOT IN (SELECT path FROM file_metadata WHERE revision > 1 AND path IS NOT NULL) GROUP BY language",
}
