"""Queries of search: lexical, by name, enhanced, reranked, filtered, packed into a budget. Null texts have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as N
from siftwork.operators import search as S
from siftwork.runtime import spread, table

#: The stated queries of these searches.
QUERY, WORDS, NAME = "export async function session", "the Lattice Handler for each error", "session"
ASKED = ("class api error handler", "function that fails\nand Retries; function", "keyring")
BUDGET, TOP = 4000, 50


def _fragments(spark, folder) -> DataFrame:
    f = table(spark, folder, "code_fragments").where("code_content IS NOT NULL")
    return f.groupBy("fragment_id").agg(F.max(F.struct("code_content", "function_name", "file_path", "language", "complexity_score")).alias("f")).select("fragment_id", "f.*").withColumn("function_name", F.coalesce("function_name", F.lit("")))


def _documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", "source", "doc_path")


def _lexical(query):
    return S.lexical_score(query, F.col("function_name"), F.col("code_content"))


def find_lexical(spark, folder):
    """The fifty best fragments."""
    return S.search(_fragments(spark, folder), _lexical(QUERY), "fragment_id", TOP).select("fragment_id", F.round("score", 6).alias("score"), "rank")


def find_lexical_scores(spark, folder):
    """The lexical score of every fragment."""
    return _fragments(spark, folder).select("fragment_id", F.round(_lexical(QUERY), 6).alias("score"))


def find_keywords(spark, folder):
    """As ``find_lexical`` for a description's keywords."""
    words = " ".join(w.lower() for w in WORDS.split() if len(w.encode()) > 2 and w not in N.STOP_WORDS)
    return S.search(_fragments(spark, folder), _lexical(words), "fragment_id", TOP).select("fragment_id", F.round("score", 6).alias("score"), "rank")


def find_by_name(spark, folder):
    """All fragments whose name holds the pattern, by how well it fits."""
    f = _fragments(spark, folder)
    return f.select("fragment_id", "function_name", S.name_relevance(F.col("function_name"), NAME).alias("score")).where("score > 0")


def find_enhanced(spark, folder):
    """Enhanced relevance above 0.05 of every fragment, with the token overlap as similarity."""
    f = _fragments(spark, folder)
    overlap = N.jaccard(N.words(F.col("code_content")), F.array(*[F.lit(w) for w in QUERY.split()]))
    score = S.enhanced_relevance(QUERY, overlap, F.col("function_name"), F.col("file_path"), F.col("code_content"))
    return f.select("fragment_id", F.round(score, 6).alias("score")).where("score > 0.05")


def find_similar_code(spark, folder):
    """Fragments whose words overlap with those of the fragment of least id by a quarter at least."""
    f = _fragments(spark, folder).select("fragment_id", N.words(F.col("code_content")).alias("w"))
    target = f.orderBy("fragment_id").limit(1).select(F.col("w").alias("target"))
    return f.join(target).select("fragment_id", F.round(N.jaccard(F.col("w"), F.col("target")), 6).alias("score")).where("score >= 0.25")


def _asked(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED)), "query int, question string")


def rank_documents(spark, folder):
    """Every document's score for each question (a stated, small set)."""
    d = S.text_facts(spread(_documents(spark, folder)), "text").join(_asked(spark))
    return d.select("query", "doc_id", F.round(S.rerank_score(F.col("question"), F.col("text"), facts=True), 6).alias("score"))


def rank_best(spark, folder):
    """The ten best documents of each question."""
    from siftwork.operators.ann import top_per

    r = rank_documents(spark, folder).withColumnRenamed("doc_id", "id")
    return top_per(r, "query", 10).select("query", F.col("id").alias("doc_id"), "score", "rank")


def rank_above(spark, folder):
    r = rank_documents(spark, folder).where("score >= 0.2")
    return r.select("query", "doc_id", S.score_confidence(F.col("score")).alias("confidence"))


def rank_reasons(spark, folder):
    return _documents(spark, folder).groupBy(S.impact_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def rank_files(spark, folder):
    """Files of the sources as texts to rank, by their score for the first question."""
    f = table(spark, folder, "source_files").where("path IS NOT NULL")
    return f.select("path", F.round(S.rerank_score(F.lit(ASKED[0]), S.path_document(F.col("path"))), 6).alias("score"))


def _combined(spark, folder) -> DataFrame:
    """Documents with a combined score: token overlap and rerank score for the first question."""
    from siftwork.operators.ann import combined_confidence, combined_score

    q = F.array(*[F.lit(w) for w in ASKED[0].split()])
    d = S.text_facts(spread(_documents(spark, folder)), "text").select("doc_id", "source", "doc_path", "text", N.jaccard(N.words(F.col("text")), q).alias("sim"), S.rerank_score(F.lit(ASKED[0]), F.col("text"), facts=True).alias("rr"))
    return d.withColumn("score", combined_score(F.col("sim"), F.col("rr"))).withColumn("confidence", combined_confidence(F.col("sim"), F.col("rr")))


def combined_scores(spark, folder):
    return _combined(spark, folder).select("doc_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def budget_pack(spark, folder):
    """The best documents, one for each source, in a token budget."""
    d = _combined(spark, folder).withColumn("score", F.round("score", 6))
    p = S.pack_budget(d, "doc_id", "source", "text", "score", BUDGET, 0.05)
    return p.select(F.col("id").alias("doc_id"), F.col("file").alias("source"), "score", "tokens", "upto", "cut")


def token_estimates(spark, folder):
    return _documents(spark, folder).select("doc_id", N.token_estimate(F.col("text")).alias("tokens"))


def doc_keywords(spark, folder):
    return _documents(spark, folder).select("doc_id", F.array_join(N.keywords(F.col("text")), " ").alias("keywords"))


def doc_exact_copies(spark, folder):
    """Texts that occur more than once: hash, copies, least id."""
    d = _documents(spark, folder).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1")


def filtered_search(spark, folder):
    """Filters after the limit: fewer rows than asked for."""
    f = _fragments(spark, folder).select("fragment_id", "function_name", "code_content", "file_path", "language", F.lit("Function").alias("code_type"), F.col("complexity_score").alias("complexity"))
    wanted = S.Filters(languages=["TypeScript", "rust"], include_paths=["/src/"], exclude_paths=["spec"], least_complexity=1.0, most_complexity=40.0)
    return S.search(f, _lexical(QUERY), "fragment_id", TOP, filters=wanted).select("fragment_id", "rank")


def filtered_first(spark, folder):
    """The same filters before the limit."""
    f = _fragments(spark, folder).select("fragment_id", "function_name", "code_content", "file_path", "language", F.lit("Function").alias("code_type"), F.col("complexity_score").alias("complexity"))
    wanted = S.Filters(languages=["TypeScript", "rust"], include_paths=["/src/"], exclude_paths=["spec"], least_complexity=1.0, most_complexity=40.0)
    return S.search(f, _lexical(QUERY), "fragment_id", TOP, filters=wanted, filter_after=False).select("fragment_id", "rank")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_F = "f AS (SELECT fragment_id, coalesce(x.function_name, '') AS function_name, x.code_content AS code_content, x.file_path AS file_path, x.language AS language, x.complexity AS complexity FROM (SELECT fragment_id, max(struct_pack(code_content := code_content, function_name := function_name, file_path := file_path, language := language, complexity := complexity_score)) AS x FROM code_fragments WHERE code_content IS NOT NULL GROUP BY fragment_id))"
_W = lambda t: rf"list_filter(regexp_split_to_array({t}, '[ \t\n\v\f\r]+'), lambda w: w <> '')"
_LINES = lambda t: f"(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} = '' OR ends_with({t}, chr(10)) THEN 0 ELSE 1 END)"


def _lex_sql(query: str) -> str:
    q = query.lower()
    parts = [f"contains(lower(code_content), '{q}')::INT"] + [f"2 * contains(lower(function_name), '{w}')::INT + contains(lower(code_content), '{w}')::INT" for w in q.split()]
    return f"1 / (1 + exp(-((({' + '.join(parts)}) / {len(q.split())}.0::DOUBLE - 1) * 2)))"


def _top_sql(score: str, where: str = "") -> str:
    return f"WITH {_F}, s AS (SELECT *, {score} AS score FROM f {where}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, fragment_id) AS rank FROM s)"


_JACCARD = lambda a, b: f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"
_LITERAL = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_RATIO = lambda a, b: f"(least({a}, {b}) / greatest({a}, {b})::DOUBLE)"


def _rerank_sql(q: str, t: str) -> str:
    both = lambda *ps: "((" + " OR ".join(f"contains(lower({q}), '{p}')" for p in ps) + ") AND (" + " OR ".join(f"contains(lower({t}), '{p}')" for p in ps) + "))::INT"
    punct = lambda x: rf"len(regexp_extract_all({x}, '[!-/:-@\[-`{{-~]'))"
    caps = lambda x: rf"len(regexp_extract_all({x}, '\p{{Lu}}'))"
    words = _W(f"lower({q})")
    keyword = f"len(list_filter({words}, lambda a: len(list_filter(string_split_regex(lower({t}), '[ \\t\\n\\v\\f\\r]+'), lambda d: contains(d, a))) > 0)) / len({words})::DOUBLE"
    structure = f"(CASE WHEN {punct(q)} > 0 AND {punct(t)} > 0 THEN {_RATIO(punct(q), punct(t))} * 0.3::DOUBLE ELSE 0 END + CASE WHEN {caps(q)} > 0 AND {caps(t)} > 0 THEN {_RATIO(caps(q), caps(t))} * 0.2::DOUBLE ELSE 0 END + CASE WHEN {_LINES(q)} > 1 AND {_LINES(t)} > 1 THEN {_RATIO(_LINES(q), _LINES(t))} * 0.5::DOUBLE ELSE 0 END)"
    r = _RATIO(f"strlen({q})", f"strlen({t})")
    length = f"CASE WHEN strlen({q}) = 0 OR strlen({t}) = 0 THEN 0 WHEN {r} > 0.5 THEN 1 - (1 - {r}) * 2 ELSE {r} * 2 END"
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {keyword} * 0.4::DOUBLE + least(1::DOUBLE, {both('function')} * 0.3::DOUBLE + {both('class', 'interface')} * 0.3::DOUBLE + {both('api')} * 0.2::DOUBLE + {both('error')} * 0.2::DOUBLE) * 0.3::DOUBLE + least(1::DOUBLE, {structure}) * 0.2::DOUBLE + ({length}) * 0.1::DOUBLE))"


_ASKED_SQL = "q(query, question) AS (VALUES " + ", ".join("({}, {})".format(n, "'" + x.replace("\n", "' || chr(10) || '") + "'") for n, x in enumerate(ASKED)) + ")"
_RANKED = f"WITH {_ASKED_SQL}, s AS (SELECT query::INT AS query, doc_id, round({_rerank_sql('question', 'text')}, 6) AS score FROM documents, q WHERE text IS NOT NULL)"
_COMBINED = f"c AS (SELECT doc_id, source, text, {_JACCARD(_W('text'), _LITERAL(ASKED[0].split()))} AS sim, {_rerank_sql(repr(ASKED[0]), 'text')} AS rr FROM documents WHERE text IS NOT NULL)"
_KEYWORDS = " ".join(w.lower() for w in WORDS.split() if len(w.encode()) > 2 and w not in N.STOP_WORDS)
_WANTED = "lower(language) IN ('typescript', 'rust') AND contains(file_path, '/src/') AND NOT contains(file_path, 'spec') AND complexity BETWEEN 1 AND 40"
_PATH_DOC = r"'File: ' || regexp_extract(path, '[^/]*$') || ' Type: ' || regexp_extract(path, '[^./]*$') || ' Directory: ' || string_split(path, '/')[-2] || ' Components: ' || replace(replace(replace(path, '/', ' '), '-', ' '), '_', ' ')"
ORACLES = {
    "find_lexical": _top_sql(_lex_sql(QUERY)) + f" SELECT fragment_id, round(score, 6) AS score, rank FROM r WHERE rank <= {TOP}",
    "find_lexical_scores": f"WITH {_F} SELECT fragment_id, round({_lex_sql(QUERY)}, 6) AS score FROM f",
    "find_keywords": _top_sql(_lex_sql(_KEYWORDS)) + f" SELECT fragment_id, round(score, 6) AS score, rank FROM r WHERE rank <= {TOP}",
    "find_by_name": f"WITH {_F}, s AS (SELECT fragment_id, function_name, CASE WHEN lower(function_name) = '{NAME}' THEN 1.0 WHEN starts_with(lower(function_name), '{NAME}') THEN 0.8 WHEN contains(lower(function_name), '{NAME}') THEN 0.6 ELSE 0 END::DOUBLE AS score FROM f) SELECT * FROM s WHERE score > 0",
    "find_enhanced": f"""WITH {_F}, s AS (SELECT fragment_id, {_JACCARD(_W('code_content'), _LITERAL(QUERY.split()))} * 0.6::DOUBLE + 0.25::DOUBLE * contains(lower(function_name), '{QUERY.lower()}')::INT
        + ({' + '.join(f"contains(lower(code_content), '{w}')::INT" for w in QUERY.split())}) / {len(QUERY.split())}.0::DOUBLE * 0.15::DOUBLE
        + {' + '.join(f"{g}::DOUBLE * contains(code_content, '{b}')::INT" for a, b, g in S.BOOSTS if a in QUERY)} + 0.03::DOUBLE * contains(lower(regexp_extract(file_path, '[^/]*$')), '{QUERY.lower()}')::INT AS x FROM f)
        SELECT fragment_id, round(1 / (1 + exp(-(x - 0.5) * 4)), 6) AS score FROM s WHERE round(1 / (1 + exp(-(x - 0.5) * 4)), 6) > 0.05""",
    "find_similar_code": f"WITH {_F}, t AS (SELECT {_W('code_content')} AS target FROM f ORDER BY fragment_id LIMIT 1), s AS (SELECT fragment_id, round({_JACCARD(_W('code_content'), 'target')}, 6) AS score FROM f, t) SELECT * FROM s WHERE score >= 0.25",
    "rank_documents": _RANKED + " SELECT query, doc_id, score FROM s",
    "rank_best": _RANKED + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query, doc_id, score, rank FROM r WHERE rank <= 10",
    "rank_above": _RANKED + " SELECT query, doc_id, CASE WHEN score > 0.8 THEN 0.9 WHEN score > 0.6 THEN 0.7 WHEN score > 0.4 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM s WHERE score >= 0.2",
    "rank_reasons": "SELECT CASE WHEN contains(lower(text), 'import') OR contains(lower(text), 'require') THEN 'imports' WHEN contains(lower(text), 'function') OR contains(lower(text), 'class') THEN 'definitions' WHEN contains(lower(text), 'interface') OR contains(lower(text), 'type') THEN 'types' ELSE 'patterns' END AS reason, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "rank_files": f"WITH p AS (SELECT path, {_PATH_DOC} AS doc FROM source_files WHERE path IS NOT NULL) SELECT path, round({_rerank_sql(repr(ASKED[0]), 'doc')}, 6) AS score FROM p",
    "combined_scores": f"WITH {_COMBINED} SELECT doc_id, round(sim * 0.4::DOUBLE + rr * 0.6::DOUBLE, 6) AS score, round((1 - abs(sim - rr)) * 0.3::DOUBLE + (sim + rr) / 2 * 0.7::DOUBLE, 6) AS confidence FROM c",
    "budget_pack": f"""WITH {_COMBINED}, s AS (SELECT doc_id, source, round(sim * 0.4::DOUBLE + rr * 0.6::DOUBLE, 6) AS score, ceil(strlen(text) * (1 / 4.5::DOUBLE))::BIGINT AS tokens FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s WHERE score >= 0.05 AND tokens > 0),
        u AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE n = 1)
        SELECT doc_id, source, score, CASE WHEN total <= {BUDGET - BUDGET // 20} THEN tokens ELSE {BUDGET - BUDGET // 20} - (total - tokens) END::BIGINT AS tokens, least(total, {BUDGET - BUDGET // 20})::BIGINT AS upto, total > {BUDGET - BUDGET // 20} AS cut FROM u WHERE total - tokens < {BUDGET - BUDGET // 20}""",
    "token_estimates": "SELECT doc_id, ceil(strlen(text) * (1 / 4.5::DOUBLE))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "doc_exact_copies": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "doc_keywords": rf"SELECT doc_id, array_to_string(list_transform(list_filter({_W('text')}, lambda w: strlen(w) > 2 AND w NOT IN {N.STOP_WORDS}), lambda w: lower(w)), ' ') AS keywords FROM documents WHERE text IS NOT NULL",
    "filtered_search": _top_sql(_lex_sql(QUERY)) + f" SELECT fragment_id, rank FROM r WHERE rank <= {TOP} AND {_WANTED}",
    "filtered_first": _top_sql(_lex_sql(QUERY), f"WHERE {_WANTED}") + f" SELECT fragment_id, rank FROM r WHERE rank <= {TOP}",
}
