"""Queries over the analysis history, file metadata and events: cache maintenance, rollups, health, changes, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import classify as C
from siftwork.functions import extract as X
from siftwork.functions import responses as R
from siftwork.functions.paths import normal_path
from siftwork.operators import cache as K
from siftwork.runtime import table

#: Responses that a cache may hold.
MOST_RESPONSES = 200


#: Where the facts of a cached entry lie.
_ENTRY_FACTS = {"size": "metadata.size", "n_lines": "metadata.line_count", "file_type": "summary.file_type"}


def _cache(spark, folder, *facts: str) -> DataFrame:
    """The last entry of every path, with the facts asked for; no other columns are read."""
    e = table(spark, folder, "cache_entry").where("path IS NOT NULL").select(normal_path("path").alias("path"), F.lower("file_hash").alias("hash"), "last_analyzed", *[F.col(_ENTRY_FACTS[f]).alias(f) for f in facts])
    return e.groupBy("path").agg(F.max(F.struct("last_analyzed", "hash", *facts)).alias("e")).select("path", "e.*")


def current_files(spark, folder, *facts: str) -> DataFrame:
    """The last state of every scanned file, with the facts asked for; no other columns are read."""
    m = table(spark, folder, "file_metadata").where("path IS NOT NULL AND hash IS NOT NULL").select(normal_path("path").alias("path"), F.lower("hash").alias("hash"), "revision", *facts)
    # repeated rows of a state may lack facts: each fact is the greatest that any of them has
    states = m.groupBy("path", "revision", "hash").agg(*[F.max(f).alias(f) for f in facts]) if facts else m
    return states.groupBy("path").agg(F.max(F.struct("revision", "hash", *facts)).alias("m")).select("path", "m.*")


def cache_stats(spark, folder):
    return K.table_stats(_cache(spark, folder, "size"), F.col("size"), F.col("last_analyzed"))


def cache_stale(spark, folder):
    """Entries whose file has changed or is gone from the sources."""
    s = table(spark, folder, "source_files").select("path", "hash")
    return K.stale(_cache(spark, folder), s, "path", "hash").select("path", "reason")


def cache_to_analyse(spark, folder):
    return K.to_analyse(current_files(spark, folder), _cache(spark, folder), "path", "hash").select("path", "change_type")


def cache_upserted(spark, folder):
    """The table after an upsert of the current files: rows and size by type."""
    new = current_files(spark, folder, "size", "file_type").select("path", "hash", "size", "file_type")
    return K.upsert(_cache(spark, folder, "size", "file_type").drop("last_analyzed"), new, "path").groupBy("file_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def cache_left(spark, folder):
    """Entries left after those without a source file are deleted."""
    gone = _cache(spark, folder).join(table(spark, folder, "source_files").select("path"), "path", "left_anti")
    return K.without(_cache(spark, folder, "file_type"), gone, "path").groupBy("file_type").agg(F.count("*").alias("n"))


def cache_run_actions(spark, folder):
    """What a run does: files added, updated, unchanged."""
    j = current_files(spark, folder).select("path", "hash").join(_cache(spark, folder).select("path", F.col("hash").alias("held"), F.lit(True).alias("there")), "path", "left")
    action = F.when(F.col("there").isNull(), "added").when(F.col("hash").eqNullSafe(F.col("held")), "unchanged").otherwise("updated")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def _requests(spark, folder) -> DataFrame:
    """Events as requests: the event type and value are the prompt, a user is a model."""
    e = table(spark, folder, "events")
    prompt = F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), K.prompt_hash(prompt, F.concat(F.lit("m"), F.col("user_id") % 3), F.lit("default")).alias("prompt_hash"))


def response_cache(spark, folder):
    """The responses that stay when the cache is full: those of most hits."""
    c = _requests(spark, folder).groupBy("prompt_hash").agg((F.count("*") - 1).alias("hit_count"), F.min("ts").alias("cached_at"))
    return K.evict(c, MOST_RESPONSES, "hit_count", ["cached_at", "prompt_hash"]).select("prompt_hash", "hit_count")


def response_hits(spark, folder):
    """The hit rate of the second half of the requests against responses to the first."""
    r = _requests(spark, folder)
    middle = r.agg(F.expr("timestamp_micros((unix_micros(min(ts)) + unix_micros(max(ts))) div 2)").alias("middle"))
    r = r.join(middle)
    held = r.where("ts <= middle").select("prompt_hash").distinct().withColumn("response", F.lit("r"))
    return K.hit_rate(K.lookup(r.where("ts > middle"), held, "prompt_hash"))


def report_health(spark, folder):
    """Mean complexity as a level, share of tests, total size."""
    m = current_files(spark, folder, "complexity", "file_type", "size")
    score = F.avg(F.when(F.col("complexity") == "Low", 1.0).when(F.col("complexity") == "Medium", 2.0).when(F.col("complexity") == "High", 3.0))
    level = F.when(F.col("score") < 1.5, "Low").when(F.col("score") < 2.5, "Medium").otherwise("High")
    a = m.agg(score.alias("score"), (F.count_if(F.col("file_type") == "Test") / F.count("*") * 100).alias("test_share"), F.sum("size").alias("total_size"), F.count("*").alias("files"))
    return a.select(level.alias("complexity"), F.round("score", 6).alias("score"), F.round("test_share", 6).alias("test_share"), "total_size", "files")


def report_recommendations(spark, folder):
    """Which recommendations hold."""
    tests = F.count_if(F.col("file_type") == "Test")
    a = current_files(spark, folder, "line_count", "complexity", "file_type", "size", "summary").agg(
        F.coalesce(F.bool_or((F.col("line_count") > 300) & (F.col("complexity") == "High")), F.lit(False)).alias("split_large_files"),
        (tests == 0).alias("add_tests"),
        ((tests > 0) & (tests / F.count("*") < 0.3)).alias("more_tests"),
        (F.coalesce(F.sum("size"), F.lit(0)) > 5 * 1024 * 1024).alias("lazy_loading"),
        F.coalesce(F.bool_or(F.contains("summary", F.lit(": any"))), F.lit(False)).alias("no_any"),
    )
    return a.unpivot([], a.columns, "recommendation", "holds").where("holds").select("recommendation")


def report_status(spark, folder):
    """Files, Rust and TypeScript files, complex files, mean size, health from 5 to 10."""
    m = current_files(spark, folder, "complexity", "size")
    ext = C.extension(F.col("path"))
    high = F.count_if(F.col("complexity") == "High")
    return m.agg(F.count("*").alias("files"), F.count_if(ext == "rs").alias("rust"), F.count_if(ext == "ts").alias("typescript"), high.alias("complex"), F.floor(F.coalesce(F.sum("size"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_size"), F.round(10.0 - high / F.greatest(F.count("*"), F.lit(1)) * 5.0, 6).alias("health"))


def report_largest(spark, folder):
    """The ten largest files."""
    return current_files(spark, folder, "size").where("size IS NOT NULL").orderBy(F.desc("size"), "path").limit(10).select("path", "size")


def report_by_type(spark, folder):
    """Rollup by project and type."""
    m = current_files(spark, folder, "project", "file_type", "line_count")
    return m.rollup("project", "file_type").agg(F.count("*").alias("n"), F.sum("line_count").alias("n_lines"), F.grouping_id().alias("level"))


def report_modules(spark, folder):
    return current_files(spark, folder, "file_type").where("file_type = 'Module'").groupBy(C.module_type(F.col("path")).alias("module_type")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def report_summary(spark, folder):
    """One line for each project."""
    p = current_files(spark, folder, "project", "complexity", "size").where("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("complexity") == "High").alias("h"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    return p.select("project", F.format_string("%s: %d files, %d complex, %d bytes", "project", "n", "h", "s").alias("line"))


def _changed(spark, folder) -> DataFrame:
    """Files whose last two states differ, with the difference in lines, by project."""
    m = table(spark, folder, "file_metadata").where("path IS NOT NULL AND hash IS NOT NULL").select(normal_path("path").alias("path"), "project", "revision", F.lower("hash").alias("hash"), "line_count").dropDuplicates(["path", "revision"])
    w = Window.partitionBy("path").orderBy("revision")
    m = m.withColumn("before", F.lag("hash").over(w)).withColumn("next", F.lead("revision").over(w)).where("next IS NULL")
    return m.where("before IS NOT NULL AND before <> hash").select("path", F.substring_index(F.substring_index("path", "/", 3), "/", -1).alias("project"), "revision")


def change_scope(spark, folder):
    """How far the changes of each project reach, and what to do about them."""
    has = lambda *parts: F.bool_or(C.contains_any(F.col("path"), parts))
    g = _changed(spark, folder).groupBy("project").agg(F.count("*").alias("n"), has("service").alias("s"), has("component").alias("c"), has("config", "json").alias("j"))
    scope = F.when(F.col("j") | (F.col("n") > 10), "Global").when(F.col("s"), "Service").when(F.col("c"), "Component").otherwise("Local")
    actions = F.array_compact(F.array(F.lit("review"), F.when(F.col("s"), "test services"), F.when(F.col("c"), "verify components"), F.when(F.col("n") > 5, "run all tests")))
    return g.select("project", "n", scope.alias("scope"), F.array_join(actions, ",").alias("actions"))


def change_log_rollup(spark, folder):
    """Logged changes by type and level."""
    e = table(spark, folder, "cache_entry").select(F.explode("change_log").alias("c"))
    return e.groupBy("c.change_type", "c.impact_level").agg(F.count("*").alias("n"), F.sum("c.lines_changed").alias("n_lines"))


def change_days(spark, folder):
    """Analysed entries for each day and hour."""
    e = table(spark, folder, "cache_entry").where("last_analyzed IS NOT NULL")
    return e.groupBy(F.date_format("last_analyzed", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


def dependency_degrees(spark, folder):
    """For each path, how many entries depend on it (reverse adjacency of the last entries)."""
    e = table(spark, folder, "cache_entry").where("path IS NOT NULL").groupBy(normal_path("path").alias("path")).agg(F.max(F.struct("last_analyzed", "dependencies")).alias("e"))
    return e.select("path", F.explode(F.array_distinct("e.dependencies")).alias("target")).groupBy("target").agg(F.count("*").alias("dependents"))


def impact_files(spark, folder):
    """Impact of a change to each source file: dependencies, severity, score, confidence, kind."""
    c = F.col("content")
    f = table(spark, folder, "source_files").where("content IS NOT NULL").select("path", F.size(X.imports(c)).cast("long").alias("deps"), C.content_severity(c).alias("severity"), C.change_type(c).alias("change_type"))
    by = lambda low, medium, high, critical: F.when(F.col("severity") == "Low", low).when(F.col("severity") == "Medium", medium).when(F.col("severity") == "High", high).otherwise(critical)
    score = F.least(F.lit(1.0), F.col("deps") * 0.1 + by(0.1, 0.3, 0.6, 1.0))
    conf = F.least(F.lit(0.8), 0.6 + F.least(F.col("deps") * 0.02, F.lit(0.1)) + by(0.05, 0.1, 0.15, 0.2))
    kind = F.when(F.col("deps") == 0, "Minimal").when(F.col("deps") > 5, "Direct").otherwise("Indirect")
    return f.select("path", "deps", "severity", "change_type", F.round(score, 6).alias("score"), F.round(conf, 6).alias("confidence"), kind.alias("kind"))


def impact_functions(spark, folder):
    """Severity of a change to each extracted function: visibility, parameters, async."""
    f = table(spark, folder, "function_info").where("name IS NOT NULL")
    public = F.coalesce(F.exists("modifiers", lambda m: F.contains(m, F.lit("public")) | F.contains(m, F.lit("export"))), F.lit(False))
    score = F.when(public, 2).otherwise(0) + F.when(F.coalesce(F.size("parameters"), F.lit(0)) > 5, 1).otherwise(0) + F.when(F.coalesce("is_async", F.lit(False)), 1).otherwise(0)
    return f.select("file_path", "name", F.col("location.line").alias("line"), C.severity_level(score).alias("severity")).distinct()


def impact_cascade(spark, folder):
    """The files that a change of each module reaches directly."""
    f = table(spark, folder, "source_files").where("content IS NOT NULL").select("path", F.explode(F.array_distinct(X.imports(F.col("content")))).alias("module"))
    return f.select("module", "path", F.lit("Direct").alias("effect"), F.lit("Medium").alias("level"))


#: Responses made of a text's own facts, so that the parsers have well-formed, partial and plain inputs.
def _responses(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", "source")
    listed = F.to_json(F.struct(F.array(F.struct(F.lit("extends").alias("relationship_type"), F.col("source").alias("source"), F.lit("t").alias("target")), F.struct(F.lit("other").alias("relationship_type"), F.lit("a").alias("source"), F.lit("b").alias("target"))).alias("semantic_relationships"), (F.col("doc_id") % 10 / 10).alias("confidence")))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, F.lit('{"other": 1}')).otherwise(F.col("text")).alias("response"))


def response_relations(spark, folder):
    r = _responses(spark, folder).select("doc_id", F.explode(R.RELATIONSHIPS.rows(F.col("response"))).alias("r"))
    return r.select("doc_id", "r.kind", "r.source", "r.target", "r.strength")


def response_confidence(spark, folder):
    return _responses(spark, folder).select("doc_id", F.round(X.confidence(F.col("response")), 6).alias("confidence"))


def response_risk(spark, folder):
    """Risk that each document's words stand for."""
    r = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", R.risk_from_text(F.col("text")).alias("r"))
    return r.select("doc_id", "r.overall", "r.breaking", "r.regression", "r.performance", "r.security")


def json_props(spark, folder):
    """A number out of the events' JSON, by type."""
    k = F.from_json("props", "struct<k:long>")["k"]
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.round(F.sum("value"), 2).alias("value"))




QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith(("_", "current_files"))}

_N = "'.' || list_aggregate(list_transform(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), lambda s: '/' || s), 'string_agg', '')"
_CACHE = f"c AS (SELECT path, e.hash AS hash, e.last_analyzed AS last_analyzed, e.size AS size, e.n_lines AS n_lines, e.file_type AS file_type FROM (SELECT {_N} AS path, max(struct_pack(last_analyzed := last_analyzed, hash := lower(file_hash), size := metadata.size, n_lines := metadata.line_count, file_type := summary.file_type)) AS e FROM cache_entry WHERE path IS NOT NULL GROUP BY 1))"
_NOW = f"m AS (SELECT * FROM (SELECT {_N} AS path, revision, lower(hash) AS hash, max(size) AS size, max(line_count) AS line_count, max(file_type) AS file_type, max(complexity) AS complexity, max(summary) AS summary, max(project) AS project FROM file_metadata WHERE path IS NOT NULL AND hash IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY path ORDER BY revision DESC, hash DESC) = 1)"
_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]*)$', 1)"
_HAS = lambda t, *ss: "(" + " OR ".join(f"contains({t}, '{s}')" for s in ss) + ")"
_IMPORTS = r"regexp_extract_all(content, '(?m)^[ \t]*import [^\n]*? from [''\"]([^''\"\n]+)[''\"]', 1)"
_REQ = "r AS (SELECT event_id, ts, sha256(event_type || ':' || json_extract_string(props, '$.k') || 'm' || (user_id % 3) || 'default') AS prompt_hash FROM events)"
_FN = "(length(content) - length(replace(content, 'function', ''))) // 8"
_SEV = f"CASE WHEN s <= 1 THEN 'Low' WHEN s <= 3 THEN 'Medium' ELSE 'High' END"
_RESP = """d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'list' WHEN doc_id % 3 = 1 THEN 'other' WHEN json_valid(text) THEN 'json' ELSE 'text' END AS kind, text, source FROM documents WHERE text IS NOT NULL)"""
ORACLES = {
    "cache_stats": f"WITH {_CACHE} SELECT count(*) AS entries, coalesce(sum(size), 0)::BIGINT AS total_size, min(last_analyzed) AS oldest, max(last_analyzed) AS newest FROM c",
    "cache_stale": f"WITH {_CACHE} SELECT c.path, CASE WHEN s.path IS NULL THEN 'deleted' ELSE 'changed' END AS reason FROM c LEFT JOIN source_files s ON s.path = c.path WHERE s.path IS NULL OR c.hash IS DISTINCT FROM lower(s.hash)",
    "cache_to_analyse": f"WITH {_CACHE}, {_NOW} SELECT m.path, CASE WHEN c.path IS NULL THEN 'Created' ELSE 'Modified' END AS change_type FROM m LEFT JOIN c ON c.path = m.path WHERE c.path IS NULL OR m.hash IS DISTINCT FROM c.hash",
    "cache_upserted": f"WITH {_CACHE}, {_NOW} SELECT file_type, count(*) AS n, sum(size)::BIGINT AS size FROM (SELECT file_type, size FROM c WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT file_type, size FROM m) GROUP BY file_type",
    "cache_left": f"WITH {_CACHE} SELECT file_type, count(*) AS n FROM c WHERE path IN (SELECT path FROM source_files) GROUP BY file_type",
    "cache_run_actions": f"WITH {_CACHE}, {_NOW} SELECT CASE WHEN c.path IS NULL THEN 'added' WHEN m.hash IS NOT DISTINCT FROM c.hash THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM m LEFT JOIN c ON c.path = m.path GROUP BY 1",
    "response_cache": f"WITH {_REQ} SELECT prompt_hash, hit_count FROM (SELECT prompt_hash, count(*) - 1 AS hit_count, min(ts) AS cached_at FROM r GROUP BY 1) ORDER BY hit_count DESC, cached_at DESC, prompt_hash DESC LIMIT {MOST_RESPONSES}",
    "response_hits": f"WITH {_REQ}, w AS (SELECT *, make_timestamp((SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM r)) AS middle FROM r), h AS (SELECT prompt_hash IN (SELECT prompt_hash FROM w WHERE ts <= middle) AS hit FROM w WHERE ts > middle) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) / count(*)::DOUBLE AS hit_rate FROM h",
    "report_health": f"WITH {_NOW}, a AS (SELECT avg(CASE complexity WHEN 'Low' THEN 1.0::DOUBLE WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END) AS score, count(*) FILTER (file_type = 'Test') / count(*)::DOUBLE * 100 AS t, sum(size)::BIGINT AS total_size, count(*) AS files FROM m) SELECT CASE WHEN score < 1.5 THEN 'Low' WHEN score < 2.5 THEN 'Medium' ELSE 'High' END AS complexity, round(score, 6) AS score, round(t, 6) AS test_share, total_size, files FROM a",
    "report_recommendations": f"WITH {_NOW}, a AS (SELECT coalesce(bool_or(line_count > 300 AND complexity = 'High'), false) AS split_large_files, count(*) FILTER (file_type = 'Test') = 0 AS add_tests, count(*) FILTER (file_type = 'Test') > 0 AND count(*) FILTER (file_type = 'Test') / count(*)::DOUBLE < 0.3 AS more_tests, coalesce(sum(size), 0) > 5242880 AS lazy_loading, coalesce(bool_or(contains(summary, ': any')), false) AS no_any FROM m) SELECT recommendation FROM (UNPIVOT a ON * INTO NAME recommendation VALUE holds) WHERE holds",
    "report_status": f"WITH {_NOW} SELECT count(*) AS files, count(*) FILTER ({_EXT} = 'rs') AS rust, count(*) FILTER ({_EXT} = 'ts') AS typescript, count(*) FILTER (complexity = 'High') AS complex, floor(coalesce(sum(size), 0) / greatest(count(*), 1))::BIGINT AS mean_size, round(10 - count(*) FILTER (complexity = 'High') / greatest(count(*), 1)::DOUBLE * 5, 6) AS health FROM m",
    "report_largest": f"WITH {_NOW} SELECT path, size FROM m WHERE size IS NOT NULL ORDER BY size DESC, path LIMIT 10",
    "report_by_type": f"WITH {_NOW} SELECT project, file_type, count(*) AS n, sum(line_count)::BIGINT AS n_lines, grouping_id(project, file_type)::BIGINT AS level FROM m GROUP BY ROLLUP (project, file_type)",
    "report_modules": f"WITH {_NOW} SELECT CASE WHEN contains(path, 'app.module') THEN 'Root' WHEN contains(path, 'routing') THEN 'Routing' WHEN {_HAS('path', 'shared', 'core')} THEN 'Shared' ELSE 'Feature' END AS module_type, count(*) AS n, min(path) AS first_path FROM m WHERE file_type = 'Module' GROUP BY 1",
    "report_summary": f"WITH {_NOW} SELECT project, project || ': ' || count(*) || ' files, ' || count(*) FILTER (complexity = 'High') || ' complex, ' || coalesce(sum(size), 0) || ' bytes' AS line FROM m WHERE project IS NOT NULL GROUP BY project",
    "change_scope": f"""WITH s AS (SELECT DISTINCT {_N} AS path, revision, lower(hash) AS hash FROM file_metadata WHERE path IS NOT NULL AND hash IS NOT NULL), l AS (SELECT *, lag(hash) OVER w AS before, lead(revision) OVER w AS next FROM s WINDOW w AS (PARTITION BY path ORDER BY revision)),
        g AS (SELECT string_split(path, '/')[3] AS project, count(*) AS n, bool_or(contains(path, 'service')) AS s, bool_or(contains(path, 'component')) AS c, bool_or({_HAS('path', 'config', 'json')}) AS j FROM l WHERE next IS NULL AND before IS NOT NULL AND before <> hash GROUP BY 1)
        SELECT project, n, CASE WHEN j OR n > 10 THEN 'Global' WHEN s THEN 'Service' WHEN c THEN 'Component' ELSE 'Local' END AS scope, concat_ws(',', 'review', CASE WHEN s THEN 'test services' END, CASE WHEN c THEN 'verify components' END, CASE WHEN n > 5 THEN 'run all tests' END) AS actions FROM g""",
    "change_log_rollup": "SELECT c.change_type AS change_type, c.impact_level AS impact_level, count(*) AS n, sum(c.lines_changed)::BIGINT AS n_lines FROM (SELECT unnest(change_log) AS c FROM cache_entry) GROUP BY 1, 2",
    "change_days": "SELECT strftime(last_analyzed AT TIME ZONE 'UTC', '%Y-%m-%d %H') AS hour, count(*) AS n, count(DISTINCT run_id) AS runs FROM cache_entry WHERE last_analyzed IS NOT NULL GROUP BY 1",
    "dependency_degrees": f"WITH e AS (SELECT {_N} AS path, max(struct_pack(l := last_analyzed, d := dependencies)).d AS d FROM cache_entry WHERE path IS NOT NULL GROUP BY 1) SELECT target, count(*) AS dependents FROM (SELECT path, unnest(list_distinct(d)) AS target FROM e) GROUP BY target",
    "impact_files": f"""WITH f AS (SELECT path, len({_IMPORTS}) AS deps, 2 * contains(content, 'export')::INT + {_HAS('content', 'async', 'Promise')}::INT + ({_FN} > 5)::INT AS s,
        CASE WHEN {_HAS('content', '@Injectable', 'service')} THEN 'ServiceModification' WHEN {_HAS('content', '@Component', 'component')} THEN 'ComponentModification' WHEN {_HAS('content', 'test', 'spec')} THEN 'TestModification' ELSE 'CodeModification' END AS change_type FROM source_files WHERE content IS NOT NULL)
        SELECT path, deps, {_SEV} AS severity, change_type, round(least(1::DOUBLE, deps * 0.1::DOUBLE + CASE WHEN s <= 1 THEN 0.1 WHEN s <= 3 THEN 0.3 ELSE 0.6 END::DOUBLE), 6) AS score,
        round(least(0.8::DOUBLE, 0.6::DOUBLE + least(deps * 0.02::DOUBLE, 0.1::DOUBLE) + CASE WHEN s <= 1 THEN 0.05 WHEN s <= 3 THEN 0.1 ELSE 0.15 END::DOUBLE), 6) AS confidence, CASE WHEN deps = 0 THEN 'Minimal' WHEN deps > 5 THEN 'Direct' ELSE 'Indirect' END AS kind FROM f""",
    "impact_functions": "SELECT DISTINCT file_path, name, location.line AS line, CASE WHEN s <= 1 THEN 'Low' WHEN s <= 3 THEN 'Medium' ELSE 'High' END AS severity FROM (SELECT *, 2 * coalesce(len(list_filter(modifiers, lambda m: contains(m, 'public') OR contains(m, 'export'))) > 0, false)::INT + (coalesce(len(parameters), 0) > 5)::INT + coalesce(is_async, false)::INT AS s FROM function_info WHERE name IS NOT NULL)",
    "impact_cascade": f"SELECT unnest(list_distinct({_IMPORTS})) AS module, path, 'Direct' AS effect, 'Medium' AS level FROM source_files WHERE content IS NOT NULL",
    "response_relations": f"WITH {_RESP} SELECT doc_id, 'Extends' AS kind, source, 't' AS target, 0.5::DOUBLE AS strength FROM d WHERE kind = 'list' AND source IS NOT NULL UNION ALL SELECT doc_id, 'Uses', 'a', 'b', 0.5 FROM d WHERE kind = 'list' UNION ALL SELECT doc_id, 'Uses', 'detected_function', 'dependency_function', 0.6 FROM d WHERE kind = 'text' AND {_HAS('text', 'uses', 'depends')}",
    "response_confidence": f"WITH {_RESP} SELECT doc_id, CASE kind WHEN 'list' THEN round(doc_id % 10 / 10::DOUBLE, 6) WHEN 'other' THEN 0.8 WHEN 'json' THEN coalesce(try_cast(json_extract_string(CASE WHEN kind = 'json' THEN text END, '$.confidence') AS DOUBLE), 0.8) ELSE 0.7 END::DOUBLE AS confidence FROM d",
    "response_risk": f"SELECT doc_id, CASE WHEN {_HAS('text', 'critical', 'breaking', 'high risk', 'dangerous')} THEN 'High' WHEN {_HAS('text', 'medium risk', 'moderate')} THEN 'Medium' ELSE 'Low' END AS overall, CASE WHEN {_HAS('text', 'critical', 'breaking')} THEN 0.7 WHEN {_HAS('text', 'high risk', 'dangerous')} THEN 0.5 WHEN {_HAS('text', 'medium risk', 'moderate')} THEN 0.3 ELSE 0.1 END::DOUBLE AS breaking, CASE WHEN {_HAS('text', 'critical', 'breaking')} THEN 0.5 WHEN {_HAS('text', 'high risk', 'dangerous')} THEN 0.4 WHEN {_HAS('text', 'medium risk', 'moderate')} THEN 0.2 ELSE 0.1 END::DOUBLE AS regression, CASE WHEN {_HAS('text', 'performance', 'slow')} THEN 0.3 ELSE 0.1 END::DOUBLE AS performance, {_HAS('text', 'security', 'vulnerability')} AS security FROM documents WHERE text IS NOT NULL",
    "json_props": "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, round(sum(value), 2) AS value FROM events GROUP BY event_type",
}
