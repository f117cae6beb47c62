"""Queries over source files and code fragments: classifiers, measures, extraction. Null contents have no row unless a query says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import classify as C
from siftwork.functions import extract as X
from siftwork.functions import text as N
from siftwork.operators import scanners
from siftwork.runtime import spread, table


def c() -> Column:
    return F.col("content")


def p() -> Column:
    return F.col("path")


def code() -> Column:
    return F.col("code_content")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").where("content IS NOT NULL")


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_fragments").where("code_content IS NOT NULL")


def src_scan(spark, folder):
    """The files that a project scan keeps, with language and size in bytes."""
    return table(spark, folder, "source_files").where(C.is_scanned(p())).select("path", C.language(p()).alias("language"), F.octet_length("content").cast("long").alias("bytes"))


def src_lines(spark, folder):
    return _files(spark, folder).select("path", N.line_count(c()).alias("n_lines"), F.octet_length(c()).cast("long").alias("n_bytes"), F.length(c()).cast("long").alias("n_chars"))


def src_hash(spark, folder):
    """SHA-256 of each content, and whether the recorded hash is that."""
    return _files(spark, folder).select("path", F.sha2(c(), 256).alias("sha256"), (F.lower("hash") == F.sha2(c(), 256)).alias("matches"))


def src_types(spark, folder):
    return _files(spark, folder).select("path", C.path_type(p()).alias("path_type"), C.content_type(p(), c()).alias("content_type"), C.module_type(p()).alias("module_type"), C.is_test_path(p()).alias("is_test"))


def src_complexity(spark, folder):
    return spread(_files(spark, folder).select("path", "content")).select("path", C.cyclomatic(c()).cast("long").alias("cyclomatic"), C.complexity(c()).alias("complexity"), F.round(C.weighted_complexity(c()), 6).alias("weighted"), F.round(C.context_complexity(c()), 6).alias("contextual"))


def src_patterns(spark, folder):
    return _files(spark, folder).select("path", F.array_join(C.key_patterns(c()), ",").alias("key_patterns"), F.array_join(C.usage_patterns(c()), ",").alias("usage"), C.service_scope(c()).alias("scope"))


def src_flow(spark, folder):
    """What an interceptor-like file does: overlapping categories as flags."""
    return _files(spark, folder).select("path", N.contains_any(c(), C.ERROR_SIGNS).alias("handles_errors"), N.contains_any(c(), C.REQUEST_SIGNS).alias("changes_request"), N.contains_any(c(), C.RESPONSE_SIGNS).alias("changes_response"))


def src_imports(spark, folder):
    return _files(spark, folder).select("path", F.posexplode(X.imports(c())).alias("n", "module")).select("path", F.col("n").cast("long").alias("n"), "module")


def src_imported_names(spark, folder):
    return _files(spark, folder).select("path", F.explode(X.imported_names(c())).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def src_exports(spark, folder):
    return _files(spark, folder).select("path", F.array_join(X.exports(c()), ",").alias("exports"))


def src_plain_functions(spark, folder):
    return _files(spark, folder).select("path", F.explode(X.plain_functions(c())).alias("name"))


def src_dependencies(spark, folder):
    """Dependency edges of each file."""
    return spread(_files(spark, folder).select("path", "content")).select("path", F.explode(X.dependencies(c())).alias("d")).select("path", "d.kind", "d.target", "d.strength")


def src_dependents(spark, folder):
    """The reverse edges: for each imported module, how many files import it and which comes first."""
    e = _files(spark, folder).select("path", F.explode(F.array_distinct(X.imports(c()))).alias("module"))
    return e.groupBy("module").agg(F.count("*").alias("dependents"), F.min("path").alias("first_path"))


def src_components(spark, folder):
    i = _files(spark, folder).select("path", X.component_info(c()).alias("i")).where("i IS NOT NULL")
    return i.select("path", "i.selector", F.array_join("i.inputs", ",").alias("inputs"), F.array_join("i.outputs", ",").alias("outputs"), F.array_join(F.array_sort("i.hooks"), ",").alias("hooks"))


def src_services(spark, folder):
    """Injectable classes: class, scope, constructor types."""
    return _files(spark, folder).where(F.contains(c(), F.lit("@Injectable"))).select("path", F.get(X.class_names(c()), 0).alias("class"), C.service_scope(c()).alias("scope"), F.array_join(X.constructor_types(c()), ",").alias("constructor_types"))


def src_guards(spark, folder):
    g = _files(spark, folder).select("path", X.guard_info(p(), c()).alias("g")).where("g IS NOT NULL")
    return g.select("path", "g.name", "g.kind", F.array_join("g.dependencies", ",").alias("dependencies"))


def src_state(spark, folder):
    """Subjects, signals and observables of each injectable class."""
    s = _files(spark, folder).where(F.contains(c(), F.lit("@Injectable"))).select("path", X.state_properties(c()).alias("s"), X.observables(c()).alias("o"))
    return s.select("path", F.size("s").cast("long").alias("properties"), F.size("o").cast("long").alias("observables"), F.exists("o", lambda x: x["is_readonly"]).alias("any_readonly"), F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"))


def src_state_patterns(spark, folder):
    """How many classes hold state in which way; only ways that occur."""
    s = _files(spark, folder).where(F.contains(c(), F.lit("@Injectable"))).select(X.state_properties(c()).alias("s"), X.observables(c()).alias("o"))
    readonly = F.exists("o", lambda x: x["is_readonly"])
    agg = s.agg(
        F.count_if(F.exists("s", lambda x: x["kind"] == "BehaviorSubject")).alias("BehaviorSubject"),
        F.count_if(F.size("o") > 0).alias("Observable"),
        F.count_if(readonly).alias("Readonly observable"),
        F.coalesce(F.sum(F.size(F.filter("o", lambda x: F.endswith(x["name"], F.lit("$"))))), F.lit(0)).alias("Dollar suffix"),
        F.count_if(F.exists("s", lambda x: x["is_private"]) & readonly).alias("Encapsulation"),
    )
    return agg.unpivot([], agg.columns, "pattern", "n").where("n > 0")


def src_styles(spark, folder):
    return _files(spark, folder).where(C.extension(p()).isin("css", "scss")).select("path", F.size(X.custom_properties(c())).cast("long").alias("custom_properties"), F.array_join(F.coalesce(X.style_variables(c()), F.array().cast("array<string>")), ",").alias("variables"), F.array_join(F.coalesce(X.style_mixins(c()), F.array().cast("array<string>")), ",").alias("mixins"))


def src_summary(spark, folder):
    """A summary line for each file by its type."""
    kind = C.content_type(p(), c())
    said = F.format_string("%s with %d functions, %d imports, %d exports, %d lines", kind, F.size(X.plain_functions(c())), F.size(X.imports(c())), F.size(X.exports(c())), N.line_count(c()))
    return _files(spark, folder).select("path", said.alias("summary"))


def src_sections(spark, folder):
    """Sections of each file by its type, and how many test suites and cases it declares."""
    kind = C.content_type(p(), c())
    return _files(spark, folder).select("path", F.array_join(C.relevant_sections(kind, c()), ",").alias("sections"), N.count_of(c(), "describe(").cast("long").alias("suites"), N.count_of(c(), "#[test]").cast("long").alias("cases"))


def src_layered(spark, folder):
    """The first tier of a layered analysis: confident enough, or left to the next."""
    r = _files(spark, folder).select("path", C.layered_confidence(c()).alias("r"))
    return r.select("path", F.col("r.complexity").cast("long").alias("complexity"), F.col("r.dependencies").cast("long").alias("dependencies"), "r.confidence", F.when(F.col("r.confidence") >= 0.8, "static").otherwise("next").alias("tier"))


def src_functions_scanned(spark, folder):
    """Functions by brace counting."""
    f = _files(spark, folder).where(C.extension(p()).isin("ts", "js", "tsx", "jsx"))
    return scanners.scan(f, scanners.blocks, "path", "content", least_bytes=30)


def src_functions_measured(spark, folder):
    """Functions of more than 50 bytes with complexity and line count."""
    f = _files(spark, folder).where(C.extension(p()).isin("ts", "js"))
    s = scanners.scan(f, scanners.blocks, "path", "content", least_bytes=50)
    return s.select("path", "function_name", "function_signature", "line_start", C.cyclomatic(code()).cast("long").alias("complexity"), N.line_count(code()).alias("n_lines"))


def src_code_patterns(spark, folder):
    """Error handling and algorithms in Rust files."""
    return scanners.scan(_files(spark, folder).where(C.extension(p()) == "rs"), scanners.patterns, "path", "content")


def src_routes(spark, folder):
    return scanners.scan(_files(spark, folder).where(F.contains(c(), F.lit("Routes = ["))), scanners.routes, "path", "content")


def src_guard_routes(spark, folder):
    """Each guard with the routes that it protects; guards without routes have an empty list."""
    g = _files(spark, folder).select(X.guard_info(p(), c()).alias("g")).where("g IS NOT NULL").select(F.col("g.name").alias("guard")).distinct()
    r = src_routes(spark, folder).select("route", F.explode("guards").alias("guard"))
    return g.join(r, "guard", "left").groupBy("guard").agg(F.array_join(F.array_sort(F.collect_list("route")), ",").alias("routes"))


def frag_tokens(spark, folder):
    return _fragments(spark, folder).select("fragment_id", F.array_join(N.index_tokens(code()), " ").alias("tokens"))


def frag_names(spark, folder):
    """The name that a fragment's first line gives."""
    line = F.trim(N.first_line(code()))
    after = F.regexp_extract(line, r"^function\s+([^\s(]+)", 1)
    arrow = F.regexp_extract(F.substring_index(line, "=", 1), r"(\S+)\s*$", 1)
    other = F.regexp_replace(F.regexp_extract(F.substring_index(line, "(", 1), r"(\S+)\s*$", 1), ":+$", "")
    return _fragments(spark, folder).select("fragment_id", F.when(F.startswith(line, F.lit("function ")), after).when(F.contains(line, F.lit("=>")), arrow).otherwise(other).alias("name"))


def frag_preprocess(spark, folder):
    return _fragments(spark, folder).select("fragment_id", F.md5(N.preprocess(code())).alias("md5"))


def frag_snippets(spark, folder):
    return _fragments(spark, folder).select("fragment_id", N.snippet(code()).alias("snippet"))


def frag_context(spark, folder):
    """Two lines around the fragment's lines in its file."""
    f = _fragments(spark, folder).where("line_start IS NOT NULL AND line_end IS NOT NULL").select("fragment_id", F.col("file_path").alias("path"), "line_start", "line_end").distinct()
    return f.join(_files(spark, folder).select("path", "content"), "path").select("fragment_id", "line_start", "line_end", F.md5(N.context_lines(c(), F.col("line_start"), F.col("line_end"))).alias("md5"))


def frag_features(spark, folder):
    """Fifteen counts of a fragment, divided by their sum."""
    f = _features(code())
    total = F.aggregate(f, F.lit(0.0), lambda s, x: s + x)
    return _fragments(spark, folder).select("fragment_id", F.posexplode(F.when(total > 0, F.transform(f, lambda x: F.round(x / total, 9))).otherwise(f)).alias("n", "value")).select("fragment_id", F.col("n").cast("long").alias("n"), "value")


_COUNTED = ("function", "class", "if", "for", "while", "async", "await", "return", "@Component", "@Injectable", "Observable", "subscribe", "ngOnInit")


def _features(text):
    counts = [N.count_of(text, w).cast("double") for w in _COUNTED]
    return F.array(F.octet_length(text) / 1000.0, N.line_count(text) / 100.0, *counts)


def frag_scopes(spark, folder):
    return _fragments(spark, folder).select("fragment_id", C.impact_scope(code()).alias("scope"), C.change_type(code()).alias("change_type"), C.content_severity(code()).alias("severity"))


def frag_architecture(spark, folder):
    """Fragments by the first kind that their path names; kinds of more than one fragment."""
    fp = F.col("file_path")
    kind = F.when(F.contains(fp, F.lit("service")), "service").when(F.contains(fp, F.lit("component")), "component").when(F.contains(fp, F.lit("guard")), "guard").when(F.contains(fp, F.lit("interceptor")), "interceptor")
    return table(spark, folder, "code_fragments").select(kind.alias("kind"), "file_path").where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files")).where("n > 1")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith(("src_", "frag_"))}

# The same in SQL.
_N = lambda t, s: f"((length({t}) - length(replace({t}, '{s}', ''))) // {len(s)})"
_HAS = lambda t, *ss: "(" + " OR ".join(f"contains({t}, '{s}')" for s in ss) + ")"
_LINES = lambda t: f"(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} = '' OR ends_with({t}, chr(10)) THEN 0 ELSE 1 END)"
_LF = lambda t: f"replace({t}, chr(13) || chr(10), chr(10))"
_LIST = lambda t: f"string_split(CASE WHEN ends_with({t}, chr(10)) THEN left({_LF(t)}, length({_LF(t)}) - 1) ELSE {_LF(t)} END, chr(10))"
_FILES = "source_files WHERE content IS NOT NULL"
_FRAGMENTS = "code_fragments WHERE code_content IS NOT NULL"
_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]*)$', 1)"
_FILE = "regexp_extract(path, '[^/]*$')"
_PATH_TYPE = f"""CASE WHEN {_HAS('path', '.spec.', '.test.')} OR (contains(path, 'test') AND ends_with(path, '.rs')) THEN 'Test'
    WHEN {_FILE} IN ('Cargo.toml', 'Cargo.lock') THEN 'Config'
    WHEN {_EXT} = 'rs' AND NOT {_HAS('path', '/bin/', '/examples/')} AND ({_HAS('path', '/tests/', '/benches/')} OR starts_with(path, 'tests/') OR starts_with(path, 'benches/')) THEN 'Test'
    WHEN {_EXT} = 'ts' AND contains(path, 'component') THEN 'Component' WHEN {_EXT} = 'ts' AND contains(path, 'service') THEN 'Service'
    WHEN {_EXT} IN ('css', 'scss') THEN 'Style' WHEN {_EXT} IN ('json', 'toml') THEN 'Config' ELSE 'Other' END"""
_CONTENT_TYPE = f"""CASE WHEN {_EXT} = 'rs' THEN CASE {_FILE} WHEN 'lib.rs' THEN 'RustLibrary' WHEN 'main.rs' THEN 'RustBinary' WHEN 'mod.rs' THEN 'RustModule' ELSE
        CASE WHEN {_HAS('content', '#[cfg(test)]', '#[test]', 'mod tests')} THEN 'RustTest' WHEN {_HAS('content', '#[bench]', 'test::Bencher')} OR contains(path, 'benches') THEN 'RustBench' WHEN contains(content, 'fn main()') THEN 'RustBinary' ELSE 'RustModule' END END
    WHEN {_FILE} = 'Cargo.toml' THEN 'Cargo'
    WHEN {_EXT} IN ('ts', 'js') THEN CASE WHEN contains(content, '@Component') THEN 'Component' WHEN contains(content, '@Injectable') THEN 'Service' WHEN {_HAS('content', '@Pipe', 'implements PipeTransform')} THEN 'Pipe' WHEN contains(content, '@NgModule') THEN 'Module' ELSE {_PATH_TYPE} END
    ELSE {_PATH_TYPE} END"""
_CYCLO = lambda t: "(1 + " + " + ".join(_N(t, s) for s in C.DECISIONS) + ")"
_IMPORTS = r"regexp_extract_all(content, '(?m)^[ \t]*import [^\n]*? from [''\"]([^''\"\n]+)[''\"]', 1)"
_NAMES = r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(content, '(?m)^[ \t]*import[^{\n]*\{([^}\n]*)\}[^\n]*from', 1), lambda x: string_split(x, ','))), lambda x: trim(x)), lambda x: x <> '')"
_EXPORTS = r"regexp_extract_all(content, '(?m)^[ \t]*export (?:class|function|const)[ \t]+([^\s({=:<;/]+)', 1)"
_FUNCTIONS = r"regexp_extract_all(content, '(?m)(?:^|[^\w$])function\s+([\w$]+)\s*\(', 1)"
_INJECTABLE = f"{_FILES} AND contains(content, '@Injectable')"
_SCOPE = r"CASE regexp_extract(content, 'providedIn:\s*[''\"]([^''\"]*)[''\"]', 1) WHEN 'root' THEN 'Root' WHEN 'platform' THEN 'Platform' ELSE 'Module' END"
_GUARD = r"regexp_extract(path, '([^/]*?)(?:\.guard)?\.[^./]+$', 1)"

ORACLES = {
    "src_scan": f"SELECT path, CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + f" END AS language, strlen(content) AS bytes FROM source_files WHERE {_EXT} IN {C.SCANNED} AND NOT {_HAS('path', *C.IGNORED_PARTS)} AND NOT ends_with(path, '.min.js') AND NOT ends_with(path, '.min.css')",
    "src_lines": f"SELECT path, {_LINES('content')} AS n_lines, strlen(content) AS n_bytes, length(content) AS n_chars FROM {_FILES}",
    "src_hash": f"SELECT path, sha256(content) AS sha256, lower(hash) = sha256(content) AS matches FROM {_FILES}",
    "src_types": f"SELECT path, {_PATH_TYPE} AS path_type, {_CONTENT_TYPE} AS content_type, CASE WHEN contains(path, 'app.module') THEN 'Root' WHEN contains(path, 'routing') THEN 'Routing' WHEN {_HAS('path', 'shared', 'core')} THEN 'Shared' ELSE 'Feature' END AS module_type, {_HAS('path', 'test', 'spec')} AS is_test FROM {_FILES}",
    "src_complexity": f"""SELECT path, {_CYCLO('content')} AS cyclomatic,
        CASE WHEN s > 15 OR n > 500 THEN 'High' WHEN s >= 3 OR n > 200 THEN 'Medium' ELSE 'Low' END AS complexity,
        round(least(10.0, 1.0 + {' + '.join(f"{_N('content', t)} * {w}::DOUBLE" for t, w in C.WEIGHTED.items())}), 6) AS weighted,
        round(greatest(0.1::DOUBLE, n * 0.02::DOUBLE + {_N('content', 'if ')} * 0.3::DOUBLE + ({_N('content', 'for ')} + {_N('content', 'while ')}) * 0.4::DOUBLE + {_N('content', 'await ')} * 0.2::DOUBLE + {_N('content', 'try ')} * 0.3::DOUBLE + {_N('content', '.')} * 0.05::DOUBLE), 6) AS contextual
        FROM (SELECT *, {_LINES('content')} AS n, {' + '.join(_N('content', s) for s in C.DECLARATIONS)} + {_CYCLO('content')} / 5.0::DOUBLE AS s FROM {_FILES})""",
    "src_patterns": "SELECT path, concat_ws(',', " + ", ".join(f"CASE WHEN contains(content, '{w}') THEN '{w}' END" for w in C.PATTERN_WORDS) + ") AS key_patterns, concat_ws(',', " + ", ".join(f"CASE WHEN contains(content, '{w}') THEN '{v}' END" for w, v in C.USAGE.items()) + f") AS usage, {_SCOPE} AS scope FROM {_FILES}",
    "src_flow": f"SELECT path, {_HAS('content', *C.ERROR_SIGNS)} AS handles_errors, {_HAS('content', *C.REQUEST_SIGNS)} AS changes_request, {_HAS('content', *C.RESPONSE_SIGNS)} AS changes_response FROM {_FILES}",
    "src_imports": f"SELECT path, unnest(range(len(m))) AS n, unnest(m) AS module FROM (SELECT path, {_IMPORTS} AS m FROM {_FILES})",
    "src_imported_names": f"SELECT name, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, unnest({_NAMES}) AS name FROM {_FILES}) GROUP BY name",
    "src_exports": f"SELECT path, array_to_string({_EXPORTS}, ',') AS exports FROM {_FILES}",
    "src_plain_functions": f"SELECT path, unnest({_FUNCTIONS}) AS name FROM {_FILES}",
    "src_dependencies": rf"""WITH n AS (SELECT path, content, {_NAMES} AS named FROM {_FILES}),
        r AS (SELECT path, content, named, list_distinct(list_filter(list_transform({_LIST('content')}, lambda x: regexp_extract(x, '^[^.]*?(\w+)\.', 1)), lambda x: x <> '' AND NOT list_contains(named, x))) AS called FROM n),
        a AS (SELECT path, named, called, list_distinct(list_filter(regexp_extract_all(content, 'await (\w+)\.', 1), lambda x: NOT list_contains(named, x) AND NOT list_contains(called, x))) AS awaited FROM r)
        SELECT path, 'Import' AS kind, unnest(named) AS target, 0.8::DOUBLE AS strength FROM a UNION ALL SELECT path, 'FunctionCall', unnest(called), 0.6 FROM a UNION ALL SELECT path, 'FunctionCall', unnest(awaited), 0.7 FROM a""",
    "src_components": r"""SELECT path, nullif(regexp_extract(content, 'selector:\s*[''"]([^''"]+)[''"]', 1), '') AS selector, array_to_string(regexp_extract_all(content, '@Input\([^)]*\)\s*(?:\w+\s+)*?(\w+)\s*[!?]?\s*[:=;]', 1), ',') AS inputs, array_to_string(regexp_extract_all(content, '@Output\([^)]*\)\s*(?:\w+\s+)*?(\w+)\s*[!?]?\s*[:=;]', 1), ',') AS outputs,
        array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?m)^[ \t]*(ng(?:OnInit|OnDestroy|OnChanges|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked))\s*\(', 1))), ',') AS hooks FROM source_files WHERE content IS NOT NULL AND contains(content, '@Component')""",
    "frag_context": f"WITH f AS (SELECT DISTINCT fragment_id, file_path, line_start, line_end FROM code_fragments WHERE code_content IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL), l AS (SELECT path, CASE WHEN content = '' THEN [] ELSE {_LIST('content')} END AS ls FROM {_FILES}) SELECT fragment_id, line_start, line_end, md5(coalesce(array_to_string(ls[greatest(line_start - 2, 1):line_end + 2], chr(10)), '')) AS md5 FROM f JOIN l ON l.path = f.file_path",
    "src_dependents": f"SELECT module, count(*) AS dependents, min(path) AS first_path FROM (SELECT path, unnest(list_distinct({_IMPORTS})) AS module FROM {_FILES}) GROUP BY module",
    "src_services": rf"SELECT path, regexp_extract_all(content, '(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+)', 1)[1] AS class, {_SCOPE} AS scope, array_to_string(regexp_extract_all(regexp_extract(content, 'constructor\s*\(([^)]*)\)', 1), 'private\s+(?:readonly\s+)?\w+\s*:\s*([\w.<>\[\]]+)', 1), ',') AS constructor_types FROM {_INJECTABLE}",
    "src_guards": rf"SELECT path, {_GUARD} AS name, CASE WHEN contains(content, 'CanActivateFn') THEN 'CanActivate' WHEN contains(content, 'CanDeactivateFn') THEN 'CanDeactivate' WHEN contains(content, 'CanLoadFn') THEN 'CanLoad' WHEN contains(content, 'ResolveFn') THEN 'Resolve' WHEN contains(content, 'CanMatchFn') THEN 'CanMatch' ELSE 'CanActivate' END AS kind, array_to_string(list_transform(regexp_extract_all(content, 'inject\(([^)\n]*)\)', 1), lambda x: trim(x)), ',') AS dependencies FROM {_FILES} AND contains(path, '.guard.')",
    "src_layered": f"SELECT path, c AS complexity, d AS dependencies, k AS confidence, CASE WHEN k >= 0.8 THEN 'static' ELSE 'next' END AS tier FROM (SELECT *, CASE WHEN c <= 5 AND d <= 10 THEN 0.9::DOUBLE WHEN c <= 15 AND d <= 20 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS k FROM (SELECT path, CASE WHEN NOT {_HAS('content', 'if', 'for', 'while')} THEN 1 WHEN {_N('content', 'if')} > 3 OR {_N('content', 'for')} > 2 THEN 10 ELSE 5 END::BIGINT AS c, {_N('content', 'import')} + {_N('content', 'export')} AS d FROM {_FILES}))",
    "src_summary": f"SELECT path, {_CONTENT_TYPE} || ' with ' || len({_FUNCTIONS}) || ' functions, ' || len({_IMPORTS}) || ' imports, ' || len({_EXPORTS}) || ' exports, ' || {_LINES('content')} || ' lines' AS summary FROM {_FILES}",
    "src_sections": f"SELECT path, CASE {_CONTENT_TYPE} " + " ".join(f"WHEN '{k}' THEN concat_ws(',', " + ", ".join(f"CASE WHEN contains(content, '{s}') THEN '{label}' END" for s, label in signs.items()) + ")" for k, signs in C.SECTIONS.items()) + f" ELSE '' END AS sections, {_N('content', 'describe(')} AS suites, {_N('content', '#[test]')} AS cases FROM {_FILES}",
    "src_styles": rf"SELECT path, len(list_distinct(regexp_extract_all(content, '(--[\w-]+)[ \t]*:', 1))) AS custom_properties, array_to_string(regexp_extract_all(content, '(?m)^[ \t]*(\$[^:\s]+)[ \t]*:', 1), ',') AS variables, array_to_string(regexp_extract_all(content, '(?m)^[ \t]*@mixin ([^\s(]+)', 1), ',') AS mixins FROM {_FILES} AND {_EXT} IN ('css', 'scss')",
    "frag_tokens": rf"SELECT fragment_id, array_to_string(list_filter(regexp_split_to_array(code_content, '[ \t\n\v\f\r]+'), lambda w: strlen(w) > 2)[:50], ' ') AS tokens FROM {_FRAGMENTS}",
    "frag_preprocess": f"SELECT fragment_id, md5(array_to_string(list_filter(list_transform({_LIST('code_content')}, lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*')), chr(10))) AS md5 FROM {_FRAGMENTS}",
    "frag_snippets": f"SELECT fragment_id, CASE WHEN len(ls) <= 10 THEN code_content ELSE array_to_string(ls[:5], chr(10)) || '...' || chr(10) || array_to_string(ls[-2:], chr(10)) END AS snippet FROM (SELECT *, CASE WHEN code_content = '' THEN [] ELSE {_LIST('code_content')} END AS ls FROM {_FRAGMENTS})",
    "frag_features": f"SELECT fragment_id, unnest(range(15)) AS n, unnest(list_transform(f, lambda x: round(x / t, 9))) AS value FROM (SELECT fragment_id, f, list_sum(f) AS t FROM (SELECT fragment_id, [strlen(code_content) / 1000.0::DOUBLE, {_LINES('code_content')} / 100.0::DOUBLE, {', '.join(_N('code_content', w) + '::DOUBLE' for w in _COUNTED)}] AS f FROM {_FRAGMENTS}))",
    "frag_scopes": f"""SELECT fragment_id, CASE WHEN {_HAS('code_content', 'export', 'public')} THEN 'Service' WHEN contains(code_content, 'private') THEN 'Local' WHEN contains(code_content, 'async') AND contains(code_content, 'await') THEN 'Service' ELSE 'Component' END AS scope,
        CASE WHEN {_HAS('code_content', '@Injectable', 'service')} THEN 'ServiceModification' WHEN {_HAS('code_content', '@Component', 'component')} THEN 'ComponentModification' WHEN {_HAS('code_content', 'test', 'spec')} THEN 'TestModification' ELSE 'CodeModification' END AS change_type,
        CASE WHEN s <= 1 THEN 'Low' WHEN s <= 3 THEN 'Medium' ELSE 'High' END AS severity
        FROM (SELECT *, 2 * contains(code_content, 'export')::INT + {_HAS('code_content', 'async', 'Promise')}::INT + ({_N('code_content', 'function')} > 5)::INT AS s FROM {_FRAGMENTS})""",
    "frag_architecture": "SELECT kind, count(*) AS n, count(DISTINCT file_path) AS files FROM (SELECT *, CASE WHEN contains(file_path, 'service') THEN 'service' WHEN contains(file_path, 'component') THEN 'component' WHEN contains(file_path, 'guard') THEN 'guard' WHEN contains(file_path, 'interceptor') THEN 'interceptor' END AS kind FROM code_fragments) WHERE kind IS NOT NULL GROUP BY kind HAVING count(*) > 1",
    "frag_names": r"SELECT fragment_id, CASE WHEN starts_with(line, 'function ') THEN regexp_extract(line, '^function\s+([^\s(]+)', 1) WHEN contains(line, '=>') THEN regexp_extract(string_split(line, '=')[1], '(\S+)\s*$', 1) ELSE regexp_replace(regexp_extract(string_split(line, '(')[1], '(\S+)\s*$', 1), ':+$', '') END AS name FROM (SELECT fragment_id, trim(regexp_extract(code_content, '^([^\r\n]*)', 1), ' ') AS line FROM " + _FRAGMENTS + ")",
}

_STATE = rf"""WITH f AS (SELECT path, list_transform({_LIST('content')}, lambda x: trim(x)) AS l FROM {_INJECTABLE}),
    g AS (SELECT path,
        list_filter(list_transform(l, lambda x: struct_pack(name := regexp_extract(x, '^[^=]*?(\S+)\s*=', 1),
            kind := CASE WHEN contains(x, 'BehaviorSubject') THEN 'BehaviorSubject' WHEN contains(x, 'ReplaySubject') THEN 'ReplaySubject' WHEN contains(x, 'AsyncSubject') THEN 'AsyncSubject' WHEN contains(x, 'Subject') THEN 'Subject' WHEN contains(x, 'writableSignal(') THEN 'WritableSignal' WHEN contains(x, 'signal(') THEN 'Signal' WHEN contains(x, 'computed(') THEN 'ComputedSignal' END,
            hidden := contains(x, 'private ') OR NOT contains(x, 'readonly '))), lambda r: r.kind IS NOT NULL AND r.name <> '') AS s,
        list_filter(list_transform(l, lambda x: struct_pack(name := CASE
            WHEN contains(x, '$') AND (contains(x, '=') OR contains(x, 'asObservable') OR contains(x, 'pipe')) THEN regexp_extract(x, '^[^$]*?([^\s$]*\$)', 1)
            WHEN contains(x, '=') AND regexp_matches(x, ': (?:Observable|BehaviorSubject|Subject|ReplaySubject|AsyncSubject)<') THEN regexp_extract(x, '^[^:]*?([^\s:]+)\s*:', 1)
            WHEN contains(x, '=') AND regexp_matches(x, 'asObservable\(\)|\.pipe\(|new (?:Observable|BehaviorSubject|Subject)\(|this\.http\.(?:get|post|put|delete)|computed\(') THEN regexp_extract(x, '^[^=]*?(\S+)\s*=', 1) ELSE '' END,
            fixed := contains(x, 'readonly '))), lambda r: r.name <> '') AS o FROM f)"""
_FIXED = "len(list_filter(o, lambda r: r.fixed)) > 0"
ORACLES |= {
    "src_state": f"{_STATE} SELECT path, len(s) AS properties, len(o) AS observables, {_FIXED} AS any_readonly, array_to_string(list_transform(s, lambda r: r.kind), ',') AS kinds FROM g",
    "src_state_patterns": f"{_STATE}, a AS (SELECT count(*) FILTER (len(list_filter(s, lambda r: r.kind = 'BehaviorSubject')) > 0) AS \"BehaviorSubject\", count(*) FILTER (len(o) > 0) AS \"Observable\", count(*) FILTER ({_FIXED}) AS \"Readonly observable\", coalesce(sum(len(list_filter(o, lambda r: ends_with(r.name, '$')))), 0)::BIGINT AS \"Dollar suffix\", count(*) FILTER (len(list_filter(s, lambda r: r.hidden)) > 0 AND {_FIXED}) AS \"Encapsulation\" FROM g) SELECT pattern, n FROM (UNPIVOT a ON * INTO NAME pattern VALUE n) WHERE n > 0",
}
