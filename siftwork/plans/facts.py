"""Queries over facts that need texts of their own kind: manifests, routes, pipes, responses, attributes, paths.

Where no table holds such texts, they are composed of a table's columns, so that every row gives one. The SQL states what must
come out from the columns alone, with literals of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import classify as C
from siftwork.functions import extract as X
from siftwork.functions import features as E
from siftwork.functions import paths
from siftwork.functions import purpose as P
from siftwork.functions import responses as R
from siftwork.functions import text as N
from siftwork.operators import cache as K
from siftwork.operators import scanners
from siftwork.operators import search as S
from siftwork.operators.store import VectorStore
from siftwork.plans import reports
from siftwork.plans.functions import _functions
from siftwork.plans.tools import _current_fragments
from siftwork.runtime import new_folder, table
from siftwork.sources import files, sinks


def _joined(array) -> F.Column:
    return F.array_join(array, ",")


def fact_state_methods(spark, folder):
    """Methods that keep state, of each file that has any."""
    f = table(spark, folder, "source_files").where("content IS NOT NULL").select("path", X.state_methods(F.col("content")).alias("m"))
    return f.where(F.size("m") > 0).select("path", F.size("m").cast("long").alias("n"), F.md5(_joined(F.col("m"))).alias("md5"))


def fact_pipes(spark, folder):
    """Pipes written around the functions: name, purity, signature of transform, uses."""
    f = _functions(spark, folder).where("line IS NOT NULL")
    given = F.array_join(F.transform(F.coalesce("parameters", F.array().cast(f.schema["parameters"].dataType)), lambda p: F.concat(F.regexp_replace(p["name"], r"[^\w]", "_"), F.lit(": string"))), ", ")
    pure, alone = F.col("line") % 2 == 0, F.col("line") % 3 == 0
    text = F.concat(
        F.lit("import { Pipe } from '@a/core';\n\n@Pipe({\n  name: '"), F.lower("name"), F.when(pure, "',\n").otherwise("',\n  pure: false,\n"), F.when(alone, "  standalone: true,\n").otherwise(""),
        F.lit("})\nexport class "), F.regexp_replace("name", r"\W", "_"), F.lit("Pipe {\n  transform("), given, F.lit("): "), F.when(pure, "string").otherwise("number"), F.lit(" {\n    return value;\n  }\n}\n"),
    )
    i = f.select("file_path", "line", "name", X.pipe_info(text).alias("i"))
    return i.select("file_path", "line", "i.pipe_name", "i.is_pure", "i.is_standalone", F.md5(X.transform_signature(F.col("i"))).alias("signature"), F.md5(_joined(X.pipe_uses(F.col("name")))).alias("uses"))


def _routing(spark, folder) -> DataFrame:
    """Routing files of four routes each, written around the guards."""
    g = table(spark, folder, "source_files").where("content IS NOT NULL AND path LIKE '%.guard.ts'").select("path", F.regexp_extract("path", r"([^/]*?)\.guard\.ts$", 1).alias("guard"), F.pmod(F.octet_length("content"), F.lit(7)).alias("n"))
    text = F.concat(
        F.lit("const routes: Routes = [\n  {\n    path: 'home-"), F.col("n"), F.lit("',\n    component: HomeComponent\n  },\n  {\n    path: 'inner-"), F.col("n"), F.lit("',\n    component: InnerComponent,\n    canActivate: ["), F.col("guard"),
        F.lit("]\n  },\n  {\n    path: 'late-"), F.col("n"), F.lit("',\n    loadChildren: () => import('./late')\n  },\n  {\n    path: '**',\n    redirectTo: 'home-"), F.col("n"), F.lit("'\n  }\n];\n"),
    )
    return g.select("path", text.alias("content"))


def fact_routes(spark, folder):
    """Routes of routing files: component, guards, redirect, lazy."""
    r = scanners.scan(_routing(spark, folder), scanners.routes, "path", "content")
    return r.select("path", "route", F.coalesce("component", F.lit("")).alias("component"), _joined(F.col("guards")).alias("guards"), F.coalesce("redirect_to", F.lit("")).alias("redirect_to"), "lazy")


def fact_guarded(spark, folder):
    """How many routes each guard protects."""
    r = scanners.scan(_routing(spark, folder), scanners.routes, "path", "content").select(F.explode("guards").alias("guard"))
    return r.groupBy("guard").agg(F.count("*").alias("routes"))


def fact_manifests(spark, folder):
    """Manifests written around the source files: package, edition, dependencies with their sources, features, targets, members."""
    f = table(spark, folder, "source_files").select("path", F.coalesce("line_count", F.lit(0)).alias("n"), F.coalesce("project", F.lit("none")).alias("project"))
    text = F.concat(
        F.lit('[package]\nname = "'), F.col("project"), F.lit('"\nversion = "1.'), F.col("n"), F.lit('.0"\n'), F.when(F.col("n") % 2 == 0, 'edition = "2024"\n').otherwise(""),
        F.lit('\n[dependencies]\nplain = "'), F.col("n"), F.lit('"\nfar = { git = "https://x.test/far", optional = true }\nnear = { path = "../near", features = ["a", "b"], default-features = false }\n\n[features]\ndefault = ["quick"]\nquick = ["plain/fast"]\nslow = []\n\n[[bin]]\nname = "run"\npath = "src/run.rs"\n'),
        F.when(F.col("n") % 3 == 0, '\n[workspace]\nmembers = ["one", "two"]\n').otherwise(""),
    )
    m = scanners.scan(f.select("path", text.alias("content")), scanners.manifest, "path", "content")
    told = F.transform("dependencies", lambda d: F.concat_ws(":", d["name"], d["version"], d["source"], _joined(d["features"]), d["optional"].cast("string"), d["default_features"].cast("string")))
    quick = F.transform("features", lambda x: F.concat(x["name"], F.when(x["is_default"], "*").otherwise("")))
    return m.select("path", "package_name", "version", "edition", _joined(told).alias("dependencies"), _joined(quick).alias("features"), _joined(F.transform("targets", lambda t: F.concat(t["kind"], F.lit(":"), t["name"]))).alias("targets"), F.coalesce(_joined(F.col("members")), F.lit("")).alias("members"))


def fact_packages(spark, folder):
    """Package manifests in JSON written around the source files: framework and number of packages, development ones apart where both name one."""
    f = table(spark, folder, "source_files").select("path", F.coalesce("line_count", F.lit(0)).alias("n"))
    core = F.when(F.col("n") % 4 == 0, "@angular/core").when(F.col("n") % 4 == 1, "react").when(F.col("n") % 4 == 2, "vue").otherwise("plain")
    text = F.concat(F.lit('{"dependencies": {"'), core, F.lit('": "1"}, "devDependencies": {"'), F.when(F.col("n") % 2 == 0, core).otherwise("tester"), F.lit('": "2"}}'))
    m = f.select("path", X.manifest_dependencies(text).alias("m"))
    return m.select("path", X.framework(F.col("m")).alias("framework"), F.size("m").cast("long").alias("packages"))


def fact_modules(spark, folder):
    """Module decorators written around the source files."""
    f = table(spark, folder, "source_files").where("project IS NOT NULL").select("path", "project", F.coalesce("line_count", F.lit(0)).alias("n"))
    text = F.concat(F.lit("@NgModule({\n  declarations: [A, B],\n  imports: ["), F.when(F.col("n") % 2 == 0, "CommonModule, ").otherwise(""), F.lit("C],\n"), F.when(F.col("n") % 5 == 0, "  bootstrap: [A],\n").otherwise(""), F.lit("})\nexport class "), F.translate("project", "-", "_"), F.lit(" {}\n"))
    i = f.select("path", X.module_info(text).alias("i"))
    return i.select("path", "i.name", _joined(F.col("i.imports")).alias("imports"), _joined(F.col("i.declarations")).alias("declarations"), _joined(F.col("i.bootstrap")).alias("bootstrap"), "i.is_root", "i.is_shared")


def fact_attributes(spark, folder):
    """What derives and attributes in Rust files stand for, and how often they occur."""
    f = table(spark, folder, "source_files").where("content IS NOT NULL AND path LIKE '%.rs'")
    a = f.select(F.explode(F.regexp_extract_all("content", F.lit(r"#\[(\w+)"), F.lit(1))).alias("word"), F.lit("attribute").alias("kind"))
    # derives don't occur in every table: the words of names stand for them as well
    d = table(spark, folder, "function_info").where("return_type IS NOT NULL").select(F.explode(F.array(F.lit("Clone"), F.lit("Eq"), F.col("return_type"))).alias("word"), F.lit("derive").alias("kind"))
    meaning = F.when(F.col("kind") == "derive", P.by_rules(F.col("word"), P.DERIVES)).otherwise(P.by_rules(F.col("word"), P.ATTRIBUTES))
    return a.unionByName(d).groupBy("kind", meaning.alias("meaning")).agg(F.count("*").alias("n"))


def fact_literals(spark, folder):
    """Types of literals and shortened descriptions."""
    f = table(spark, folder, "function_info").select(F.explode("parameters").alias("p")).where("p.default_value IS NOT NULL")
    t = f.groupBy(N.literal_type(F.col("p.default_value")).alias("kind")).agg(F.count("*").alias("n"))
    return t


def fact_ellipses(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(N.ellipsis(F.col("text"), 40)).alias("md5"))


def fact_path_keys(spark, folder):
    """Keys of absolute, bare and project-relative forms of each path, and whether they name one file."""
    f = table(spark, folder, "source_files").select("path")
    whole = F.concat(F.lit("/home/dev/work/"), F.substring("path", 3, 1 << 30))
    bare = F.substring("path", 3, 1 << 30)
    return f.select("path", paths.project_relative(whole, "/home/dev/work").alias("relative"), paths.project_relative(F.concat(F.lit("/else"), F.substring("path", 2, 1 << 30)), "/home/dev/work").alias("elsewhere"), paths.lookup_key(bare, "/home/dev/work").alias("key"), paths.paths_match(bare, F.col("path")).alias("same"), paths.paths_match(F.concat(F.lit("x/"), bare), F.lit("./src/none.ts")).alias("other"))


def fact_contexts(spark, folder):
    """The context of each fragment's function: lines, complexity, scope, what it depends on."""
    f = _current_fragments(spark, folder, "function_name", "file_path", "code_content").where("code_content IS NOT NULL")
    i = f.select("fragment_id", C.function_context(F.col("function_name"), F.col("file_path"), F.col("code_content")).alias("i"))
    return i.select("fragment_id", "i.name", "i.path", F.col("i.line_end").cast("long").alias("line_end"), F.round("i.complexity", 6).alias("complexity"), "i.scope")


def fact_function_texts(spark, folder):
    """Functions as texts to search."""
    f = _functions(spark, folder)
    return f.select("file_path", "name", "line", F.md5(P.function_text(F.col("name"), F.col("parameters"), F.col("return_type"), F.col("is_async"), F.col("modifiers"), F.col("file_path"), F.lit("return 1;"))).alias("md5"))


def fact_attended(spark, folder):
    """Six numbers of each fragment's embedding after the weights of its text."""
    f = _current_fragments(spark, folder, "code_content").where("length(code_content) BETWEEN 1 AND 5000")
    one = f.select("fragment_id", "code_content", F.array(*[F.lit(1.0)] * 6).alias("v"))
    return E.attend(one, "fragment_id", "code_content", "v").select("fragment_id", F.posexplode("vector").alias("n", "value")).select("fragment_id", F.col("n").cast("long").alias("n"), F.round("value", 6).alias("value"))


def fact_reasons(spark, folder):
    """Why each document fits three questions."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    q = F.explode(F.array(F.lit("a Function of the class"), F.lit("the class api"), F.lit("any API"), F.lit("none"))).alias("question")
    return d.select("doc_id", "text", q).groupBy("question", S.relevance_reason(F.col("question"), F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def fact_search_types(spark, folder):
    """How many vectors each type of search may find."""
    v = table(spark, folder, "vectors").select("language", "code_type", "file_path", "complexity")
    kinds = (("general", None), ("similar_functions", None), ("similar_code", "RUST"), ("similar_components", "typescript"), ("file_context", "./a/b.py"), ("file_context", "./a/none"))
    names = [f"{k}_{n}" for n, (k, _) in enumerate(kinds)]
    counted = v.agg(*[F.count_if(S.filters_of(*k).condition()).alias(n) for n, k in zip(names, kinds)])
    return counted.unpivot([], names, "search", "n")


def cache_outdated(spark, folder):
    """The first ten outdated files and how many more there are."""
    return K.first_and_rest(reports.cache_stale(spark, folder), "path")


def _responses(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("prompt"), F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("response"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_type"))


def response_prewarmed(spark, folder):
    """A cache filled with the responses of two models, warmed with those of the third and anew with those of the second."""
    r = _responses(spark, folder)
    empty = spark.createDataFrame([], "prompt_hash string, response string, model_type string, hit_count long")
    held = K.pre_warm(empty, r.where("model_type IN ('m0', 'm1') AND response < 'r000000500'"))
    return K.pre_warm(held, r.where("model_type IN ('m1', 'm2')")).select("prompt_hash", "response", "model_type")


def response_models(spark, folder):
    """The responses of one model."""
    return K.of_model(response_prewarmed(spark, folder), "m1")


#: Columns of a response that the SQL composes anew.
def _said(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", "source")
    item = lambda **c: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in c.items()])
    some = F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string"))
    whole = F.to_json(
        F.struct(
            F.array(item(concept=some, change_type="Added", impact_description="i")).alias("conceptual_changes"),
            F.array(item(component=some, implication="p", severity="high"), item(component="c2", implication="q", severity=F.lit(None).cast("string"))).alias("architectural_implications"),
            F.array(item(description=some, priority="low", steps=F.array(F.lit("one"), F.lit("two")))).alias("recommendations"),
            F.array(item(component=some, function="f", description="d", type="direct", impact="critical")).alias("cascade_effects"),
            F.array(item(description=some)).alias("suggestions"),
            F.array(some, F.lit("b")).alias("affected_domains"), F.array(some, F.lit("g")).alias("related_functions"), some.alias("purpose"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"), F.lit("high").alias("overall_risk"),
        )
    )
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, whole).otherwise(F.col("text")).alias("response"), (F.col("doc_id") % 2 == 0).alias("is_json"))


def _stated(kind: R.Response, *columns: str):
    def run(spark, folder):
        r = _said(spark, folder).select("doc_id", F.explode(kind.rows(F.col("response"))).alias("r"))
        return r.select("doc_id", *[f"r.{c}" for c in columns])

    return run


def response_steps(spark, folder):
    r = _said(spark, folder).select("doc_id", F.explode(R.RECOMMENDATIONS.rows(F.col("response"))).alias("r"))
    return r.select("doc_id", "r.description", "r.kind", "r.priority", "r.effort", _joined(F.col("r.steps")).alias("steps"))


def response_parts(spark, folder):
    """Single facts of responses in JSON: domains, purpose, embedding, related functions, overall risk."""
    r = _said(spark, folder).where("is_json")
    first = lambda kind: F.get(kind.rows(F.col("response")), 0)
    return r.select("doc_id", _joined(first(R.DOMAINS)["domains"]).alias("domains"), first(R.SEMANTICS)["purpose"].alias("purpose"), F.get(R.embedding_of(F.col("response"), 2), 1).alias("second"), _joined(R.named_functions(F.col("response"))).alias("related"), first(R.RISK)["overall"].alias("overall"))


def response_bullets(spark, folder):
    """Names of bullet lines."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", R.bullet_names(F.concat(F.lit("- one: a\n  - two\nno\n- three of "), "source", F.lit(": b"))).alias("b"))
    return d.select("doc_id", _joined(F.col("b")).alias("names"))


def report_written(spark, folder):
    """A report as JSON, text and Markdown."""
    df = reports.report_modules(spark, folder).select("module_type", "n").orderBy("module_type")
    made = [("json", sinks.report_json(df)), ("markdown", sinks.report_text("Modules", df, markdown=True)), ("text", sinks.report_text("Modules", df))]
    return spark.createDataFrame(made, "kind string, content string")


def io_roundtrips(spark, folder):
    """The vectors through each format, written and read back: rows, ids, sum of the vectors' numbers where the format holds them."""
    v = _store_rows(spark, folder)
    base = new_folder(spark, "io")
    parts = []
    for fmt in ("json", "csv", "parquet"):
        sinks.export(v, f"{base}/{fmt}", fmt)
        back = spark.read.option("header", "true").csv(f"{base}/csv") if fmt == "csv" else files.read_table(spark, f"{base}/{fmt}", files.VECTOR_SCHEMA, fmt)
        size = F.lit(None).cast("long") if fmt == "csv" else F.sum(F.size("embedding"))
        parts.append(back.agg(F.lit(fmt).alias("format"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("file_path").alias("files"), size.alias("numbers")))
    sinks.write_batches(v, f"{base}/batches", 100)
    parts.append(spark.read.schema(files.VECTOR_SCHEMA).json(f"{base}/batches").agg(F.lit("batches").alias("format"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("file_path").alias("files"), F.sum(F.size("embedding")).alias("numbers")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _store_rows(spark, folder) -> DataFrame:
    """Usable rows of the vectors as a store takes them."""
    return table(spark, folder, "vectors").where("id IS NOT NULL AND size(embedding) = 64").select(*files.VECTOR_SCHEMA.names)


def io_backups(spark, folder):
    """Two backups, the older one cleaned up, the newer restored."""
    v, base = _store_rows(spark, folder), new_folder(spark, "backups")
    b = sinks.Backups(spark, base)
    b.create(v.where("language = 'rust'"), "old", at=1_000_000.0)
    b.create(v, "new", at=2_000_000.0)
    gone = b.cleanup(5, now=2_000_000.0)
    left = ",".join(i["name"] for i in b.list())
    return b.restore("new").agg(F.lit(",".join(gone)).alias("gone"), F.lit(left).alias("left"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


def store_entries(spark, folder):
    """A store of the current vectors after adding, updating and deleting: all entries with their files."""
    s = VectorStore(spark, new_folder(spark, "store"), dim=64)
    v = _store_rows(spark, folder)
    s.add(v)
    s.update(v.where("language = 'python'").withColumn("file_path", F.lit("./moved.py")).withColumn("updated_at", F.expr("timestamp_seconds(4000000000)")))
    s.delete_files(spark.createDataFrame([("./moved.py",)], "file_path string").where("false").unionByName(v.where("language = 'css'").select("file_path").distinct()))
    return s.all().select("id", "file_path")


def store_nearest(spark, folder):
    """The nearest entries of a store to one of its vectors, exactly."""
    s = VectorStore(spark, new_folder(spark, "store"), dim=64)
    s.add(_store_rows(spark, folder))
    first = s.all().where("exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)").orderBy("id").select("id", "embedding").first()
    if first is None:
        return spark.createDataFrame([], "id string, rank long")
    return s.search(list(first["embedding"]), 5, 0.3, exact=True).select("rank", F.round("score", 5).alias("score"))


def change_snapshots(spark, folder):
    """What changed between the files' first and last states: added later, modified, lines."""
    m = table(spark, folder, "file_metadata").where("path IS NOT NULL AND hash IS NOT NULL").select(paths.normal_path("path").alias("path"), "revision", F.lower("hash").alias("hash"))
    top = lambda df: df.groupBy("path").agg(F.max(F.struct("revision", "hash")).alias("t")).select("path", "t.hash")
    return files.snapshot_changes(top(m.where("revision <= 1")), top(m)).groupBy("change").agg(F.count("*").alias("n"))


def change_lines(spark, folder):
    """Lines added and removed where each file's first line is dropped and two are put behind."""
    f = table(spark, folder, "source_files").where("length(content) > 0 AND NOT contains(content, char(13))").select("path", "content")
    after = f.select("path", F.concat(F.regexp_replace("content", r"^[^\n]*\n?", ""), F.lit("\n@@one\n@@two")).alias("content"))
    c = files.line_changes(f, after)
    return c.select("path", F.col("lines_added").cast("long").alias("added"), F.col("lines_removed").cast("long").alias("removed"))


def index_fresh(spark, folder):
    """Whether an index of a time is newer than all files."""
    f = table(spark, folder, "source_files").select("last_modified")
    parts = [sinks.is_fresh(f, F.lit(t).cast("timestamp")).select(F.lit(t).alias("indexed_at"), "fresh") for t in ("2000-01-01 00:00:00", "2100-01-01 00:00:00")]
    return parts[0].unionByName(parts[1])


response_changes = _stated(R.CHANGES, "concept", "change_type", "impact")
response_implications = _stated(R.IMPLICATIONS, "component", "implication", "severity")
response_cascades = _stated(R.CASCADES, "component", "function", "kind", "level")
response_suggestions = _stated(R.SUGGESTIONS, "kind", "description", "effort", "priority")
for _f, _n in ((response_changes, "response_changes"), (response_implications, "response_implications"), (response_cascades, "response_cascades"), (response_suggestions, "response_suggestions")):
    _f.__name__ = _n
QUERIES = {
    f.__name__: f
    for f in (
        fact_state_methods, fact_pipes, fact_routes, fact_guarded, fact_manifests, fact_packages, fact_modules, fact_attributes, fact_literals, fact_ellipses, fact_path_keys, fact_contexts, fact_function_texts, fact_attended, fact_reasons, fact_search_types,
        cache_outdated, response_prewarmed, response_models, response_changes, response_implications, response_cascades, response_suggestions, response_steps, response_parts, response_bullets, report_written, io_roundtrips, io_backups, store_entries, store_nearest, change_snapshots, change_lines, index_fresh,
    )
}

_HAS = lambda t, *ss: "(" + " OR ".join(f"contains({t}, '{s}')" for s in ss) + ")"
_COUNT = lambda t, s: f"((length({t}) - length(replace({t}, '{s}', ''))) // {len(s)})"
_LINES = "list_transform(string_split(CASE WHEN ends_with(content, chr(10)) THEN left(replace(content, chr(13) || chr(10), chr(10)), length(replace(content, chr(13) || chr(10), chr(10))) - 1) ELSE replace(content, chr(13) || chr(10), chr(10)) END, chr(10)), lambda x: trim(x))"
_FN = "(SELECT DISTINCT file_path, name, parameters, return_type, is_async, modifiers, location.line AS line FROM function_info WHERE name IS NOT NULL)"
_CURRENT = "(SELECT fragment_id, max(struct_pack(t := extracted_at, {0})) AS f FROM code_fragments GROUP BY fragment_id)"
_REQ = "(SELECT sha256(event_type || ':' || json_extract_string(props, '$.k') || 'm' || (user_id % 3) || 'default') AS prompt_hash, 'r' || lpad(event_id::VARCHAR, 9, '0') AS response, 'm' || (user_id % 3) AS model_type FROM events)"
_WARM = f"WITH r AS {_REQ}, a AS (SELECT prompt_hash, max(response) AS response, max(model_type) AS model_type FROM r WHERE model_type IN ('m0', 'm1') AND response < 'r000000500' GROUP BY 1), b AS (SELECT prompt_hash, max(response) AS response, max(model_type) AS model_type FROM r WHERE model_type IN ('m1', 'm2') GROUP BY 1), h AS (SELECT * FROM a WHERE prompt_hash NOT IN (SELECT prompt_hash FROM b) UNION ALL SELECT * FROM b)"
_D = "(SELECT doc_id, text, source, 's' || (doc_id % 10) AS s, CASE WHEN doc_id % 2 = 0 THEN 'json' WHEN json_valid(text) THEN 'other' ELSE 'text' END AS kind FROM documents WHERE text IS NOT NULL)"
_BY = lambda t, rules: "CASE " + " ".join("WHEN " + " OR ".join({"is": f"{t} = '{w}'", "starts": f"starts_with({t}, '{w}')", "ends": f"ends_with({t}, '{w}')", "contains": f"contains({t}, '{w}')"}[h] for w in ws) + f" THEN '{v}'" for h, ws, v in rules if h != "else") + f" ELSE '{rules[-1][2]}' END"
_ROWS = "FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64"
_GUARDS = r"(SELECT path, regexp_extract(path, '([^/]*?)\.guard\.ts$', 1) AS guard, strlen(content) % 7 AS n FROM source_files WHERE content IS NOT NULL AND path LIKE '%.guard.ts')"
_N0 = "(SELECT path, coalesce(line_count, 0) AS n, coalesce(project, 'none') AS project FROM source_files)"
_SHA = "CASE WHEN length({0}) <= 40 THEN {0} ELSE left({0}, 37) || '...' END"

ORACLES = {
    "fact_state_methods": rf"""WITH f AS (SELECT path, content, {_LINES} AS l FROM source_files WHERE content IS NOT NULL),
        n AS (SELECT path, content, list_filter(list_transform(list_filter(l, lambda x: NOT {_HAS('x', 'fn ', 'function ')} AND contains(x, '(') AND {_HAS('x', '):', ') {')}), lambda x: regexp_extract(string_split(x, '(')[1], '(\S+)\s*$', 1)), lambda x: x <> '') AS names FROM f),
        k AS (SELECT path, list_filter(names, lambda m: {_HAS('lower(m)', 'update', 'set', 'clear', 'reset', 'init', 'store', 'load', 'refresh', 'state', 'auth', 'user', 'loading', 'next', 'emit', 'trigger')}
            OR CASE WHEN contains(content, m || '(') THEN {_HAS("array_to_string(string_split(replace(substr(content, strpos(content, m || '(')), chr(13) || chr(10), chr(10)), chr(10))[1:10], ' ')", '.next(', '.emit(', '.update(', 'Subject')} ELSE false END) AS m FROM n)
        SELECT path, len(m) AS n, md5(array_to_string(m, ',')) AS md5 FROM k WHERE len(m) > 0""",
    "fact_pipes": rf"""SELECT file_path, line, lower(name) AS pipe_name, line % 2 = 0 AS is_pure, line % 3 = 0 AS is_standalone,
        md5('transform(' || coalesce(array_to_string(list_transform(parameters, lambda p: regexp_replace(p.name, '[^\w]', '_', 'g') || ': string'), ', '), '') || '): ' || CASE WHEN line % 2 = 0 THEN 'string' ELSE 'number' END) AS signature,
        md5(CASE WHEN contains(lower(name), 'date') THEN 'Date formatting,Locale-specific dates' WHEN contains(lower(name), 'currency') THEN 'Currency formatting,Locale-specific currency' WHEN {_HAS('lower(name)', 'upper', 'lower')} THEN 'Text transformation,String manipulation' WHEN contains(lower(name), 'async') THEN 'Async data handling,Observable transformation' ELSE 'Data transformation,Template formatting' END) AS uses FROM {_FN} WHERE line IS NOT NULL""",
    "fact_routes": f"SELECT path, 'home-' || n AS route, 'HomeComponent' AS component, '' AS guards, '' AS redirect_to, false AS lazy FROM {_GUARDS} UNION ALL SELECT path, 'inner-' || n, 'InnerComponent', guard, '', false FROM {_GUARDS} UNION ALL SELECT path, 'late-' || n, '', '', '', true FROM {_GUARDS} UNION ALL SELECT path, '**', '', '', 'home-' || n, false FROM {_GUARDS}",
    "fact_guarded": f"SELECT guard, count(*) AS routes FROM {_GUARDS} GROUP BY guard",
    "fact_manifests": f"SELECT path, project AS package_name, '1.' || n || '.0' AS version, CASE WHEN n % 2 = 0 THEN '2024' ELSE '2021' END AS edition, 'plain:' || n || ':registry::false:true,far:*:git::true:true,near:*:path:a,b:false:false' AS dependencies, 'default,quick*,slow' AS features, 'bin:run' AS targets, CASE WHEN n % 3 = 0 THEN 'one,two' ELSE '' END AS members FROM {_N0}",
    "fact_packages": f"SELECT path, CASE n % 4 WHEN 0 THEN 'Angular' WHEN 1 THEN 'React' WHEN 2 THEN 'Vue' ELSE 'Unknown' END AS framework, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS packages FROM {_N0}",
    "fact_modules": "SELECT path, replace(project, '-', '_') AS name, CASE WHEN n % 2 = 0 THEN 'CommonModule,C' ELSE 'C' END AS imports, 'A,B' AS declarations, CASE WHEN n % 5 = 0 THEN 'A' ELSE '' END AS bootstrap, n % 5 = 0 AS is_root, n % 2 = 0 AS is_shared FROM (SELECT path, project, coalesce(line_count, 0) AS n FROM source_files WHERE project IS NOT NULL)",
    "fact_attributes": r"""WITH a AS (SELECT unnest(regexp_extract_all(content, '#\[(\w+)', 1)) AS w FROM source_files WHERE content IS NOT NULL AND path LIKE '%.rs'), d AS (SELECT unnest(['Clone', 'Eq', return_type]) AS w FROM function_info WHERE return_type IS NOT NULL)
        SELECT 'attribute' AS kind, CASE WHEN contains(w, 'derive') THEN 'automatic trait implementation' WHEN contains(w, 'cfg') THEN 'conditional compilation' WHEN contains(w, 'allow') OR contains(w, 'deny') THEN 'lint control' WHEN contains(w, 'repr') THEN 'memory layout specification' WHEN contains(w, 'doc') THEN 'documentation metadata' WHEN contains(w, 'test') THEN 'test function marker' WHEN contains(w, 'bench') THEN 'benchmark function' WHEN contains(w, 'inline') THEN 'inlining hint' WHEN contains(w, 'deprecated') THEN 'deprecation warning' ELSE 'compiler directive' END AS meaning, count(*) AS n FROM a GROUP BY 2
        UNION ALL SELECT 'derive', CASE w WHEN 'Debug' THEN 'debug printing support' WHEN 'Clone' THEN 'value cloning capability' WHEN 'Copy' THEN 'trivial copying (stack-only)' WHEN 'PartialEq' THEN 'equality comparison' WHEN 'Eq' THEN 'equality comparison' WHEN 'Ord' THEN 'ordering/sorting support' WHEN 'PartialOrd' THEN 'ordering/sorting support' WHEN 'Hash' THEN 'hash map key capability' WHEN 'Serialize' THEN 'serde serialization' WHEN 'Deserialize' THEN 'serde serialization' WHEN 'Default' THEN 'default value construction' WHEN 'Display' THEN 'formatted display output' ELSE 'code generation' END, count(*) FROM d GROUP BY 2""",
    "fact_literals": r"""SELECT CASE WHEN (length(v) > 1 AND left(v, 1) = right(v, 1) AND left(v, 1) IN ('''', '"', '`')) THEN 'string' WHEN regexp_full_match(v, '[-+]?(?:\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|0[xX][0-9a-fA-F]+)') THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean' WHEN v IN ('null', 'undefined') THEN v WHEN starts_with(v, '[') THEN 'array' WHEN starts_with(v, '{') THEN 'object' ELSE 'auto' END AS kind, count(*) AS n FROM (SELECT trim(p.default_value) AS v FROM (SELECT unnest(parameters) AS p FROM function_info) WHERE p.default_value IS NOT NULL) GROUP BY 1""",
    "fact_ellipses": f"SELECT doc_id, md5({_SHA.format('text')}) AS md5 FROM documents WHERE text IS NOT NULL",
    "fact_path_keys": "SELECT path, path AS relative, CASE WHEN contains(path, '/src/') THEN '.' || substr(path, strpos(path, '/src/')) ELSE '/else' || substr(path, 2) END AS elsewhere, path AS key, true AS same, contains('/x/' || substr(path, 3), '/src/') AND substr('/x/' || substr(path, 3), strpos('/x/' || substr(path, 3), '/src/')) = '/src/none.ts' AS other FROM source_files",
    "fact_contexts": f"SELECT fragment_id, f.n AS name, f.p AS path, greatest(length(c) - length(replace(c, chr(10), '')) + CASE WHEN c = '' OR ends_with(c, chr(10)) THEN 0 ELSE 1 END, 1)::BIGINT AS line_end, round(least(10.0::DOUBLE, 1.0::DOUBLE + {' + '.join(f'{_COUNT('c', t)} * {w}::DOUBLE' for t, w in C.WEIGHTED.items())}), 6) AS complexity, CASE WHEN {_HAS('c', 'export', 'public')} THEN 'Service' WHEN contains(c, 'private') THEN 'Local' WHEN contains(c, 'async') AND contains(c, 'await') THEN 'Service' ELSE 'Component' END AS scope FROM (SELECT *, f.c AS c FROM {_CURRENT.format('n := function_name, p := file_path, c := code_content')}) WHERE c IS NOT NULL",
    "fact_function_texts": f"""SELECT file_path, name, line, md5(concat_ws(chr(10),
        'FUNCTION: ' || CASE WHEN len(m) > 0 THEN array_to_string(m, ' ') || ' ' ELSE '' END || 'fn ' || name || CASE WHEN g THEN '(' || coalesce(array_to_string(list_transform(parameters, lambda p: p.name || ': ' || coalesce(p.param_type, '')), ', '), '') || ')' ELSE '' END || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END,
        'FILE: ' || file_path, 'PURPOSE: ' || {_BY('lower(name)', P.FUNCTION_NAMES)}, 'IMPLEMENTATION:' || chr(10) || 'return 1;',
        CASE WHEN g THEN 'PARAMETERS: ' || array_to_string(list_transform(parameters, lambda p: p.name || ': ' || coalesce(p.param_type, '') || ' (' || CASE WHEN ({_BY('p.name', P.PARAMETER_NAMES)}) <> 'parameter' THEN ({_BY('p.name', P.PARAMETER_NAMES)}) ELSE ({_BY("coalesce(p.param_type, '')", P.TYPE_NAMES)}) END || ')'), ', ') END,
        CASE WHEN return_type <> '' THEN 'RETURNS: ' || return_type || ' (' || ({_BY('return_type', P.TYPE_NAMES)}) || ')' END)) AS md5
        FROM (SELECT *, coalesce(len(parameters), 0) > 0 AS g, list_concat(CASE WHEN coalesce(is_async, false) THEN ['async'] ELSE [] END, list_filter(coalesce(modifiers, []), lambda x: x IN ('pub', 'unsafe', 'const'))) AS m FROM {_FN})""",
    "fact_attended": f"""WITH f AS (SELECT fragment_id, f.c AS c FROM {_CURRENT.format('c := code_content')} WHERE length(f.c) BETWEEN 1 AND 5000),
        h AS (SELECT fragment_id, list_reduce(list_transform(regexp_extract_all(c, '(?s).'), lambda x: unicode(x)::HUGEINT), lambda a, x: (a * 31 + x) % 18446744073709551616::HUGEINT) AS h FROM f)
        SELECT fragment_id, i AS n, round(1 + (((h * i) % 18446744073709551616::HUGEINT % 1000)::DOUBLE / 1000 * 2 - 1) * 0.1::DOUBLE + sin(i / pow(1000, 2 * (i % 2) / 768.0::DOUBLE)) * 0.05::DOUBLE, 6) AS value FROM h, range(6) r(i)""",
    "fact_reasons": "WITH q AS (SELECT unnest(['a Function of the class', 'the class api', 'any API', 'none']) AS question), r AS (SELECT question, CASE WHEN contains(lower(question), 'function') AND contains(lower(text), 'function') THEN 'Contains function definitions matching the query' WHEN contains(lower(question), 'class') AND contains(lower(text), 'class') THEN 'Contains class definitions matching the query' WHEN contains(lower(question), 'api') AND contains(lower(text), 'api') THEN 'Contains API-related code matching the query' ELSE 'Contains code patterns relevant to the query' END AS reason FROM documents, q WHERE text IS NOT NULL) SELECT question, reason, count(*) AS n FROM r GROUP BY 1, 2",
    "fact_search_types": "SELECT 'general_0' AS search, count(*) AS n FROM vectors UNION ALL SELECT 'similar_functions_1', count(*) FILTER (code_type = 'Function') FROM vectors UNION ALL SELECT 'similar_code_2', count(*) FILTER (lower(language) = 'rust') FROM vectors UNION ALL SELECT 'similar_components_3', count(*) FILTER (code_type = 'Component' AND lower(language) = 'typescript') FROM vectors UNION ALL SELECT 'file_context_4', count(*) FILTER (lower(language) = 'python') FROM vectors UNION ALL SELECT 'file_context_5', count(*) FROM vectors",
    "cache_outdated": f"WITH {reports._CACHE}, s AS (SELECT c.path AS line, row_number() OVER (ORDER BY c.path) AS n, count(*) OVER () AS a FROM c LEFT JOIN source_files s ON s.path = c.path WHERE s.path IS NULL OR c.hash IS DISTINCT FROM lower(s.hash)) SELECT n, line FROM s WHERE n <= 10 UNION ALL SELECT DISTINCT 11, '... and ' || (a - 10) || ' more' FROM s WHERE a > 10",
    "response_prewarmed": f"{_WARM} SELECT prompt_hash, response, model_type FROM h",
    "response_models": f"{_WARM} SELECT prompt_hash, response, model_type FROM h WHERE model_type = 'm1'",
    "response_changes": f"SELECT doc_id, s AS concept, 'Added' AS change_type, 'i' AS impact FROM {_D} WHERE kind = 'json' UNION ALL SELECT doc_id, 'Data flow', 'Modified', 'data flow' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'data flow', 'workflow')} UNION ALL SELECT doc_id, 'Security', 'Modified', 'security' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'security', 'authentication')} UNION ALL SELECT doc_id, 'Interface', 'Modified', 'interface' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'api', 'interface')}",
    "response_implications": f"SELECT doc_id, s AS component, 'p' AS implication, 'High' AS severity FROM {_D} WHERE kind = 'json' UNION ALL SELECT doc_id, 'c2', 'q', 'Medium' FROM {_D} WHERE kind = 'json' UNION ALL SELECT doc_id, 'Service layer', 'service layer affected', 'Medium' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'service', 'layer')} UNION ALL SELECT doc_id, 'Components', 'components affected', 'Low' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'component', 'module')} UNION ALL SELECT doc_id, 'Storage', 'storage affected', 'High' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'database', 'storage')}",
    "response_cascades": f"SELECT doc_id, s AS component, 'f' AS function, 'Direct' AS kind, 'Critical' AS level FROM {_D} WHERE kind = 'json' UNION ALL SELECT doc_id, 'Dependents', 'dependents', 'Indirect', 'Medium' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'cascade', 'ripple')} UNION ALL SELECT doc_id, 'Callers', 'callers', 'Direct', 'High' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'direct', 'immediate')}",
    "response_suggestions": f"SELECT doc_id, 'Performance' AS kind, s AS description, 'Medium' AS effort, 'Medium' AS priority FROM {_D} WHERE kind = 'json'",
    "response_steps": f"SELECT doc_id, s AS description, 'Refactor' AS kind, 'Low' AS priority, 'Medium' AS effort, 'one,two' AS steps FROM {_D} WHERE kind = 'json' UNION ALL SELECT doc_id, 'Add tests', 'Test', 'High', 'Medium', 'Review and implement' FROM {_D} WHERE kind = 'text' AND contains(text, 'test') UNION ALL SELECT doc_id, 'Review the change', 'Review', 'Medium', 'Medium', 'Review and implement' FROM {_D} WHERE kind = 'text' AND {_HAS('text', 'review', 'check')}",
    "response_parts": f"SELECT doc_id, s || ',b' AS domains, s AS purpose, 0.25::DOUBLE AS second, s || ',g' AS related, 'High' AS overall FROM {_D} WHERE kind = 'json'",
    "response_bullets": "SELECT doc_id, 'one,two,three of ' || source AS names FROM documents WHERE text IS NOT NULL AND source IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NOT NULL AND source IS NULL",
    "report_written": f"""WITH {reports._NOW}, t AS (SELECT CASE WHEN contains(path, 'app.module') THEN 'Root' WHEN contains(path, 'routing') THEN 'Routing' WHEN {_HAS('path', 'shared', 'core')} THEN 'Shared' ELSE 'Feature' END AS module_type, count(*) AS n FROM m WHERE file_type = 'Module' GROUP BY 1)
        SELECT 'json' AS kind, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "module_type": "' || module_type || '",' || chr(10) || '    "n": ' || n || chr(10) || '  }}', ',' || chr(10) ORDER BY module_type) || chr(10) || ']' AS content FROM t
        UNION ALL SELECT 'markdown', '# Modules' || chr(10) || chr(10) || '| module_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || module_type || ' | ' || n || ' |', chr(10) ORDER BY module_type) || chr(10) FROM t
        UNION ALL SELECT 'text', 'Modules' || chr(10) || '=======' || chr(10) || string_agg('module_type: ' || module_type || ', n: ' || n, chr(10) ORDER BY module_type) || chr(10) FROM t""",
    "io_roundtrips": f"SELECT unnest(['json', 'parquet', 'batches']) AS format, count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT file_path) AS files, (count(*) * 64)::BIGINT AS numbers {_ROWS} UNION ALL SELECT 'csv', count(*), count(DISTINCT id), count(DISTINCT file_path), NULL {_ROWS}",
    "io_backups": f"SELECT 'old' AS gone, 'new' AS \"left\", count(*) AS rows, count(DISTINCT id) AS ids {_ROWS}",
    "store_entries": f"WITH v AS (SELECT * FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64), s AS (SELECT id, arg_max(struct_pack(p := file_path), struct_pack(u := updated_at, h := hash)).p AS file_path FROM v GROUP BY id), u AS (SELECT id, CASE WHEN id IN (SELECT id FROM v WHERE language = 'python') THEN './moved.py' ELSE file_path END AS file_path FROM s) SELECT id, file_path FROM u WHERE file_path NOT IN (SELECT file_path FROM v WHERE language = 'css' AND file_path IS NOT NULL)",
    "store_nearest": f"WITH s AS (SELECT id, list_transform(arg_max(struct_pack(e := embedding), struct_pack(u := updated_at, h := hash)).e, lambda x: x::DOUBLE) AS e FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64 GROUP BY id), g AS (SELECT id, e FROM s WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 1e30)) = 0), q AS (SELECT id, e FROM g WHERE len(list_filter(e, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1), r AS (SELECT list_cosine_similarity(q.e, g.e) AS score FROM g, q WHERE len(list_filter(g.e, lambda x: x <> 0)) > 0) SELECT row_number() OVER (ORDER BY score DESC) AS rank, round(score, 5) + 0 AS score FROM r WHERE score >= 0.3 ORDER BY score DESC LIMIT 5",
    "change_snapshots": f"WITH m AS (SELECT {reports._N} AS path, revision, lower(hash) AS hash FROM file_metadata WHERE path IS NOT NULL AND hash IS NOT NULL), b AS (SELECT path, max(struct_pack(r := revision, h := hash)).h AS h FROM m WHERE revision <= 1 GROUP BY 1), a AS (SELECT path, max(struct_pack(r := revision, h := hash)).h AS h FROM m GROUP BY 1) SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN a.h <> b.h THEN 'modified' END AS change FROM a LEFT JOIN b ON a.path = b.path) WHERE change IS NOT NULL GROUP BY 1",
    "change_lines": "WITH f AS (SELECT path, content, string_split(content, chr(10))[1] AS head, contains(content, chr(10)) AS more FROM source_files WHERE length(content) > 0 AND NOT contains(content, chr(13))) SELECT path, CASE WHEN more THEN 2 WHEN head = '' THEN 2 ELSE 3 END::BIGINT AS added, CASE WHEN more OR head <> '' THEN 1 ELSE 0 END::BIGINT AS removed FROM f",
    "index_fresh": "SELECT '2000-01-01 00:00:00' AS indexed_at, NOT coalesce(max(last_modified) > TIMESTAMP '2000-01-01', false) AS fresh FROM source_files UNION ALL SELECT '2100-01-01 00:00:00', NOT coalesce(max(last_modified) > TIMESTAMP '2100-01-01', false) FROM source_files",
}
