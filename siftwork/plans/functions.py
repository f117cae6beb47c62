"""Queries over functions, types and features: what names stand for, feature vectors, classes, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import features as E
from siftwork.functions import purpose as P
from siftwork.plans import vectors
from siftwork.runtime import table


def _functions(spark, folder) -> DataFrame:
    return table(spark, folder, "function_info").where("name IS NOT NULL").select("file_path", "name", "parameters", "return_type", "is_async", "modifiers", F.col("location.line").alias("line")).distinct()


def func_purposes(spark, folder):
    """What each function's name and return type stand for."""
    return _functions(spark, folder).select("file_path", "name", "line", P.by_rules(F.lower("name"), P.FUNCTION_NAMES).alias("purpose"), P.by_rules(F.col("return_type"), P.TYPE_NAMES).alias("returns"))


def func_parameters(spark, folder):
    """What parameters stand for: names, types and how often."""
    p = table(spark, folder, "function_info").select(F.explode("parameters").alias("p"))
    return p.groupBy(P.by_rules(F.col("p.name"), P.PARAMETER_NAMES).alias("purpose"), P.by_rules(F.col("p.param_type"), P.TYPE_NAMES).alias("kind")).agg(F.count("*").alias("n"), F.count_if("p.is_optional").alias("optional"))


def func_signatures(spark, folder):
    """Signatures as text, with a complexity of parameters, async and unsafe."""
    args = F.transform("parameters", lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["param_type"], F.lit("any"))))
    cost = 1.0 + F.coalesce(F.size("parameters"), F.lit(0)) * 0.1 + F.when(F.coalesce("is_async", F.lit(False)), 0.5).otherwise(0.0) + F.when(F.coalesce(F.array_contains("modifiers", "unsafe"), F.lit(False)), 0.8).otherwise(0.0)
    return _functions(spark, folder).select("file_path", "line", F.concat("name", F.lit("("), F.coalesce(F.array_join(args, ", "), F.lit("")), F.lit("): "), F.coalesce("return_type", F.lit("void"))).alias("signature"), F.round(F.least(cost, F.lit(10.0)), 6).alias("complexity"))


def func_fields(spark, folder):
    """What the names of cached facts' dependencies stand for, as fields."""
    f = _functions(spark, folder).select(F.explode(F.array_distinct(F.transform("parameters", lambda p: p["name"]))).alias("name"))
    return f.groupBy(P.by_rules(F.col("name"), P.FIELD_NAMES).alias("purpose")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def frag_semantics(spark, folder):
    """Thirty-two semantic and five content features of each fragment's content."""
    c = F.col("code_content")
    f = F.concat(E.semantic_features(c), E.content_features(c))
    rows = table(spark, folder, "code_fragments").where("length(code_content) > 0").select("fragment_id", F.posexplode(F.transform(f, lambda x: F.round(x, 6))).alias("n", "value"))
    return rows.select("fragment_id", F.col("n").cast("long").alias("n"), "value")


def frag_embeddings(spark, folder):
    """A lexical embedding of 768 numbers for each fragment."""
    return E.embed_texts(table(spark, folder, "code_fragments").where("code_content IS NOT NULL"), "fragment_id", "code_content")


def src_classes(spark, folder):
    """Classes with their base and interfaces."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+[^{\n]*)"), F.lit(1))
    rows = table(spark, folder, "source_files").where("content IS NOT NULL").select("path", F.explode(found).alias("head"))
    part = lambda word: F.nullif(F.regexp_extract("head", rf"{word}[ \t]+([\w.<>, ]*\w>?)", 1), F.lit(""))
    return rows.select("path", F.regexp_extract("head", r"^(\w+)", 1).alias("name"), part("extends").alias("base"), part("implements").alias("interfaces"))


def src_elements(spark, folder):
    """How many elements of each kind a file declares at the beginning of a line."""
    kinds = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "struct": "struct", "trait": "trait", "impl": "impl", "const": "const"}
    c = table(spark, folder, "source_files").where("content IS NOT NULL")
    return c.select("path", *[F.regexp_count("content", F.lit(rf"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+|export[ \t]+)?{k}[ \t]")).cast("long").alias(n) for n, k in kinds.items()])


def cluster_kinds(spark, folder):
    """Clusters of two and more entries with the kind that their functions' names show."""
    names = table(spark, folder, "vectors").groupBy("id").agg(F.max_by("function_name", "updated_at").alias("name"))
    c = vectors.vec_leader_clusters(spark, folder).join(names, "id")
    return c.groupBy("leader").agg(F.count("*").alias("members"), P.cluster_kind(F.col("name")).alias("kind")).where("members > 1")


def pattern_suggestions(spark, folder):
    """Refactorings: one for each near-duplicate pair, one for each cluster of more than two."""
    d = vectors.vec_duplicate_pairs(spark, folder).select(F.lit("ExtractFunction").alias("suggestion"), F.col("a").alias("subject"), F.lit("High").alias("priority"))
    c = cluster_kinds(spark, folder).where("members > 2").select(F.lit("ExtractUtilityClass").alias("suggestion"), F.col("leader").alias("subject"), F.lit("Medium").alias("priority"))
    return d.unionByName(c)


QUERIES = {f.__name__: f for f in (func_purposes, func_parameters, func_signatures, func_fields, frag_semantics, frag_embeddings, src_classes, src_elements, cluster_kinds, pattern_suggestions)}

_F = "f AS (SELECT DISTINCT file_path, name, parameters, return_type, is_async, modifiers, location.line AS line FROM function_info WHERE name IS NOT NULL)"
_T = "code_content"
_COUNT = lambda w: f"((length({_T}) - length(replace({_T}, '{w}', ''))) // {len(w)})"
_FLAG = lambda w: f"contains({_T}, '{w}')::INT::DOUBLE"
_LINES = f"(length({_T}) - length(replace({_T}, chr(10), '')) + CASE WHEN ends_with({_T}, chr(10)) THEN 0 ELSE 1 END)"
_FEATURES = ", ".join(
    [_FLAG(w) for w in E.FLAGS] + [f"{_COUNT(w)} / 10.0::DOUBLE" for w in E.FLOW] + [_FLAG(w) for w in E.FRAMEWORK]
    + [f"log2({_LINES}) / 10", f"log2(strlen({_T})) / 20"] + [f"{_COUNT(w)} / 50.0::DOUBLE" for w in "{(["] + [_FLAG("/**"), _FLAG("//"), f"{_COUNT('@param')} / 10.0::DOUBLE"]
    + [f"ln(strlen({_T})) / 10", rf"ln(len(list_filter(regexp_split_to_array({_T}, '[ \t\n\v\f\r]+'), lambda w: w <> ''))) / 5", f"CASE WHEN contains({_T}, 'function') OR contains({_T}, 'class') OR contains({_T}, 'interface') THEN 0.5 ELSE -0.2 END::DOUBLE"]
    + [rf"len(regexp_extract_all({_T}, '[!-/:-@\[-`{{-~]')) / strlen({_T})::DOUBLE", rf"len(regexp_extract_all({_T}, '\p{{Lu}}')) / strlen({_T})::DOUBLE"]
)
_HEAD = r"unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+[^{\n]*)', 1)) AS head"
ORACLES = {
    "func_purposes": f"WITH {_F} SELECT file_path, name, line, {P.rules_sql('lower(name)', P.FUNCTION_NAMES)} AS purpose, {P.rules_sql('return_type', P.TYPE_NAMES)} AS returns FROM f",
    "func_parameters": f"SELECT {P.rules_sql('p.name', P.PARAMETER_NAMES)} AS purpose, {P.rules_sql('p.param_type', P.TYPE_NAMES)} AS kind, count(*) AS n, count(*) FILTER (p.is_optional) AS optional FROM (SELECT unnest(parameters) AS p FROM function_info) GROUP BY 1, 2",
    "func_signatures": f"WITH {_F} SELECT file_path, line, name || '(' || coalesce(array_to_string(list_transform(parameters, lambda p: p.name || ': ' || coalesce(p.param_type, 'any')), ', '), '') || '): ' || coalesce(return_type, 'void') AS signature, round(least(10::DOUBLE, 1 + coalesce(len(parameters), 0) * 0.1::DOUBLE + 0.5::DOUBLE * coalesce(is_async, false)::INT + 0.8::DOUBLE * coalesce(list_contains(modifiers, 'unsafe'), false)::INT), 6) AS complexity FROM f",
    "func_fields": f"WITH {_F}, n AS (SELECT unnest(list_distinct(list_transform(parameters, lambda p: p.name))) AS name FROM f) SELECT {P.rules_sql('name', P.FIELD_NAMES)} AS purpose, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY 1",
    "frag_semantics": f"SELECT fragment_id, unnest(range(37)) AS n, unnest(list_transform([{_FEATURES}], lambda x: round(x, 6))) AS value FROM code_fragments WHERE length(code_content) > 0",
    "src_classes": rf"SELECT path, regexp_extract(head, '^(\w+)', 1) AS name, nullif(regexp_extract(head, 'extends[ \t]+([\w.<>, ]*\w>?)', 1), '') AS base, nullif(regexp_extract(head, 'implements[ \t]+([\w.<>, ]*\w>?)', 1), '') AS interfaces FROM (SELECT path, {_HEAD} FROM source_files WHERE content IS NOT NULL)",
    "src_elements": "SELECT path, " + ", ".join(rf"""len(regexp_extract_all(content, '(?m)^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+|export[ \t]+)?{k}[ \t]')) AS "{k}" """ for k in ("class", "interface", "enum", "type", "struct", "trait", "impl", "const")) + " FROM source_files WHERE content IS NOT NULL",
}
