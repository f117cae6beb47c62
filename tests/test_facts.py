import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import classify, extract, features, purpose
from siftwork.operators import ann, cache, scanners
from siftwork.operators import search as S
from siftwork.plans import tools
from siftwork.sources import sinks

SERVICE = """export class Desk {
  setUser(user: User): void {
    this.user = user;
  }
  plain(n: number): number { return n; }
  pushed(): void {
    this.news$.next(1);
  }
  function outer() {
}
"""
PIPE = """@Pipe({ name: 'shortDate', pure: false, standalone: true })
export class ShortDatePipe implements PipeTransform {
  transform(value: Date, form?: string): string {
    return '';
  }
}
"""


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_state_methods(spark):
    assert one(spark, extract.state_methods(F.col("t")), t=SERVICE) == ["setUser", "plain", "pushed"], "next() stands within ten lines after plain"
    assert one(spark, extract.state_methods(F.col("t")), t=SERVICE.replace("next", "call").replace("news", "seen")) == ["setUser"]
    assert one(spark, extract.state_methods(F.col("t")), t="") == [] and one(spark, extract.state_methods(F.col("t")), t=None) is None


def test_pipes(spark):
    i = one(spark, extract.pipe_info(F.col("t")), t=PIPE)
    assert (i["name"], i["pipe_name"], i["is_pure"], i["is_standalone"], i["parameters"], i["returns"]) == ("ShortDatePipe", "shortDate", False, True, ["value: Date", "form?: string"], "string")
    assert one(spark, extract.transform_signature(extract.pipe_info(F.col("t"))), t=PIPE) == "transform(value: Date, form?: string): string"
    assert one(spark, extract.pipe_info(F.col("t")), t=SERVICE) is None
    assert one(spark, extract.pipe_uses(F.col("t")), t="ShortDatePipe")[0] == "Date formatting" and one(spark, extract.pipe_uses(F.col("t")), t=None) is None


def test_contexts_and_texts(spark):
    c = one(spark, classify.function_context(F.lit("f"), F.lit("./a.ts"), F.col("t")), t="export function f() {\n  if (a) { b.c(); }\n}")
    assert (c["line_start"], c["line_end"], c["scope"]) == (1, 3, "Service") and c["complexity"] > 1
    assert one(spark, classify.function_context(F.lit("f"), F.lit("p"), F.col("t")), t=None) is None
    df = spark.createDataFrame([("getPath", [("path", "String")], "Option<T>", True, ["pub", "other"], "a.rs", "x()"), ("run", None, None, None, None, "b.rs", "")], "n string, p array<struct<name:string,param_type:string>>, r string, a boolean, m array<string>, f string, b string")
    text = [r[0].split("\n") for r in df.select(purpose.function_text(*(F.col(c) for c in "npramfb"))).collect()]
    assert text[0] == ["FUNCTION: async pub fn getPath(path: String) -> Option<T>", "FILE: a.rs", "PURPOSE: accessor/getter", "IMPLEMENTATION:", "x()", "PARAMETERS: path: String (file path)", "RETURNS: Option<T> (optional value)"]
    assert text[1][:2] == ["FUNCTION: fn run", "FILE: b.rs"] and len(text[1]) == 3


@pytest.mark.parametrize("text", ["", "a", "Größe 😀 der Dinge", "x" * 3000])
def test_attended_vectors(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % 2**64
    want = [v * (1 + ((h * i) % 2**64 % 1000 / 1000 * 2 - 1) * 0.1) + np.sin(i / 1000 ** (2 * (i % 2) / 768)) * 0.05 for i, v in enumerate([1.0, 2.0, -1.0, 0.5])]
    assert np.allclose(features.attended(np.array([1.0, 2.0, -1.0, 0.5]), text), want)


def test_attend_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, [1.0]), (3, "a", None), (4, "a", [None])], "id long, t string, v array<double>")
    got = {r["id"]: r["vector"] for r in features.attend(df, "id", "t", "v").collect()}
    assert got[3] is None and got[4] is None and len(got[1]) == len(got[2]) == 1
    assert features.attend(df.limit(0), "id", "t", "v").count() == 0


def test_search_types_and_reasons(spark):
    assert S.filters_of("similar_code", "rust").languages == ("rust",) and S.filters_of("similar_components", "vue").code_types == ("Component",)
    assert S.filters_of("file_context", "./a/b.rs").languages == ("rust",) and S.filters_of("file_context", "./a/b").languages is None
    for kind, value in (("none", None), ("similar_code", None)):
        with pytest.raises(ValueError):
            S.filters_of(kind, value)
    assert one(spark, S.relevance_reason(F.lit("the API"), F.col("t")), t="some api") == "Contains API-related code matching the query"
    assert one(spark, S.relevance_reason(F.lit("the API"), F.col("t")), t=None) is None


def test_first_and_rest(spark, rows):
    df = spark.createDataFrame([(f"p{n:02d}",) for n in range(13)] + [(None,)], "path string")
    got = rows(cache.first_and_rest(df, "path"))
    assert len(got) == 11 and (11, "... and 3 more") in got and (1, "p00") in got
    assert rows(cache.first_and_rest(df.where("path < 'p02'"), "path")) == [(1, "p00"), (2, "p01")]
    assert cache.first_and_rest(df.limit(0), "path").count() == 0


def test_pre_warm(spark, rows):
    empty = spark.createDataFrame([], "prompt_hash string, response string, model_type string, hit_count long")
    r = spark.createDataFrame([("p", "a", "m"), ("p", "b", "m"), ("q", "c", "n")], "prompt string, response string, model_type string")
    warm = cache.pre_warm(empty, r)
    assert rows(warm, "response", "hit_count") == [("b", 0), ("c", 0)]
    again = cache.pre_warm(warm.withColumn("hit_count", F.lit(7).cast("long")), r.where("prompt = 'q'"))
    assert rows(again, "response", "hit_count") == [("b", 7), ("c", 0)] and rows(cache.of_model(again, "n"), "response") == [("c",)]


def test_reports_are_bounded(spark):
    df = spark.range(30)
    assert sinks.report_json(df, 30).count("id") == 30
    for make in (lambda: sinks.report_json(df, 29), lambda: sinks.report_text("t", df, most=29)):
        with pytest.raises(ValueError):
            make()


def test_table_functions_take_batches(spark, rows):
    code = "function alpha(x) {\n  return 1 + 2 + 3 + 4 + 5;\n}\nfunction beta(y) {\n  return 5 + 4 + 3 + 2 + 1;\n}\n"
    df = spark.createDataFrame([("a", code), ("b", None), ("c", "")] + [(f"d{n}", code) for n in range(20)], "k string, t string")
    tools.register_table_functions(spark)
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT key, function_name, line_start FROM blocks_of(TABLE(SELECT k, t FROM texts))")
    want = scanners.scan(df, scanners.blocks, "k", "t", least_bytes=30).select("k", "function_name", "line_start")
    assert rows(got) == rows(want) and got.count() == 42
    assert spark.sql("SELECT * FROM patterns_of(TABLE(SELECT k, t FROM texts WHERE k = 'b'))").count() == 0


def test_numbers_that_are_not_finite_have_no_score(spark):
    v = {1: [1.0, 0.0], 2: [1.0, 0.1], 3: [float("nan"), 1.0], 4: [float("inf"), 1.0], 5: [1.0, None]}
    df = spark.createDataFrame(list(v.items()), "id long, v array<double>")
    q = df.where("id IN (1, 3)").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    assert [(r["query"], r["id"]) for r in ann.exact_topk(df, q, 3).collect()] == [(1, 2)]
    assert {(r["query"], r["id"]) for r in ann.similarity_rows(df, q).collect()} == {(1, 1), (1, 2)}
