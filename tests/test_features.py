import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import features as E
from siftwork.functions import purpose as P
from siftwork.plans import tools


@pytest.mark.parametrize(("rules", "name", "want"), [(P.FUNCTION_NAMES, "create_x", "factory method"), (P.FUNCTION_NAMES, "zap", "general purpose function"), (P.PARAMETER_NAMES, "key", "identifier"), (P.PARAMETER_NAMES, "file_path", "file path"), (P.TYPE_NAMES, "&T", "immutable reference"), (P.TYPE_NAMES, "XBuilder", "builder pattern object"), (P.DERIVES, "Eq", "equality comparison"), (P.ATTRIBUTES, "#[inline]", "inlining hint"), (P.FIELD_NAMES, "user_id", "foreign identifier"), (P.FIELD_NAMES, None, None)])
def test_rules(spark, rules, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(P.by_rules(F.col("n"), rules)).first()[0] == want


def test_cluster_kind(spark):
    df = spark.createDataFrame([(1, "formatX"), (1, "checkY"), (2, "zap"), (3, None)], "g int, n string")
    got = {r["g"]: r["k"] for r in df.groupBy("g").agg(P.cluster_kind(F.col("n")).alias("k")).collect()}
    assert got == {1: "Validation", 2: "Utility", 3: "Utility"}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "function a() {}"), (2, "function a() {}"), (3, "x"), (4, ""), (5, None)], "id int, t string")
    for name in ("lexical", "hashed"):
        got = {r["id"]: r["embedding"] for r in E.embed_texts(df, "id", "t", name).collect()}
        assert got[1] == got[2] != got[3] and got[5] is None and len(got[4]) == E.DIM
        assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        E.register_embedder("lexical", E.lexical_vector)
    f = df.where("id = 1").select(E.semantic_features(F.col("t")).alias("s"), E.content_features(F.col("t")).alias("c")).first()
    assert len(f["s"]) == 32 and f["s"][0] == 1 and f["s"][1] == 0 and f["c"][2] == 0.5


def test_tools(spark, tmp_path):
    rows = [(1, "loadPanel", "src/a.ts", "export function loadPanel() { return api; }", "typescript", 2.0), (2, None, "src/b.spec.ts", "panel", "rust", None)]
    spark.createDataFrame(rows, "fragment_id long, function_name string, file_path string, code_content string, language string, complexity_score float").write.parquet(f"{tmp_path}/code_fragments.parquet")
    found = tools.call(spark, str(tmp_path), "search", '{"query": "panel", "languages": ["TypeScript"]}').collect()
    assert [r["fragment_id"] for r in found] == [1]
    got = tools.call(spark, str(tmp_path), "context", {"query": "api function", "max_tokens": 100}).collect()
    assert [r["id"] for r in got] == [1] and got[0]["section"].startswith("// File: src/a.ts (relevance: ")
    with pytest.raises(KeyError):
        tools.call(spark, str(tmp_path), "nothing")
    with pytest.raises(KeyError):
        tools.call(spark, str(tmp_path), "status", {"odd": 1})
    with pytest.raises(ValueError):
        tools.tool("status", "again")(lambda: None)
    tools.register_table_functions(spark)
    assert spark.sql("SELECT function_name FROM function_blocks('function ab() {\n  return 12345678901234567890;\n}', 30)").first()[0] == "ab"
