from datetime import datetime

import pytest

from siftwork.functions import features
from siftwork.operators.search import Filters
from siftwork.operators.store import VectorStore, semantic_search
from siftwork.sources.files import VECTOR_SCHEMA

TEXTS = {"a": "function loadUser(id) { return api.get(id); }", "b": "function saveUser(id) { return api.put(id); }", "c": "class Panel extends Base {}"}


def entries(spark, rows, dim=32):
    made = [(i, features.lexical_vector(t, dim).tolist(), path, i, 1, 2, "Function", "typescript", 1.0, t.split(), "h", datetime(2024, 1, 1), datetime(2024, 1, day)) for i, t, path, day in rows]
    return spark.createDataFrame(made, VECTOR_SCHEMA)


def test_vector_store(spark, tmp_path, rows):
    s = VectorStore(spark, f"file://{tmp_path}/s", 32)
    assert s.all().count() == 0 and s.search([0.0] * 32).count() == 0
    s.add(entries(spark, [("a", TEXTS["a"], "f1", 1), ("a", TEXTS["b"], "f1", 2), ("b", TEXTS["b"], "f1", 1), ("c", TEXTS["c"], "f2", 1)]))
    assert rows(s.all(), "id") == [("a",), ("b",), ("c",)]
    assert s.by_id("a").first()["tokens"] == TEXTS["b"].split(), "the last updated row of an id counts"
    s.update(entries(spark, [("a", TEXTS["a"], "f1", 3)]))
    assert s.all().count() == 3 and s.by_file("f1").count() == 2 and s.by_file("none").count() == 0
    v = features.lexical_vector(TEXTS["a"], 32).tolist()
    for exact in (True, False):
        found = s.search(v, 2, exact=exact).orderBy("rank").collect()
        assert found[0]["id"] == "a" and found[0]["score"] == pytest.approx(1, abs=1e-6)
    total = s.stats().where("language IS NULL AND code_type IS NULL").first()
    assert (total["n"], total["files"]) == (3, 2)
    assert s.delete(spark.createDataFrame([("a",), ("z",)], "id string")) == 1
    assert s.replace_files(entries(spark, [("n", TEXTS["c"], "f1", 1)])) and rows(s.all(), "id") == [("c",), ("n",)]
    with pytest.raises(ValueError):
        s.add(entries(spark, [("q", "x", "f", 1)], 16))
    with pytest.raises(ValueError):
        s.search([1.0])


def test_semantic_search(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", 32)
    s.add(entries(spark, [(i, t, f"src/{i}.ts", 1) for i, t in TEXTS.items()]))
    found = semantic_search(s, TEXTS["a"], 2, exact=True).collect()
    assert [r["id"] for r in found] == ["a", "b"] and found[0]["score"] >= found[1]["score"]
    assert found[0]["similarity"] == pytest.approx(1, abs=1e-6) and 0 < found[0]["confidence"] <= 1
    left = semantic_search(s, TEXTS["a"], 2, Filters(include_paths=["src/c"]), exact=True)
    assert left.count() == 0, "the filter comes after the limit"
