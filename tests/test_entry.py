import __spark_entry__ as entry


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert entry.FLAGSHIP in q


def test_core_does_not_need_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "siftwork"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siftwork.llm" not in p.read_text(), p
