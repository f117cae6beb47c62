import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import pieces

LIMIT, LINES, CHARS = 1600, 2, 100


def check(text, limit=LIMIT, lines=LINES, chars=CHARS):
    made = pieces.cuts(text, limit, lines, chars)
    assert "".join(text[own:end] for _, own, end in made) == text
    assert all(end - start <= limit for start, _, end in made)
    assert len(made) >= -(-len(text) // limit)
    for (_, _, before), (start, own, _) in zip(made, made[1:]):
        assert own == before
        last = text[:own]
        starts = pieces.line_starts(last)
        whole = max((int(s) for s in starts if len([x for x in starts if x >= s and x < own]) >= lines), default=0)
        assert start == whole or own - start <= chars + 2, "two lines, or the last characters"
        assert text[own - 1 : own + 1] != "\r\n"
    return made


CASES = ["x" * 5000, "\r\n" * 3000, "\r" * 2000, "ab\n" * 4000, "é" * 2000, "\n" * 1601, "y" * 1601, "word " * 1000, "l" * 1500 + "\n" + "m" * 1500 + "\n" + "z" * 3000, "a\n" + "b" * 1599, "日本語\n" * 700, "é" * 1700]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_cases(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab {};é\t", max_size=60), st.sampled_from(["\n", "\r\n", "\r", "\n\n"])), max_size=60), st.integers(60, 200))
def test_any_text(parts, limit):
    check("".join(a + b for a, b in parts), limit, 2, 20)


def test_cuts_at_natural_boundaries():
    rng = random.Random(2)
    text = "\n\n".join(f"function f{k}() {{\n" + "\n".join("  " + "x" * rng.randint(5, 60) for _ in range(rng.randint(3, 12))) + "\n}" for k in range(40))
    made = check(text)
    assert all(text[own:].startswith("function") for _, own, _ in made[1:])
    sizes = [end - own for _, own, end in made]
    assert max(sizes) < 2.2 * min(sizes)


def test_pieces_of_a_table(spark):
    long = "line of code;\n" * 200
    data = [(1, long, 10, 5), (1, long, 10, 5), (2, "x" * 1600, 1, 1), (3, "x" * 1601, None, None), (4, None, 1, 1), (5, "", 1, 1), (None, long, 1, 1)]
    df = spark.createDataFrame(data, "fragment_id long, code_content string, line_start int, line_end int").withColumnRenamed("line_end", "piece")
    got = pieces.split_items(df).orderBy("fragment_id", "piece").collect()
    assert {r["fragment_id"] for r in got} == {None, 1, 3}
    mine = [r for r in got if r["fragment_id"] == 1]
    assert [r["piece"] for r in mine] == list(range(1, mine[0]["n_pieces"] + 1)), "repeated rows are cut once"
    assert "".join(r["text"][r["overlap"] :] for r in mine) == long
    assert mine[0]["line_start"] == 10 and mine[-1]["line_end"] == 209
    for a, b in zip(mine, mine[1:]):
        assert b["line_start"] == a["line_end"] - 1 and b["text"].startswith("line of code;\nline of code;\n")
    assert all(r["line_start"] is None for r in got if r["fragment_id"] == 3)
    assert pieces.split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.cuts("x" * 500, 200, 2, 100)
