import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwork.llm import packing, tokens

TEXTS = [None, "", " ", "\n\n", "Hello, world!", "aaaa" * 50, "don't we'll I'm", "naïve 日本語のテキスト ﷽ 👩‍👩‍👧", "x" * 500, "=-" * 300, " \t\n  x", "<|endoftext|> a", "tab\tand\x00nul\x85 ", "1234567890" * 9, "́combining", "Hello, world!"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.BYTE_BPE)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_ids_equal_the_tokenizer(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_texts(df).collect()}
    assert got == {k: reference(t) for k, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encode_texts(df, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_ids_of_random_texts(reference):
    rng = random.Random(3)
    pool = [*map(chr, range(1, 0x250)), *"日本語текстعربى👍🏽 \n\t'", " the", " of", "ing"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 300))) for _ in range(150)]
    at, ids = tokens.WordEncoder.of(tokens.BYTE_BPE).encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == reference(t)


def test_long_text_and_chunks(reference, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 50)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.WordEncoder(tokens.BYTE_BPE)
    text = "".join(chr(97 + k * k % 26) for k in range(3000)) + " word" * 400
    at, ids = e.encode([text, "a b c", "d e f g"])
    assert ids[: at[1]].tolist() == reference(text)


def test_other_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", "y"), (1, "a", "x", "y"), (None, "b", "x", "y")], "doc_id long, text string, ids string, __text string")
    got = sorted(map(tuple, tokens.encode_texts(df).collect()), key=repr)
    assert len(got) == 3 and got[0] == got[1]
    assert tokens.encode_texts(df.limit(0)).count() == 0


def best_fit(sizes, capacity):
    import bisect

    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, n = capacity, n + 1
        if gap > s:
            bisect.insort(gaps, gap - s)
    return n


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(2, 60))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    u, c = np.unique(sizes, return_counts=True)
    table, n = packing.plan(dict(zip(u.tolist(), c.tolist())), capacity)
    assert n == best_fit(sizes.tolist(), capacity)
    assert len(table) <= 8 * capacity


def test_plan_of_many_items_stays_small():
    table, n = packing.plan({s: 10**7 for s in range(1, 2049)}, 2048)
    assert len(table) < 20_000 and n >= 10**7 * 2049 / 2
    assert packing.plan({}, 10)[1] == 0
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def packed(df, **options):
    return packing.pack(df, "id", "n", **options).collect()


def check(rows, sizes, capacity):
    load, parts = {}, {}
    for r in rows:
        if r["container"] is None:
            assert r["size"] == 0
            continue
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        parts.setdefault(r["id"], []).append((r["piece"], r["first"], r["size"]))
    assert all(0 < x <= capacity for x in load.values())
    assert set(load) == set(range(len(load)))
    for key, n in sizes.items():
        if not n:
            continue
        at = 0
        for p, (piece, first, size) in enumerate(sorted(parts[key])):
            assert (piece, first) == (p, at) and (size == capacity or first + size == n)
            at += size
        assert at == n and len(parts[key]) == -(-n // capacity)
    return len(load)


def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 5, 7, 7, 7, 20, 33, 64, 65, 200, rng.randint(1, 300)]) for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n int")
    n = check(packed(df, capacity=64), sizes, 64)
    pieces = [p for s in sizes.values() for p in [64] * (s // 64) + [s % 64] if p]
    assert n == best_fit(pieces, 64)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 5), (3, 5), (None, 5), (None, 5)], "id long, n int")
    got = packed(df, capacity=10)
    assert len(got) == 6 and sorted(r["container"] for r in got if r["container"] is not None) == [0, 0, 1, 1]
    assert packed(df.limit(0), capacity=10) == []
    hot = spark.range(3000).select(F.col("id"), F.lit(3).alias("n"))
    assert check(packed(hot, capacity=10), {i: 3 for i in range(3000)}, 10) == 1000


def test_texts_are_sized_in_tokens(spark, reference):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = packing.pack_texts(df, capacity=16).collect()
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
    assert sizes == {k: len(reference(t)) for k, t in enumerate(TEXTS)}
