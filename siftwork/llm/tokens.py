"""Encoding of texts with a public byte-level BPE tokenizer, by recursive queries.

Each task splits its texts into words with the tokenizer's pattern and keeps the distinct
words. A recursive DuckDB query holds them as rows (word, position, token): every round joins
neighbouring positions to the merge table, takes for each word the pair of least rank and
contracts its occurrences from the left, until no word has a pair left. An ordered aggregation
gives the ids of a word, and the texts are put together from their words.

Contracting all occurrences of the least pair in one round equals contracting the leftmost one
round after round: a pair that the contraction makes has a greater rank than its parts' merges,
so the other occurrences of the least pair come next anyway.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.runtime import spread

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: How this tokenizer's words are cut out of a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that one recursive query sees; bounds a task's memory.
CHUNK_CHARS = 3_000_000
#: Words whose ids a worker remembers from one chunk to the next.
REMEMBERED = 300_000

#: Bytes above which a word is contracted by all its occurrences of a pair at once.
LONG_WORD = 64

#: Short words: a word is one row, its positions are unnested to rows in each round.
_SHORT = """
WITH RECURSIVE step(w, toks, round) AS (
    SELECT w, toks, 0 FROM spelled
    UNION ALL
    SELECT s.w, list_concat(list_append(s.toks[:p.best % 128], (p.best // 128)::INTEGER), s.toks[p.best % 128 + 3:]), s.round + 1
    FROM step s JOIN (
        SELECT w, min(merged * 128 + pos) AS best
        FROM (SELECT w, unnest(toks[:-2])::BIGINT * 65536 + unnest(toks[2:]) AS pair, unnest(range(len(toks) - 1)) AS pos FROM step) JOIN merges USING (pair)
        GROUP BY w
    ) p USING (w)
)
SELECT w, arg_max(toks, round) AS ids FROM step GROUP BY w ORDER BY w
"""

#: Long words: a position is one row all along.
_LONG = """
WITH RECURSIVE step(w, pos, tok, round) AS (
    SELECT w, pos, tok, 0 FROM letters
    UNION ALL
    SELECT w, pos, CASE WHEN taken THEN merged ELSE tok END, round + 1 FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS swallowed FROM (
            SELECT *, least_pair AND row_number() OVER (PARTITION BY w, least_pair, island ORDER BY pos) % 2 = 1 AS taken FROM (
                SELECT *, n - row_number() OVER (PARTITION BY w, least_pair ORDER BY pos) AS island FROM (
                    SELECT *, coalesce(merged = min(merged) OVER (PARTITION BY w), false) AS least_pair, count(merged) OVER (PARTITION BY w) AS pairs FROM (
                        SELECT a.w, a.pos, a.tok, a.round, a.n, m.merged
                        FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS after, row_number() OVER (PARTITION BY w ORDER BY pos) AS n FROM step) a
                        LEFT JOIN merges m ON m.pair = a.tok::BIGINT * 65536 + a.after
                    )
                )
                WHERE pairs > 0
            )
        )
    )
    WHERE NOT swallowed
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round)
GROUP BY w ORDER BY w
"""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of words; one for each vocabulary file in a Python worker."""

    _known: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p.split(" ", 1) if isinstance(p, str) else p for p in model["merges"]]
        made = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in pairs], dtype=np.int32)
        if (np.diff(made[:, 2]) <= 0).any():
            raise ValueError("ids must rise with the rank of the merges")
        letters = _byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.words: dict[str, np.ndarray] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB"})
        if made.max() >= 65536:
            raise ValueError("ids of two bytes are expected")
        self.db.register("given", pa.table({"pair": made[:, 0].astype(np.int64) * 65536 + made[:, 1], "merged": made[:, 2]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.pattern = regex.compile(PATTERN)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def learn(self, words: list[str]) -> None:
        """Encode the words that aren't known yet."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        if not new:
            return
        raw = [(w, w.encode("utf-8", "surrogatepass")) for w in new]
        self._contract([x for x in raw if len(x[1]) <= LONG_WORD], "spelled", _SHORT)
        self._contract([x for x in raw if len(x[1]) > LONG_WORD], "letters", _LONG)

    def _contract(self, raw: list[tuple[str, bytes]], name: str, query: str) -> None:
        if not raw:
            return
        sizes = np.fromiter((len(b) for _, b in raw), dtype=np.int64, count=len(raw))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        toks = self.of_byte[np.frombuffer(b"".join(b for _, b in raw), dtype=np.uint8)]
        ordinal = np.arange(len(raw), dtype=np.int32)
        if name == "spelled":
            given = pa.table({"w": ordinal, "toks": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(toks))})
        else:
            given = pa.table({"w": np.repeat(ordinal, sizes), "pos": (np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)).astype(np.int32), "tok": toks})
        self.db.register(name, given)
        found = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister(name)
        at, ids = np.asarray(found.offsets), np.asarray(found.values.cast(pa.int32()))
        for k, (w, _) in enumerate(raw):
            self.words[w] = ids[at[k] : at[k + 1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; a null or empty text has no ids."""
        cut = self.pattern.findall
        per_text = [cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
        coded = pa.array([w for ws in per_text for w in ws], type=pa.string()).dictionary_encode()
        del per_text
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        ids = [self.words[w] for w in distinct]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        codes = np.asarray(coded.indices)
        long = sizes[codes]
        ends = np.cumsum(long)
        at = np.repeat(starts[codes] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)
        words_to = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate([[0], ends])[words_to], flat[at]


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of the batches with at most CHUNK_CHARS characters, or one text if that alone has more."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = held = 0
        for k, t in enumerate(texts):
            if k > start and held + len(t or "") > CHUNK_CHARS:
                yield batch.slice(start, k - start), texts[start:k]
                start, held = k, 0
            held += len(t or "")
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, counts_only: bool = False) -> DataFrame:
    """``id_col`` and ``ids ARRAY<INT>``, or ``n_tokens INT`` with ``counts_only``; one row for each row of ``df``.

    Null, empty: an empty list (0 tokens). Blank texts have the ids of their white space. Repeated
    rows and null ids stay as they are; an empty table gives an empty table; other columns, whatever
    their names, are not read. A text of any length is encoded whole. It is a map over the partitions,
    without a shuffle.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        for batch, texts in _chunks(batches, "__text"):
            ends, ids = encoder.encode(texts)
            made = pa.array(np.diff(ends).astype(np.int32)) if counts_only else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), made], names=[id_col, out.names[1]])

    return spread(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))).mapInArrow(run, out)
