"""Dense feature vectors of texts: counts and flags as columns, and hashed embeddings in Arrow batches.

The embeddings are deterministic: the same text gives the same vector on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import contains_any, count_of, line_count, words

#: What the features look for, in order.
FLAGS = ("function", "class", "interface", "async", "await", "import", "export", "const", "let", "var")
FLOW = ("if", "for", "while", "switch", "try", "catch")
FRAMEWORK = ("@Component", "@Injectable", "@Input", "@Output", "Observable", "subscribe", "ngOnInit", "ngOnDestroy")
COUNTED = ("function", "class", "const", "let", "var", "if", "for", "while", "async", "await", "import", "export", "interface", "type")
FRAMEWORK_COUNTED = ("HttpClient", "Router", "FormBuilder", "Validators", "pipe", "map", "filter", "catchError")
DIM = 768


def semantic_features(text: Column) -> Column:
    """Thirty-two flags, counts and logarithms; logarithms of an empty text are null."""
    flag = lambda w: F.when(F.contains(text, F.lit(w)), 1.0).otherwise(0.0)
    n = lambda w, by: count_of(text, w) / float(by)
    return F.array(
        *[flag(w) for w in FLAGS], *[n(w, 10) for w in FLOW], *[flag(w) for w in FRAMEWORK],
        F.log2(line_count(text).cast("double")) / 10.0, F.log2(F.octet_length(text).cast("double")) / 20.0, n("{", 50), n("(", 50), n("[", 50), flag("/**"), flag("//"), n("@param", 10),
    )


def content_features(text: Column) -> Column:
    """Length, words, whether it looks like code, punctuation and upper case shares."""
    size = F.octet_length(text).cast("double")
    per = F.greatest(size, F.lit(1.0))
    return F.array(F.log(size) / 10.0, F.log(F.size(words(text)).cast("double")) / 5.0, F.when(contains_any(text, ("function", "class", "interface")), 0.5).otherwise(-0.2), F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")) / per, F.regexp_count(text, F.lit(r"\p{Lu}")) / per)


def _rolling(text: str) -> int:
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def lexical_vector(text: str, dim: int = DIM) -> np.ndarray:
    """Scaled counts, flags, then bytes and a rolling hash under a sine; unit length (zero for a text without any)."""
    raw = text.encode()
    head = [len(raw) / 1000, len(text.splitlines()) / 50, *map(text.count, COUNTED), *(float(w in text) for w in FRAMEWORK), *map(text.count, FRAMEWORK_COUNTED)]
    at = np.arange(len(head), dim)
    by_byte = np.zeros(dim - len(head))
    seen = np.frombuffer(raw, np.uint8)[len(head) : dim]
    by_byte[: len(seen)] = (seen.astype(np.float64) - 128) / 128
    with np.errstate(over="ignore"):
        by_hash = ((np.uint64(_rolling(text)) * at.astype(np.uint64)) % np.uint64(1000)).astype(np.float64)
    tail = (by_byte * 0.7 + (by_hash - 500) / 1000 * 0.3) * np.sin(at / dim * np.pi)
    v = np.concatenate([np.array(head, dtype=np.float64), tail])
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def hashed_vector(text: str, dim: int = DIM) -> np.ndarray:
    """Numbers of a linear congruence that starts from the text's hash; unit length."""
    x, out = _rolling(text), np.empty(dim)
    for k in range(dim):
        x = (x * 1103515245 + 12345) & 0xFFFFFFFFFFFFFFFF
        out[k] = (x >> 16) % 65536 / 32768 - 1
    return out / np.linalg.norm(out)


EMBEDDERS: dict[str, Callable[[str, int], np.ndarray]] = {"lexical": lexical_vector, "hashed": hashed_vector}


def register_embedder(name: str, embed: Callable[[str, int], np.ndarray]) -> None:
    """Make a text-to-vector model of one's own available by name; a known name can't be taken."""
    if name in EMBEDDERS:
        raise ValueError(f"the embedder {name} exists")
    EMBEDDERS[name] = embed


def embed_texts(df: DataFrame, id_col: str, text_col: str, embedder: str = "lexical", dim: int = DIM) -> DataFrame:
    """``id_col`` and ``embedding ARRAY<FLOAT>``; each distinct text of a batch is embedded once. Null texts have a null vector."""
    embed, kind = EMBEDDERS[embedder], df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text").to_pylist()
            made = {t: embed(t, dim).astype(np.float32) for t in set(texts) if t is not None}
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([made.get(t) for t in texts], pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def attended(vectors: np.ndarray, text: str) -> np.ndarray:
    """A text's vector (or several) with weights that its hash gives each place, and a wave of the place added: v * (1 + 0.1 w) + 0.05 sin(i / 1000^(2 (i mod 2) / 768))."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(len(codes), 31, np.uint64)
        powers[-1:] = 1
        # 31^(n-1) ... 31, 1 modulo 2^64
        h = (codes * np.multiply.accumulate(powers[::-1])[::-1]).sum(dtype=np.uint64) if len(codes) else np.uint64(0)
        i = np.arange(vectors.shape[-1], dtype=np.uint64)
        weight = (h * i % np.uint64(1000)).astype(np.float64) / 1000 * 2 - 1
    place = np.arange(vectors.shape[-1])
    return vectors * (1 + weight * 0.1) + np.sin(place / 1000 ** (2 * (place % 2) / 768)) * 0.05


def attend(df: DataFrame, id_col: str, text_col: str, vector_col: str) -> DataFrame:
    """``id_col`` and ``vector``: ``attended`` of each row's vector and text. Null texts count as empty; null vectors and vectors with nulls stay null."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if v is None or None in v else attended(np.array(v, np.float64), t or "").tolist() for v, t in zip(b.column("__v").to_pylist(), b.column("__t").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(made, pa.list_(pa.float64()))], names=[id_col, "vector"])

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(vector_col).alias("__v")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, vector array<double>")
