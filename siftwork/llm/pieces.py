"""Cutting oversized items at natural boundaries, with balanced targets and an overlap.

The least number of pieces comes from the limit; equal-length targets are placed, and each is
snapped to the strongest boundary nearby. If a piece with its overlap then breaks the limit, the
whole item is planned again with one piece more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAK = re.compile(r"\r\n|\n|\r")
_WORD_END = re.compile(r"[\s;,)}\]]")
#: How far from its target, as a share of the distance between targets, a cut may go.
REACH = 0.3


def line_starts(text: str) -> np.ndarray:
    """Positions at which a line begins; CR LF, LF and CR each end one line."""
    return np.array([0, *(m.end() for m in _BREAK.finditer(text))], dtype=np.int64)


def _strength(line: str, after: str) -> float:
    """How good it is to cut between these two lines."""
    score = 1.0
    if not line.strip():
        score += 2.0
    elif line.rstrip().endswith(("}", "};", "});", ")", "end")):
        score += 1.0
    elif line.rstrip().endswith((";", ".", ":")):
        score += 0.3
    if after.strip():
        indent = len(after) - len(after.lstrip())
        score += 1.5 / (1 + indent / 2)
        if after.lstrip().startswith(("}", ")", "]", "else", "catch", "finally", "elif", "except")):
            score -= 1.2
    return score


def _overlap(text: str, starts: np.ndarray, cut: int, lines: int) -> int:
    """Where the last ``lines`` lines before the cut begin."""
    k = int(np.searchsorted(starts, cut, side="left")) - 1
    return int(starts[max(0, k - lines + 1)])


def _safe(text: str, at: int) -> int:
    """The next position at or after ``at`` that neither splits CR LF nor parts a mark from its letter."""
    while at < len(text) and (text[at - 1 : at + 1] == "\r\n" or 0x300 <= ord(text[at]) < 0x370 or text[at] in "‍️" or text[at - 1] == "‍"):
        at += 1
    return at


def cuts(text: str, limit: int, lines: int, chars: int) -> list[tuple[int, int, int]]:
    """For each piece: where its text begins, where its own part begins, where it ends."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    if limit <= 2 * chars:
        raise ValueError("the limit must be more than twice the overlap")
    starts = line_starts(text)
    bounds = np.append(starts, n)
    strength: dict[int, float] = {}

    def best(target: float, low: int, high: int) -> int:
        i, j = np.searchsorted(starts, [low, high])
        found = []
        for k in range(max(1, int(i)), int(j)):
            at = int(starts[k])
            if at not in strength:
                strength[at] = _strength(text[starts[k - 1] : at], text[at : bounds[k + 1]])
            found.append((strength[at] - 2.5 * abs(at - target) / (high - low), -abs(at - target), at))
        if found:
            return max(found)[2]
        for reach in range(int(high - low)):
            for at in (int(target) - reach, int(target) + reach):
                if low < at < high and _WORD_END.match(text, at - 1):
                    return _safe(text, at)
        return _safe(text, int(target))

    pieces = max(2, -(-(n - chars) // (limit - chars)))
    while True:
        step = n / pieces
        at, done, out = 0, True, []
        for k in range(1, pieces + 1):
            start = at
            if k > 1:
                start = _overlap(text, starts, at, lines)
            if k < pieces:
                # what is left is spread evenly over the pieces that are left
                target = at + (n - at) / (pieces - k + 1)
                high = min(n, at + limit - (min(chars, at) if k > 1 else 0))
                end = best(min(target, high), max(at + 1, int(target - REACH * step)), min(high, int(target + REACH * step)) + 1)
            else:
                end = n
            if end - start > limit or start < (out[-1][0] if out else 0):
                start = max(0, at - chars)
                start = min(at, _safe(text, start) if start else 0)
            if end - start > limit or end <= at:
                done = False
                break
            out.append((start, at, end))
            at = end
        if done:
            return out
        pieces += 1


def split_items(df: DataFrame, id_col: str = "fragment_id", text_col: str = "code_content", line_col: str = "line_start", limit: int = 1600, overlap_lines: int = 2, overlap_chars: int = 100) -> DataFrame:
    """The pieces of every item of more than ``limit`` characters (code points; CR and LF are one each).

    Columns: ``id_col``, ``piece`` from 1, ``n_pieces``, ``text``, ``overlap`` (characters repeated from
    the piece before), ``line_start`` and ``line_end`` of the text, counted on from ``line_col`` whatever
    the input's own end line says. A null ``line_col`` gives null lines. Null, empty and short items have
    no pieces. Repeated rows are cut once; rows that share an id but differ are each cut. Pieces without
    their overlap, put together, are the item. Two lines that would not fit beside the piece's own
    part give way to the last ``overlap_chars`` characters. An item's own cuts follow in order, so
    texts of any length work; no shuffle but the one that drops repeated rows.
    """
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("n_pieces", T.IntegerType()), ("text", T.StringType()), ("overlap", T.IntegerType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()))])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            source: list[int] = []
            for row, (text, first) in enumerate(zip(b.column("__text").to_pylist(), b.column("__line").to_pylist())):
                made = cuts(text, limit, overlap_lines, overlap_chars)
                starts = line_starts(text)
                for k, (start, own, end) in enumerate(made):
                    a, z = (np.searchsorted(starts, [start, max(start, end - 1)], side="right") - 1).tolist()
                    source.append(row)
                    for c, v in zip(cols, (k + 1, len(made), text[start:end], own - start, None if first is None else first + a, None if first is None else first + z)):
                        c.append(v)
            arrays = [b.column("__id").take(pa.array(source, pa.int64()))] + [pa.array(c, pa.string() if name == "text" else pa.int32()) for name, c in zip(names[1:], cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    big = df.where(F.length(text_col) > limit).select(F.col(id_col).alias("__id"), F.col(line_col).cast("int").alias("__line"), F.col(text_col).alias("__text"))
    return big.dropDuplicates().mapInArrow(run, out)
