"""Text measures as columns: lines, tokens, substring counts, snippets, token estimates.

All take and give columns, stay in the JVM, and give null for a null text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword search leaves out (in lower case only).
STOP_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for")
#: Characters that one token of a budget stands for.
CHARS_PER_TOKEN = 4.5


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def contains_any(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def lines(text: Column) -> Column:
    """The lines, split at LF, without the CR before it; a last empty line doesn't count."""
    split = F.split(text, "\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def line_count(text: Column) -> Column:
    """The number of lines, without building them."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return (breaks + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def words(text: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def index_tokens(text: Column, least_bytes: int = 3, most: int = 50) -> Column:
    """The first ``most`` words of at least ``least_bytes`` bytes."""
    return F.slice(F.filter(words(text), lambda w: F.octet_length(w) >= least_bytes), 1, most)


def keywords(text: Column) -> Column:
    """Words of more than two bytes in lower case, without stop words; these are recognised in lower case only."""
    kept = F.filter(words(text), lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.transform(kept, F.lower)


def first_line(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^([^\r\n]*)", 1), text)


def snippet(text: Column, most: int = 10, head: int = 5, tail: int = 2) -> Column:
    """A text of at most ``most`` lines as it is, else its first and last lines around an ellipsis."""
    ls = lines(text)
    cut = F.concat(F.array_join(F.slice(ls, 1, head), "\n"), F.lit("...\n"), F.array_join(F.slice(ls, -tail, tail), "\n"))
    return F.when(F.size(ls) <= most, text).otherwise(cut)


def preprocess(text: Column) -> Column:
    """Trimmed lines without blank ones and without those that begin with ``//`` or ``/*``."""
    kept = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("/*")))
    return F.array_join(kept, "\n")


def context_lines(text: Column, first: Column, last: Column, radius: int = 2) -> Column:
    """The lines from ``radius`` before line ``first`` to ``radius`` after line ``last`` (from 1)."""
    start = F.greatest(first - radius, F.lit(1))
    return F.array_join(F.slice(lines(text), start.cast("int"), F.greatest(last + radius - start + 1, F.lit(0)).cast("int")), "\n")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) * F.lit(1.0 / CHARS_PER_TOKEN)).cast("long")


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Common share of two arrays as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def ellipsis(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots if the text is longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(most - 3, 0))), F.lit("...")))


def literal_type(value: Column) -> Column:
    """The type of a literal as source code writes it; ``auto`` for what isn't one."""
    v = F.trim(value)
    return (
        F.when(F.rlike(v, F.lit(r"^(['\"`]).*\1$")), "string")
        .when(F.rlike(v, F.lit(r"^[-+]?(?:\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|0[xX][0-9a-fA-F]+)$")), "number")
        .when(v.isin("true", "false"), "boolean")
        .when(v.isin("null", "undefined"), v)
        .when(F.startswith(v, F.lit("[")), "array")
        .when(F.startswith(v, F.lit("{")), "object")
        .when(v.isNotNull(), "auto")
    )
