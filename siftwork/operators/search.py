"""Lexical search and reranking of texts, filters, and packing of the best into a token budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.text import count_of, line_count, sigmoid, token_estimate, words

#: Pairs of words (of query and text) that raise an enhanced relevance, and by how much.
BOOSTS = (("function", "function", 0.02), ("class", "class", 0.02), ("async", "async", 0.02), ("interface", "interface", 0.02), ("component", "@Component", 0.05), ("service", "@Injectable", 0.05))


def _any(parts: Sequence[str], text: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def lexical_score(query: str, name: Column, text: Column) -> Column:
    """2 for each query word in the name, 1 for each in the text, 1 for the whole query in it; over the words, through a sigmoid at 1.

    A query without words has no score.
    """
    q = query.lower()
    low_name, low_text = F.lower(name), F.lower(text)
    asked = q.split()
    if not asked:
        return F.lit(None).cast("double")
    score = F.when(F.contains(low_text, F.lit(q)), 1.0).otherwise(0.0)
    for w in asked:
        score = score + F.when(F.contains(low_name, F.lit(w)), 2.0).otherwise(0.0) + F.when(F.contains(low_text, F.lit(w)), 1.0).otherwise(0.0)
    return sigmoid((score / len(asked) - 1.0) * 2.0)


def name_relevance(name: Column, pattern: str) -> Column:
    """1 for the same name, 0.8 for one that begins with the pattern, 0.6 for one that holds it; letter case doesn't count."""
    n, p = F.lower(name), F.lit(pattern.lower())
    return F.when(n == p, 1.0).when(F.startswith(n, p), 0.8).when(F.contains(n, p), 0.6).otherwise(0.0)


def enhanced_relevance(query: str, similarity: Column, name: Column, path: Column, text: Column) -> Column:
    """Similarity, name, words, boosts and file name, through a steep sigmoid at 0.5."""
    q = query.lower()
    asked = q.split()
    score = similarity * 0.6 + F.when(F.contains(F.lower(name), F.lit(q)), 0.25).otherwise(0.0)
    if asked:
        hits = F.lit(0)
        for w in asked:
            if len(w.encode()) > 2:
                hits = hits + F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0)
        score = score + hits / len(asked) * 0.15
    for in_query, in_text, gain in BOOSTS:
        if in_query in query:
            score = score + F.when(F.contains(text, F.lit(in_text)), gain).otherwise(0.0)
    score = score + F.when(F.contains(F.lower(F.substring_index(path, "/", -1)), F.lit(q)), 0.03).otherwise(0.0)
    return sigmoid((score - 0.5) * 4.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _marks(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, _PUNCTUATION, ""))


def _capitals(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\p{Lu}"))


def text_facts(df: DataFrame, text_col: str) -> DataFrame:
    """With what ``rerank_score`` needs of a text, so that it is found once for each text, whatever is asked of it."""
    t = F.col(text_col)
    return df.withColumns({"__lower": F.lower(t), "__marks": _marks(t), "__capitals": _capitals(t), "__rows": line_count(t)})


def rerank_score(query: Column, text: Column, facts: bool = False) -> Column:
    """How relevant a text is to a query, from 0 to 1: words 0.4, meaning signs 0.3, structure 0.2, length 0.1. With ``facts`` the rows have those of ``text_facts``."""
    q = F.lower(query)
    t, marks, capitals, rows = map(F.col, ("__lower", "__marks", "__capitals", "__rows")) if facts else (F.lower(text), _marks(text), _capitals(text), line_count(text))
    asked = words(q)
    # a word without white space is in one of the text's words if it is in the text, which needn't be split
    found = F.size(F.filter(asked, lambda w: F.contains(t, w)))
    keyword = F.when(F.size(asked) == 0, 0.0).otherwise(found / F.size(asked))
    both = lambda *parts: _any(parts, q) & _any(parts, t)
    meaning = F.when(both("function"), 0.3).otherwise(0.0) + F.when(both("class", "interface"), 0.3).otherwise(0.0) + F.when(both("api"), 0.2).otherwise(0.0) + F.when(both("error"), 0.2).otherwise(0.0)
    structure = (
        F.when((_marks(query) > 0) & (marks > 0), _ratio(_marks(query), marks) * 0.3).otherwise(0.0)
        + F.when((_capitals(query) > 0) & (capitals > 0), _ratio(_capitals(query), capitals) * 0.2).otherwise(0.0)
        + F.when((line_count(query) > 1) & (rows > 1), _ratio(line_count(query), rows) * 0.5).otherwise(0.0)
    )
    nq, nt = F.octet_length(query), F.octet_length(text)
    r = _ratio(nq, nt)
    length = F.when((nq == 0) | (nt == 0), 0.0).when(r > 0.5, 1.0 - (1.0 - r) * 2.0).otherwise(r * 2.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), keyword * 0.4 + F.least(F.lit(1.0), meaning) * 0.3 + F.least(F.lit(1.0), structure) * 0.2 + length * 0.1))


def score_confidence(score: Column) -> Column:
    return F.when(score > 0.8, 0.9).when(score > 0.6, 0.7).when(score > 0.4, 0.5).otherwise(0.3)


def impact_reason(text: Column) -> Column:
    """Why a text may be affected by a change: the first sign it has."""
    t = F.lower(text)
    return F.when(_any(("import", "require"), t), "imports").when(_any(("function", "class"), t), "definitions").when(_any(("interface", "type"), t), "types").otherwise("patterns")


def path_document(path: Column) -> Column:
    """A path as a text to rank: file, type, folder and the words of all its parts."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(name)
    return F.concat(F.lit("File: "), name, F.lit(" Type: "), F.substring_index(name, ".", -1), F.lit(" Directory: "), folder, F.lit(" Components: "), F.translate(F.array_join(parts, " "), "-_", "  "))


@dataclass(frozen=True)
class Filters:
    """Conditions on found rows; those that are None hold for all. Languages are compared without letter case."""

    languages: Sequence[str] | None = None
    code_types: Sequence[str] | None = None
    include_paths: Sequence[str] | None = None
    exclude_paths: Sequence[str] | None = None
    least_complexity: float | None = None
    most_complexity: float | None = None

    def condition(self) -> Column:
        """One predicate over ``language, code_type, file_path, complexity``, which the engine pushes into the scan where it can."""
        out = F.lit(True)
        if self.languages is not None:
            out = out & F.lower("language").isin(*[x.lower() for x in self.languages])
        if self.code_types is not None:
            out = out & F.col("code_type").isin(*self.code_types)
        if self.include_paths is not None:
            out = out & _any(self.include_paths, F.col("file_path"))
        if self.exclude_paths is not None:
            out = out & ~_any(self.exclude_paths, F.col("file_path"))
        if self.least_complexity is not None:
            out = out & (F.col("complexity") >= self.least_complexity)
        if self.most_complexity is not None:
            out = out & (F.col("complexity") <= self.most_complexity)
        return out


def search(df: DataFrame, score: Column, id_col: str, k: int | None = None, above: float | None = None, filters: Filters | None = None, filter_after: bool = True) -> DataFrame:
    """Rows with ``score`` and ``rank``, best first, ties by id; by default filters come after the limit, so that a filtered search may give fewer than ``k``."""
    rows = df if filters is None or filter_after else df.where(filters.condition())
    rows = rows.withColumn("score", score).where("score IS NOT NULL")
    if above is not None:
        rows = rows.where(F.col("score") > above)
    ranked = rows.orderBy(F.desc("score"), id_col)
    if k is not None:
        ranked = ranked.limit(k)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))
    return ranked if filters is None or not filter_after else ranked.where(filters.condition())


def pack_budget(df: DataFrame, id_col: str, file_col: str, text_col: str, score_col: str, budget: int, least: float = 0.1) -> DataFrame:
    """The best rows that fit a token budget: ``id, file, score, tokens, upto, cut``.

    A twentieth of the budget is for structure. Of each file the best row counts (ties by id); rows come in order
    of score. The first row that would exceed the budget is cut to what is left (``cut``) and ends the list, also if
    nothing of it fits (then it has 0 tokens and is left out). Only rows that can still be in the list reach the final
    sort: as each takes at least one token, the best ``budget`` files are enough. Rows of an empty text take no token
    and can't crowd the list; they are left out.
    """
    room = budget - budget // 20
    rows = df.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.col(score_col).alias("score"), token_estimate(F.col(text_col)).alias("tokens")).where((F.col("score") >= least) & (F.col("tokens") > 0))
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id"))
    best = rows.withColumn("__n", first).where("__n = 1").drop("__n").orderBy(F.desc("score"), "id").limit(room + 1)
    upto = F.sum("tokens").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    seen = best.withColumn("sum", upto).withColumn("before", F.col("sum") - F.col("tokens")).where(F.col("before") < room)
    fits = F.col("sum") <= room
    return seen.select("id", "file", "score", F.when(fits, F.col("tokens")).otherwise(room - F.col("before")).alias("tokens"), F.least("sum", F.lit(room)).alias("upto"), (~fits).alias("cut"))


def snippet_of(text: Column, tokens: Column) -> Column:
    """The characters that so many tokens stand for, with a mark where the text is cut."""
    n = F.floor(tokens * 4.5).cast("int")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, F.lit(1), n), F.lit("\n// ... (truncated)")))


def file_section(path: Column, content: Column, score: Column) -> Column:
    return F.concat(F.format_string("// File: %s (relevance: %.2f)\n", path, score), content, F.lit("\n\n"))


def keyword_total(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + count_of(text, p)
    return out


def relevance_reason(question: Column, text: Column) -> Column:
    """Why a text fits a question: the first kind of thing that both name."""
    q, t = F.lower(question), F.lower(text)
    both = lambda w: F.contains(q, F.lit(w)) & F.contains(t, F.lit(w))
    return (
        F.when(both("function"), "Contains function definitions matching the query")
        .when(both("class"), "Contains class definitions matching the query")
        .when(both("api"), "Contains API-related code matching the query")
        .when(q.isNotNull() & t.isNotNull(), "Contains code patterns relevant to the query")
    )


def filters_of(kind: str, value: str | None = None) -> Filters:
    """The filters that a type of search stands for: similar_code (a language), similar_functions, similar_components (a framework), file_context (a path) or general."""
    from siftwork.functions.classify import LANGUAGES

    if kind == "general":
        return Filters()
    if kind == "similar_functions":
        return Filters(code_types=("Function",))
    if kind not in ("similar_code", "similar_components", "file_context") or not value:
        raise ValueError(f"no search of type {kind} with {value!r}")
    if kind == "similar_code":
        return Filters(languages=(value,))
    if kind == "similar_components":
        return Filters(code_types=("Component",), languages=(value,))
    language = LANGUAGES.get(value.rpartition(".")[2].lower()) if "." in value.rpartition("/")[2] else None
    return Filters(languages=None if language is None else (language,))
