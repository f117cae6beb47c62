"""Named tools with parameters, and scanners as table functions of SQL.

A tool is a function (session, folder, parameters) -> DataFrame under a name, with the parameters it knows
and their defaults: the form in which a server or a notebook calls the engine by JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf

from siftwork.operators import ann, scanners
from siftwork.operators import search as S
from siftwork.plans import reports
from siftwork.runtime import table


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    about: str
    parameters: Mapping[str, object] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(name: str, about: str, **parameters: object) -> Callable:
    """Register a function as a tool; its keyword parameters and their defaults are given here."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TOOLS:
            raise ValueError(f"the tool {name} exists")
        TOOLS[name] = Tool(f, about, parameters)
        return f

    return put


def call(spark: SparkSession, folder: str, name: str, parameters: str | Mapping[str, object] = "{}") -> DataFrame:
    """Run a tool with parameters in JSON or as a mapping; unknown names of tools and parameters are errors."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
    given = json.loads(parameters) if isinstance(parameters, str) else dict(parameters)
    known = TOOLS[name].parameters
    if unknown := set(given) - set(known):
        raise KeyError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return TOOLS[name].run(spark, folder, **{**known, **given})


def _current_fragments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Of each fragment id the row extracted last; of rows extracted at once, or where a table doesn't tell when, the greatest."""
    f = table(spark, folder, "code_fragments")
    top = F.max(F.struct(*[c for c in ("extracted_at",) if c in f.columns], *columns)).alias("top")
    return f.groupBy("fragment_id").agg(top).select("fragment_id", *[f"top.{c}" for c in columns])


@tool("search", "Fragments by words, with filters before or after the limit", query="", limit=20, languages=None, include_paths=None, exclude_paths=None, filter_after=True)
def search(spark, folder, query, limit, languages, include_paths, exclude_paths, filter_after):
    f = _current_fragments(spark, folder, "function_name", "code_content", "file_path", "language", "complexity_score").where("code_content IS NOT NULL")
    f = f.select("fragment_id", F.coalesce("function_name", F.lit("")).alias("function_name"), "code_content", "file_path", "language", F.lit("Function").alias("code_type"), F.col("complexity_score").alias("complexity"))
    wanted = S.Filters(languages, None, include_paths, exclude_paths)
    found = S.search(f, S.lexical_score(query, F.col("function_name"), F.col("code_content")), "fragment_id", limit, filters=wanted, filter_after=filter_after)
    return found.select("fragment_id", "function_name", "file_path", "score", "rank", F.array_join(F.slice(F.split("code_content", r"\s+"), 1, 10), " ").alias("snippet"))


@tool("similar", "Entries most similar to one entry", id="", limit=10, least=0.3, most=None)
def similar(spark, folder, id, limit, least, most):
    v = table(spark, folder, "vectors").groupBy("id").agg(F.max_by("embedding", F.struct("updated_at", "hash")).alias("v"))
    return ann.exact_topk(v, v.where(F.col("id") == id).select(F.col("id").alias("query"), F.col("v").alias("qv")), limit if most is None else min(limit, most), least=least)


@tool("context", "The best files for a question, packed into a token budget", query="", max_tokens=4000, include_tests=False)
def context(spark, folder, query, max_tokens, include_tests):
    from siftwork.functions.classify import is_test_path

    f = _current_fragments(spark, folder, "code_content", "file_path").where("code_content IS NOT NULL AND file_path IS NOT NULL")
    f = f if include_tests else f.where(~is_test_path(F.col("file_path")))
    scored = f.withColumn("score", S.rerank_score(F.lit(query), F.col("code_content")))
    packed = S.pack_budget(scored, "fragment_id", "file_path", "code_content", "score", max_tokens)
    text = scored.select(F.col("fragment_id").alias("id"), "code_content")
    return packed.join(text, "id").select("id", "file", "score", "tokens", S.file_section(F.col("file"), S.snippet_of(F.col("code_content"), F.col("tokens")), F.col("score")).alias("section"))


@tool("file", "What is known of one file", path="")
def one_file(spark, folder, path):
    return reports.current_files(spark, folder, "size", "line_count", "file_type", "complexity", "summary", "project").where(F.col("path") == path)


@tool("status", "Files, complexity and health")
def status(spark, folder):
    return reports.report_status(spark, folder)


@tool("changes", "Files that the next run must handle")
def changed(spark, folder):
    return reports.cache_to_analyse(spark, folder)


@tool("impact", "Impact of a change to files whose path holds a text", path="")
def impact(spark, folder, path):
    return reports.impact_files(spark, folder).where(F.contains("path", F.lit(path)))


def _scanned(batch: pa.RecordBatch, scanner: Callable, schema: pa.Schema, **options: object) -> pa.Table:
    keys, rows = [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        for row in scanner(text, **options) if text else ():
            keys.append(key)
            rows.append(row)
    return pa.Table.from_pylist(rows, schema=schema).add_column(0, "key", pa.array(keys, pa.string()))


_BLOCKS = pa.schema([("function_name", pa.string()), ("code_content", pa.string()), ("function_signature", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
_PATTERNS = pa.schema([("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("complexity", pa.float64()), ("content", pa.string())])


@arrow_udtf(returnType="key: string, function_name: string, code_content: string, function_signature: string, line_start: int, line_end: int")
class BlocksOf:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _scanned(batch, scanners.blocks, _BLOCKS, least_bytes=30)


@arrow_udtf(returnType="key: string, kind: string, line_start: int, line_end: int, complexity: double, content: string")
class PatternsOf:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _scanned(batch, scanners.patterns, _PATTERNS)


@udtf(returnType="function_name: string, code_content: string, function_signature: string, line_start: int, line_end: int", useArrow=True)
class FunctionBlocks:
    def eval(self, text: str, least_bytes: int):
        for r in scanners.blocks(text or "", least_bytes):
            yield tuple(r.values())


@udtf(returnType="kind: string, line_start: int, line_end: int, complexity: double, content: string", useArrow=True)
class CodePatterns:
    def eval(self, text: str):
        for r in scanners.patterns(text or ""):
            yield tuple(r.values())


def register_table_functions(spark: SparkSession) -> None:
    """For SQL: ``blocks_of(TABLE(...))`` and ``patterns_of(TABLE(...))`` of a table whose first two columns are a key and a text, by whole
    Arrow batches; ``function_blocks(text, least_bytes)`` and ``code_patterns(text)`` of one text, for LATERAL, their rows sent as Arrow batches."""
    for name, f in (("blocks_of", BlocksOf), ("patterns_of", PatternsOf), ("function_blocks", FunctionBlocks), ("code_patterns", CodePatterns)):
        spark.udtf.register(name, f)


def fragments_by_sql(spark, folder):
    """The functions of all files by a table function in SQL."""
    register_table_functions(spark)
    table(spark, folder, "source_files").createOrReplaceTempView("__sources")
    return spark.sql("SELECT key AS path, function_name, line_start, line_end FROM blocks_of(TABLE(SELECT path, content FROM __sources WHERE content IS NOT NULL AND (path LIKE '%.ts' OR path LIKE '%.js')))")


def tool_search(spark, folder):
    return call(spark, folder, "search", '{"query": "export session", "limit": 20, "languages": ["typescript"]}').select("fragment_id", "rank")


def tool_context(spark, folder):
    return call(spark, folder, "context", {"query": "class api error handler", "max_tokens": 2000}).select("id", "file", "tokens")


QUERIES = {f.__name__: f for f in (fragments_by_sql, tool_search, tool_context)}
ORACLES: dict[str, str] = {}
