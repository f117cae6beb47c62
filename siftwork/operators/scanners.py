"""Scanners over lines that need to count brackets: functions, match blocks, call chains, routes; and manifests.

They are Python, in Arrow batches, one pass over whole texts, without a shuffle. A null or empty text gives no row.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.runtime import spread

_START = re.compile(r"^(?:async )?function |=> \{|\(.*:.*\{|:.*\(.*\{|\(.*\{.*:")


def function_name(line: str) -> str:
    """The name that a line opening a function gives."""
    line = line.strip()
    if line.startswith("function "):
        return line.split()[1].partition("(")[0] if len(line.split()) > 1 else "unknown"
    head = line.partition("=")[0] if "=>" in line else line.partition("(")[0]
    parts = head.split()
    return (parts[-1] if "=>" in line else parts[-1].rstrip(":")) if parts else ("unknown" if "=>" in line else "")


def blocks(text: str, least_bytes: int) -> Iterator[dict]:
    """Functions found by counting braces from a line that opens one: name, text, first and last line (from 1).

    A block closes at the first later line after which no brace is open; one of at most ``least_bytes`` is dropped.
    """
    held: list[str] = []
    name, first, open_braces = "", 0, 0
    for n, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None], 1):
        line = line.removesuffix("\r")
        if not held:
            if _START.search(line.strip()):
                held, name, first = [line], function_name(line), n
                open_braces = line.count("{") - line.count("}")
            continue
        held.append(line)
        open_braces += line.count("{") - line.count("}")
        if open_braces <= 0:
            body = "".join(x + "\n" for x in held)
            if name and len(body.encode()) > least_bytes:
                yield {"function_name": name, "code_content": body, "function_signature": held[0].strip(), "line_start": first, "line_end": n}
            held = []


def brace_block(lines: list[str], start: int, most: int = 21) -> str:
    """The lines from ``start`` to the one that closes the first brace opened, at most ``most``."""
    depth, opened, out = 0, False, []
    for line in lines[start : start + most]:
        out.append(line)
        for c in line:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return "\n".join(out)
    return "\n".join(out)


def call_chain(lines: list[str], start: int, most: int = 11) -> str:
    """The lines of a call chain that goes on over line ends."""
    if lines[start].lstrip().startswith("."):
        while start > 0 and lines[start - 1].rstrip().endswith("."):
            start -= 1
    out = []
    for line in lines[start : start + most]:
        out.append(line)
        if not line.strip().endswith((".", "(", ",")):
            break
    return "\n".join(out)


def _around(lines: list[str], at: int, radius: int) -> str:
    return "\n".join(lines[max(0, at - radius) : at + radius + 1])


def patterns(text: str) -> Iterator[dict]:
    """Lines of error handling and algorithms with the lines around them: kind, first and last line, content, complexity."""
    lines = text.splitlines()
    n = len(lines)

    def row(kind: str, first: int, last: int, complexity: float, content: str) -> dict:
        return {"kind": kind, "line_start": first, "line_end": min(last, n), "complexity": complexity, "content": content}

    for at, raw in enumerate(lines):
        line = raw.strip()
        if "?" in line and ("Result" in line or ".await" in line):
            yield row("error_handling_pattern", max(at - 2, 0) + 1, at + 3, 2.0, _around(lines, at, 3))
        if line.startswith("match "):
            block = brace_block(lines, at)
            if "Ok(" in line or "Some(" in line:
                yield row("match_error_handling", at + 1, at + block.count("\n") + 1, 3.0, block)
            if block.count("=>") > 3:
                yield row("match_logic", at + 1, at + block.count("\n") + 1, 3.5, block)
        if line.startswith("if let ") and any(x in line for x in ("Ok(", "Some(", "Err(")):
            yield row("if_let_pattern", at + 1, at + 4, 2.5, _around(lines, at, 4))
        if line.startswith("for "):
            block = brace_block(lines, at)
            if len(block.encode()) > 50:
                yield row("loop_algorithm", at + 1, at + block.count("\n") + 1, 3.0, block)
        if any(x in line for x in (".iter()", ".map(", ".filter(", ".collect(")):
            chain = call_chain(lines, at)
            if len(chain.encode()) > 30:
                yield row("iterator_chain", at + 1, at + chain.count("\n") + 1, 2.5, chain)


def routes(text: str) -> Iterator[dict]:
    """The routes of the first ``Routes = [`` array whose objects have their braces on lines of their own."""
    quoted = lambda s: next((m.group(2) for m in re.finditer(r"(['\"])(.*?)\1", s)), None)
    inside, route = False, None
    for line in map(str.strip, text.splitlines()):
        if not inside:
            inside = "Routes = [" in line
            continue
        if line == "];":
            break
        if line == "{":
            route = {"route": "", "component": "", "guards": [], "redirect_to": None, "lazy": False}
        elif line in ("},", "}") and route is not None:
            yield route
            route = None
        elif route is not None:
            if "path:" in line:
                route["route"] = quoted(line) or route["route"]
            if "component:" in line:
                route["component"] = line.partition("component:")[2].partition(",")[0].strip()
            if "redirectTo:" in line:
                route["redirect_to"] = quoted(line)
            if re.search(r"can(?:Activate|Deactivate|Load):", line) and (m := re.search(r"\[([^\]]*)\]", line)):
                route["guards"] = [x.strip() for x in m.group(1).split(",") if x.strip()]
            route["lazy"] = route["lazy"] or "loadChildren" in line
    if route is not None:
        yield route


def manifest(text: str) -> Iterator[dict]:
    """Package, dependencies, features, targets and workspace of a TOML manifest; nothing if it isn't TOML."""
    try:
        m = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    package = m.get("package", {})

    def listed(table: str) -> list[dict]:
        out = []
        for name, spec in m.get(table, {}).items():
            s = spec if isinstance(spec, dict) else {"version": spec}
            source = "git" if "git" in s else "path" if "path" in s else "registry"
            out.append({"name": name, "version": str(s.get("version", "*")), "source": source, "features": list(map(str, s.get("features", []))), "optional": bool(s.get("optional", False)), "default_features": bool(s.get("default-features", True))})
        return out

    targets = [{"kind": k, "name": str(t.get("name", "")), "path": t.get("path")} for k in ("bin", "example", "test", "bench") for t in m.get(k, [])]
    if isinstance(m.get("lib"), dict):
        targets.append({"kind": "lib", "name": str(m["lib"].get("name", package.get("name", ""))), "path": m["lib"].get("path")})
    features = m.get("features", {})
    work = m.get("workspace")
    text_of = lambda v, default: v if isinstance(v, str) else default
    yield {
        "package_name": text_of(package.get("name"), ""), "version": text_of(package.get("version"), "0.1.0"), "edition": text_of(package.get("edition"), "2021"),
        "dependencies": listed("dependencies"), "dev_dependencies": listed("dev-dependencies"), "build_dependencies": listed("build-dependencies"),
        "features": [{"name": k, "requires": list(map(str, v)), "is_default": k in features.get("default", [])} for k, v in features.items()],
        "targets": targets, "members": None if work is None else list(work.get("members", [])), "excluded": None if work is None else list(work.get("exclude", [])),
    }


_DEPENDENCY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("source", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("optional", T.BooleanType()), T.StructField("default_features", T.BooleanType())]))
_STRINGS = T.ArrayType(T.StringType())
SCHEMAS: dict[Callable, T.StructType] = {
    blocks: T.StructType([T.StructField("function_name", T.StringType()), T.StructField("code_content", T.StringType()), T.StructField("function_signature", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType())]),
    patterns: T.StructType([T.StructField("kind", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("complexity", T.DoubleType()), T.StructField("content", T.StringType())]),
    routes: T.StructType([T.StructField("route", T.StringType()), T.StructField("component", T.StringType()), T.StructField("guards", _STRINGS), T.StructField("redirect_to", T.StringType()), T.StructField("lazy", T.BooleanType())]),
    manifest: T.StructType(
        [T.StructField(c, T.StringType()) for c in ("package_name", "version", "edition")]
        + [T.StructField(c, _DEPENDENCY) for c in ("dependencies", "dev_dependencies", "build_dependencies")]
        + [
            T.StructField("features", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("requires", _STRINGS), T.StructField("is_default", T.BooleanType())]))),
            T.StructField("targets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType())]))),
            T.StructField("members", _STRINGS),
            T.StructField("excluded", _STRINGS),
        ]
    ),
}


def scan(df: DataFrame, scanner: Callable, key_col: str, text_col: str, **options: object) -> DataFrame:
    """The rows that a scanner of this module finds in each text, with the key of the text's row."""
    key = T.StructField(key_col, df.schema[key_col].dataType)
    found = SCHEMAS[scanner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(found)
        for b in batches:
            source, rows = [], []
            for at, text in enumerate(b.column("__text").to_pylist()):
                for row in scanner(text, **options) if text else ():
                    source.append(at)
                    rows.append(row)
            made = pa.Table.from_pylist(rows, schema=kinds).combine_chunks()
            cols = [made.column(c).combine_chunks() for c in kinds.names]
            yield pa.RecordBatch.from_arrays([b.column("__key").take(pa.array(source, pa.int64())), *cols], names=[key_col, *kinds.names])

    return spread(df.select(F.col(key_col).alias("__key"), F.col(text_col).alias("__text"))).mapInArrow(run, T.StructType([key, *found.fields]))
