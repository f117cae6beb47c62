"""Telling hand-written source from generated, minified and vendored files and from data stored as code.

1. Layout: greatest and mean line length, share of white space, share of letters and digits, density of number literals, length of
   encoded runs and share of lines of one shape, against limits fitted for each language. Of a file whose content can't be read, size and
   line count give the mean line length.
2. Notices: what a tool or another party writes about the file itself, in the comments before its first code or after its last.
3. Places: the folders that package managers fill, those that tools fill beside the sources, and the names that tools give their
   output. They tell only of files of which nothing within says that the project's people wrote them.

Each is a named signal; the first found is told.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.runtime import spread


@dataclass(frozen=True)
class Limits:
    """Layout thresholds of a language. Lengths in characters, shares of all characters or lines."""

    longest: int
    mean: float
    least_space: float
    most_space_dense: float
    most_alnum: float
    numbers: float
    encoded_run: int
    one_shape: float


#: Fixed values, fitted on the training table for each language: about the geometric mean of the most that hand-written files show and the least that cases show (where a language has none, four times what hand-written files show at most).
LIMITS = {
    "javascript": Limits(400, 295, 0.065, 0.13, 0.910, 3.0, 300, 0.40),
    "typescript": Limits(450, 300, 0.065, 0.13, 0.915, 3.0, 400, 0.44),
    "rust": Limits(500, 228, 0.055, 0.26, 0.905, 4.0, 300, 0.35),
    "python": Limits(530, 230, 0.050, 0.13, 0.930, 2.0, 285, 0.50),
    "css": Limits(143, 80, 0.110, 0.11, 0.860, 12.0, 300, 0.75),
}
#: The language that a file's extension stands for.
EXTENSIONS = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "py": "python", "css": "css", "scss": "css"}
#: Folders that nobody but a package manager or a tool fills, wherever they are. A name counts as a whole segment.
MANAGED_FOLDERS = frozenset("node_modules bower_components jspm_packages __generated__ __pycache__ .next".split())
#: Folders that tools fill where they lie beside the sources; below a source folder such a name is as good as any other.
OUTPUT_FOLDERS = frozenset("build out dist target codegen generated gen".split())
#: Folders that hold sources, and those right below them in which tools put what they generate.
SOURCE_FOLDERS, GENERATED_BELOW = frozenset("src source sources".split()), frozenset("gen generated".split())
#: Folders for foreign code, if another folder (the library's) follows.
FOREIGN_FOLDERS = frozenset("vendor third_party thirdparty third-party extern deps 3rdparty".split())
#: Lines of code from which a file is one, whatever data it holds besides.
CODE_LINES = 3
_LIBRARY_VERSION = re.compile(r"^[A-Za-z][\w.]*(?:-[A-Za-z]\w*)*[-@]v?\d+\.\d+(?:\.\d+)?$")
_TOOL_NAME = re.compile(r"(?:\.min|\.bundle|\.prod|\.chunk|\.pb|_pb2|\.g|\.generated|\.gen|\.ngfactory|\.ngsummary|\.designer)\.[a-z]+$")

_MADE = r"(?:auto[- ]?(?:matically )?generated|automatically (?:generated|produced|created|written)|machine[- ](?:written|generated|made)|automatisch (?:erzeugt|erstellt|generiert)|généré automatiquement|generado automáticamente)"
#: What a tool writes about its own output, at the start of a comment line.
_TOOL_NOTICE = re.compile(
    rf"^(?:@generated\b|<auto-?generated|code generated by\b|generated (?:by|from|with)\b|{_MADE} (?:file|from|by|code|aus|par|por)\b|(?:this (?:file|code|source|is an?)|the (?:file|code)|diese datei|ce fichier|este archivo).{{0,20}}{_MADE}|{_MADE}\W*$|output of .{{1,60}}(?:regenerate|do not edit)|(?:do not|don't|never) (?:edit|modify|change)\b.{{0,40}}(?:by hand|manually|generated|file)|(?:do not edit|do not modify)\W*$|compiled (?:by|from|with)\b|transpiled (?:by|from)\b)",
    re.I,
)
#: How another party's code names its origin, at the start of a comment line.
_FOREIGN_NOTICE = re.compile(
    r"^(?:@licen[sc]e\b.*\d|@preserve\b|.{1,60}copied from (?:upstream|https?:)|upstream(?: source)?: https?:|vendored from\b|[\w.-]+ (?:javascript |css |js )?library v?\d|.{1,40}\bv?\d+\.\d+\.\d+ ?\| ?(?:\(c\)|©|licen[sc]e|mit)|\(c\) .{1,60}(?:contributors|makers|authors)\b|copyright .{1,80}(?:foundation|contributors)\b)",
    re.I,
)
_NAMED_VERSION = re.compile(r"^[A-Za-z][\w.-]* v?\d+\.\d+(?:\.\d+)?$")
_RELEASED = re.compile(r"^(?:released|licensed|distributed) under (?:the )?\w+", re.I)
_SOURCE_MAP = re.compile(r"^\s*(?://|/\*)[#@] sourceMappingURL=", re.M)
#: How people say that a file is their own; a name in it must be one of the path's.
_OWN_NOTICE = re.compile(r"^(?:(?:hand-?written|written by hand)\b|copyright\b.*)", re.I)
#: What may come before the first comment that isn't code: a marker of the language or an attribute of the whole file.
_PREAMBLE = re.compile(r"^\s*(?:#!|[\"']use (?:strict|client|server)[\"'];?\s*$)")
_LINE_COMMENT = {"python": ("#",), "rust": ("//",), "css": (), "javascript": ("//", "<!--"), "typescript": ("//", "<!--")}
_QUOTES = ('"""', "'''")
_NUMBER = re.compile(r"(?<![\w.#])[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_CODE_WORD = re.compile(r"\b(?:function|class|const|let|var|return|import|export|if|for|while|switch|def|fn|impl|use|struct|from|interface|this|self|pub|async|await)\b")
_DIGITS = re.compile(r"0x[0-9a-fA-F]+|\d+")
_HEXWORD = re.compile(r"(['\"])(?=[0-9a-f]*\d)?[0-9a-f]{4,64}\1")
_COUNTED = re.compile(r"[A-Za-z_]+\d+\b")


def language_of(path: str | None, language: str | None = None) -> str | None:
    ext = (path or "").rpartition(".")[2].lower()
    return EXTENSIONS.get(ext) or (language or "").lower() or None


def _place(path: str | None) -> tuple[str | None, list[str]]:
    """The signal of a file's place and name, if any, and the folders before the one that gives it."""
    segments = [s.lower() for s in (path or "").replace("\\", "/").split("/") if s not in ("", ".")]
    folders = segments[:-1]
    if _TOOL_NAME.search(segments[-1] if segments else ""):
        return "tool_name", folders
    sources = next((k for k, s in enumerate(folders) if s in SOURCE_FOLDERS), len(folders))
    for k, s in enumerate(folders):
        if s in MANAGED_FOLDERS or s in OUTPUT_FOLDERS and k < sources or s in GENERATED_BELOW and k == sources + 1:
            return "tool_folder", folders[:k]
        if s in FOREIGN_FOLDERS and k + 1 < len(folders) or _LIBRARY_VERSION.match(s):
            return "foreign_folder", folders[:k]
    return None, folders


def by_path(path: str | None) -> str | None:
    """The signal that a file's place and name give, if any."""
    return _place(path)[0]


def _said(line: str) -> str:
    return line.strip(" \t*!-=#/>").removesuffix("*/").removesuffix("-->").strip(" \t*!-=#/\"'")


def leading_comments(lines: list[str], language: str | None) -> list[str]:
    """What the comments before the first code say, line by line, blocks included, however long they are."""
    signs = _LINE_COMMENT.get(language or "", ("//", "#", "<!--"))
    out, until = [], ""
    for line in lines:
        body = line.strip()
        if until:
            end = body.find(until)
            out.append(_said(body if end < 0 else body[:end]))
            if end >= 0:
                if body[end + len(until) :].strip():
                    break
                until = ""
        elif not body or _PREAMBLE.match(body):
            continue
        elif body.startswith("/*") and language != "python" or body.startswith(_QUOTES) and language in ("python", None):
            until = "*/" if body[0] == "/" else body[:3]
            end = body.find(until, len(until))
            out.append(_said(body if end < 0 else body[len(until) : end]) if body[0] == "/" or end >= 0 else _said(body[3:]))
            if end >= 0:
                if body[end + len(until) :].strip():
                    break
                until = ""
        elif signs and body.startswith(signs):
            out.append(_said(body))
        elif body.startswith("#![") and language == "rust":
            continue
        else:
            break
    return out


def trailing_comments(lines: list[str], language: str | None) -> list[str]:
    """What the comments after the last code say."""
    signs = _LINE_COMMENT.get(language or "", ("//", "#", "<!--"))
    out: list[str] = []
    k = len(lines) - 1
    while k >= 0:
        body = lines[k].strip()
        if not body or signs and body.startswith(signs):
            out.append(_said(body))
        elif body.endswith("*/") and language != "python":
            first = k
            while first >= 0 and "/*" not in lines[first]:
                first -= 1
            # a comment behind code on its line belongs to that
            if first < 0 or not lines[first].lstrip().startswith("/*"):
                break
            out += [_said(x) for x in lines[first : k + 1][::-1]]
            k = first
        else:
            break
        k -= 1
    return [x for x in reversed(out) if x]


def _notice(said: list[str]) -> str | None:
    named = False
    for line in said:
        if _TOOL_NOTICE.match(line):
            return "tool_notice"
        if _FOREIGN_NOTICE.match(line) or named and _RELEASED.match(line):
            return "foreign_notice"
        named = named or bool(_NAMED_VERSION.match(line))
    return None


def by_head(content: str, language: str | None = None) -> str | None:
    """The signal of a notice in the comments before a file's first code."""
    return _notice(leading_comments(content.lstrip("\ufeff").splitlines(), language))


def by_foot(content: str, language: str | None = None) -> str | None:
    """The signal of a notice in the comments after a file's last code."""
    return _notice(trailing_comments(content.splitlines(), language))


def own_notice(said: list[str], folders: list[str]) -> bool:
    """Whether a comment says that the file is the project's own: written by hand, or copyright of a name that is one of the folders that it lies in."""
    names = {s for s in folders if len(s) > 2}
    for line in said:
        if _OWN_NOTICE.match(line) and (not line.lower().startswith("copyright") or names & set(re.findall(r"[\w.-]+", line.lower())[1:])):
            return True
    return False


def layout(content: str) -> dict[str, float]:
    """The layout statistics of a text; a byte order mark and blank lines at the ends don't count."""
    text = content.lstrip("\ufeff").strip("\r\n")
    return _line_layout(text) | _word_layout(text)


def _line_layout(text: str) -> dict[str, float]:
    lines = [x for x in text.splitlines() if x.strip()]
    n = max(1, len(text))
    no_space = "".join(text.split())
    return {
        "chars": len(text),
        "lines": len(lines),
        "longest": max(map(len, lines), default=0),
        "mean": n / max(1, len(lines)),
        "space": 1 - len(no_space) / n,
        "alnum": sum(map(str.isalnum, no_space)) / max(1, len(no_space)),
        "run": sum(len(x) for x in _RUN.findall(text)),
    }


def _word_layout(text: str) -> dict[str, float]:
    lines = [x for x in text.splitlines() if x.strip()]
    shapes = Counter(_COUNTED.sub("N", _DIGITS.sub("0", _HEXWORD.sub("H", x.strip()))) for x in lines)
    # a word of the language within a row of data is none of code
    bare = sum(1 for x in lines if x.lstrip()[0] not in "{[\"'-0123456789" and _CODE_WORD.search(x))
    return {
        "numbers": 100 * sum(1 for _ in _NUMBER.finditer(text)) / max(1, len(text)),
        "one_shape": max((c for s, c in shapes.items() if len(s) > 2), default=0) / max(1, len(lines)),
        "code_lines": bare,
        "number_lines": sum(map(_number_line, lines)) / max(1, len(lines)),
    }


def _number_line(line: str) -> bool:
    found = _NUMBER.findall(line)
    return bool(found) and not _CODE_WORD.search(line) and sum(map(len, found)) * 2 > sum(map(str.isalnum, line)) and len(line.strip()) > 1


def by_layout(content: str, language: str | None) -> str | None:
    """The signal of a file's layout, if any."""
    text = content.lstrip("\ufeff").strip("\r\n")
    s, t = _line_layout(text), LIMITS.get(language or "", LIMITS["javascript"])
    if s["chars"] < 120:
        return None
    if s["run"] >= t.encoded_run and s["run"] > 0.4 * s["chars"]:
        return "encoded"
    if s["longest"] >= t.longest and s["space"] < t.least_space:
        return "dense_lines"
    s |= _word_layout(text)
    if s["mean"] > t.mean and (s["longest"] > t.longest and s["space"] < t.most_space_dense or s["code_lines"] < CODE_LINES or s["alnum"] > t.most_alnum):
        return "data_lines"
    if language != "css" and s["numbers"] > t.numbers and s["number_lines"] > 0.5:
        return "numbers"
    if s["lines"] >= 12 and s["one_shape"] > t.one_shape:
        return "one_shape"
    # rows of records have fewer numbers than plain ones, but hardly any code
    if language != "css" and s["numbers"] > 0.6 * t.numbers and s["code_lines"] < CODE_LINES and s["lines"] >= 3:
        return "numbers"
    # the last line may hold the whole map
    end = content.rstrip()
    if _SOURCE_MAP.search(content, max(end.rfind("\n"), end.rfind("\r")) + 1):
        return "source_map"
    return None


def by_counts(size: int | None, lines: int | None, language: str | None) -> str | None:
    """The signal of a file's size and line count alone, where its content can't be read."""
    t = LIMITS.get(language or "", LIMITS["javascript"])
    return "dense_lines" if size and lines and lines > 0 and size >= 2 * t.longest and size / lines > 2 * t.mean else None


def signal_of(path: str | None, content: str | None, language: str | None, size: int | None = None, lines: int | None = None) -> str | None:
    """Why a file isn't hand-written, or None."""
    language = language_of(path, language)
    if not content:
        return by_counts(size, lines, language) or by_path(path)
    found = by_layout(content, language)
    if found:
        return found
    found = by_head(content, language) or by_foot(content, language)
    if found:
        return found
    place, folders = _place(path)
    return None if place and own_notice(leading_comments(content.lstrip("\ufeff").splitlines(), language), folders) else place


def not_handwritten(df: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str = "language", size_col: str = "size", lines_col: str = "line_count") -> DataFrame:
    """``path`` and ``signal`` of the files that nobody on the project wrote by hand; other files have no row.

    A null or empty content is judged by size, line count and path; a null path by the content alone. A null language is
    taken from the extension; an unknown one has the limits of JavaScript. Columns for size and lines that ``df`` lacks count as
    null. Repeated rows come out repeatedly. Whole texts are read, one pass, no shuffle. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, signals = [], []
            for path, content, language, size, lines in zip(*(b.column(k).to_pylist() for k in range(5))):
                signal = signal_of(path, content, language, size, lines)
                if signal:
                    paths.append(path)
                    signals.append(signal)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(signals, pa.string())], names=["path", "signal"])

    counts = [(F.col(c) if c in df.columns else F.lit(None)).cast("long").alias(n) for c, n in ((size_col, "d"), (lines_col, "e"))]
    given = df.select(F.col(path_col).cast("string").alias("a"), F.col(content_col).alias("b"), F.col(language_col).alias("c"), *counts)
    return spread(given).mapInArrow(run, "path string, signal string")
