"""Functions paired with their documentation.

A scanner for each language blanks strings and comments out of a file, finds the declarations of
functions and methods in what is left, and puts them into a symbol table: qualified name, normalised
signature, whether there is a body, the classes, interfaces or traits that the owner is derived from, and the
comment that belongs to the declaration. What the comments say is then joined with the definitions of the same project,
family of languages, owner, name and normalised signature: that of a definition with itself, that of documented
declarations without a body (methods of interfaces and traits, abstract and overloaded ones) across files with the
definitions of the same owner or of one derived from it, so overloads find their own. Definitions that find a
description come out as pairs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.handwritten import language_of
from siftwork.runtime import spread

#: Words that a description must have besides the function's name and small words.
LEAST_WORDS = 3
#: Small grammar words.
SMALL = frozenset(
    """a an the this that these those it its of to in on at by for from with without as into onto over under up out off and or but nor so if then than when while is are was were be been being am do does did
    has have had will would can could shall should may might must not no yes all any each every some such which who whom whose what where how here there he she they we you i his her their our your my me him them us
    der die das den dem des ein eine einer einen einem und oder aber nicht ist sind war wird werden von vor zu zur zum im in an am auf aus bei mit nach als wie für um ob so nur noch auch es er sie wir ihr
    el la los las un una unos unas de del al y o u en con por para que se es son no si su sus lo como más
    le les l d un une des du de la et ou en dans par pour sur sous avec sans que qui se ce cette ces est sont ne pas au aux à son sa ses""".split()
)
#: How a note begins that a text is still to be written, or that work is left.
_MARK = re.compile(r"^\W*(?:TODO|FIXME|TBD|WIP|XXX|HACK|(?:todo|fixme|tbd|wip|xxx)(?=\W|$)(?=\s*[:.!-]|\s*$))\b")
#: What such notes say.
_UNWRITTEN = re.compile(
    r"\b(?:documentation|description|docs?|docstring|explanation|comment)s? (?:is |are )?(?:missing|pending|(?:still )?(?:to follow|to be (?:written|added|done)|has to be|needs? to be|needed)|goes here|here)\b|\bplaceholder\b|\b(?:insert|add|write|provide|put) (?:an? |the |some )?(?:\w+ )?(?:summary|description|documentation|explanation|docs?|docstring)\b|^\W*(?:documentation|description) missing\b|\bstill (?:has|have|needs?) to be (?:written|documented)|\bto be (?:documented|described|written)\b|\bundocumented\b|\b(?:beschreibung|dokumentation|erklärung) (?:folgt|fehlt)\b|\b(?:falta|pendiente) (?:la |de )?(?:documenta|descri)|\bdocumentation (?:à venir|manquante)\b|\blorem ipsum\b",
    re.I,
)
#: Directives to tools.
_DIRECTIVE = re.compile(r"^\W*(?:eslint|tslint|jshint|jscs|stylelint|prettier-ignore|istanbul|c8 |v8 |ts-(?:ignore|nocheck|check|expect-error)|noinspection|noqa|type: *ignore|pylint|flake8|mypy|pragma|pyright|fmt:|isort|rustfmt|clippy|cspell|webpack|sourceMappingURL|SPDX|region\b|endregion\b|nosec|coding[:=]|allow\(|deny\()", re.I)
_NOTICE = re.compile(r"copyright|\(c\) |©|\blicen[sc]ed? under|spdx-license|do not edit|all rights reserved|auto-?generated", re.I)
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*[\w.$]+\s*(?:[-+*/|&]?=|\+\+|--)(?!=)|^\s*[\w.$:]+\s*\([^()]*\)\s*[;:{]?\s*$|^\s*(?:return|import|from|const|let|var|fn|def|function|class|pub|if|for|while|use)\b[^.]*[({;=]|^\s*[})\]]+|=>|^\s*</?\w+[^>]*>\s*$")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")

_TS_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)
_RS_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'", re.S)
_PY_SKIP = re.compile(r"#[^\n]*|[rbuRBUfF]{0,2}(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)", re.S)

#: Patterns begin with their fixed letters, what stands before these is looked at behind them, and nothing that can't match otherwise is given back: both only for speed.
_NAME = r"[A-Za-z_$][\w$]*"
_TS_FUNCTION = re.compile(rf"function(?<!\wfunction)\b\s*\*?\s*(?P<name>{_NAME})\s*(?=[<(])")
_TS_VALUE = rf"\s*(?:async\s+|async(?=\())?(?:(?P<fn>function\b\s*\*?\s*(?:{_NAME})?\s*)(?=[<(])|(?=[<(])|(?P<one>{_NAME})\s*=>)"
_TS_ASSIGNED = re.compile(rf"=(?<![=!<>+*/%&|^-]=)(?![=>]){_TS_VALUE}")
_TS_PROPERTY = re.compile(rf":{_TS_VALUE}")
_TS_ANNOTATED = re.compile(rf"(?P<name>{_NAME})[?!]?\s*:")
_TS_METHOD = re.compile(rf"^[ \t]*+(?P<mods>(?:(?:@{_NAME}(?:\([^()\n]*\))?|public|private|protected|static|abstract|override|async|get|set|readonly|declare|export|default)[ \t]++)*)\*?[ \t]*+(?P<name>#?{_NAME}+)\??[ \t]*+(?=[<(])", re.M)
_NOT_NAMES = frozenset("if for while switch catch function return with constructor new typeof super await import do else try throw delete void yield of in case instanceof".split())
_TS_OWNER = re.compile(rf"(?:class(?<!\wclass)|interface(?<!\winterface)|namespace(?<!\wnamespace)|module(?<!\wmodule)|enum(?<!\wenum))\s+(?P<name>{_NAME})")
_RS_FUNCTION = re.compile(r"fn(?<!\wfn)\s+(?P<name>(?:r#)?[^\W\d]\w*)\s*(?=[<(])")
_RS_OWNER = re.compile(r"\b(?:impl\b|(?:trait|mod)\s+(?P<name>[A-Za-z_]\w*))")
_PY_FUNCTION = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>[^\W\d]\w*)[ \t]*(?:\[[^\]]*\])?[ \t]*(?=\()", re.M)
_PY_OWNER = re.compile(r"^(?P<indent>[ \t]*)class[ \t]+(?P<name>[^\W\d]\w*)", re.M)
_STOP = re.compile(r"[;{}]")
_BOUND = re.compile(r"[;{}]|=(?!>)")
_BASES = re.compile(r"\b(?:extends|implements)\b")
_DERIVED_WORDS = re.compile(r"[^\W\d][\w$]*")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Symbol:
    name: str
    owner: str
    line: int
    has_body: bool
    parameters: list[dict] = field(default_factory=list)
    signature: str = ""
    comment: str = ""
    bases: list[str] = field(default_factory=list)


_ARROW_BODY = re.compile(r"\s*(?::[^={}]*)?=>\s*\{")
_BRACKET = re.compile(r"[()\[\]{}]")


def _brackets(text: str) -> dict[int, int]:
    """Where each bracket closes; one without a partner is left out."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in "([{":
            stack.append((_PAIRS[c], m.start()))
        elif stack and stack[-1][0] == c:
            out[stack.pop()[1]] = m.start()
        elif any(want == c for want, _ in stack[-3:]):
            while stack:
                want, at = stack.pop()
                if want == c:
                    out[at] = m.start()
                    break
    return out


def _closing(f: "_File", at: int) -> int:
    """Where the bracket at ``at`` closes, or -1; for ``<``, that of type parameters: an arrow's ``>`` closes nothing."""
    if f.masked[at] != "<":
        return f.pairs.get(at, -1)
    depth, k, n = 0, at, len(f.masked)
    while k < n:
        c = f.masked[k]
        if c == "<":
            depth += 1
        elif c == ">" and f.masked[k - 1] not in "=-":
            depth -= 1
            if not depth:
                return k
        elif c in "([{":
            k = f.pairs.get(k, n)
        elif c in ";)]}":
            return -1
        k += 1
    return -1


def _split_top(text: str, masked: str) -> list[tuple[str, str]]:
    """Pieces between top-level commas, of the text and of its masked form."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(masked):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and masked[k - 1] not in "=-":
            depth -= 1
        elif c == "," and depth <= 0:
            out.append((text[start:k], masked[start:k]))
            start = k + 1
    out.append((text[start:], masked[start:]))
    return [x for x in out if x[1].strip()]


_PARAMETER = re.compile(r"^\s*(?:(?:public|private|protected|readonly|override|mut|ref|@\w+(?:\([^)]*\))?)\s+)*(?P<name>\.{3}\w+|&?(?:'\w+\s+)?(?:mut\s+)?self\b|\*{0,2}[\w$]+|[\[{(].*?[\]})])(?P<opt>\?)?\s*(?::(?P<type>.*?))?(?:(?<![=<>!])=(?![=>])(?P<value>.*))?$", re.S)


_SPACES, _UNTYPED, _RECEIVER = re.compile(r"\s+"), re.compile(r"\s+|&|'\w+\s*|\bmut\b|\b(?:\w+::)+"), re.compile(r"&?(?:'\w+ )?(?:mut )?self|cls|this")


def _parameters(text: str, masked: str) -> list[dict]:
    out = []
    for piece, blank in _split_top(text, masked):
        m = _PARAMETER.match(blank)
        if not m:
            continue
        part = lambda g: piece[m.start(g) : m.end(g)].strip() if m.group(g) is not None else None
        name = _SPACES.sub(" ", part("name"))
        if name in ("/", "*"):
            continue
        kind, value = part("type"), part("value")
        out.append({"name": name, "param_type": kind or None, "is_optional": bool(m.group("opt")) or value is not None or bool(kind and kind.startswith("Option<")), "default_value": value})
    return out


def _signature(parameters: list[dict]) -> str:
    """The parameters' types without spaces, paths and lifetimes, the receiver apart; of untyped ones, their number."""
    kinds = [_UNTYPED.sub("", p["param_type"]) if p["param_type"] else "_" for p in parameters if not _RECEIVER.fullmatch(p["name"])]
    return f"{len(kinds)}({','.join(kinds)})"


class _File:
    """A file with strings and comments blanked, its lines and its comments."""

    def __init__(self, content: str, language: str) -> None:
        text = content.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
        self.text, self.python = text, language == "python"
        skip = {"python": _PY_SKIP, "rust": _RS_SKIP}.get(language, _TS_SKIP)
        self.comments: list[tuple[int, int]] = []
        pieces, last = [], 0
        for m in skip.finditer(text):
            a, z = m.span()
            piece = m.group()
            pieces.append(text[last:a])
            comment = piece[0] == "#" if self.python else piece.startswith(("//", "/*"))
            if comment:
                self.comments.append((a, z))
            blank = " " * (z - a) if "\n" not in piece else "\n".join([" " * len(x) for x in piece.split("\n")])
            pieces.append(blank if comment else '"' + blank[1:])
            last = z
        self.masked = "".join(pieces) + text[last:]
        self.pairs = _brackets(self.masked)
        self.opened: dict[int, int] | None = None
        self.marked: tuple[list[int], list[int], list[tuple[int, ...]]] | None = None
        self.found: dict[re.Pattern, list[int]] = {}
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.lines = text.split("\n")
        self.masked_lines = self.masked.split("\n")
        self.ends_on: dict[int, tuple[int, int]] = {}
        for a, z in self.comments:
            if not self.masked[self.starts[self.line(a)] : a].strip() and not self.masked_lines[self.line(z - 1)].strip():
                self.ends_on[self.line(z - 1)] = (a, z)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def opening_line(self, line: int) -> int:
        """The line on which the bracket opens that closes at the end of this one; the line itself if none does."""
        if self.opened is None:
            self.opened = {z: a for a, z in self.pairs.items()}
        at = self.starts[line] + len(self.masked_lines[line].rstrip()) - 1
        return self.line(self.opened[at]) if at in self.opened else line

    def places(self, pattern: re.Pattern) -> list[int]:
        """Where a pattern of single signs matches, found once for the file."""
        if pattern not in self.found:
            self.found[pattern] = [m.start() for m in pattern.finditer(self.masked)]
        return self.found[pattern]

    def decorated_from(self, line: int) -> int:
        """The last line up to this one that begins a decorator or attribute, with no blank line and no open bracket between; the line after this one if there is none."""
        if self.marked is None:
            marks, blanks, depths, mark, blank = [], [], [(0,) * 6], -1, -1
            for k, text in enumerate(self.masked_lines):
                body = text.lstrip()
                mark = k if body.startswith(("@", "#[")) else mark
                blank = blank if body else k
                marks.append(mark)
                blanks.append(blank)
                depths.append(tuple(d + text.count(c) for d, c in zip(depths[-1], "()[]{}")))
            self.marked = marks, blanks, depths
        marks, blanks, depths = self.marked
        k = marks[line]
        if k <= blanks[line]:
            return line + 1
        more = [z - a for a, z in zip(depths[k], depths[line + 1])]
        return k if more[0] == more[1] and more[2] == more[3] and more[4] == more[5] else line + 1

    def name_before(self, at: int, annotated: bool) -> tuple[int, str] | None:
        """Where the name stands that a value at ``at`` is given to, and the name: the word right before, or with ``annotated`` the one before the type between."""
        m, end = self.masked, at
        while end and m[end - 1].isspace():
            end -= 1
        if annotated:
            bounds = self.places(_BOUND)
            k = bisect_left(bounds, at)
            first = bounds[k - 1] + 1 if k else 0
            # names are looked for on the line of the value, then from the end of the statement before
            for start in sorted({max(first, self.starts[self.line(at)]), first}, reverse=True):
                named = _TS_ANNOTATED.search(m, start, end)
                if named:
                    return named.start("name"), named.group("name")
                if m[start:end].strip():
                    break
            end -= end > 0 and m[end - 1] in "?!"
        start = end
        while start and (m[start - 1].isalnum() or m[start - 1] in "_$"):
            start -= 1
        return (start, m[start:end]) if start < end and not m[start].isdigit() else None

    def comment_above(self, line: int) -> str:
        """The comment that ends right above this line or the decorators and attributes over it."""
        top = line
        while top > 0:
            above = self.masked_lines[top - 1].strip()
            if above.startswith(("@", "#[", "#![")) and not self.python or above.startswith("@"):
                top -= 1
                continue
            if above.endswith((")", "]", "})")):
                k = self.opening_line(top - 1)
                if k < top - 1 and self.masked_lines[k].lstrip().startswith(("@", "#[")):
                    top = k
                    continue
                k = self.decorated_from(top - 1)
                if k < top:
                    top = k
                    continue
            break
        end = top - 1
        if end not in self.ends_on:
            return ""
        a, z = self.ends_on[end]
        if self.text.startswith("/*", a):
            return self.text[a:z]
        first = end
        while first - 1 in self.ends_on and not self.text.startswith("/*", self.ends_on[first - 1][0]):
            first -= 1
        return "\n".join(x.strip() for x in self.lines[first : end + 1])

    def heads(self, pattern: re.Pattern) -> Iterator[tuple[re.Match, int]]:
        """Matches of a declaration's first words, and where the brace opens that its head ends with, however long the head is."""
        stops = self.places(_STOP)
        for m in pattern.finditer(self.masked):
            k = bisect_left(stops, m.end())
            while k < len(stops):
                at = stops[k]
                if self.masked[at] != "{":
                    break
                before = self.masked[m.end() : at]
                if before.count("<") > before.count(">") - before.count("=>") - before.count("->") and at in self.pairs:
                    k = bisect_right(stops, self.pairs[at])  # a brace within type arguments
                    continue
                yield m, at
                break


Owner = tuple[int, int, str, list[str]]


def _without_arguments(text: str) -> str:
    """A head without what stands in angle brackets."""
    out, depth = [], 0
    for k, c in enumerate(text):
        if c == "<":
            depth += 1
        elif c == ">" and depth and text[k - 1] not in "=-":
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out)


def _last_names(text: str) -> list[str]:
    """Of names between commas the last segment of each."""
    return [x[-1] for x in (_DERIVED_WORDS.findall(part) for part in text.split(",")) if x]


def _ts_owners(f: _File) -> list[Owner]:
    out = []
    for m, at in f.heads(_TS_OWNER):
        parts = _BASES.split(_without_arguments(f.masked[m.end() : at]))
        out.append((m.start(), f.pairs.get(at, len(f.masked)), m.group("name"), [n for part in parts[1:] for n in _last_names(part)]))
    return out


def _rust_owners(f: _File) -> list[Owner]:
    out = []
    for m, at in f.heads(_RS_OWNER):
        name, bases = m.group("name"), []
        if not name:
            head = re.split(r"\bwhere\b", _without_arguments(f.masked[m.end() : at]))[0]
            trait, _, kind = head.rpartition(" for ")
            names = _last_names(kind)
            if not names:
                continue
            name, bases = names[-1], _last_names(trait)
        out.append((m.start(), f.pairs.get(at, len(f.masked)), name, bases))
    return out


def _owner(owners: list[Owner], at: int) -> tuple[str, list[str]]:
    """The names of the owners around a place, and what the innermost is derived from."""
    around = [o for o in owners if o[0] < at < o[1]]
    return ".".join(o[2] for o in around), list(around[-1][3]) if around else []


def _after_parameters(f: _File, at: int) -> tuple[int, int] | None:
    """The brackets of the parameters that begin, after type parameters, at ``at``."""
    masked = f.masked
    if at < len(masked) and masked[at] == "<":
        end = _closing(f, at)
        if end < 0:
            return None
        at = end + 1
        while at < len(masked) and masked[at].isspace():
            at += 1
    if at >= len(masked) or masked[at] != "(":
        return None
    end = _closing(f, at)
    return (at, end) if end >= 0 else None


def _sign_before(text: str, at: int) -> str:
    while at and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at else "\n"


_NO_BODY, _RETURNS, _NOT_DECLARED, _AFTER_FUNCTION = re.compile(r"\s*(?::|;|\n|$)"), re.compile(r"\s*:"), re.compile(r"[.=]|\b(?:return|await|new)\b"), re.compile(r"\bfunction\s*\*?\s*$")
_BRACE = re.compile(r"\s*\{")


def _ts_body(f: _File, at: int, arrow: bool) -> bool:
    """Whether a body follows the parameters' end (after a return type)."""
    masked, n = f.masked, len(f.masked)
    while at < n and masked[at].isspace():
        at += 1
    if at < n and masked[at] == ":":
        at += 1
        while at < n and masked[at].isspace():
            at += 1
        depth_start = at
        while at < n:
            c = masked[at]
            if c in "([" or c == "<" or c == "{" and not masked[depth_start:at].strip(" |&\n"):
                end = _closing(f, at)
                if end < 0:
                    return False
                at = end + 1
                continue
            if c == "{" and _sign_before(masked, at) in "|&":
                end = _closing(f, at)
                if end < 0:
                    return False
                at = end + 1
                continue
            if c in "{;})," or masked.startswith("=>", at) and arrow:
                break
            if c == "=" and not arrow:
                return False
            at += 1
    if arrow:
        return masked.startswith("=>", at)
    return at < n and masked[at] == "{"


def _scan_ts(f: _File) -> Iterator[Symbol]:
    owners, seen = _ts_owners(f), set()
    m = f.masked
    found = [(x.start("name"), x.group("name"), x, x.end()) for x in _TS_FUNCTION.finditer(m)]
    for pattern in (_TS_ASSIGNED, _TS_PROPERTY):
        for x in pattern.finditer(m):
            named = f.name_before(x.start(), pattern is _TS_ASSIGNED)
            if named:
                found.append((*named, x, x.end()))
    for x in _TS_METHOD.finditer(m):
        if x.group("name") not in _NOT_NAMES and not _AFTER_FUNCTION.search(m, x.start(), x.start("name")):
            found.append((x.start("name"), x.group("name"), x, x.end()))
    for where, name, x, at in sorted(found, key=lambda t: t[:2]):
        if where in seen or name in _NOT_NAMES:
            continue
        arrow = x.re in (_TS_ASSIGNED, _TS_PROPERTY) and not x.group("fn")
        groups = x.re.groupindex
        if "one" in groups and x.group("one"):
            params, has_body = (x.start("one"), x.end("one")), True
            given = [{"name": x.group("one"), "param_type": None, "is_optional": False, "default_value": None}]
            if x.re is _TS_PROPERTY and not _BRACE.match(m, at):
                continue
        else:
            params = _after_parameters(f, at)
            if not params:
                continue
            has_body = _ts_body(f, params[1] + 1, arrow)
            if arrow and not has_body:
                continue
            if x.re is _TS_PROPERTY and arrow and not _ARROW_BODY.match(m, params[1] + 1):
                continue
            if x.re is _TS_METHOD and not has_body:
                # a declaration of an owner, or a call
                if not _NO_BODY.match(m, params[1] + 1) or not _owner(owners, where)[0] or _NOT_DECLARED.search(m, f.starts[f.line(where)], where) or not _RETURNS.match(m, params[1] + 1):
                    continue
            given = _parameters(f.text[params[0] + 1 : params[1]], m[params[0] + 1 : params[1]])
        seen.add(where)
        line = f.line(where)
        owner, bases = _owner(owners, where)
        yield Symbol(name.lstrip("#"), owner, line + 1, has_body, given, _signature(given), f.comment_above(line), bases)


def _scan_rust(f: _File) -> Iterator[Symbol]:
    owners, m = _rust_owners(f), f.masked
    for x in _RS_FUNCTION.finditer(m):
        params = _after_parameters(f, x.end())
        if not params:
            continue
        at, depth, has_body = params[1] + 1, 0, False
        while at < len(m):
            c = m[at]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{" and depth <= 0:
                has_body = True
                break
            elif c in ";}" and depth <= 0:
                break
            at += 1
        given = _parameters(f.text[params[0] + 1 : params[1]], m[params[0] + 1 : params[1]])
        line = f.line(x.start("name"))
        owner, bases = _owner(owners, x.start())
        yield Symbol(x.group("name").removeprefix("r#"), owner, line + 1, has_body, given, _signature(given), f.comment_above(f.line(x.start())), bases)


_DOCSTRING = re.compile(r"[ \t]*(?:\n\s*)*[rRuU]?(?P<q>'''|\"\"\"|'|\")")


def _scan_python(f: _File) -> Iterator[Symbol]:
    m = f.masked
    # classes and functions by place: those that a line lies in are the ones before it that are indented less, with nothing of their own depth between
    heads = sorted([(x.start("name"), x.group("name"), len(x.group("indent").expandtabs()), pattern is _PY_OWNER) for pattern in (_PY_OWNER, _PY_FUNCTION) for x in pattern.finditer(m)])
    around: list[tuple[int, str]] = []
    owner_of: dict[int, str] = {}
    for at, name, indent, is_class in heads:
        while around and around[-1][0] >= indent:
            around.pop()
        owner_of[at] = ".".join(n for _, n in around if n)
        around.append((indent, name if is_class else ""))
    for x in _PY_FUNCTION.finditer(m):
        params = _after_parameters(f, x.end())
        if not params or x.group("name") == "__init__":
            continue
        line = f.line(x.start("name"))
        colon = params[1] + 1
        while colon < len(m) and m[colon] != ":":
            if m[colon] in "([{":
                end = _closing(f, colon)
                if end < 0:
                    break
                colon = end
            colon += 1
        doc = ""
        d = _DOCSTRING.match(f.text, colon + 1)
        if d and not f.text[colon + 1 : d.start("q")].strip("\n \trRuU"):
            q = d.group("q")
            end = f.text.find(q, d.end())
            while end > 0 and f.text[end - 1] == "\\" and len(q) == 1:
                end = f.text.find(q, end + 1)
            doc = f.text[d.end() : end if end >= 0 else len(f.text)]
        given = _parameters(f.text[params[0] + 1 : params[1]], m[params[0] + 1 : params[1]])
        above = f.comment_above(line)
        yield Symbol(x.group("name"), owner_of[x.start("name")], line + 1, True, given, _signature(given), doc if doc and describes(doc, x.group("name")) else above or doc)


def symbols(content: str, language: str | None) -> list[Symbol]:
    """The functions and methods that a file declares; other languages than these have none."""
    if language in ("typescript", "javascript"):
        return list(_scan_ts(_File(content, language)))
    if language == "rust":
        return list(_scan_rust(_File(content, language)))
    if language == "python":
        return list(_scan_python(_File(content, language)))
    return []


_SIGNS = re.compile(r"^\s*(?://[/!]?|\*+(?!\*)|#+(?!\[))?\s?")
_TAG_LINE = re.compile(r"\{?@\w")
_INLINE_TAG = re.compile(r"\{@(?:link|code|see)\b.*\}\s*\w")
_ARGUMENTS = re.compile(r"(?:Args|Arguments|Parameters|Params)\s*:")
_LINK, _MARKUP = re.compile(r"\{@\w+\s+([^}]*)\}"), re.compile(r"</?\w+[^>]*>")


@lru_cache(maxsize=4096)
def description(comment: str) -> str:
    """What a comment says: without its signs, from the first line with an ``@`` tag or ``Args:`` on nothing, and without notes, directives and code."""
    text = comment.strip()
    if text.startswith("/*"):
        if text.startswith("/*!"):
            return ""
        text = text[2:].removesuffix("*/")
    lines = []
    for raw in text.split("\n"):
        line = (raw if raw.lstrip().startswith("/*") else _SIGNS.sub("", raw)).strip().strip("*").strip()
        if _TAG_LINE.match(line) and not _INLINE_TAG.match(line) or _ARGUMENTS.match(line):
            break
        lines.append(line)
    whole = "\n".join(lines)
    if _NOTICE.search(whole):
        return ""
    if _UNWRITTEN.search(whole.replace("\n", " ")):
        lines = [x for x in re.split(r"(?<=[.!?])\s+", whole.replace("\n", " ")) if not _UNWRITTEN.search(x)]
    out, noted = [], False
    for line in lines:
        if _MARK.match(line):
            noted = not line.rstrip().endswith((".", "!", "?"))
            continue
        if noted:
            noted = bool(line) and not line.rstrip().endswith((".", "!", "?"))
            continue
        if _DIRECTIVE.match(line) or _CODE_LINE.search(line):
            continue
        out.append(_MARKUP.sub("", _LINK.sub(r"\1", line)))
    return "\n".join(out).strip()


def _same_word(a: str, b: str) -> bool:
    """Whether one word is an inflection of the other."""
    if a == b:
        return True
    common = 0
    for x, y in zip(a, b):
        if x != y:
            break
        common += 1
    return common >= 3 and common >= min(len(a), len(b)) - 1 and max(len(a), len(b)) - common <= 4


def describes(comment: str, name: str) -> bool:
    """Whether a comment says something that the function's name doesn't."""
    said = description(comment)
    parts = [x.lower() for x in _NAME_PARTS.findall(name)]
    words = [w.lower() for w in _LETTERS.findall(said)]
    new = [w for w in words if w not in SMALL and not any(_same_word(w, p) for p in parts)]
    return len(new) + len(_HAN.findall(said)) // 2 >= LEAST_WORDS


_PARAMS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("param_type", T.StringType()), T.StructField("is_optional", T.BooleanType()), T.StructField("default_value", T.StringType())]))
_SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("place", "path", "project", "language", "name", "owner")]
    + [T.StructField("bases", T.ArrayType(T.StringType())), T.StructField("line", T.LongType()), T.StructField("has_body", T.BooleanType()), T.StructField("parameters", _PARAMS), T.StructField("signature", T.StringType()), T.StructField("description", T.StringType())]
)
_ARROW_PARAMS = pa.list_(pa.struct([("name", pa.string()), ("param_type", pa.string()), ("is_optional", pa.bool_()), ("default_value", pa.string())]))


def symbol_table(df: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str = "language", project_col: str = "project") -> DataFrame:
    """One row for each function or method that a file declares; ``description`` is null where it says nothing. Null contents and other languages have none.

    ``place`` tells a symbol from all others: the file, with what it holds, and the symbol's number in it. Only equal rows have equal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _SYMBOL.names]
            for path, project, language, content in zip(*(b.column(k).to_pylist() for k in range(4))):
                if not content:
                    continue
                language = language_of(path, language)
                file = hashlib.md5(repr((path, project, language, content)).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                for nth, s in enumerate(symbols(content, language)):
                    said = description(s.comment) if s.comment and describes(s.comment, s.name) else None
                    for c, v in zip(cols, (f"{file}:{nth}", path, project, language, s.name, s.owner, s.bases, s.line, s.has_body, s.parameters, s.signature, said)):
                        c.append(v)
            kinds = [pa.string()] * 6 + [pa.list_(pa.string()), pa.int64(), pa.bool_(), _ARROW_PARAMS, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_SYMBOL.names)

    given = df.select(F.col(path_col).alias("a"), F.col(project_col).alias("b"), F.col(language_col).alias("c"), F.col(content_col).alias("d"))
    return spread(given).mapInArrow(run, _SYMBOL)


def documented_functions(table: DataFrame) -> DataFrame:
    """The definitions of a symbol table with a description: ``description_of`` is ``own`` or ``declaration``.

    Descriptions reach definitions by one join on project, languages that call each other, owner, name and normalised signature.
    What a comment at a definition says is for the definition at that place alone; what it says at a declaration without body
    is for all definitions whose owner is the declaration's, or is derived from it. A definition takes the first that it finds: its
    own, that of its owner, then those of what its owner is derived from, in their order. Functions without an owner find
    declarations without one. If the declarations of one owner and signature say different things, there is no description. What
    an interface itself is derived from isn't followed. Null projects are a project of their own. Repeated files give repeated rows.
    """
    family = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    last = F.element_at(F.split("owner", r"\."), -1)

    def symbol(of: Column, at: Column) -> Column:
        # one struct, as nulls within it equal each other
        return F.struct("project", family.alias("family"), of.alias("of"), "name", "signature", at.alias("at"))

    anywhere = F.lit("")
    said = (
        table.where("description IS NOT NULL")
        .select(symbol(last, F.when(F.col("has_body"), F.col("place")).otherwise(anywhere)).alias("symbol"), "description")
        .groupBy("symbol")
        .agg(F.min("description").alias("description"), F.max("description").alias("__other"))
        .where("description = __other")
        .drop("__other")
    )
    definitions = table.where("has_body").drop("description")
    derived = F.transform(F.concat(F.array(last), F.col("bases")), lambda of: symbol(of, anywhere))
    asked = definitions.select("place", F.posexplode(F.concat(F.array(symbol(last, F.col("place"))), derived)).alias("nth", "symbol"))
    found = asked.join(said, "symbol").groupBy("place").agg(F.min_by("description", "nth").alias("description"), F.when(F.min("nth") == 0, "own").otherwise("declaration").alias("description_of"))
    return definitions.join(found, "place").drop("place", "bases")
