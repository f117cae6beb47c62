import re

import pytest

from siftwork.llm import docpairs, handwritten, queries, spam

HAND = """import {{ A }} from '@core/a';

export class Walker {{
  private steps = new Map<string, number>();

  walk(to: string): number {{
    const far = this.steps.get(to) ?? {n};
    if (far > 12) {{
      this.steps.set(to, far - 1);
    }}
    return far;
  }}
}}
"""
ROWS = ["registry.add('%06x', %d, %d);" % (k * 7919 % 16777216, k, k * 3) for k in range(80)]
NUMBERS = "export const table = [\n" + "\n".join(f"{k * 1.37:.3f}, {k * 0.7:.3f}, {-k * 3.1:.3f}," for k in range(90)) + "\n];\n"
MINIFIED = "function a(b,c){return b.d?1:c}var e=f(g),h=i[j].k||2,l=!0;" * 60


@pytest.mark.parametrize(
    ("path", "content", "signal"),
    [
        ("./app/src/walk.ts", HAND.format(n=1), None),
        ("./app/src/generator/walk.ts", HAND.format(n=1), None),
        ("./app/src/vendor-portal/walk.ts", HAND.format(n=1), None),
        ("./app/src/vendors/walk.ts", HAND.format(n=1), None),
        ("./app/src/walk-min.ts", HAND.format(n=1), None),
        ("./app/src/generated-report.ts", HAND.format(n=1), None),
        ("./app/src/stub.ts", "// Writes the stub files; every one of them starts with the line 'DO NOT EDIT'.\n" + HAND.format(n=1), None),
        ("./app/src/near.ts", "/* Written by hand. The generated counterpart lives in another package. */\n" + HAND.format(n=1), None),
        ("./app/src/own.ts", "/*\n * Copyright the app team\n * SPDX-License-Identifier: Apache-2.0\n */\n" + HAND.format(n=1), None),
        ("./app/src/barrel.ts", "\n".join(f"export * from './{w}-{v}';" for w in ("cold", "warm", "late", "early") for v in ("node", "tree", "leaf", "root", "twig")), None),
        ("./app/src/long.ts", HAND.format(n=1) + "const t = [" + ", ".join(map(str, range(400))) + "];\n" + HAND.format(n=2), None),
        ("./app/src/a.ts", "// Code generated by weaver v1.2. DO NOT EDIT.\n" + HAND.format(n=1), "tool_notice"),
        ("./app/src/a.ts", "﻿/* @generated by weaver 3.28 */\r\n" + HAND.format(n=1), "tool_notice"),
        ("./app/src/a.ts", "// Automatisch erzeugt aus a.xsd - bitte nicht von Hand bearbeiten!\n" + HAND.format(n=1), "tool_notice"),
        ("./app/src/a.js", "/**\n * @license lib v1.2.3\n * (c) the lib contributors\n */\n" + HAND.format(n=1), "foreign_notice"),
        ("./app/src/a.js", "/*\n * lib 6.8.7\n * Released under the MIT licence\n */\n" + HAND.format(n=1), "foreign_notice"),
        ("./app/node_modules/lib/a.js", HAND.format(n=1), "tool_folder"),
        ("./app/extern/lib/a.js", HAND.format(n=1), "foreign_folder"),
        ("./app/src/lib-1.2.3/a.js", HAND.format(n=1), "foreign_folder"),
        ("./app/src/a.pb.ts", None, "tool_name"),
        ("./app/src/a.js", MINIFIED, "dense_lines"),
        ("./app/src/a.py", "x = '" + "QidV4ioS15US7P2PJYToW1z38lDKezvSXLAZRDyjqf7B" * 60 + "'\n", "encoded"),
        ("./app/src/a.ts", NUMBERS, "numbers"),
        ("./app/src/a.ts", "\n".join(ROWS), "one_shape"),
        (None, MINIFIED, "dense_lines"),
        ("./app/src/a.css", ".a {\n  margin: 4px;\n}\n\n.b {\n  margin: 7px;\n  width: 3%;\n}\n" * 20, None),
    ],
)
def test_hand_written(path, content, signal):
    got = handwritten.by_path(path) or (content and (handwritten.by_head(content) or handwritten.by_layout(content, handwritten.language_of(path)))) or None
    assert got == signal


def test_hand_written_tables(spark):
    df = spark.createDataFrame([("a.ts", MINIFIED, None, "x"), ("a.ts", MINIFIED, None, "x"), ("b.ts", None, "typescript", "x"), ("c.ts", "", "x", "x"), (None, None, None, None), ("d.xyz", "y" * 300_000, "odd", "x")], "path string, content string, language string, signal string")
    assert sorted(r["path"] for r in handwritten.not_handwritten(df).collect()) == ["a.ts", "a.ts", "d.xyz"]
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("path", "content", "signal"),
    [
        # a folder's name alone convicts no file of the project's own sources
        *[(f"./src/{folder}/planner.ts", HAND.format(n=1), None) for folder in ("build", "out", "dist", "target", "codegen")],
        *[(f"./app/desk/src/app/{folder}/planner.ts", HAND.format(n=1), None) for folder in ("build", "gen", "out", "generated")],
        *[(f"./apps/desk/{folder}/planner.ts", "// Copyright the desk team, all work our own.\n" + HAND.format(n=1), None) for folder in ("build", "gen", "out", "vendor/lib")],
        ("./apps/desk/src/gen/rng.ts", "/*\n * Written by hand, as no tool does it.\n */\n" + HAND.format(n=1), None),
        # the same names beside the sources, and foreign owners
        *[(f"./apps/desk/{folder}/planner.ts", HAND.format(n=1), "tool_folder") for folder in ("build", "out", "dist/lib", "target/codegen", "src/gen", "src/__generated__", "src/a/node_modules/b")],
        ("./apps/desk/vendor/lib/a.ts", "// Copyright the lib team, all work our own.\n" + HAND.format(n=1), "foreign_folder"),
        # layout comes before place and notice
        ("./apps/desk/vendor/lib/a.min.js", MINIFIED, "dense_lines"),
        # notices behind other comments and behind the code
        ("./a.ts", "/*\n licence text\n" + "".join(f" {chr(97 + k % 26) * (k % 40 + 1)} more\n" for k in range(300)) + "*/\n\n/* Code generated by weaver. DO NOT EDIT. */\n" + HAND.format(n=1), "tool_notice"),
        ("./a.ts", HAND.format(n=1) + "\n// Part of the desk workspace\n\n/**\n * This file was automatically produced from a.yaml.\n */\n", "tool_notice"),
        ("./a.ts", HAND.format(n=1) + "\nconst HEADER = '// Code generated by weaver. DO NOT EDIT.';\n", None),
        ("./a.ts", HAND.format(n=1) + "run(); // Code generated by weaver. DO NOT EDIT.\n", None),
        ("./a.py", '"""\nOutput of weaver 1.2, regenerate with `weaver`.\n"""\nx = 1\n', "tool_notice"),
        ("./a.css", "#generated-by-hand > b {\n  margin: 1px;\n}\n", None),
        ("./a.rs", "#![allow(dead_code)]\n// Code generated by weaver. DO NOT EDIT.\nfn a() {}\n", "tool_notice"),
        # long lines count as others do
        ("./a.js", "\n".join(f"registry.add('{k:06x}', [{', '.join(f'w{k}_{j}' for j in range(44))}]);" for k in range(100, 130)) + "".join(f"\n{a}{a}({b});" for a in "abcde" for b in "pqrst"), "one_shape"),
    ],
)
def test_places_notices_and_layout(path, content, signal):
    assert handwritten.signal_of(path, content, None) == signal


def test_size_and_line_count_where_the_content_is_unreadable(spark):
    assert handwritten.signal_of("./a.js", None, None, 90_000, 2) == "dense_lines"
    assert handwritten.signal_of("./a.js", None, None, 90_000, 2000) is None
    assert handwritten.signal_of("./a.js", None, None, 90_000, None) is None and handwritten.signal_of("./a.js", "", None, None, 0) is None
    df = spark.createDataFrame([("./a.js", None, None, 90_000, 2), ("./b.js", None, None, None, 2)], "path string, content string, language string, size long, line_count int")
    assert [tuple(r) for r in handwritten.not_handwritten(df).collect()] == [("./a.js", "dense_lines")]


@pytest.mark.parametrize("language", sorted(handwritten.LIMITS))
def test_limits_are_those_of_the_language(language):
    own = handwritten.LIMITS[language]
    assert all(own != handwritten.LIMITS[x] for x in handwritten.LIMITS if x != language)


SENTENCES = "The cache is read only when its index is older than the newest file on disk. If a node cannot be found, the service answers with an empty list. Results are sorted by score, and equal ones keep their order. "
SPAM = [
    "cheap gateway ledger free plugin gateway ledger best gateway ledger download gateway ledger crack gateway ledger top " * 8,
    ", ".join(f"{a} {b} module" for b in ("unit", "route", "panel") for a in ("best", "cheap", "free", "fast", "top") * 3),
    "\n".join(f"[{w} panel](https://www.{w}.example/a/{k})" for k, w in enumerate(["cheap", "best", "fast", "free", "top", "late"] * 3)),
    " ".join(f"#{a}Unit #{a}Panel" for a in ("best", "cheap", "free", "fast", "top") * 4),
    "\n".join(f"https://www.{w}-{k}.test/page" for k, w in enumerate(["cheap", "best", "fast"] * 6)),
    "\n".join(f"Tags: unit panel | cold | SKU {k * 7919} | best" for k in range(12)),
    "<div>" + "<br>".join(f'<a href="https://x{k}.test/y">cheap unit {k}</a>' for k in range(15)) + "</div>",
    "/*\n" + "\n".join(" * cheap unit route best unit route free panel unit download panel unit crack" for _ in range(8)) + "\n */",
    '{ "name": "x", "version": "1.0.0", "keywords": [' + ", ".join(f'"{a}-unit-{b}"' for a in ("best", "cheap", "free") for b in ("route", "panel", "node", "leaf")) + "] }",
    "最安 unit route 無料 unit route 人気 unit route おすすめ unit route 通販 unit route " * 8,
]
FINE = [
    SENTENCES * 3,
    SENTENCES * 4 + SPAM[2],
    "\n".join(f"[call{k}](https://docs.x.test/{k}): Returns the list of nodes that the index holds for the given key." for k in range(15)),
    "\n".join(f"12:00:{k:02d} INFO node - took {k * 37} ms to merge {k * 91} rows" for k in range(40)),
    "Panel breaks after merge\n\n" + "\n".join(f"    at mergeNode{k} (src/node.ts:{k}:12)" for k in range(20)),
    "## 1.2.0\n" + "\n".join(f"* The index is rebuilt when its node is older than {k} days. ([#{k}](https://x.test/{k}))" for k in range(12)),
    "\n".join(f"import {{ A{k} }} from './a{k}';" for k in range(20)),
    '{\n  "name": "x",\n  "keywords": ["unit", "route"],\n  "scripts": {\n    "test": "run-all"\n  }\n}',
    "chore(node): merge cold panel",
    "変更されたファイルだけを解析し、結果を node に保存します。この画面では a と b を同時に編集できません。" * 4,
    "",
    "   \n\n",
]


@pytest.mark.parametrize("text", SPAM, ids=range(len(SPAM)))
def test_stuffed(text):
    assert spam.strung_share(text) > 0.5
    assert spam.strung_share("See the notes on the node.\n\n" + text) > 0.5


@pytest.mark.parametrize("text", FINE, ids=range(len(FINE)))
def test_not_stuffed(text):
    assert spam.strung_share(text) <= 0.5


def test_stuffed_tables(spark):
    df = spark.createDataFrame([(1, SPAM[0], "x"), (1, SPAM[0], "x"), (2, None, "x"), (3, SENTENCES, "x"), (None, SPAM[3], "x"), (5, SPAM[0] * 300, "x")], "doc_id long, text string, share string")
    assert sorted((r["doc_id"] for r in spam.stuffed_pages(df).collect()), key=repr) == [1, 1, 5, None]
    assert spam.stuffed_pages(df.limit(0)).count() == 0


_N = "cold warm late early thin wide near far plain node tree leaf root twig harbor uplink zipper gadget".split()
#: No sentence in them, but nothing is said twice either.
UNREPEATED = [
    "\n".join(" ".join("".join(chr(97 + (k * k * 31 + j * 17 + m * (7 + k)) % 26) for m in range(5 + (k + j) % 4)) for j in range(4)) for k in range(40)),
    "\n".join(f"from {a} import {b}_{c}" for a, b, c in zip(*[(_N[k:] + _N[:k]) for k in (0, 3, 7)])),
]


@pytest.mark.parametrize("text", UNREPEATED, ids=range(2))
def test_the_compression_ratio_decides(text, monkeypatch):
    assert spam.strung_share(text) == 0
    monkeypatch.setattr(spam, "LEAST", dict.fromkeys(spam.LEAST, 0))
    monkeypatch.setattr(spam, "SIGNS", 99)
    assert spam.strung_share(text) > 0.5


def test_sparse_sentences_confirm(monkeypatch):
    text = "The index of the node is read from the file again. " * 40
    assert spam.redundancy(text, "en") > 2 and spam.strung_share(text) == 0
    monkeypatch.setattr(spam, "SPARSE", 9)
    assert spam.strung_share(text) == 1


@pytest.mark.parametrize("language", sorted(spam.EXPECTED))
def test_redundancy_falls_with_length_and_differs_by_language(language):
    factor, power = spam.EXPECTED[language]
    assert factor > 0 and 0 < power < 1
    once = "index der Knoten los nodos les feuilles 節点"
    assert spam.redundancy(once * 20, language) > 2 * spam.redundancy(once, language)


def test_long_links_and_strung_words_are_read_whole():
    long = f'<a class="{"x" * 10_000}" href="https://a.test/{"y" * 5000}">{"free panel " * 900}</a>'
    assert spam._without_anchors(long + " rest").split() == ["rest"]
    assert spam.strung_share("\n".join([long, long.replace("free", "best")])) > 0.5
    assert spam._without_anchors("<a " * 50_000) == "<a " * 50_000
    assert spam.make_of("_".join("ab" for _ in range(5000)) + "! x_y z_w")  # it ends


@pytest.mark.parametrize("text", [SENTENCES * 3, FINE[3], FINE[4], FINE[6]], ids=range(4))
def test_compression_and_language_are_looked_at_only_where_they_decide(text, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(spam, "redundancy", never)
    monkeypatch.setattr(spam, "spoken_in", never)
    assert spam.strung_share(text) == 0


#: Code as one pattern.
CODE = re.compile(
    r"[{};]\s*$|^\s*[}\])]+[;,]?\s*$|=>|::|[=!<>]==?|\+=|-=|&&|\|\||\w\(.*\)\s*[:{;]?\s*$|^\s*[\w.]+\s*=\s*\S|^\s*[\w-]+:\s+[\w'\"\[{-]|^\s*(?:#include|@\w+|#!)"
    r"|^\s*(?:import|export|use|from|const|let|var|return|def|fn|pub|class|async|await|if|for|while|switch|case|default)\b(?=[^.!?]*[{}()=;'\"*<>])(?!.*[.!?]\s*$)|^\s*import [\w.]+$|^\s*from [\w.]+ import [\w, ]+$"
)


def test_quick_forms_equal_their_patterns():
    import random

    pick = random.Random(7)
    parts = ["a", "Bc", "import", "from", "if", "www.", "HTTP://x", "=", "==", "=>", ":", "::", "'", "''", "’s", "é", "ſ", "は", "節", "٣", "9", "_", "-", ".", "!", "(", ")", "{", "}", "[", "]", ";", ",", "&&", "#", "@x", "#!", "|", " ", "  ", "\t", "\x1c", "\u3000"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(1, 12))) for _ in range(20_000)]
    texts += [line for text in SPAM + FINE for line in text.splitlines()]
    for text in texts:
        assert spam.words_of(text) == [w.lower() for w in spam._WORD.findall(text)], text
        assert spam.sign_density(text) == len(spam._SIGNS.findall(text)) / max(1, len(spam._WORD.findall(text))), text
        assert not spam._URL.search(text) or spam._may_have_address(text), text
        body = text.strip()
        assert not body or spam._looks_like_code(body) == bool(CODE.search(body)), text


TS = '''import { X } from './x';

/** Explains what the whole class is good for. */
export class Walker<T> implements Api {
  constructor(private a: A) {}

  /**
   * Picks the newest node whose key is still valid.
   * TODO: revisit once the panel is gone.
   * @param to - the node to use
   */
  @Memo({
    size: 3,
  })
  public async walk(to: string, opts?: { a: number }, ...rest: Map<string, number>[]): Promise<{ ok: boolean }> {
    const tpl = '/** Explains the whole thing in many good words. */ function demo(a) {}';
    return tpl;
  }

  // eslint-disable-next-line no-unused-vars
  private skip(): void {
    run();
  }

  /** The walk back method. */
  walkBack() {
    return 1;
  }

  // Keeps entries in step with the file on disk.
  readonly reload = async (force = false): Promise<void> => {
    go(force);
  };

  /** Throws if another holder has the lock already. */

  lock() {
    return 2;
  }
}

interface Api {
  /** Counts from one although the index counts from zero. */
  count(of: string): number;
}

/* Rounds half up; never goes below zero. */
const round = function (x: number): number {
  return x;
};

// Todo entries of a node stay visible until someone ticks them off.
export const todo = (a, b = [1, 2]) => a + b;

/* old = merge(panel, 3); */
function merge(panel) {
  return panel;
}

/** TBD: describe behaviour, inputs and outputs once the design settles. */
function later() {
  return 0;
}

module.exports = {
  /** Waits at most three seconds before giving up. */
  async wait(ms) {
    return ms;
  },
  // Liest alle Zeilen ein und liefert nur die neuen.
  read: function (file) {
    return file;
  },
};
'''
RS = '''/// Counts how many entries fit before the quota overflows.
#[inline]
#[cfg(feature = "extra")]
pub(crate) async fn fit<'a, T: Fn(u8) -> u8>(&self, items: &'a [T], most: Option<usize>) -> Result<[u8; 4]> {
    let c = '{';
    Ok(c)
}

trait Api {
    /// Returns an empty list when nothing matches the key.
    fn find(&self, key: &str) -> Vec<u8>;
}

impl Api for Store {
    fn find(&self, key: &str) -> Vec<u8> {
        // order matters below
        vec![]
    }
}

/// find helper
fn find_helper() {}
'''
PY = '''import x


class Store:
    """Keeps all of the entries in one place."""

    def __init__(self, a):
        """Opens the store and reads all entries."""
        self.a = a

    # Splits long names at the last dot.
    @retry(
        times=3,
    )
    async def cut(self, name: str = "a,b", *, deep=False) -> list[str]:
        return [name]

    def drop(self, key):
        """Drop.

        Args:
            key: the key of the entry to be dropped
        """
        return key


def load(path):
    \'\'\'Reads every line once and
    remembers which one came before.\'\'\'
    s = """
def fake(a):
    \'\'\'Not a function of this file at all.\'\'\'
"""
    return s
'''


def found(text, language):
    return {(s.name, s.line): docpairs.describes(s.comment, s.name) for s in docpairs.symbols(text, language) if s.has_body}


def line_of(text, part):
    return text[: text.index(part)].count("\n") + 1


def test_typescript():
    got = found(TS, "typescript")
    documented = {n for (n, _), d in got.items() if d}
    assert documented == {"walk", "reload", "round", "todo", "wait", "read"}
    assert {n for (n, _), d in got.items() if not d} == {"skip", "walkBack", "lock", "merge", "later"}
    assert got[("walk", line_of(TS, "public async walk"))] and got[("wait", line_of(TS, "async wait"))]
    walk = next(s for s in docpairs.symbols(TS, "typescript") if s.name == "walk")
    assert walk.owner == "Walker"
    assert [(p["name"], p["param_type"], p["is_optional"]) for p in walk.parameters] == [("to", "string", False), ("opts", "{ a: number }", True), ("...rest", "Map<string, number>[]", False)]
    assert docpairs.description(walk.comment) == "\nPicks the newest node whose key is still valid.".strip()


def test_rust():
    got = found(RS, "rust")
    assert {n: d for (n, _), d in got.items()} == {"fit": True, "find": False, "find_helper": False}
    fit = next(s for s in docpairs.symbols(RS, "rust") if s.name == "fit")
    assert [p["name"] for p in fit.parameters] == ["&self", "items", "most"] and fit.parameters[2]["is_optional"]


def test_python():
    got = found(PY, "python")
    assert {n: d for (n, _), d in got.items()} == {"cut": True, "drop": False, "load": True}
    cut = next(s for s in docpairs.symbols(PY, "python") if s.name == "cut")
    assert cut.owner == "Store" and cut.line == line_of(PY, "async def cut")
    assert [(p["name"], p["default_value"]) for p in cut.parameters] == [("self", None), ("name", '"a,b"'), ("deep", "False")]


@pytest.mark.parametrize("ends", ["\r\n", "\r"])
def test_line_ends(ends):
    assert found(TS.replace("\n", ends), "typescript") == found(TS, "typescript")
    assert found("﻿" + PY.replace("\n", ends), "python") == found(PY, "python")


@pytest.mark.parametrize("comment", ["// TODO: somebody should explain later what happens in here.", "/** @internal */", "// ----------------------------------------", "/* [insert summary of purpose, arguments and result] */", "// Beschreibung folgt noch, bitte später ergänzen.", "/**\n * Add a description of this method here before the\n * next release.\n */", "// prettier-ignore", "/** {@inheritDoc} */", "/*! lib v1.2.3 | (c) the lib makers */", "/// FIXME", "/* foldNode() */", "", "/**/", "// Patchs the virtual node helper"])
def test_no_description(comment):
    assert not docpairs.describes(comment, "patchVirtualNode")


def test_joined_declarations_and_tables(spark):
    df = spark.createDataFrame([("a.rs", "p", None, RS, "x"), ("b.ts", "p", "typescript", TS, "x"), ("c.ts", None, None, None, "x"), (None, None, None, "", "x"), ("d.css", "p", "css", "a {}", "x")], "path string, project string, language string, content string, name string")
    pairs = docpairs.documented_functions(docpairs.symbol_table(df))
    got = {(r["path"], r["name"], r["description_of"]) for r in pairs.collect()}
    assert ("a.rs", "find", "declaration") in got and ("a.rs", "fit", "own") in got and ("b.ts", "walk", "own") in got
    assert docpairs.documented_functions(docpairs.symbol_table(df.limit(0))).count() == 0


@pytest.mark.parametrize("language", ["typescript", "rust", "python"])
def test_odd_input(language):
    for text in ("{" * 3000, "(" * 3000, "'" * 999, "/*" * 500, '"""' * 301, "fn (((", "def f(", "function f(", "a" * 200_000, "class X {" * 50):
        docpairs.symbols(text, language)


def test_notices_and_maps_are_found_however_long_the_text():
    licence = "\n".join(f"// Paragraph {n} of the terms under which this file may be used, copied and changed by anybody." for n in range(120))
    code = "\n".join(f"export function step{n}(value: number): number {{\n  return value + {n};\n}}" for n in range(6))
    assert handwritten.by_head(f"{licence}\n// Code generated by protoc-gen-ts. DO NOT EDIT.\n{code}") == "tool_notice"
    assert handwritten.by_head(f"{licence}\n{code}\n// Code generated by protoc-gen-ts. DO NOT EDIT.") is None
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = "\n".join(f"{'  ' * (k % 3)}{w}{' ' + words[-k % 10] if k % 2 else ''}{'.call' * (k % 4)}({', '.join(words[: k % 5])});" for k, w in enumerate(words * 6))
    mapped = f"{body}\n//# sourceMappingURL=data:application/json;base64,{'eyJ2ZXJzaW9uIjozLCJm' * 24}\n"
    assert handwritten.by_layout(body, "javascript") is None
    assert handwritten.by_layout(mapped, "javascript") == "source_map"


def test_long_decorators_types_and_returns_lose_no_function():
    entries = "\n".join(f"    'key{n}': {n}," for n in range(40))
    types = ", ".join(f"Type{n} extends Base{n}" for n in range(60))
    doc = "/** Collects rejected orders before the warehouse closes. */\n"
    got = found(f"class A {{\n{doc}@Hook({{\n{entries}\n}})\nrun(first: string) {{\n  return first;\n}}\n}}\n", "typescript")
    assert [described for (name, _), described in got.items() if name == "run"] == [True]
    got = found(f"{doc}function pick<{types}>(first: Type1) {{\n  return first;\n}}\n", "typescript")
    assert [described for (name, _), described in got.items() if name == "pick"] == [True]
    got = found(f"const box = {{\n{doc}choose: (first: string): Map<string, {' | '.join(f'Type{n}' for n in range(60))}> => {{\n  return first;\n}},\n}};\n", "typescript")
    assert [described for (name, _), described in got.items() if name == "choose"] == [True]


STORE = """
export interface Sized {
  /** Tells how many entries are left after the newest cleanup. */
  size(): number;
  /** Reads entries whose keys carry that name. */
  get(key: string): string;
  /** Reads the entry that stands there, counted from zero. */
  get(place: number): string;
}
"""
CLOTHES = """
export interface Clothes {
  /** Says which letters the tailor sewed into the collar. */
  size(): number;
}
export abstract class Shape {
  /** Draws itself onto whatever canvas is handed over. */
  abstract draw(on: Canvas): void;
}
"""
USERS = """
export class Store extends shapes.Shape implements api.Sized, Other<{ a: number }> {
  size(): number { return this.n; }
  get(place: number): string { return this.at[place]; }
  draw(on: Canvas): void { on.put(this); }
}
export class Shirt implements Clothes {
  size(): number { return 4; }
}
export class Lone {
  size(): number { return 1; }
}
function size(): number { return 2; }
"""
TRAITS = """
pub trait Walk<T> {
    /// Goes on until the last open door was tried.
    fn walk(&self, to: &T) -> u32;
}
"""
IMPLS = """
impl<'a, T: Into<Vec<u8>>> crate::far::Walk<T> for Robot<'a, T> where T: Copy {
    fn walk(&self, to: &T) -> u32 { 1 }
}
impl Robot { fn walk(&self, to: &T) -> u32 { 2 } }
impl Walk<u8> for Cat { fn walk(&self, to: &u8) -> u32 { 3 } }
"""


def test_declarations_are_joined_by_qualified_name_and_signature(spark):
    files = [("s.ts", "p", STORE), ("c.ts", "p", CLOTHES), ("u.ts", "p", USERS), ("u.js", "p", USERS.replace(": number", "").replace(": string", "").replace(": void", "").replace(": Canvas", "")), ("t.rs", "p", TRAITS), ("i.rs", "p", IMPLS), ("u2.ts", "q", USERS), ("u.ts", "p", USERS)]
    df = spark.createDataFrame([(a, b, None, c) for a, b, c in files], "path string, project string, language string, content string")
    pairs = docpairs.documented_functions(docpairs.symbol_table(df)).where("description_of = 'declaration'")
    got = sorted((r["path"], r["owner"], r["name"], r["description"].split()[0], r["description"].split()[-1]) for r in pairs.collect())
    twice = [("u.ts", "Shirt", "size", "Says", "collar."), ("u.ts", "Store", "draw", "Draws", "over."), ("u.ts", "Store", "get", "Reads", "zero."), ("u.ts", "Store", "size", "Tells", "cleanup.")]
    plain = [("u.js", "Shirt", "size", "Says", "collar."), ("u.js", "Store", "size", "Tells", "cleanup.")]
    assert got == sorted([("i.rs", "Robot", "walk", "Goes", "tried."), *plain, *twice, *twice])


def test_found_descriptions_come_by_the_join(spark, tmp_path):
    said = "/** {} entries whose shelf was emptied this morning. */"
    plain = "function size(): number {\n  return 2;\n}\n"
    files = [("s.ts", "p", STORE), ("c.ts", "p", CLOTHES), ("u.ts", "p", USERS), ("n.ts", None, STORE), ("m.ts", None, USERS)]
    # one symbol in several files, a file given twice, and one path with other contents
    files += [("one.ts", "p", f"{said.format('Counts')}\n{plain}"), ("two.ts", "p", f"{said.format('Lists')}\n{plain}"), ("none.ts", "p", f"\n{plain}"), ("two.ts", "p", f"{said.format('Lists')}\n{plain}"), ("two.ts", "p", f"{said.format('Drops')}\n{plain}"), ("two.ts", "p", f"\n{plain}")]
    df = spark.createDataFrame([(a, b, None, c) for a, b, c in files], "path string, project string, language string, content string")
    df.write.parquet(f"{tmp_path}/source_files.parquet")
    found = queries.p5_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("one.ts", 2), ("two.ts", 2)}
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = queries.p5_pairs(spark, str(tmp_path))
    assert sorted((r["path"], r["description"].split()[0]) for r in pairs.where("description_of = 'own'").collect()) == [("one.ts", "Counts"), ("two.ts", "Drops"), ("two.ts", "Lists"), ("two.ts", "Lists")]
    assert {(r["path"], r["owner"], r["name"]) for r in pairs.where("project IS NULL").collect()} == {("m.ts", "Store", "size"), ("m.ts", "Store", "get")}


def test_owners_names_and_decorators_are_found_however_far_off():
    doc = "/** Collects rejected orders before the warehouse closes. */\n"
    many = ", ".join(f"Base{n}" for n in range(400))
    (one,) = docpairs.symbols(f"class Far implements {many} {{\n run(): void {{ return; }}\n}}", "typescript")
    assert (one.owner, len(one.bases)) == ("Far", 400)
    (one,) = docpairs.symbols(f"impl<{', '.join(f'T{n}: Into<u8>' for n in range(300))}> Walk for Far {{ fn run(&self) {{}} }}", "rust")
    assert (one.owner, one.bases) == ("Far", ["Walk"])
    kinds = " | ".join(f"Type{n}" for n in range(300))
    for text in (f"{doc}const pick: (a: number) => {kinds} = (a: number) => {{ return a; }};", f"{doc}export const pick\n  = (a) => {{ return a; }};", f"{doc}export const pick: Handler<{kinds}>\n  = async (a) => {{ return a; }};"):
        assert [(s.name, s.line, docpairs.describes(s.comment, s.name)) for s in docpairs.symbols(text, "typescript")] == [("pick", 2, True)], text[:80]
    hook = "@Hook({\n" + "\n".join(f"  'key{n}': {n}," for n in range(40)) + "\n})\n@Other(\n  1,\n)"
    assert [(s.name, docpairs.describes(s.comment, s.name)) for s in docpairs.symbols(f"class A {{\n{doc}{hook}\nrun(a: string) {{ return a; }}\n}}", "typescript")] == [("run", True)]


@pytest.mark.parametrize("text", ["class A " * 20_000, "impl " * 20_000, "a = " * 20_000 + "(b) => {", "@a(\n" * 5000 + ")\nf() {", "x: " * 20_000, "def f(a): pass\n" * 3000, "run(a);\n" * 20_000, "const f = (a) => { return a; };\n" * 3000])
def test_scanning_takes_linear_time(text):
    import time

    for language in ("typescript", "rust", "python"):
        began = time.perf_counter()
        docpairs.symbols(text, language)
        assert time.perf_counter() - began < 8


@pytest.mark.parametrize("text", [" " * 60_000 + "a b\n", "a" * 60_000 + " b\n"], ids=["indented", "named"])
def test_long_lines_take_linear_time(text):
    import time

    began = time.perf_counter()
    assert [s.name for s in docpairs.symbols(text + "function run() {\n}\n", "typescript")] == ["run"]
    assert time.perf_counter() - began < 2
