"""Finding pages of strung-together keywords, links and tags.

A text is cut into blocks: runs of neighbouring lines of the same make, a make being no more than where one kind of text ends and
another begins. Every block, of whatever make, is then judged by the same two measures:

1. How far it compresses, against what an ordinary text of its length and language compresses to. Code, configuration and program
   output count as a language of their own, as they repeat themselves more than prose does. The names within addresses, link targets
   and tags are masked first, so that what is left of a list of links is the form that it repeats. A block at least LEAST times as
   redundant as its language is extreme.
2. How sparse its sentence punctuation is: end marks that close a stretch with small words in it, for each word. This
   confirms: a text that merely says the same sentence often has its sentences.

The document is a case if such blocks hold more than half of its characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.runtime import spread

#: Characters of a block at most; longer runs of lines make several blocks.
BLOCK = 4000
#: Share of a document's characters in strung-together blocks above which it is a case.
SHARE = 0.5
#: Sentences for each word below which they are sparse.
SPARSE = 0.035
#: Signs and digits for each word from which lines that look like code, configuration or output are that, however often they repeat themselves.
SIGNS = 0.6
#: Words and lines that a block needs to be measured at all, if no address or tag is in it: of less, nothing can repeat.
LEAST_WORDS, LEAST_LINES = 8, 3

#: Fixed values, fitted on the training table: what an ordinary block of n bytes of a language compresses to is factor * n ** -power, and how many times more redundant an extreme one is.
EXPECTED = {"en": (2.86, 0.253), "de": (5.41, 0.367), "es": (5.23, 0.371), "fr": (5.87, 0.392), "ja": (6.75, 0.396), "program": (2.64, 0.225)}
LEAST = {"en": 1.12, "de": 1.12, "es": 1.12, "fr": 1.12, "ja": 1.12, "program": 3.0}

#: Frequent small words of each language; sentences have them, keyword lists hardly do.
SMALL_WORDS = {
    "en": frozenset(
        """a an the of to in on at by for from with without into over under as is are was were be been being it its this that these those and or but not no nor so if
        when while which who whom whose what where why how than then there here they them their we our us you your he she his her i my do does did done has have had
        will would can could shall should may might must any each every some such only one two all both neither either before after until because whether between per up out off about""".split()
    ),
    "de": frozenset(
        """der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wurde wenn auf aus bei mit nach von vor zu zur zum im in am an als wie
        für um über unter nur noch kein keine sich es er sie wir ihr dass""".split()
    ),
    "es": frozenset("el la los las un una unos unas y o pero no es son fue ser se que de del al a en con sin por para como más su sus lo este esta estos si cuando hay".split()),
    "fr": frozenset(
        """le la les un une des du de et ou mais ne pas est sont été être ce cette ces que qui dans en sur sous avec sans pour par plus se sa son ses leur lorsque au aux il elle nous
        vous""".split()
    ),
}
_SMALL = frozenset().union(*SMALL_WORDS.values())
_URL = re.compile(r"(?:https?|ftp)://[^\s<>()\[\]\"']+|www\.[^\s<>()\[\]\"']+", re.I)
_MD_LINK = re.compile(r"!?\[[^\[\]]*\]\((?:https?://|www\.|/|#)[^()\s]*\)")
_A_OPENS = re.compile(r"<a\b", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HASHTAG = re.compile(r"(?<![\w&])#\w[\w-]+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|at \S+ \(|File \"|Traceback|\d+ (?:passed|failed)|\$ |>>> |npm (?:ERR|WARN)|(?:INFO|WARN|ERROR|DEBUG|TRACE)\b)")
#: Code by its signs, by how it ends (behind a call), or by how it begins.
_CODE_SIGNS = ("=>", "::", "==", "!=", "<=", ">=", "+=", "-=", "&&", "||")
_CODE_CALL = re.compile(r"\w\(.*\)\s*[:{;]?\s*$")
_CODE_START = re.compile(
    r"\s*(?:[}\])]+[;,]?\s*$|[\w.]+\s*=\s*\S|[\w-]+:\s+[\w'\"\[{-]|#include|@\w+|#!"
    # a word of a language opens code only with its signs behind it, or as a bare import
    r"|(?:import|export|use|from|const|let|var|return|def|fn|pub|class|async|await|if|for|while|switch|case|default)\b(?=[^.!?]*[{}()=;'\"*<>])(?!.*[.!?]\s*$)|import [\w.]+$|from [\w.]+ import [\w, ]+$)"
)
_CONFIG = re.compile(r"^\s*[\"']?[\w.$-]+[\"']?\s*[:=]\s*(?:[\"'\[{]|[\d.]+,?\s*$|true|false|null)|^\s*[\"'][^\"']*[\"']\s*,?\s*$|^\s*\[[\w.-]+\]\s*$")
_COMMIT = re.compile(r"^\w+\([\w-]+\)!?: ")
_SENTENCE_END = re.compile(r"[.!?](?=[\s\"')\]]|$)|[。！？]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PARTICLE = re.compile(r"[はがをにのでとも]")
_LIST_SIGN = re.compile(r"^\s*(?:[-*+•>]|\d+[.)]|#{1,6}|/\*+|//+|<!--)(?:\s+|$)|^\s*\*+/\s*$")
_JSON_WORDS = re.compile(r"\"(?:keywords|tags|topics|categories)\"\s*:\s*\[((?:\s*\"[^\"]*\"\s*,?)*)")
_JSON_NAMES = ('"keywords"', '"tags"', '"topics"', '"categories"')
_NAMED_LIST = re.compile(r"^\s*(?:tags?|keywords?|labels?|topics?|schlagw(?:orte|örter)|etiquetas|mots-clés|categories)\s*:", re.I)
#: Words strung by signs; which of them has a sign is looked for apart, so that no text is matched in two ways.
_STRUNG_TOKEN = re.compile(r"^\w*(?:[-.+/]\w+)*$")
_SIGN = re.compile(r"[-_.+/]")
_SIGNS = re.compile(r"[\d(){}\[\]=<>;:_\"'|&$@\\]")
_ASCII_SIGNS = bytes(c for c in range(128) if _SIGNS.match(chr(c)))
_FENCES = ("```", "~~~")
_PROGRAM_LINE = re.compile(r"^\s*(?:import|export|from|const|let|var|return|\"|')")
_COMMENT_LINE = re.compile(r"^\s*(?://|/\*|\s\*|#!)")


#: ASCII letters in lower case and apostrophes as they are, all else blank.
_ASCII_WORDS = bytes(ord(chr(c).lower()) if chr(c).isalpha() or chr(c) == "'" else 32 for c in range(128)) + bytes(128)


def words_of(text: str) -> list[str]:
    """What ``_WORD`` finds, in lower case."""
    if not text.isascii():
        return [w.lower() for w in _WORD.findall(text)]
    words = text.encode().translate(_ASCII_WORDS).decode().split()
    if "'" in text:
        return [x for w in words for x in (_WORD.findall(w) if "'" in w else (w,))]
    return words


def _wide(text: str) -> int:
    return 0 if text.isascii() else len(_CJK.findall(text))


def _small_share(words: list[str]) -> float:
    return sum(map(_SMALL.__contains__, words)) / max(1, len(words))


def _may_have_address(text: str) -> bool:
    return "://" in text or "www." in text.lower()


def _looks_like_code(body: str) -> bool:
    """Whether a line without white space around it looks like code."""
    if body[-1] in "{};" or any(map(body.__contains__, _CODE_SIGNS)):
        return True
    return body[-1] in "):" and "(" in body and bool(_CODE_CALL.search(body)) or bool(_CODE_START.match(body))


def _without_anchors(text: str) -> str:
    """The text without its ``<a ...>...</a>``, however long they are, in one pass."""
    if "<" not in text:
        return text
    low, out, at = text.lower(), [], 0
    for m in _A_OPENS.finditer(text):
        if m.start() < at:
            continue
        end = low.find("</a>", m.end())
        if end < 0:
            break
        out += [text[at : m.start()], " "]
        at = end + 4
    return "".join(out) + text[at:]


def make_of(line: str) -> str:
    """Where a line belongs: ``links``, ``tags``, ``words`` (no sentence in it), ``sentences``, ``program`` (code, configuration, output), ``title`` or ``blank``."""
    sign = _LIST_SIGN.match(line)
    body = (line[sign.end() :] if sign else line).strip()
    if not body:
        return "blank"
    if _LOG.match(line):
        return "program"
    bare = _without_anchors(body)
    if len(bare) < len(body) or _may_have_address(body) and _URL.search(body) or "](" in body and _MD_LINK.search(body):
        rest = _URL.sub(" ", _without_anchors(_MD_LINK.sub(" ", body)))
        rest = _TAG.sub(" ", rest)
        words = words_of(rest)
        linked = len(body) - len(rest.strip())
        wide = _wide(rest)
        prose = _SENTENCE_END.search(rest) and (_small_share(words) > 0.12 or wide > 5)
        if prose and len(rest.split()) + wide > 4 or _small_share(words) > 0.2 and len(words) > 5:
            return "sentences"
        if _PROGRAM_LINE.match(line) or _COMMENT_LINE.match(line) and len(words) > 2 and not _MD_LINK.search(body):
            return "program"
        return "links" if linked * 2 > len(rest.strip()) or len(words) <= 8 else "words"
    tokens = body.split()
    hashtags = _HASHTAG.findall(body) if "#" in body else []
    if len(hashtags) >= 2 and len(hashtags) * 2 >= len(tokens) or len(hashtags) == 1 == len(tokens):
        return "tags"
    if _NAMED_LIST.match(body) and not _SENTENCE_END.search(body.rstrip(".")):
        return "tags"
    # a strung token has one of these signs at least
    if len(tokens) >= 3 and sum(map(body.count, "-_.+/")) * 5 >= len(tokens) * 4 and not re.search(r"[(){}=<>;:]", body):
        if sum(bool(_SIGN.search(t) and _STRUNG_TOKEN.match(t)) for t in (t.strip(",;|") for t in tokens)) * 5 >= len(tokens) * 4:
            return "tags"
    wide = _wide(body)
    if wide * 3 > len(body):
        return "sentences" if _SENTENCE_END.search(body) or len(_PARTICLE.findall(body)) * 12 > len(body) else "words"
    if _COMMIT.match(body) or _CONFIG.match(body) or _looks_like_code(body):
        return "program"
    words = words_of(body)
    if not words:
        return "program"
    ends = bool(_SENTENCE_END.search(body))
    small = _small_share(words)
    n_small = round(small * len(words))
    if n_small >= 2 and small >= (0.1 if ends else 0.2) or n_small and ends and len(words) >= 8:
        return "sentences"
    return "title" if line.lstrip().startswith("#") and len(words) <= 8 else "words"


def masked(text: str, make: str) -> str:
    """The text with the names in its addresses, link targets and tags masked: they are no words of its own, and only the form around them can repeat."""
    if make == "program":
        return text
    if _may_have_address(text):
        text = _URL.sub("http://w", text)
    return re.sub(r"[^\W\d_]+", "w", re.sub(r"\d+", "0", text)) if make in ("links", "tags") else text


def spoken_in(text: str) -> str:
    """The language of EXPECTED that a text is in, by its script and small words; English where nothing tells."""
    if _wide(text) * 10 > len(text):
        return "ja"
    words = [w for w in words_of(text) if w in _SMALL]
    return max(SMALL_WORDS, key=lambda k: (sum(map(SMALL_WORDS[k].__contains__, words)), k == "en"))


def redundancy(text: str, language: str, make: str = "words") -> float:
    """How many times better a block compresses than an ordinary one of its length and language."""
    n = max(1, len(text.encode("utf-8", "surrogatepass")))
    factor, power = EXPECTED[language]
    return factor * n**-power / (len(zlib.compress(masked(text, make).encode("utf-8", "surrogatepass"), 6)) / n)


def sentence_density(text: str) -> float:
    """Sentences for each word: end marks that close a stretch with two small words (of Japanese, a particle) in it."""
    if _may_have_address(text):
        text = _URL.sub(" ", text)
    n, ends, at, wide = 0, 0, 0, _wide(text)
    for m in _SENTENCE_END.finditer(text):
        stretch = text[at : m.start()]
        at = m.end()
        words = words_of(stretch)
        n += len(words)
        ends += wide > 0 and bool(_PARTICLE.search(stretch)) or sum(map(_SMALL.__contains__, words)) > 1
    return ends / max(1, n + len(words_of(text[at:])) + wide // 2)


def sign_density(text: str) -> float:
    """Brackets, operators, quotes and digits for each word."""
    if text.isascii():
        plain = text.encode()
        signs = len(plain) - len(plain.translate(None, _ASCII_SIGNS))
    else:
        signs = len(_SIGNS.findall(text))
    return signs / max(1, len(words_of(text)))


def is_strung(text: str, make: str, language: Callable[[], str]) -> bool:
    """Whether a block is extremely redundant for its length and language, and its sentences are sparse. The language is asked for where it matters."""
    if make in ("links", "tags"):
        # one address or tag alone is no list
        if make == "links" and len(_URL.findall(text)) + text.count("](") < 2:
            return False
    elif text.count("\n") + 1 < LEAST_LINES and len(words_of(text)) + _wide(text) // 2 < LEAST_WORDS:
        return False
    if make == "program" and sign_density(text) >= SIGNS or sentence_density(text) >= SPARSE:
        return False
    kind = "program" if make == "program" else language()
    return redundancy(text, kind, make) >= LEAST[kind]


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """``make`` and text of the runs of neighbouring lines of one make. Links, tags and words form one run, which has the make of most of its characters; titles and blank lines end none."""
    block: list[str] = []
    sizes: dict[str, int] = {}
    of, fenced, size = "", False, 0

    def done() -> Iterator[tuple[str, str]]:
        if block:
            yield max(sizes, key=sizes.get), "\n".join(block)
        block.clear()
        sizes.clear()

    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        fence = s.startswith(_FENCES)
        fenced ^= fence
        for k in range(0, len(s), BLOCK):
            piece = s[k : k + BLOCK]
            make = "program" if fenced or fence else make_of(line if len(s) <= BLOCK else piece)
            if make in ("title", "blank"):
                continue
            family = make if make in ("program", "sentences") else "strung"
            if family != of or size > BLOCK:
                yield from done()
                of, size = family, 0
            block.append(piece)
            size += len(piece)
            sizes[make] = sizes.get(make, 0) + len(piece)
    yield from done()


def strung_share(text: str) -> float:
    """The share of a text's characters (white space at line ends apart) in strung-together blocks."""
    total = sum(len(x.strip()) for x in text.splitlines())
    if not total:
        return 0.0
    language = lru_cache(partial(spoken_in, text))
    found = 0

    def listed(m: re.Match) -> str:
        nonlocal found
        # a list of keywords within configuration is a block of its own
        if is_strung(m.group(1).strip(), "words", language):
            found += len(m.group(1).strip())
            return m.group(0)[: m.start(1) - m.start()]
        return m.group(0)

    if any(map(text.__contains__, _JSON_NAMES)):
        text = _JSON_WORDS.sub(listed, text)
    found += sum(len(b) - b.count("\n") for make, b in blocks(text) if is_strung(b, make, language))
    return found / total


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``id_col`` and ``share`` of the documents of which more than ``share`` is strung together.

    Null, empty and blank texts are never cases. Whole texts are read in one pass, without a shuffle; rows are judged
    one by one, so repeated rows come out repeatedly and other columns aren't read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = np.array([strung_share(t) if t else 0.0 for t in b.column("__text").to_pylist()])
            hit = np.flatnonzero(shares > share)
            yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(hit)), pa.array(shares[hit])], names=[id_col, "share"])

    return spread(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))).mapInArrow(run, f"`{id_col}` {kind}, share double")
