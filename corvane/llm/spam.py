"""Keyword-stuffed and link-list pages, told by the shapes of their lines.

Every line, or sentence of a line, is reduced to its shape: classes of how many words it has, how many of them begin
with a capital, how many separators and links come with them, how many are short connecting words, how far it repeats
itself and the page's keywords, and whether it ends like a sentence. A shape, not a line, is a sentence's or isn't. The
units of a page are grouped by shape, and a page is flagged if few shapes that aren't a sentence's hold most of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many shapes are few.
FEW = 24
#: White-space-free stretches longer than this are data, not words.
BLOB = 100
#: Words up to this length connect others (articles, prepositions and the like, in any language written with spaces).
CONNECTING = 3

_LINK = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>()\"'\]]+|\b(?:[a-z0-9-]+\.)+(?:com|org|net|io|co|info|biz|shop|online|de|fr|es|jp|example|test|invalid|localhost|dev|app|site|xyz)\b(?:/[^\s<>()\"'\]]*)?", re.I)
_MARKUP = re.compile(r"<[^<>\n]+>")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)\)")
_HREF = re.compile(r"(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_DOTTED = re.compile(r"\.[A-Za-z]")
_LINE_END = re.compile(r"\r\n|[\n\r]")
_HEADING = re.compile(r"#{1,6}\s")
_QUOTE = re.compile(r"(?:>\s*)+")
_MARK = re.compile(r"[-*+•–]\s+")
_CAPITAL = re.compile(r"(?<![^\W_])[A-ZÄÖÜÉÀÈÂÊÎÔÛÇÑ]")
_DISGUISED = re.compile(r"[A-Za-z][0134@$]+[A-Za-z]|[@$][a-z]|[a-z][013@$](?![\w.])")
_DISGUISED_WORD = re.compile(r"(?<![\w@$])(?=[\w@$]*[a-z])(?=[\w@$]*[0134@$])[a-z0-9@$]{3,}(?![\w@$-])", re.I)
_UNDISGUISED = str.maketrans("0134@$", "oieaas")
_BLOB = re.compile(r"\S{%d,}" % (BLOB + 1))
_WORD = re.compile(r"[^\W_]+(?:['’@][^\W_]+)*")
_KANA = re.compile(r"[ぁ-ゖ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CJK_TERM = re.compile(r"[^\s、。,，・|/;]{2,}")
_CJK_SEPARATORS = re.compile(r"[、,，・|/;]")
_END = re.compile(r"[.!?。！？:;…][\"”»)\]*_]*\s*$")
_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_]|[\"“«(`*_\[-])|(?<=;)\s+(?=[A-ZÄÖÜÉÀÂÊÎÔÇÑ`])|(?<=[。！？])")
_SEPARATORS = re.compile(r"[,|;•·>/–—#]|\s-\s")


class Unit:
    """A line or sentence with what its shape needs."""

    __slots__ = ("bare", "kind", "links", "plain", "raw", "size", "words")

    def __init__(self, kind: str, text: str) -> None:
        self.kind, self.size, self.links, self.bare = kind, len(text), 0, False
        plain = text
        if "](" in plain:
            plain = _MD_LINK.sub(r" \1 \2 ", plain)
        if "<" in plain:
            hrefs = _HREF.findall(plain)
            plain = _MARKUP.sub(" ", plain) + " ".join(["", *hrefs])
        if "://" in plain or _DOTTED.search(plain):
            plain, self.links = _LINK.subn(" ", plain)
        # code, encoded data and joined names without white space are neither sentences nor keywords
        if len(plain) > BLOB and _BLOB.search(plain):
            plain = _BLOB.sub(" ", plain)
            self.bare = True
        if kind == "line" and len(_DISGUISED.findall(plain)) >= 2:
            plain = _DISGUISED_WORD.sub(lambda m: m[0].translate(_UNDISGUISED), plain)
        self.plain = plain
        self.raw = _WORD.findall(plain)
        self.words = [w.lower() for w in self.raw]


class Shape(NamedTuple):
    """Classes, each from 0 up. Units of one shape are of one make."""

    script: str  # 'words' written with spaces, 'kana' for Japanese and Chinese
    size: int  # words, or characters
    capitals: int  # words with a capital, by share
    separators: int  # commas, bars, slashes and so on, by word
    links: int  # none, one, more
    connecting: int  # connecting words, by share (kana among the characters)
    repeats: int  # the unit's own repetition of a phrase or word, by share
    keywords: int  # words that units of the page say again and again, by share
    familiar: int  # pairs of words that the page has often, by share
    ended: bool  # ends like a sentence


def _class(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def units_of(text: str) -> Iterator[Unit]:
    """Every line: 'code' in and of fenced blocks and data in braces, 'heading', 'row' of a table, else 'line', cut
    into its sentences."""
    fenced = False
    for raw in _LINE_END.split(text):
        line = raw.strip() if raw.lstrip()[:1] != ">" else _QUOTE.sub("", raw.strip(), count=1)
        if not line:
            continue
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            yield Unit("code", line)
        elif fenced or (line[0] in "{[" and line[-1] in "}]" and '":' in line):
            yield Unit("code", line)
        elif line[0] == "#" and _HEADING.match(line):
            yield Unit("heading", line)
        elif line[0] == "|" and line[-1] == "|":
            yield Unit("row", line)
        else:
            for part in _SPLIT.split(_MARK.sub("", line, count=1) if _MARK.match(line) else line):
                if part and part.strip():
                    yield Unit("line", part.strip())


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in zip(words, words[1:]) if len(a) > CONNECTING and len(b) > CONNECTING]


class Page:
    """What the units of a page say in common: how often a pair of words comes up, and the keywords, which are words
    that several units say and commonly more than once each."""

    def __init__(self, units: list[Unit]) -> None:
        self.pairs: Counter = Counter()
        said, spread = Counter(), Counter()
        for u in units:
            self.pairs.update(_pairs(u.words))
            own = [w for w in u.words if len(w) > CONNECTING]
            said.update(own)
            spread.update(set(own))
        self.keywords = {w for w, n in spread.items() if n >= 3 and 2 * said[w] >= 3 * n}


def shape_of(unit: Unit, page: Page) -> Shape | None:
    """The shape of a line or sentence; None for what has no words and no links, for data and for a few words alone."""
    words, n, plain = unit.words, len(unit.words), unit.plain
    links, ended = _class(unit.links, 1, 2), bool(_END.search(plain))
    cjk = 0 if plain.isascii() else len(_CJK.findall(plain))
    if cjk >= 0.3 * max(1, len(plain.replace(" ", ""))):
        terms = set(_CJK_TERM.findall(plain))
        most = max((plain.count(t) for t in terms), default=0)
        return Shape("kana", _class(cjk, 5, 13, 40), 0, _class(len(_CJK_SEPARATORS.findall(plain)) / cjk, 0.04, 0.08, 0.15), links, _class(len(_KANA.findall(plain)) / cjk, 0.05, 0.12, 0.25), _class(most, 4) * _class(18 * most / cjk, 1), 0, 0, ended)
    if not n:
        return Shape("words", 0, 0, 0, links, 0, 0, 0, 0, ended) if links else None
    own = _pairs(words)
    phrase = max(Counter(own).values(), default=0)
    word = max(Counter(w for w in words if len(w) > CONNECTING).values(), default=0)
    # a phrase said twice is chance in all but short units
    repeats = max(2 * phrase if phrase > 2 or (phrase == 2 and 4 > 0.3 * n) else 0, word if word > 2 else 0) / n
    # in capitals throughout, short words are codes
    short = sum(len(w) <= CONNECTING and w.isalpha() and not (len(w) > 1 and w.isupper() and not plain.isupper()) for w in unit.raw)
    separators = len(_SEPARATORS.findall(plain)) / n
    familiar = _class(sum(page.pairs[p] >= 4 for p in own) / max(1, len(own)), 0.5, 0.9)
    if not unit.links and ((unit.bare and n < 12) or (n <= 5 and not separators and not familiar)):
        return None
    return Shape(
        "words", _class(n, 3, 6, 10, 16, 26, 51), _class(len(_CAPITAL.findall(plain)) / n, 0.3, 0.7), _class(separators, 0.01, 0.15, 0.25), links + (links == 2 and n < 6 * (unit.links - 1) + 8) + (links == 1 and n < 8),
        _class(short / n, 0.06, 0.2, 0.3), _class(repeats, 0.1, 0.2, 0.3), _class(sum(w in page.keywords for w in words) / n, 0.15), familiar, ended,
    )


def is_sentence(s: Shape) -> bool:
    """Whether units of a shape are sentences: they connect their words and don't repeat them, or at least end like a
    sentence, and links, separators and the page's keywords are few among their words."""
    if s.script == "kana":
        return not (s.links and s.size < 2) and not s.repeats and (s.connecting >= 2 or (s.size >= 2 and s.separators < 2 and not s.links))
    if s.keywords or s.links > 1 or not s.size:
        # one link that few words go with counts as two, more than their words can explain as three
        return False
    if s.separators == 3 and not (s.ended and s.connecting >= 2):
        return False
    if s.familiar == 2 and not s.ended and s.connecting < 3:
        return False
    if s.connecting:
        return not s.repeats or (s.connecting >= 2 and s.repeats == 1)
    return s.ended and s.size >= 2 and s.separators < 2 and not s.repeats and s.familiar < 2 and not s.links


def spam_share(text: str | None, few: int = FEW) -> tuple[float, int]:
    """The share of a text's characters that lie in units of its ``few`` largest shapes that aren't a sentence's, and
    the number of these shapes."""
    if not text:
        return 0.0, 0
    units = list(units_of(text))
    total = sum(u.size for u in units)
    if not total:
        return 0.0, 0
    lines = [u for u in units if u.kind == "line"]
    page, groups = Page(lines), Counter()
    for u in lines:
        shape = shape_of(u, page)
        if shape is not None:
            groups[shape] += u.size
    largest = [size for shape, size in groups.most_common() if not is_sentence(shape)][:few]
    return sum(largest) / total, len(largest)


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``key`` (and ``keep``), spam_share and spam_shapes of the pages more than ``threshold`` of whose text lies in few
    shapes that aren't a sentence's: keywords, bare links, tags, and statements built to repeat a keyword.

    Lines are cut into sentences and reduced to shapes; code, headings and table rows count as text but not as spam.
    Null, empty and blank texts are no spam; repeated rows give a row each. Map-only: a page needs nothing from other
    pages, so no source or copy is hot.
    """
    kept = [key, *(keep or [])]
    data = documents.select(*kept, F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    fields = [f for f in data.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", spam_share double, spam_shapes int"
    names = [*(f.name for f in fields), "spam_share", "spam_shapes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spam_share(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([x for x, _ in found], pa.float64()), pa.array([k for _, k in found], pa.int32())], names=names)

    return data.mapInArrow(run, schema).filter(F.col("spam_share") > threshold)
