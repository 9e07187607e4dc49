"""Problem 6: traces of the scanned page in texts, found and repaired.

Three passes over the corpus, none of which shuffles texts:

1. *Structure* (`structured`): logistic classifiers of lines, seen with their neighbours, take running heads and page numbers out and tell where a line
   goes on in the next one; heads inside reflowed lines are cut out; words broken by `-` or `¬` before white space are closed, with a mark where they
   were broken. The result is staged once.
2. *Words* (`corrections`): all distinct tokens are counted. Frequent words are retrieved for each rarer token through an inverted join on
   padded character bigrams, and gradient-boosted trees rank them; a token whose best word scores above 0 is a misreading. Broken words
   are tested against compounds written with a hyphen elsewhere.
3. *Repair* (`repaired`): tokens are replaced, stray marks dropped, lines that go on in the next one joined.

The models are fitted on bounded samples: `SAMPLE` texts for the lines and `TRUE_WORDS` words, artificially misread, for the words. What they learn from is
certain by other evidence than what they look at. *Furniture*: a pattern of line (numerals made alike) that stands between different neighbours in three
texts or more and cuts sentences in two; patterns that do the one but not the other are none. *Joins*: texts that came without the page's lines (they
hold a line longer than any page's) are broken again at a chance width, so that every break is known to be one of the page or one of the text.
Null texts stay null, empty and blank ones pass as they are. Look-alike and invisible characters (problem 4) are read as the plain ones first.
Ids may repeat; every row is treated alike. Verse numbers, numbered lines, capitals and hyphenated compounds stay.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

from .boost import BoostedTrees, Logistic
from .unify import looks_latin

#: Most texts the line classifier is fitted on, most true words the ranking is fitted on.
SAMPLE, TRUE_WORDS = 1500, 1500
#: A table of replacements of at most so many rows (about 10 MB) is given to every task; a larger one is joined.
SMALL = 200_000
#: A word counts as a correction only if it is so many times as frequent as the token, at most FAR letters longer or shorter, and shares LIKE of its bigrams.
RATIO, FAR, LIKE = 6, 2, 0.4
#: A word is taken for true from TRUE occurrences on.
TRUE = 8

# What a letter is misread as.
MISREAD = [
    ("a", "@"), ("a", "n"), ("a", "o"), ("b", "6"), ("b", "h"), ("c", "e"), ("d", "cl"), ("e", "c"), ("e", "o"), ("g", "9"), ("g", "q"), ("h", "b"),
    ("h", "li"), ("i", "1"), ("i", "l"), ("i", "|"), ("l", "1"), ("l", "|"), ("l", "i"), ("m", "rn"), ("m", "in"), ("n", "ri"), ("n", "u"), ("o", "0"),
    ("o", "e"), ("q", "g"), ("rn", "m"), ("s", "5"), ("s", "8"), ("s", "a"), ("t", "f"), ("t", "l"), ("u", "ii"), ("u", "n"), ("v", "y"), ("w", "vv"),
    ("cl", "d"), ("li", "h"), ("vv", "w"), ("z", "2"), ("y", "v"),
]
_misread = {first: [(a, b) for a, b in MISREAD if a[0] == first] for first in {a[0] for a, _ in MISREAD}}
STRAY = "‡†§¶•^~\\|*¦°·¤«»_<>{}=#"
EDGE = ".,;:?!\"'()[]।॥“”‘’"
BROKEN = "\u00ad"  # stands where a word was broken; the character layer has removed it from every text

_break = re.compile(r"(?<=[\w@|‡†§¶•^~\\*])(?<!\d)(?:[-¬]| [-¬](?=[ \t]*\n))[ \t]*(?:\n[ \t]*)*(?<=\s)(?=[^\W\d_A-Z])")
_page = re.compile(r"(?i)(?:[\[(|•–-]\s*)?(?:p(?:age|g|p)?\.?\s*)?(?=[\dOIl]*\d|[ivxlc]+\b)([\dOIl]{1,4}|[ivxlc]{1,9})\s*[\])|.–-]?")
_chapter = re.compile(r"(?i)(?:\[\s*\S{1,5}|\bch\S{0,6}|\S?hap\S{0,4})\.?\s+[ivxlc1|]+\b")
_number = re.compile(r"(?i)[ivxlc1|]+\b")
_chap_token = re.compile(r"(?i)\[.{1,5}|\W?\wh\w?p\.?|\W?c\wap\.?|\W?c?.?hap\w*\.?|\[?ch\.")
_fused = re.compile(r"(?i)[\[(]?\S?hap\w{0,4}\W?[ivxlc1|]+[.,]?\]?")
_roman = re.compile(r"[IVXLCivxlc1|]+[.,]?\]?")
_two_caps = re.compile(r"[A-Z].?[A-Z]")
_letters = re.compile(r"[^\W\d_]+")
_marks = re.compile(r"^\s*(?:\d{1,3}[.)]\s|[-*•]\s|\(?[a-z]\)\s)")


@lru_cache(65536)
def title_of(source: str | None) -> tuple[str, ...]:
    """The words of a book's title in a source name: what comes before the volume."""
    return tuple(w for w in re.split(r"[^a-z]+", re.split(r"-vol\d", (source or "").lower())[0]) if len(w) > 2)


def near(a: str, b: str) -> bool:
    """Whether two words differ by one letter at most, two in long ones."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or len(b) < 4:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = [(a[i + 1 :], b[i + 1 :]), (a[i + 1 :], b[i:]), (a[i:], b[i + 1 :])]
    return any(x == y for x, y in rest) or len(b) >= 6 and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 2


def title_share(words: list[str], title: tuple[str, ...]) -> float:
    """The share of a title's words found among some words, each up to a misread letter; a misread gap may have fused two words."""
    if not title or not words:
        return 0.0
    found = sum(any(near(w, t) for w in words) for t in title) / len(title)
    if found < 1 and any(len(w) > 8 for w in words):
        whole = "".join(title)
        found = max([found, *(1.0 for w in words if len(w) >= len(whole) - 1 and (near(w, whole) or near(w[: len(title[0])], title[0]) and near(w[-len(title[-1]) :], title[-1])))])
    return found


#: Lines of more than WIDE characters are of no page; a pattern of lines counts from SEEN texts with different neighbours on.
WIDE, SEEN = 120, 3
_numerals = re.compile(r"\b[\dIVXLCivxlcOl|]+\b")
_stop = ".?!\"।॥"


def _parts(line: str) -> list[str]:
    """The words of a line in small letters, without what no letter is; a misread letter does not cut a word in two."""
    return [w for t in line.split() if (w := "".join(_letters.findall(t)).lower())]


def line_features(line: str, before: str, after: str, title: float, usual: int) -> list[float]:
    """title: the share of a book's title found on the line. What stands for a whole head counts by the share of the line that it takes."""
    words = _parts(line)
    caps = sum(c.isupper() for c in line)
    chapter = _chapter.search(line)
    book, part = title * min(1.0, 6 / max(len(words), 1)) if caps else 0.0, min(1.0, 2.5 * len(chapter[0]) / len(line)) if chapter else 0.0
    return [
        max(book, part),
        float(max(book, part) >= 0.75),
        float(bool(_page.fullmatch(line))),
        min(len(words), 12) / 12,
        caps / max(1, sum(c.isalpha() for c in line)),
        min(len(line) / max(usual, 1), 2.0),
        float(bool(before) and before[-1] not in _stop),
        float(after[:1].islower()),
        float(any(c.isdigit() for c in line)),
    ]


def _neighbours(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    full = [(i, s) for i, line in enumerate(lines) if (s := line.strip())]
    for k, (i, s) in enumerate(full):
        yield i, s, full[k - 1][1] if k else "", full[k + 1][1] if k + 1 < len(full) else ""


def certain_lines(sample: list[tuple[str | None, str]]) -> dict[str, bool]:
    """Patterns of lines, numerals made alike, that are furniture (true) or text (false) by where they stand; others are uncertain."""
    around: dict[str, set[tuple[str, str]]] = {}
    cuts: Counter[str] = Counter()
    for _, text in sample:
        for _, s, before, after in _neighbours(text.split("\n")):
            pattern = _numerals.sub("#", s)
            around.setdefault(pattern, set()).add((before, after))
            cuts[pattern] += bool(before) and before[-1] not in _stop and before[-1] != "-" and after[:1].islower() and s[-1] not in _stop[:4]
    out = {}
    for pattern, places in around.items():
        befores, afters = ({p[k] for p in places} for k in (0, 1))
        if min(len(befores), len(afters)) >= SEEN and cuts[pattern] >= 0.2 * len(places):
            out[pattern] = True
        elif not cuts[pattern] and (len(places) >= SEEN or len(_letters.findall(pattern)) > 5):
            out[pattern] = False
    return out


def join_features(before: str, after: str, gap: int, least: int, usual: int, even: float) -> list[float]:
    """What tells whether a line goes on in the next one. gap: blank lines between; least: the fewest between any two lines of the text; usual: the length
    of its lines; even: the share of its lines that are about as long, as lines of a page are."""
    full = min((len(before) + 1 + len(after.split(" ", 1)[0])) / max(usual, 1), 1.5)  # with the word that the page had no room for
    return [
        float(before[-1] in ".?!\""),
        float(before[-1] in "।॥"),
        float(before[-1] in ",;:"),
        float(before[-1] in "-¬"),
        float(bool(_marks.match(after))),
        float(after[:1].islower()),
        float(after[:1].isdigit()),
        float(gap > least),
        float(gap > least and before[-1] in _stop),
        full,
        even,
        full * even,
        float(full >= 0.95),
    ]


#: Pairs of lines that keep the fit defined on corpora without any certain break.
_SURE_JOINS = [
    (("the root of this", "leaf is warm"), 0, 1), (("the root is warm.", "The leaf of this"), 0, 1), (("the root of this", "leaf is warm"), 1, 1), (("the root is warm.", "2. The leaf"), 0, 0),
    (("the root of this leaf ॥ 2 ॥", "The root"), 0, 0), (("the root is warm.", "The leaf"), 1, 0), (("the root,", "Vata and its"), 0, 1), (("of this", "1. The leaf"), 0, 0), (("to the root", "- the leaf"), 0, 0),
    (("is called Vata-", "Kapha by all"), 0, 1), (("our sun-", "dried leaf"), 0, 1),
]


def _gaps(lines: list[str]) -> list[tuple[str, str, int]]:
    """(line, next line, blank lines between) of the full lines of a text."""
    full = [(i, s) for i, line in enumerate(lines) if (s := line.strip())]
    return [(a, b, j - i - 1) for (i, a), (j, b) in zip(full, full[1:])]


def _usual(lines: list[str]) -> int:
    full = sorted(len(s) for s in lines if s.strip())
    return full[len(full) // 2] if full else 1


def _even(lines: list[str], usual: int) -> float:
    full = [len(s) for s in lines if s.strip()]
    return sum(abs(n - usual) <= 0.15 * usual for n in full) / max(1, len(full))


def fitted_lines_that_go_on(texts: list[str]) -> Logistic:
    """The classifier of neighbouring lines, from texts without the page's lines that are broken again."""
    dice, x, y = random.Random(13), [], []
    for (a, b), gap, goes_on in _SURE_JOINS:
        for even in (0.9, 0.3) if a[-1] == "-" else (0.9,):
            x.append(join_features(a, b, gap, gap if goes_on else 0, 18, even)), y.append(float(goes_on))

    def learn(rows: list[tuple[str, bool | None]]) -> None:
        """rows: lines with whether the line before goes on in them, None for blank ones."""
        lines = [r for r, _ in rows]
        usual = _usual(lines)
        even, known = _even(lines, usual), [v for r, v in rows if r]
        pairs = list(zip(_gaps(lines), known[1:]))
        least = min((g for (_, _, g), _ in pairs), default=0)
        for (a, b, g), goes_on in pairs:
            if goes_on or a[-1] not in "-¬":  # a compound may have kept a break of the page
                x.append(join_features(a, b, g, least, usual, even)), y.append(float(goes_on))

    for text in texts:
        lines = [line.strip() for line in text.split("\n")]
        if max(map(len, lines)) <= WIDE:
            continue
        learn([(line, False if line else None) for line in lines])
        width, blank, apart, broken = dice.randrange(38, 78), dice.random() < 0.3, dice.random() < 0.5, []
        for line in lines:
            if not line:
                broken.append(("", None))
                continue
            rows, row = [], ""
            for w in line.split():
                if row and len(row) + 1 + len(w) > width - dice.randrange(6):
                    rows.append(row)
                    row = w
                else:
                    row = f"{row} {w}".strip()
            for k, r in enumerate([*rows, row]):
                broken.append((r, k > 0))
                broken += [("", None)] * blank
            broken += [("", None)] * apart
        learn(broken)
    return Logistic().fit(np.array(x), np.array(y), ridge=0.2)


@lru_cache(1)
def _plain_joins() -> Logistic:
    return fitted_lines_that_go_on([])


PART, CAPITALS, NUMERAL = 1, 2, 4


class _Heads(dict):
    """Whether a token may be part of a title (PART, in capitals CAPITALS) or the number of a chapter (NUMERAL). Every distinct token is looked at once."""

    def __init__(self, titles: frozenset[tuple[str, ...]]) -> None:
        super().__init__()
        self.titles, self.words = titles, {w for t in titles for w in t}

    def __missing__(self, token: str) -> int:
        w = "".join(_letters.findall(token)).lower()
        found = len(w) > 2 and (any(near(w, t) for t in self.words) or len(w) > 8 and any(title_share([w], t) == 1 for t in self.titles))
        got = (PART | CAPITALS * _in_capitals(token) if found else 0) | NUMERAL * bool(_number.match(token))
        self[token] = got
        if len(self) > 500_000:
            self.clear()
        return got

    def held(self, texts: list[str | None]) -> list[int]:
        """`of` the tokens of each text; every distinct token of all texts is looked up once."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))  # at what str.split splits
        tokens, sizes = lists.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flags = np.fromiter(map(self.__getitem__, tokens.dictionary.to_pylist()), np.uint8)[tokens.indices.to_numpy()]
        got, some = np.zeros(len(texts), np.uint8), sizes > 0
        if some.any():
            got[some] = np.bitwise_or.reduceat(flags, (np.cumsum(sizes) - sizes)[some])
        return got.tolist()

    def of(self, words: list[str]) -> int:
        got = 0
        for v in set(map(self.__getitem__, words)):
            got |= v
        return got


def _in_capitals(token: str) -> bool:
    return bool(len(token) > 3 and _two_caps.search(token) and sum(c.isupper() for c in token) >= 0.6 * sum(c.isalpha() for c in token) and not _roman.fullmatch(token))


@dataclass
class Lines:
    """The classifiers of lines, fitted on at most SAMPLE texts, with the titles of all books."""

    model: Logistic
    titles: frozenset[tuple[str, ...]]
    joins: Logistic
    heads: _Heads | None = None

    @classmethod
    def fitted(cls, sample: list[tuple[str | None, str | None]], sources: Iterable[str | None] = ()) -> Lines:
        """sample: (source, text). sources: those of all texts, of which the sample may hold but some."""
        titles = frozenset(t for s in [*sources, *(s for s, _ in sample)] if (t := title_of(s)))
        plain = [(source, looks_latin(text) or "") for source, text in sample]
        certain = certain_lines(plain)
        x, y = [], []
        for source, text in plain:
            lines = text.split("\n")
            usual = _usual(lines)
            for _, s, before, after in _neighbours(lines):
                sure = certain.get(_numerals.sub("#", s))
                if sure is not None:
                    share = title_share(_parts(s), title_of(source))
                    x.append(line_features(s, before, after, share, usual)), y.append(float(sure))
        # Weak copies of sure cases keep the fit defined on corpora without any furniture.
        x += [[1, 1, 0, 0.25, 1, 0.5, 1, 1, 0], [0, 0, 1, 0, 0, 0.1, 1, 1, 1], [0, 0, 1, 0.08, 0, 0.1, 1, 1, 0], [1, 1, 0, 0.4, 0.9, 0.6, 1, 1, 0], [0, 0, 0, 1, 0.02, 1, 1, 1, 0], [1, 1, 0, 0.25, 1, 0.5, 0, 0, 0], [0, 0, 1, 0, 0, 0.1, 0, 0, 1], [0, 0, 0, 0.25, 0.1, 0.6, 1, 0, 0], [0, 0, 0, 0.5, 0.05, 1, 0, 1, 0], [0, 0, 0, 0.4, 1, 0.9, 1, 1, 1]]
        y += [1, 1, 1, 1, 0, 1, 1, 0, 0, 0]
        return cls(Logistic().fit(np.array(x), np.array(y), ridge=0.2), titles, fitted_lines_that_go_on([t for _, t in plain]))

    def _at_best(self) -> float:
        """The greatest score of a line without any part of a title, chapter or page number."""
        w = self.model.weights
        top = [0, 0, 0, 1, 1, 2, 1, 1, 1]
        return float(w[0] + sum(max(0.0, v) * t for v, t in zip(w[1:], top)))

    def may_be(self, line: str) -> bool:
        """False only for lines that cannot be furniture, whatever stands around them."""
        got = self.heads.of(line.split())
        return bool(got & PART or got & NUMERAL and _chapter.search(line) or _page.fullmatch(line) or self._open)

    def ready(self) -> Lines:
        if self.heads is None:
            self.heads, self._open = _Heads(self.titles), self._at_best() > 0
        return self

    def kinds(self, line: str, before: str, after: str, title: tuple[str, ...], usual: int) -> tuple[str, ...]:
        """What kind of furniture a line is; empty for lines of text."""
        self.ready()
        if not self.may_be(line):
            return ()
        low = _parts(line)
        share = title_share(low, title)
        if share < 1 and len(low) >= 2 and sum(c.isupper() for c in line) > 0.1 * sum(c.isalpha() for c in line):
            share = max([share, *(title_share(low, t) for t in self.titles)])
        f = line_features(line, before, after, share, usual)
        if self.model.score(np.array([f]))[0] <= 0:
            return ()
        if f[0] >= 0.5:
            rest = _chapter.sub(" ", line)
            return ("header", "page_no") if re.search(r"(?:^|\s)\d{1,4}(?:\s|[.\])|]|$)", rest) else ("header",)
        return ("page_no",)


def _heads_inside(line: str, titles: list[tuple[str, ...]], heads: _Heads) -> list[tuple[int, int]]:
    """Spans of running heads within a longer line: title words in capitals with a chapter before or after."""
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", line)]
    caps = [_in_capitals(w) for w, _, _ in tokens]
    spans, k = [], 0
    while k < len(tokens):
        n = 0
        if caps[k] and heads[tokens[k][0]] & PART:
            run = 1
            while k + run < len(tokens) and caps[k + run] and run < 4:
                run += 1
            for width in range(1, min(run, 3) + 1):
                words = ["".join(_letters.findall(t)).lower() for t, _, _ in tokens[k : k + width]]
                if any(title_share(words, t) == 1 for t in titles):
                    n = width
                    break
        if n:
            a, b = k, k + n - 1
            if a >= 2 and _chap_token.fullmatch(tokens[a - 2][0]) and _roman.fullmatch(tokens[a - 1][0]):
                a -= 2
            elif b + 2 < len(tokens) and (_chap_token.fullmatch(tokens[b + 1][0]) or near(tokens[b + 1][0].lower(), "chapter")) and _roman.fullmatch(tokens[b + 2][0]):
                b += 2
            elif b + 1 < len(tokens) and _fused.fullmatch(tokens[b + 1][0]):
                b += 1
            spans.append((tokens[a][1], tokens[b][2]))
            k = b + 1
        else:
            k += 1
    return spans


def structure(text: str | None, source: str | None, lines_model: Lines) -> tuple[str | None, set[str]]:
    """(text without furniture and with broken words closed around BROKEN, kinds of furniture found)."""
    text = looks_latin(text)
    return _structure(text, source, lines_model, lines_model.ready().heads.of((text or "").split()))


def _structure(text: str | None, source: str | None, lines_model: Lines, held: int) -> tuple[str | None, set[str]]:
    """The same for a text that looks Latin. held: what its tokens may be (`_Heads.of`)."""
    if not text or not text.strip():
        return text, set()
    kinds: set[str] = set()
    title = title_of(source)
    heads = lines_model.heads
    if "\n" in text:
        lines = text.split("\n")
        usual, drop = _usual(lines), set()
        some = held & (PART | NUMERAL) or lines_model._open
        for i, s, before, after in _neighbours(lines):
            if (some or _page.fullmatch(s)) and (got := lines_model.kinds(s, before, after, title, usual)):
                kinds.update(got), drop.add(i)
        if drop:
            lines = [s for i, s in enumerate(lines) if i not in drop and not (not s.strip() and i - 1 in drop)]
            text = "\n".join(lines)
    if held & CAPITALS:
        titles = [title, *(t for t in lines_model.titles if t != title)] if title else list(lines_model.titles)
        out = []
        for s in text.split("\n"):
            spans = _heads_inside(s, titles, heads) if heads.of(s.split()) & CAPITALS else []
            for a, b in reversed(spans):
                kinds.add("header")
                s = s[:a].rstrip() + " " + s[b:].lstrip()
            if not spans or s.strip():
                out.append(s)
        text = "\n".join(out)
    if "- " in text or "-\n" in text or "¬" in text:
        text = _break.sub(BROKEN, text)
    return text, kinds


def keys(text: str) -> list[str]:
    """Every token of a text as the tables know it: small letters, outer punctuation stripped."""
    return [w.strip(EDGE) for w in text.lower().split()]


def structured(texts: DataFrame, id: str = "chunk_id", text: str = "text", source: str = "source") -> tuple[DataFrame, Logistic]:
    """((id, body, kinds, counts), classifier of neighbouring lines): staged texts after the first pass; the first row of each Arrow batch also has the
    batch's token counts."""
    sample = texts.select(source, text).where(F.col(text).isNotNull()).orderBy(F.xxhash64(id), text).limit(SAMPLE).collect()
    sources = [r[0] for r in texts.select(source).distinct().collect()]
    model = Lines.fitted([(r[0], r[1]) for r in sample], sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            latin = [looks_latin(t) for t in b.column(1).to_pylist()]
            done = [_structure(t, s, model, h) for t, s, h in zip(latin, b.column(2).to_pylist(), model.ready().heads.held(latin))]
            bodies = pa.array([d[0] for d in done], pa.string())
            raw = pc.utf8_split_whitespace(bodies).flatten().value_counts()  # of tokens as they stand; their keys are made once for each distinct token
            by_key: Counter[str] = Counter()
            for w, n in zip(raw.field(0).to_pylist(), raw.field(1).to_pylist()):
                by_key[w.lower().strip(EDGE)] += n
            counts = pa.array([list(by_key.items())] + [None] * (len(done) - 1) if done else [], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), bodies, pa.array([sorted(d[1]) for d in done], pa.list_(pa.string())), counts], ["id", "body", "kinds", "counts"])

    kind = texts.schema[id].dataType.simpleString()
    schema = f"id {kind}, body string, kinds array<string>, counts map<string,bigint>"
    return staged(texts.select(F.col(id).alias("id"), text, source).mapInArrow(run, schema)), model.joins


def token_counts(bodies: DataFrame) -> DataFrame:
    """(key, n) of every distinct token; broken words count closed, with BROKEN kept in the key so that compounds can be told."""
    counted = bodies.where("counts is not null").select(F.explode("counts").alias("key", "n"))
    return counted.groupBy("key").agg(F.sum("n").alias("n")).where("key <> ''")


def edit(token: str, word: str) -> tuple[str, str, int, int]:
    """(what stands in word, what in token, letters before, letters after) around the one place where they differ."""
    i, least = 0, min(len(token), len(word))
    while i < least and token[i] == word[i]:
        i += 1
    j = 0
    while j < least - i and token[-1 - j] == word[-1 - j]:
        j += 1
    return word[i : len(word) - j], token[i : len(token) - j], i, j


@lru_cache(200_000)
def _steps(a: str, b: str) -> tuple[int, int]:
    """(known misreadings, other letters) by which b was read for a, cheapest first."""
    wide, dear = len(b) + 1, 1000  # a cell has 1000 for each other letter and 1 for each known misreading
    best = [dear * dear] * ((len(a) + 1) * wide)
    best[0] = 0
    stray = [0 if c in STRAY else dear for c in b]
    for i in range(len(a) + 1):
        c, row = a[i : i + 1], i * wide
        ways = [(len(x) * wide + len(y), y) for x, y in _misread.get(c, ()) if a.startswith(x, i)]
        for j in range(wide):
            at = best[row + j]
            if c:
                for far, y in ways:
                    if b.startswith(y, j) and at + 1 < best[row + j + far]:
                        best[row + j + far] = at + 1
                if j < len(b) and (cost := at if c == b[j] else at + dear) < best[row + j + wide + 1]:
                    best[row + j + wide + 1] = cost
                if at + dear < best[row + j + wide]:
                    best[row + j + wide] = at + dear
            if j < len(b) and (cost := at + stray[j]) < best[row + j + 1]:
                best[row + j + 1] = cost
    other, known = divmod(best[-1], dear)
    return known, other


def pair_features(token: str, n: int, word: str, word_n: int, shared: int) -> list[float]:
    """How likely a token is a misreading of a word."""
    a, b, before, after = edit(token, word)
    known, other = _steps(a, b) if len(a) <= 8 and len(b) <= 9 else (0, 9)
    return [
        float(known), float(min(other, 9)), float(np.log10(word_n / n)), float(np.log10(n)), float(len(word)), float(before), float(after),
        float(any(not c.isalpha() and c != "-" for c in b)), float(any(ord(c) > 127 and c.isalpha() for c in b)),
        float(not a and b.isalpha()), float(a.isalpha() and not b), 2.0 * shared / (len(token) + len(word) + 2),
    ]


def _grams(key: str) -> list[str]:
    padded = f"^{key}$"
    return sorted({padded[i : i + 2] for i in range(len(padded) - 1)})


def grams_of(column: str) -> F.Column:
    """The same, as a column."""
    padded = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(column) + 1), lambda i: F.substring(padded, i, 2)))


def _bits(grams: str, half: int) -> F.Column:
    """The first (0) or second (1) 64 of the 128 bits that stand for some bigrams."""
    place = lambda g: F.xxhash64(g).bitwiseAND(F.lit(127).cast("bigint")) - 64 * half
    bit = lambda g: F.when(place(g).between(0, 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), place(g).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(grams, F.lit(0).cast("bigint"), lambda seen, g: seen.bitwiseOR(bit(g)))


# Fixed value: letters by how common they are, the common ones first. Any order of bigrams gives the same candidates; this one looks up few.
COMMON_FIRST = "e^$tainosrhldcumfgpwybvkxjqz"


def _rare_first(grams: F.Column) -> F.Column:
    """Bigrams sorted, those of rare letters first."""

    def place(c: F.Column) -> F.Column:
        at = F.position(c, F.lit(COMMON_FIRST))
        return F.when(at == 0, 40).otherwise(at)

    keyed = F.transform(grams, lambda g: F.struct((-place(F.substring(g, 1, 1)) - place(F.substring(g, 2, 1))).alias("o"), g.alias("g")))
    return F.transform(F.array_sort(keyed), lambda x: x["g"])


def similar_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(key, n, word, word_n, shared): tokens (key, n) with the words (word, word_n) that are RATIO times as frequent, at most FAR letters longer or
    shorter, and share LIKE of their bigrams, two at least.

    An inverted join on bigrams and lengths, of which only those are looked up that decide: two sets that must share t elements share one among the
    g - t + 1 of either that come first in any common order. Both sides are dealt by bigram and length into a fixed number of tasks, as few small rows
    meet very many. Most of what meets shares too little: each side's bigrams are also 128 bits, and what one side has and the other lacks there bounds
    what both share from above, so that the sets themselves are compared for few.
    """
    spark = tokens.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    need = lambda size: F.greatest(F.lit(2), F.ceil((size + 1) * F.lit(LIKE))).cast("int")

    def dealt(rows: DataFrame, key: str, kept: list[str], t: F.Column) -> DataFrame:
        """A row for each deciding bigram, with the number of all bigrams (`key`_grams) and their bits (`key`_low, `key`_high)."""
        rows = rows.select(*kept, t.alias("least"), grams_of(key).alias("grams"))
        rows = rows.select(*kept, "least", "grams", F.size("grams").alias(f"{key}_grams"), *(_bits("grams", half).alias(f"{key}_{name}") for half, name in enumerate(("low", "high"))))
        first = F.slice(_rare_first(F.col("grams")), F.lit(1), F.greatest(F.size("grams") - F.col("least") + 1, F.lit(0)))
        return rows.select(*kept, "least", f"{key}_grams", f"{key}_low", f"{key}_high", F.explode(first).alias("gram"))

    size = F.char_length("key")
    a = dealt(tokens.withColumn("size", size), "key", ["key", "n", "size"], need(F.greatest(size - FAR, F.lit(1)))).drop("least")
    b = dealt(words, "word", ["word", "word_n"], need(F.char_length("word")))
    b = b.withColumn("size", F.explode(F.sequence(F.char_length("word") - FAR, F.char_length("word") + FAR)))
    met = a.repartition(tasks, "gram", "size").join(b.repartition(tasks, "gram", "size").hint("shuffle_hash"), ["gram", "size"])
    met = met.where(F.col("word_n") >= RATIO * F.col("n"))
    for own, other in (("key", "word"), ("word", "key")):
        alone = sum(F.bit_count(F.col(f"{own}_{half}").bitwiseAND(F.bitwise_not(f"{other}_{half}"))) for half in ("low", "high"))
        met = met.where(F.col(f"{own}_grams") - alone >= F.col("least"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[str]] = {}
        for batch in batches:
            ends = [batch.column(c).to_pylist() for c in ("key", "word")]
            for w in {w for end in ends for w in end if w not in sets}:
                sets[w] = frozenset(_grams(w))
            both = pa.array([len(sets[a] & sets[b]) for a, b in zip(*ends)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, "shared"])
            if len(sets) > 100_000:
                sets.clear()

    met = met.select("key", "n", "word", "word_n").distinct().mapInArrow(shared, "key string, n bigint, word string, word_n bigint, shared int")
    return met.where(F.col("shared") >= need(F.char_length("word")))


def fitted_ranking(true: list[tuple[str, int]], rare: list[tuple[str, int]]) -> BoostedTrees:
    """true: frequent words with counts. rare: words known to be right (vocabulary terms) with counts. Misread copies of true words teach what to
    replace; true and rare words against their neighbours, and misread copies against wrong words, teach what to leave."""
    dice, x, y = random.Random(7), [], []
    words = [(w, n) for w, n in true if w.isalpha() and w.isascii() and len(w) > 2]
    by_gram: dict[str, list[tuple[str, int]]] = {}
    for w, n in words:
        for g in _grams(w):
            by_gram.setdefault(g, []).append((w, n))

    def others(token: str) -> list[tuple[str, int, int]]:
        found = Counter(p for g in _grams(token) for p in by_gram.get(g, []))
        return [(w, n, k) for (w, n), k in found.most_common(9) if k >= 2]

    for w, n in words:
        for _ in range(6):
            ways = [(i, a, b) for a, b in MISREAD for i in range(len(w)) if w.startswith(a, i)]
            i, a, b = dice.choice(ways) if ways and dice.random() < 0.75 else (at := dice.randrange(len(w)), "", dice.choice(STRAY[:10]))
            token = w[:i] + b + w[i + len(a) :]
            m = max(1, min(n // (RATIO + 2), int(10 ** dice.uniform(0, 2))))
            for v, k, shared in others(token):
                if k >= RATIO * m and token != v:
                    x.append(pair_features(token, m, v, k, shared)), y.append(float(v == w))
    for w, n in [*rare, *words]:
        for v, k, shared in others(w)[:6]:
            if v != w:
                x.append(pair_features(w, max(1, min(n, k // RATIO)), v, k, shared)), y.append(0.0)
    if not any(y):
        x, y = [*x, [1, 0, 3, 0, 6, 3, 2, 0, 0, 0, 0, 0.7], [0, 9, 1, 1, 6, 0, 0, 0, 0, 0, 0, 0.3]], [*y, 1.0, 0.0]
    return BoostedTrees().fit(np.array(x), np.array(y))


def fitted_joins(true: list[tuple[str, int]]) -> Logistic:
    """Whether two ends of lines are one word (positive) or a compound, from the counts of the compound, of the closed word and of both halves.
    Frequent words broken at random places are joins, frequent compounds are none."""
    dice, n = random.Random(3), dict(true)
    x, y = [[3.0, 0.0, 2.0, 2.0], [0.0, 3.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]], [0.0, 1.0, 1.0]
    for w, k in true:
        at = w.find("-") if "-" in w else dice.randrange(2, len(w) - 1) if len(w) > 4 else 0
        if at > 0:
            left, right = w[:at], w[at + ("-" in w) :]
            seen = (k, n.get(left + right, 0)) if "-" in w else (n.get(f"{left}-{right}", 0), k)
            x.append([float(np.log1p(v)) for v in (*seen, n.get(left, 0), n.get(right, 0))]), y.append(float("-" not in w))
    return Logistic().fit(np.array(x), np.array(y))


def corrections(counts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(key, word): replacements. counts: (key, n), staged. terms: (form) of a clean vocabulary, whose words are never misreadings.

    For a key with BROKEN the row tells a compound (word with a hyphen). Candidates are the `similar_words` of each token.
    """
    spark = counts.sparkSession
    known = terms.select(F.explode(F.split(F.lower("form"), r"[\s]+")).alias("key")).distinct() if terms is not None else spark.createDataFrame([], "key string")
    letters = r"^[\p{L}\p{M}]+(-[\p{L}\p{M}]+)*$"
    frequent = counts.where(F.col("key").rlike(letters) & (F.col("n") >= TRUE) & (F.length("key") >= 2))
    true = [(r.key, r.n) for r in frequent.orderBy(F.desc("n"), "key").limit(TRUE_WORDS).collect()]
    rare = [(r.key, r.n) for r in counts.join(known, "key").orderBy(F.xxhash64("key")).limit(TRUE_WORDS).collect()]
    floor = true[len(true) // 3][1] if true else 1
    model = fitted_ranking([p for p in true if p[1] >= floor] or true, rare)

    closed = counts.withColumn("key", F.replace("key", F.lit(BROKEN), F.lit(""))).groupBy("key").agg(F.sum("n").alias("n"))
    tokens = closed.where(F.col("key").rlike(r"\p{L}") & (F.length("key") >= 2)).join(known, "key", "left_anti")
    tokens = tokens.where(~F.col("key").rlike(r"^[ivxlcdm]+$"))
    met = similar_words(tokens, frequent.where(F.col("n") >= 2 * RATIO).select(F.col("key").alias("word"), F.col("n").alias("word_n")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "n", "word", "word_n", "shared"))))
            if rows:
                score = model.score(np.array([pair_features(*r) for r in rows]))
                keep = [i for i, s in enumerate(score) if s > 0]
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.string()), pa.array([rows[i][2] for i in keep], pa.string()), pa.array(score[keep], pa.float64()), pa.array([rows[i][3] for i in keep], pa.int64())], ["key", "word", "score", "word_n"])

    best = met.mapInArrow(rank, "key string, word string, score double, word_n bigint")
    best = best.groupBy("key").agg(F.max_by("word", F.struct("score", "word_n", "word")).alias("word"))
    joins = fitted_joins(true).weights
    halves = counts.where(F.col("key").contains(BROKEN)).select("key", F.split("key", BROKEN).alias("p"))
    halves = halves.select("key", F.array_join("p", "-").alias("open"), F.array_join("p", "").alias("shut"), F.element_at("p", 1).alias("left"), F.element_at("p", -1).alias("right"))
    odds = F.lit(float(joins[0]))
    for w, part in zip(joins[1:], ("open", "shut", "left", "right")):
        halves = halves.join(counts.select(F.col("key").alias(part), F.col("n").alias(f"{part}_n")), part, "left")
        odds = odds + float(w) * F.log1p(F.coalesce(f"{part}_n", F.lit(0)))
    return best.unionByName(halves.where((odds <= 0) & F.col("open_n").isNotNull()).select("key", F.col("open").alias("word")))


def _cased(old: str, new: str) -> str:
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[:1].upper() + new[1:] if letters and letters[0].isupper() and old[:1] == letters[0] else new


def mended(token: str, answers: dict[str, str]) -> tuple[str, tuple[str, ...]]:
    """(the token repaired, kinds of noise in it)."""
    core = token.strip(EDGE)
    key = core.lower()
    if not key or key.isascii() and key.isalpha() and key not in answers:
        return token, ()
    at, fixed, kinds = token.find(core), core, []
    if BROKEN in fixed:
        if key in answers:
            fixed = fixed.replace(BROKEN, "-")
        else:
            kinds.append("hyphen")
            fixed = fixed.replace(BROKEN, "")
        key = fixed.lower()
    if key in answers:
        kinds.append("glyph")
        fixed = _cased(fixed, answers[key])
    elif any(c in STRAY for c in key):
        kinds.append("glyph")
        fixed = "".join(c for c in fixed if c not in STRAY)
    return token[:at] + fixed + token[at + len(core) :], tuple(kinds)


def repair(body: str, answers: dict[str, str], join_lines: bool = True, memory: dict | None = None, joins: Logistic | None = None) -> tuple[str, set[str]]:
    """(repaired text, kinds of word noise found). answers: rows of `corrections`. memory: tokens mended before with the same answers. joins: the classifier
    of neighbouring lines."""
    memory = {} if memory is None else memory
    kinds: set[str] = set()
    out = []
    lines = body.split("\n")
    bullets = {b for b in "*•" if b in body and sum(s.lstrip().startswith(b + " ") for s in lines) > 1}  # a single one is a stray mark
    for line in lines:
        words = line.split()
        found = list(map(memory.get, words))  # False for tokens that stay, None for new ones
        if None in found:
            for k, w in enumerate(words):
                if found[k] is None:
                    got = mended(w, answers)
                    found[k] = memory[w] = got[0] != w and got
        if any(found):
            for k, got in enumerate(found):
                if got and not (k == 0 and words[k] in bullets):
                    words[k] = got[0]
                    kinds.update(got[1])
            words = filter(None, words)
        out.append(" ".join(words))
    return (paragraphs(out, joins or _plain_joins()) if join_lines else "\n".join(out)), kinds


def paragraphs(lines: list[str], joins: Logistic) -> str:
    """Lines joined where one goes on in the next. Other breaks stay, with one blank line where there were any beyond those that part all lines."""
    pairs = _gaps(lines)
    if not pairs:
        return next((s for line in lines if (s := line.strip())), "")
    least, usual = min(g for _, _, g in pairs), _usual(lines)
    even = _even(lines, usual)
    goes_on = joins.score(np.array([join_features(a, b, g, least, usual, even) for a, b, g in pairs])) > 0
    text = pairs[0][0]
    for (_, b, gap), on in zip(pairs, goes_on):
        text += (" " if on else "\n\n" if gap else "\n") + b
    return text


def repaired(texts: DataFrame, id: str = "chunk_id", text: str = "text", source: str = "source", terms: DataFrame | None = None, join_lines: bool = True, then: tuple[Callable, Callable[[str], str]] | None = None) -> DataFrame:
    """(id, body, kinds): every row's text repaired, with the kinds of noise that were found: hyphen, header, page_no, glyph.

    then: what to make of the repaired batches in the same task (a function of batches, and its schema by the type of id), so that texts that only
    serve a next step never leave it.
    """
    whole, joins = structured(texts, id, text, source)
    counts = staged(token_counts(whole))
    bodies = whole.select("id", "body", "kinds")
    fixes = staged(corrections(counts, terms))
    kind = bodies.schema["id"].dataType.simpleString()
    after, schema = (lambda batches: batches, f"id {kind}, body string, kinds array<string>") if then is None else (then[0], then[1](kind))

    def finish(b: pa.RecordBatch, per_row: Iterator[dict[str, str]], memory: dict | None = None) -> pa.RecordBatch:
        done = [(t, set()) if t is None or not t.strip() else repair(t, a, join_lines, memory, joins) for t, a in zip(b.column("body").to_pylist(), per_row)]
        kinds = [sorted({*k, *d[1]}) for k, d in zip(b.column("kinds").to_pylist(), done)]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array([d[0] for d in done], pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["id", "body", "kinds"])

    if fixes.count() <= SMALL:
        table = bodies.sparkSession.sparkContext.broadcast({r.key: r.word for r in fixes.collect()})

        def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answers, memory = table.value, {}
            for b in batches:
                yield finish(b, iter([answers] * b.num_rows), memory)
                if len(memory) > 500_000:
                    memory.clear()

        return bodies.mapInArrow(lambda batches: after(with_table(batches)), schema)

    tokens = F.udf(lambda t: sorted({k for w in keys(t or "") for k in (w, w.replace(BROKEN, ""))}), "array<string>")
    asked = bodies.withColumn("mark", F.xxhash64("id", "body"))
    pairs = asked.select("mark", F.explode(tokens("body")).alias("key")).join(fixes, "key").distinct()
    per_text = pairs.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("key", "word"))).alias("answers"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finish(b, (dict(a or []) for a in b.column("answers").to_pylist()))

    return asked.join(per_text, "mark", "left").select("id", "body", "kinds", "answers").mapInArrow(lambda batches: after(joined(batches)), schema)
