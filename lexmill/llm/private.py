"""Problem 9: personal information in free text, found by a skip-chain conditional random field and replaced by typed placeholders.

Every token of every script and case has a potential: a log-linear score of its shape, its first and last letters, the words around it and the formats
it is part of. Tokens that this alone does not settle, and those AROUND them, are nodes of the field. Neighbouring nodes share a transition potential;
*skip edges* join tokens of one document that are equal or nearly so (capitalised words and long numbers), so that evidence at one place, such as a
title, carries to the others. Labels come from loopy belief propagation over all documents of an Arrow batch at once; spans are runs of one label.

Node, transition and skip weights are fitted together by pseudo-likelihood: each token's label given its own features and the labels at the other end of
its edges. The sample of at most SAMPLE documents (those of the least hashes, of LONG characters at most) is labelled at a distance: formats with their cue words for numbers and
addresses; for names the table of known people and titles; of the other uncommon capitalised words only those that the sample shows LEAST times, and never
beside a title or a known person, are no names, the rest are left out of the fit. What the labels are taken from (format, known person, spelling) is hidden from a random half of the tokens in each round,
so that the words around must carry the rest, and a name that is in no table can be found by them. For the same reason every text of the sample that
names someone or some place is shown again with other names of letters by chance (`made_over`). Which words are common is no matter of the fit: words
are counted by case over all documents. The corpus itself is never gathered. A found stretch must finally pass a check of form: digits of a phone, a
house number of an address and so on.

Null, empty and blank texts hold nothing. Full-width and similar characters are read as plain ones; offsets are those of the stored text.
"""

from __future__ import annotations

import random
import re
import unicodedata as ud
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

LABELS = ("none", "email", "phone", "id_number", "address", "name")
SAMPLE, SLOTS, ROUNDS = 2500, 1 << 18, 6
#: A common word stands in small letters at least LEAST times and in the share SMALL of its uses. Names do so by mistake only, words of addresses and headings often.
LEAST, SMALL = 3, 0.05
#: Most common words that are broadcast; beyond, they are joined to each CHUNK (a power of two) of documents.
WORDS, CHUNK = 200_000, 512
#: The sample is taken from texts of at most LONG characters, up to SAMPLE_CHARACTERS in all. PART: characters of texts that are labelled at once (a longer
#: text by itself).
LONG, SAMPLE_CHARACTERS, PART = 50_000, 8_000_000, 1_000_000
#: Nodes around a token that may be personal; a token may be if its own potential leaves so much for the personal labels.
AROUND, OPEN = 4, 0.01

# Words that stand before or in personal data.
TITLES = "dr mr mrs ms miss shri sri smt vaidya prof doctor kumari".split()
ID_CUES = "passport mrn aadhaar aadhar uid licence license card id voter patient pat pan ssn".split()
NOT_CUES = "batch lot formula catalogue catalog verse verses plate price rs mix revised isbn shelf page chapter ch invoice tip row bp pulse".split()
PHONE_CUES = "call dial number tel whatsapp phone contact mobile ring".split()
CUES = dict.fromkeys(NOT_CUES, "not") | dict.fromkeys(PHONE_CUES, "phone") | dict.fromkeys(ID_CUES, "id")
STREETS = "street st road rd lane layout cross avenue ave nagar colony towers block marg".split()

_letters = re.compile(r"[^\W\d_]+")
#: White space and a word (of any script, with its marks), a number or a sign; every character of a text but white space at its end is in one.
_token = re.compile(r"\s*(?:[^\s\d_\x00-@\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u2bff\u3000-\u3004\u3008-\u3030।॥\ufe00-\ufe0f\uff00-\uff0f\uff1a-\uff20\U0001f000-\U0001faff]+|\d+|\S)")
_street = re.compile(r"(?i)\b(?:" + "|".join(STREETS) + r")\b|o\.?\s*box")
_near_digits = re.compile(r"\d+")
_email = re.compile(r"(?i)[a-z0-9][a-z0-9._+-]*(?: ?@ ?|\s*[(\[]at[)\]]\s*)[a-z0-9-]+(?:(?:\.|\s*[(\[]dot[)\]]\s*)[a-z0-9-]+)*(?:\.|\s*[(\[]dot[)\]]\s*)[a-z]{2,}")
_phone = re.compile(r"(?<![\w/.-])(?:\+|00)?\(?\d[\d ()./-]{5,18}\d(?: ?(?:ext|x)\.? ?\d{1,5})?(?![\w/])")
_id = re.compile(r"(?<![\w/])(?=(?:[\w /-]*\d){4})[A-Z]{0,5}[-/]?(?:\d{2}[ -])?\d[\d -]{2,18}\d[A-Z]?(?!\w)")
_cued = re.compile(r"(?i)\b(?:passport|mrn|aadhaar|aadhar|uid|licen[cs]e|card|i\.?d\.?|pan|ssn|pat)\b(?:\.?\s*(?:no|number|card|id))?(?:\s+(?:is|was|reads))?\s*[.:#]*\s*([A-Z]{0,5}[-/]?\d(?:[\d -]|\n(?=\d)){2,18}\d[A-Z]?)\b")
_house = r"(?:h\.? ?no\.? ?|no\.? ?|door no\.? ?|plot(?: no\.?)? ?|flat |apt\.? |#)?\d{1,4}(?:[/-]\d{1,4}){0,2}[A-Za-z]?"
_address = re.compile(
    r"(?i)(?<![\w/])(?:(?:p\.?\s?o\.?\s*box\s+\d+)|" + _house + r"(?:,?\s+(?:[A-Z][\w.]+|\d+(?:st|nd|rd|th)|opposite the \w+|near the \w+|behind the \w+),?){0,6}?\s+(?:" + "|".join(STREETS) + r")\b\.?)"
    r"(?:,?\s+[A-Z][a-z]{3,}(?:\s*[-–]?\s*\d{3} ?\d{3})?)?"
)


class _Plain(dict):
    """The plain character of each code point, found once."""

    def __missing__(self, point: int) -> int:
        plain = ud.normalize("NFKC", chr(point))
        self[point] = got = ord(plain) if len(plain) == 1 else point
        return got


_plain = _Plain({c: c for c in range(128)})


def folded(text: str) -> str:
    """The text with full-width and similar characters made plain, one for one."""
    return text if text.isascii() else text.translate(_plain)


def _may_hold_email(text: str) -> bool:
    if "@" in text:
        return True
    low = text.lower() if "(" in text or "[" in text else ""
    return "at)" in low or "at]" in low


def phones(text: str) -> list[tuple[int, int]]:
    """Stretches in the form of a phone number, first within lines, then across a line break where nothing was found within."""
    found = [m.span() for m in _phone.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    if "\n" in text:
        for m in _phone.finditer(text.replace("\n", " ")):
            a, b = m.span()
            if "\n" in text[a:b] and 9 <= sum(map(str.isdigit, m[0])) <= 13 and not any(x < b and a < y for x, y in found):
                found.append((a, b))
    return found


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Bits of a token and of the formats around it.
TITLE, STREET, NUMBER, COMMON, CAPITAL, KNOWN, STOP = 1, 2, 4, 8, 16, 32, 64
FORMATS = ("email", "phone", "id", "cued", "address")
_CUE = {"not": 1, "phone": 2, "id": 3}


class Tokens(dict):
    """The number of each distinct token, with columns of what is known of it: what neighbours see of it, its shape, first and last letters, bits, cue,
    the white space before it and its length. known: words and their bits (COMMON, KNOWN)."""

    def __init__(self, known: dict[str, int], heard: frozenset[str]) -> None:
        super().__init__()
        self.known, self.heard = known, heard
        self.columns = {c: array("Q") for c in ("seen", "shape", "head", "tail", "bits", "cue", "gap", "size", "space")}
        self[""]  # what is before and after a text

    def __missing__(self, token: str) -> int:
        w = token.lstrip()
        space = token[: len(token) - len(w)]
        low = w.lower()
        letters = bool(w) and (w[0].isalpha() or not w.isascii() and not ud.category(w[0]).startswith(("P", "S", "C")))
        bits = self.known.get(low, 0) | TITLE * (low in TITLES) | STREET * (low in STREETS) | NUMBER * w.isdigit() | CAPITAL * (letters and w[0].isupper()) | STOP * (w in ".?!।॥" or not w)
        if w.isdigit():
            shape = "9" * min(len(w), 6)
        elif letters:
            case = ("X" if len(w) == 1 else "XX") if w.isupper() else "Xx" if w[0].isupper() else "x" if w[0].islower() else "o"
            shape = case + ("" if w.isascii() else "~")
        else:
            shape = w
        usual = bits & (COMMON | TITLE | STREET) or low in CUES or low in self.heard or not letters
        rare = letters and not usual
        seen = "^" if not w else low if usual and not w.isdigit() else "rare " + shape
        row = (_hash(seen), _hash(shape), _hash(low[:3]) if rare else 0, _hash(low[-3:]) if rare else 0, bits, _CUE.get(CUES.get(low, ""), 0), 2 if "\n" in space else bool(space), len(token), len(space))
        for column, v in zip(self.columns.values(), row):
            column.append(v)
        self[token] = n = len(self)
        return n


_PADS = 6
#: The features of a token, and which of them tell what the labels of the sample were taken from.
TEMPLATES, TOLD = 28, (3, 4, 5, 10, 11, 12, 13, 14)


@dataclass
class Pages:
    """Documents end to end, each with pads before and behind. tokens: their texts; at: first token of each; start: where each token starts in its text;
    x: its features, of which `hidden` are those with nothing told."""

    tokens: list[str]
    at: np.ndarray
    sizes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bits: np.ndarray
    x: np.ndarray
    hidden: np.ndarray | None = None


@dataclass
class Field:
    """A fitted field. known: words and their bits, COMMON (usual in small letters) and KNOWN (part of a known person's name). heard: capitalised words that
    the sample shows often, and never as names."""

    known: dict[str, int]
    heard: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    moves: np.ndarray | None = None
    skip: np.ndarray | None = None
    lexicon: Tokens | None = None

    def pages(self, texts: list[str], hidden: bool = False) -> Pages:
        if self.lexicon is None or len(self.lexicon) > 500_000:
            self.lexicon = Tokens(self.known, self.heard)
        lexicon, tokens, sizes, folds = self.lexicon, [], [], []
        for t in texts:
            t = folded(t)
            folds.append(t)
            found = _token.findall(t)
            sizes.append(len(found))
            tokens += [""] * _PADS + found
        tokens += [""] * _PADS
        number = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
        col = {c: np.frombuffer(v, np.uint64)[number] for c, v in lexicon.columns.items()}
        size, space = col["size"].astype(np.int64), col["space"].astype(np.int64)
        sizes = np.array(sizes, np.int64)
        at = np.cumsum(sizes + _PADS) - sizes
        ends = np.cumsum(size)
        base = np.concatenate([[0], ends])[at]  # where each text starts among all tokens' characters
        page = np.repeat(np.arange(len(texts)), sizes + _PADS)
        page = np.concatenate([page, np.full(_PADS, max(len(texts) - 1, 0))])
        start = ends - size + space
        flags = np.zeros(len(tokens) + 1, np.int64)
        for k, t in enumerate(folds):
            for bit, places in enumerate(formats(t)):
                for a, b in places:
                    i, j = np.searchsorted(start[at[k] : at[k] + sizes[k]], [a + base[k], b + base[k]]) + at[k]
                    flags[i:j] |= 1 << bit
        flags = flags[:-1].astype(np.uint64)
        x = self._features(col, flags)
        told = None
        if hidden:
            told = self._features({**col, "head": col["head"] * 0, "tail": col["tail"] * 0, "bits": col["bits"] & ~np.uint64(KNOWN)}, flags * 0)
        shift = base[page] if len(texts) else np.zeros(len(tokens), np.int64)
        return Pages(tokens, at, sizes, start - shift, ends - shift, col["bits"].astype(np.int64), x, told)

    @staticmethod
    def _features(col: dict[str, np.ndarray], flags: np.ndarray) -> np.ndarray:
        n = len(flags)

        def near(v: np.ndarray, d: int) -> np.ndarray:
            """v of the token d further on; pads keep texts apart."""
            out = np.zeros_like(v)
            if d > 0:
                out[: n - d] = v[d:]
            elif d < 0:
                out[-d:] = v[: n + d]
            else:
                return v
            return out

        bits, shape, seen, cue0, gap = col["bits"], col["shape"], col["seen"], col["cue"], col["gap"]
        has = lambda b, d=0: near(bits, d) & np.uint64(b) != 0
        cue = np.zeros(n, np.uint64)
        for d in range(6, 0, -1):
            c = near(cue0, -d)
            cue = np.where(c > 0, c, cue)
        any_of = lambda b, ds: np.logical_or.reduce([has(b, d) for d in ds]).astype(np.uint64)
        title, street, number = any_of(TITLE, range(-4, 0)), any_of(STREET, range(0, 4)), any_of(NUMBER, range(-4, 0))
        first = has(STOP, -1).astype(np.uint64) + np.uint64(2) * (gap == 2)
        common = bits & np.uint64(COMMON | CAPITAL)
        person = bits & np.uint64(KNOWN)
        pre, pre2, pre3, post, post2 = (near(seen, d) for d in (-1, -2, -3, 1, 2))
        rare = lambda d: near(bits, d) & np.uint64(COMMON | CAPITAL)
        kept = [
            (np.zeros(n, np.uint64),), (seen,), (shape,),
            (col["head"],), (col["tail"],), (person, near(person, -1), near(person, 1), shape),
            (pre,), (pre2, pre), (post,), (post, post2),
            (flags,), (flags, shape), (flags, cue), (flags, cue, shape), (flags, street, common, title),
            (common, shape), (common, title, shape), (common, street, number, shape), (pre, shape), (post, shape),
            (first, common, gap), (pre3, pre2, shape), (title, shape, pre), (near(shape, -1), shape, near(shape, 1)), (rare(-1), common, rare(1), first),
            (rare(-1), common, rare(1), pre2, near(shape, -1)), (cue, shape, near(shape, -1), near(shape, 1)), (street, number, near(shape, -1), shape, gap),
        ]
        out = np.empty((n, TEMPLATES), np.int32)
        with np.errstate(over="ignore"):
            for k, parts in enumerate(kept):
                h = np.full(n, k + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for p in parts:
                    h = (h ^ p) * np.uint64(0x7FB5D329728EA185)
                    h ^= h >> np.uint64(32)
                out[:, k] = (h >> np.uint64(20)) & np.uint64(SLOTS - 1)
        return out

    def unary(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(LABELS)), np.float32)
        for k in range(x.shape[1]):
            out += self.weights[x[:, k]]
        return out


def formats(t: str) -> list[list[tuple[int, int]]]:
    """Stretches of a folded text in each of FORMATS. All but the first hold digits, so they are sought around digits only."""
    out: list[list[tuple[int, int]]] = [[] for _ in FORMATS]
    if _may_hold_email(t):
        out[0] = [m.span() for m in _email.finditer(t)]
    windows: list[list[int]] = []
    for m in _near_digits.finditer(t):
        a, b = max(0, m.start() - 40), min(len(t), m.end() + 90)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    if windows:
        out[1] = phones(t)
        for a, b in windows:
            while b < len(t) and not t[b].isspace():
                b += 1
            out[2] += [m.span() for m in _id.finditer(t, a, b)]
            out[3] += [m.span(1) for m in _cued.finditer(t, a, b)]
            if _street.search(t, a, b):
                out[4] += [m.span() for m in _address.finditer(t, a, b)]
    return out


def far_labels(text: str, pages: Pages, k: int, people: set[str], no_names: set[str]) -> np.ndarray:
    """Labels at a distance for the tokens of text number k, -1 where unsure. no_names: uncommon words that the sample shows often enough, and never
    beside a title or a known person."""
    t = folded(text)
    marks = np.zeros(len(t) + 1, int)
    a0, n = pages.at[k], pages.sizes[k]
    words = [w.lstrip() for w in pages.tokens[a0 : a0 + n]]
    start = pages.start[a0 : a0 + n]

    def put(a: int, b: int, label: int) -> None:
        if not marks[a:b].any():
            marks[a:b] = label

    for m in _email.finditer(t):
        put(*m.span(), 1)
    for m in _cued.finditer(t):
        put(*m.span(1), 3)
    for m in _address.finditer(t):
        if re.search(r"\d", m[0]) and re.search(r"[A-Z][a-z]{3,}", m[0]):
            put(*m.span(), 4)
    for a, b in phones(t):
        before = re.findall(r"[a-z]+", t[max(0, a - 18) : a].lower())[-3:]
        stretch = t[a:b]
        if any(w in NOT_CUES for w in before):
            continue
        if any(w in PHONE_CUES for w in before) or stretch[0] in "+(" or re.search(r"[ .-]", stretch) and sum(map(str.isdigit, stretch)) >= 10:
            put(a, b, 2)
    for i, j in titled(words, pages.bits[a0 : a0 + n]):
        put(start[i], start[j - 1] + len(words[j - 1]), 5)
    labels = marks[start] if n else np.zeros(0, int)
    for i, j in full_names(words, people):
        if not labels[i:j].any():
            labels[i:j] = 5
    for i, w in enumerate(words):
        if not labels[i] and len(w) > 2 and w[0].isalpha():
            low = w.lower()
            if low in people or w[0].isupper() and not pages.bits[a0 + i] & COMMON and low not in no_names:
                labels[i] = -1
    # Initials and signs beside an unsure word are as unsure; commas and points between two parts of one stretch belong to it.
    for order, d in ((range(n - 2, -1, -1), 1), (range(1, n), -1)):
        for i in order:
            if labels[i] == 0 and labels[i + d] == -1 and (words[i] in ".," or len(words[i]) == 1 and words[i].isupper()):
                labels[i] = -1
    for i in range(1, n - 1):
        if labels[i] == 0 and labels[i - 1] == labels[i + 1] > 0 and words[i] in ",.-":
            labels[i] = labels[i - 1]
    return labels


def full_names(words: list[str], people: set[str]) -> list[tuple[int, int]]:
    """Runs of two or more known parts of names and initials with their points, at least one of them a part, as (first, behind the last) word."""
    found = []
    i = 0
    while i < len(words):
        j, parts, initials = i, 0, 0
        while j < len(words):
            w = words[j]
            if len(w) > 2 and w.lower() in people:
                parts += 1
            elif len(w) == 1 and w.isupper() and j + 1 < len(words) and words[j + 1] == ".":
                initials += 1
                j += 1
            elif not (w == "," and parts == 1 and not initials and j + 1 < len(words) and len(words[j + 1]) > 2 and words[j + 1].lower() in people):
                break
            j += 1
        if parts and parts + initials > 1:
            found.append((i, j))
        i = max(j, i + 1)
    return found


def titled(words: list[str], bits: np.ndarray) -> list[tuple[int, int]]:
    """Runs of capitalised uncommon words and initials that follow a title, as (first, behind the last) word. A run of initials alone is none."""
    found = []
    for i in np.flatnonzero(bits & TITLE):
        j = i + 1 + (i + 1 < len(words) and words[i + 1] == ".")
        a, full = j, False
        while j < len(words) and words[j][0].isupper() and not bits[j] & (COMMON | TITLE) and (len(words[j]) > 3 or len(words[j]) == 1):
            full |= len(words[j]) > 3
            j += 1
            if len(words[j - 1]) == 1 and j < len(words) and words[j] == ".":
                j += 1
        if full:
            found.append((a, j))
    return found


def words_by_case(text: str) -> list[str]:
    """A text's words as they stand. E-mail addresses say nothing of a word's case."""
    t = folded(text)
    return _letters.findall(_email.sub(" ", t) if _may_hold_email(t) else t)


def by_case(words: Counter[str]) -> tuple[Counter[str], Counter[str]]:
    """Counts of words in small letters and of capitalised ones, from counts of words as they stand."""
    small, capital = Counter(), Counter()
    for w, n in words.items():
        (capital if w[0].isupper() else small)[w.lower()] += n
    return small, capital


def is_common(small, capital):
    """Of two numbers or two columns."""
    return (small >= LEAST) & (small >= SMALL * (small + capital))


def common_words(documents: DataFrame, text: str) -> DataFrame:
    """(word): the common words of all documents, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            small, capital = by_case(raw)
            raw.clear()
            words = list(small.keys() | capital.keys())
            got = [pa.array(words, pa.string()), pa.array([small[w] for w in words], pa.int64()), pa.array([capital[w] for w in words], pa.int64())]
            return pa.RecordBatch.from_arrays(got, ["word", "small", "capital"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw.update(words_by_case(t or ""))
                if len(raw) > 200_000:
                    yield flush()
        yield flush()

    counts = documents.select(text).mapInArrow(run, "word string, small bigint, capital bigint").groupBy("word").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital"))
    return counts.where(is_common(F.col("small"), F.col("capital"))).select("word")


def fitted(sample: list[str], people: list[str], rounds: int = 6, common: frozenset[str] | None = None) -> Field:
    """The field of at most SAMPLE texts and the names of known people: all weights together by pseudo-likelihood, with AdaGrad.

    common: the common words of the corpus that hold the sample; where none are given, the sample is the corpus.
    """
    if common is None:
        small, capital = by_case(Counter(w for t in sample for w in words_by_case(t)))
        common = frozenset(w for w, n in small.items() if is_common(n, capital[w]))
    parts = {w.lower() for p in people for w in _letters.findall(folded(p)) if len(w) > 2}
    field = Field(known_words(common, parts))
    pages = field.pages(sample, hidden=True)
    names, seen = set(), Counter()
    for k in range(len(sample)):
        a, n = pages.at[k], pages.sizes[k]
        words = [w.lstrip() for w in pages.tokens[a : a + n]]
        for i, j in titled(words, pages.bits[a : a + n]):
            names.update(w.lower() for w in words[i:j] if len(w) > 3)
        for i, w in enumerate(words):
            if len(w) > 2 and w[0].isupper() and not pages.bits[a + i] & COMMON:
                seen[w.lower()] += 1
                if any(v.lower() in parts for v in words[max(0, i - 1) : i + 2] if v != w):
                    names.add(w.lower())
    no_names = {w for w, n in seen.items() if n >= LEAST and w not in names and w not in parts}
    marks = [far_labels(t, pages, k, parts, no_names) for k, t in enumerate(sample)]
    dice = random.Random(11)
    more = [made_over([*pages.tokens[pages.at[k] : pages.at[k] + pages.sizes[k]]], m.tolist(), dice) for k, m in enumerate(marks) for _ in range(int((m >= 4).any()) + int((m == 4).any()))]
    field.heard, field.lexicon = frozenset(no_names), None
    texts, marks = [*sample, *("".join(t) for t, _ in more)], [*marks, *(np.array(m) for _, m in more)]
    pages = field.pages(texts, hidden=True)
    y = np.full(len(pages.tokens), -1)
    for k, m in enumerate(marks):
        if len(m) == pages.sizes[k]:
            y[pages.at[k] : pages.at[k] + pages.sizes[k]] = m
    fit_weights(field, pages, y, rounds)
    field.lexicon = None
    return field


def made_over(tokens: list[str], labels: list[int], dice: random.Random) -> tuple[list[str], list[int]]:
    """A text with other names and places in its stretches, of letters by chance, some names in capitals, in small letters or with initials, and with some
    unknown words elsewhere; the labels go along. What is learned from it is what stands around a name or an address, and their form."""

    def word() -> str:
        return "".join(dice.choice("bcdfghjklmnprstvwyz") * dice.choice((1, 1, 0)) + dice.choice("aeiouy") + dice.choice(("", "", "n", "r", "l", "s", "m", "ng", "th")) for _ in range(dice.choice((1, 2, 2, 3))))

    out, marks, before = [], [], 0
    style, bare = dice.random(), dice.random() < 0.5  # without bare numbers of places
    same: dict[str, str] = {}
    for token, v in zip(tokens, labels):
        w = token.lstrip()
        space = token[: len(token) - len(w)]
        if v == 5 and len(w) > 2 and w.isalpha():
            if before != 5:
                style = dice.random()
                if style < 0.3 and (w[0].isupper() or style < 0.1):
                    for sign in (space + dice.choice("ABDGHKMNPRSTV"), "."):
                        out.append(sign), marks.append(5)
                    space = " "
            while len(new := same.setdefault(w, word())) < 2:
                del same[w]
            w = new.upper() if style > 0.8 else new if style > 0.7 or w[0].islower() else new.capitalize()
        elif v == 4 and len(w) > 2 and w[0].isupper() and w.isalpha() and dice.random() < 0.7:
            w = (word() + word()).capitalize()
        elif v == 4 and before == 4 and w.isdigit() and len(w) > 2 and bare:
            continue
        elif v == 0 and len(w) > 2 and w.isalpha() and w.isascii() and dice.random() < 0.06:
            w = word() + word() if w[0].islower() else (word() + word()).capitalize()
        out.append(space + w), marks.append(v)
        before = v
    # Somewhere a name comes again by itself, somewhere an unknown capitalised word that is none.
    said = [w.lstrip() for w, v in zip(out, marks) if v == 5 and len(w.lstrip()) > 4]
    free = [i for i, (w, v) in enumerate(zip(out, marks)) if v == 0 and w.startswith(" ") and len(w) > 4 and w[1:].isalpha() and w[1].islower() and w.isascii()]
    for new, v, share in ((dice.choice(said) if said else "", 5, 0.2), ((word() + word() + word()).capitalize(), 0, 0.6)):
        if new and free and dice.random() < share:
            i = free.pop(dice.randrange(len(free)))
            out[i], marks[i] = " " + new, v
    return out, marks


def _widened(hot: np.ndarray, far: int = AROUND) -> np.ndarray:
    """Which tokens are at most `far` from a hot one."""
    return np.convolve(hot, np.ones(2 * far + 1))[far : far + len(hot)] > 0.5


def fit_weights(field: Field, pages: Pages, y: np.ndarray, rounds: int) -> None:
    """Node, transition and skip weights by pseudo-likelihood. y: a label for each token of pages, -1 for tokens outside the fit."""
    n, dice = len(LABELS), np.random.default_rng(5)
    hot = (y > 0) | (pages.bits & (TITLE | NUMBER) != 0) | (pages.bits & CAPITAL != 0) & (pages.bits & COMMON == 0)
    hot = _widened(hot)
    keep = np.flatnonzero((y >= 0) & (hot | (dice.random(len(y)) < 0.1)))
    # Features that the sample shows once teach nothing; the others are numbered, 0 standing for the rest.
    own, where, times = np.unique(np.concatenate([pages.x[keep], pages.hidden[keep]]).ravel(), return_inverse=True, return_counts=True)
    number = np.where(times > 2, np.cumsum(times > 2), 0)
    where = number[where].reshape(2, len(keep), TEMPLATES)
    size = int((times > 2).sum()) + 1
    before, after = np.concatenate([[-1], y[:-1]])[keep], np.concatenate([y[1:], [-1]])[keep]
    pairs = np.array(skips(pages.tokens, np.arange(len(y)), pages), int).reshape(-1, 2)
    pairs = np.concatenate([pairs, pairs[:, ::-1]])
    beside = np.zeros((len(y), n))
    sure = y[pairs[:, 1]] >= 0
    np.add.at(beside, (pairs[sure, 0], y[pairs[sure, 1]]), 1.0)
    beside, y = beside[keep], y[keep]
    w, moves, skip = np.zeros((size, n)), np.zeros((n + 1, n + 1)), np.zeros((n, n))
    sums = [np.full(v.shape, 1e-8) for v in (w, moves, skip)]
    for r in range(rounds):
        for rows in np.array_split(dice.permutation(len(keep)), max(1, len(keep) // 4096)):
            x = where[(dice.random(len(rows)) < 0.5).astype(int), rows]
            alone = dice.random((3, len(rows))) < 0.5  # neighbours that are not told
            u, v, side = np.where(alone[0], -1, before[rows]), np.where(alone[1], -1, after[rows]), beside[rows] * alone[2][:, None]
            s = w[x].sum(1) + moves[u, :n] + moves[:n, v].T + side @ skip
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            flat = x.ravel()
            g = np.stack([np.bincount(flat, np.repeat(p[:, k], TEMPLATES), size) for k in range(n)], 1) + 1e-6 * w
            g[0] = 0
            m = np.zeros_like(moves)
            np.add.at(m, u, np.pad(p, ((0, 0), (0, 1))))
            np.add.at(m.T, v, np.pad(p, ((0, 0), (0, 1))))
            m[n], m[:, n] = 0, 0
            sums[0] += g * g
            w -= 0.3 * g / np.sqrt(sums[0])
            # The few pair weights would never recover from the large first gradients, so theirs fade.
            for value, grad, total in ((moves, m + 1e-5 * moves, sums[1]), (skip, side.T @ p + 1e-5 * skip, sums[2])):
                total *= 0.95
                total += 0.05 * grad * grad
                value -= 0.1 * (1 - r / rounds) * grad / np.sqrt(total)
    field.weights = np.zeros((SLOTS, n), np.float32)
    field.weights[own] = np.where((number > 0)[:, None], w[number], 0)
    field.moves, field.skip = moves[:n, :n].copy(), (skip + skip.T) / 2


def known_words(common: frozenset[str], people: frozenset[str] | set[str]) -> dict[str, int]:
    return {w: COMMON * (w in common) | KNOWN * (w in people) for w in common | people}


def skips(tokens: list[str], nodes: np.ndarray, pages: Pages) -> list[tuple[int, int]]:
    """Pairs of places in `nodes` that a skip edge joins: each occurrence of a capitalised word or long number with the next equal or nearly equal one of
    its text."""
    last: dict[tuple[int, str], int] = {}
    found = []
    picked = np.flatnonzero(pages.bits[nodes] & (CAPITAL | NUMBER))
    text = np.searchsorted(pages.at, nodes[picked], "right")
    for i, k in zip(picked.tolist(), text.tolist()):
        w = tokens[nodes[i]].lstrip()
        if len(w) > 4:
            key = (k, w.lower()[:5] + w.lower()[-2:])
            if key in last:
                found.append((last[key], i))
            last[key] = i
    return found


def labelled(pages: Pages, field: Field) -> np.ndarray:
    """The most probable label of each token of some pages, by loopy sum-product on all their nodes at once."""
    unary = field.unary(pages.x).astype(np.float64)
    out = np.zeros(len(unary), int)
    inside = np.zeros(len(unary), bool)
    for a, m in zip(pages.at, pages.sizes):
        inside[a : a + m] = True
    top = unary.max(1, keepdims=True)
    none = np.exp(unary[:, 0] - top[:, 0]) / np.exp(unary - top).sum(1)
    hot = inside & (none < 1 - OPEN)
    nodes = np.flatnonzero(_widened(hot) & inside)
    if not len(nodes):
        return out
    unary, n, kinds = unary[nodes], len(nodes), len(LABELS)
    chain = np.flatnonzero(np.diff(nodes) == 1)
    s = np.array(skips(pages.tokens, nodes, pages), int).reshape(-1, 2)
    a, b = np.concatenate([chain, s[:, 0]]), np.concatenate([chain + 1, s[:, 1]])
    pair = np.concatenate([np.repeat(field.moves[None], len(chain), 0), np.repeat(field.skip[None], len(s), 0)])
    ahead, back = np.zeros((len(a), kinds)), np.zeros((len(a), kinds))  # messages to b and to a

    def belief() -> np.ndarray:
        got = unary.copy()
        for k in range(kinds):
            got[:, k] += np.bincount(b, ahead[:, k], n) + np.bincount(a, back[:, k], n)
        return got

    def passed(m: np.ndarray, pair: np.ndarray) -> np.ndarray:
        top = m.max(1, keepdims=True)
        got = np.log(np.einsum("ij,ijk->ik", np.exp(m - top), pair)) + top
        return got - got.max(1, keepdims=True)

    forth = np.exp(pair)
    to = forth.transpose(0, 2, 1)
    for _ in range(ROUNDS if len(a) else 0):
        now = belief()
        to_b, to_a = passed(now[a] - back, forth), passed(now[b] - ahead, to)
        ahead, back = 0.5 * ahead + 0.5 * to_b, 0.5 * back + 0.5 * to_a
    out[nodes] = belief().argmax(1)
    return out


def _holds(kind: str, stretch: str) -> bool:
    """The check of form."""
    digits = sum(map(str.isdigit, stretch))
    if kind == "email":
        return bool(_email.search(stretch))
    if kind == "phone":
        return 9 <= digits <= 18
    if kind == "id_number":
        return digits >= 4 and sum(map(str.isalnum, stretch)) >= 7
    if kind == "address":
        return digits > 0 and bool(re.search(r"[^\W\d_]{3,}", stretch))
    return any(w.lower() not in TITLES for w in re.findall(r"[^\W\d_]{2,}", stretch))


def stretches(text: str, pages: Pages, k: int, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is personal in text number k: runs of one label, with what may stand between two runs of a kind on one stretch."""
    found: list[list] = []
    at, n = pages.at[k], pages.sizes[k]
    marked = np.flatnonzero(labels[at : at + n]) + at
    if not len(marked):
        return []
    t = folded(text)
    for i in marked:
        v, a, b = int(labels[i]), int(pages.start[i]), int(pages.end[i])
        if found and found[-1][2] == v and re.fullmatch(r"[\s,.\-/()#:]{0,4}", t[found[-1][1] : a]):
            found[-1][1] = b
        else:
            found.append([a, b, v])
    out = []
    for a, b, v in found:
        stretch = t[a:b].rstrip(" ,.:;-")
        if _holds(LABELS[v], stretch):
            out.append((a, a + len(stretch), LABELS[v]))
    return out


def found_in(documents: DataFrame, people: DataFrame, id: str = "doc_id", text: str = "text", name: str = "full_name") -> DataFrame:
    """(id, text, found): each row with its stretches (start, end, kind), offsets in characters of the stored text.

    people may be of any size: what is gathered of it are the names of which the sample holds a part, and its words are given to every task only together
    with the common words and up to WORDS in all; beyond that both are joined.
    """
    spark = documents.sparkSession
    short = documents.where(F.char_length(text) <= LONG)
    sample = [r[0] for r in short.select(text, F.xxhash64(id).alias("h")).orderBy("h", text).limit(SAMPLE).collect()]
    room = np.searchsorted(np.cumsum([len(t) for t in sample]), SAMPLE_CHARACTERS, "right") if sample else 0
    sample = sample[:room]
    words_of = F.udf(lambda t: sorted({w.lower() for w in _letters.findall(folded(t)) if len(w) > 2}), "array<string>")
    parts = people.where(F.col(name).isNotNull()).select(F.explode(words_of(name)).alias("word")).distinct()
    lexicon = common_words(documents, text).select("word", F.lit(COMMON).alias("bits")).unionByName(parts.select("word", F.lit(KNOWN).alias("bits")))
    lexicon = staged(lexicon.groupBy("word").agg(F.sum("bits").cast("int").alias("bits")))
    few, used = lexicon.count() <= WORDS, lexicon
    if not few:
        used = lexicon.join(spark.createDataFrame([(w,) for w in {w.lower() for t in sample for w in _letters.findall(folded(t))}], "word string"), "word", "left_semi")
    known = {r.word: r.bits for r in used.collect()}
    fit = fitted(sample, [w for w, b in known.items() if b & KNOWN], common=frozenset(w for w, b in known.items() if b & COMMON))
    if not few:
        fit.known = {}
    field = spark.sparkContext.broadcast(fit)

    def spans_of(texts: list[str | None], model: Field) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        found: list[list[dict]] = []
        ends = np.cumsum([len(t or "") + 1000 for t in texts])  # a text counts 1,000 characters at least
        while len(found) < len(texts):
            first = len(found)
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PART, "right")))
            part = [t or "" for t in texts[first:last]]
            pages = model.pages(part)
            labels = labelled(pages, model)
            for k, t in enumerate(part):
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in stretches(t, pages, k, labels)])
        return pa.array(found, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans_of(batch.column(1).to_pylist(), field.value)], ["id", "text", "found"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pairs = list({(c, w.lower()) for c, t in zip(chunks, texts) for w in _letters.findall(folded(t or ""))})
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())], ["chunk", "word"])

    def joined(rows: pa.Table, known: pa.Table) -> pa.Table:
        model = replace(field.value, known=dict(zip(known.column("word").to_pylist(), known.column("bits").to_pylist())), lexicon=None)
        return pa.table({"id": rows.column("id"), "text": rows.column("text"), "found": spans_of(rows.column("text").to_pylist(), model)})

    kind = documents.schema[id].dataType.simpleString()
    schema = f"id {kind}, text string, found array<struct<start:int,end:int,kind:string>>"
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    if few:
        return rows.mapInArrow(run, schema)
    # Row numbers start at multiples of 2^33 in each partition, so a chunk is a stretch of one partition.
    rows = staged(rows.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1)))
    held = rows.select("chunk", "text").mapInArrow(words, "chunk bigint, word string").distinct().join(lexicon, "word")
    return rows.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(joined, schema)


def redacted(found: DataFrame) -> DataFrame:
    """(id, text, kinds): texts with each stretch replaced by its kind in brackets, e.g. [PHONE]; all else unchanged. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                for s in reversed(spans or []):
                    t = t[: s["start"]] + f"[{s['kind'].upper()}]" + t[s["end"] :]
                out.append(t)
            kinds = [sorted({s["kind"] for s in spans or []}) for spans in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["id", "text", "kinds"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, text string, kinds array<string>")
