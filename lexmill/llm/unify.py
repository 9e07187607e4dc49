"""Problem 4: text that looks the same, brought to one form.

Two layers:

* *characters* (`base_form`): canonical composition, full-width, mathematical and ligature
  letters, single odd spaces, hyphen twins and invisible characters. Needs no corpus.
* *scripts* (`unified`): a token that holds letters of more than one script, or that consists
  of look-alikes only, is rewritten to one script when the result is a word of the corpus.
  The dominant script of the token is tried first. A result that no plain word of the corpus
  confirms still counts when two or more records hold a token of that look.

What a reader can see (accents, case, superscripts, runs of spaces, line breaks) stays. Nulls stay
null; empty and blank texts come out as they are, apart from odd spaces.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

from .expand import member_pairs

# Letters of other scripts and the Latin letter each looks like.
CYRILLIC_LOOKS = dict(zip("асԁеһіјӏорԛѕѵԝхуАВСЕНІЈКМОРЅТХҮ", "acdehijlopqsvwxyABCEHIJKMOPSTXY"))
GREEK_LOOKS = dict(zip("ινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ivopuABEZHIKMNOPTYX"))
LATIN_LOOKS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "L"}
JOINERS = "\u200c\u200d\ufe0f"
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-"}
LOOKS = CYRILLIC_LOOKS | GREEK_LOOKS | LATIN_LOOKS
BACK = {"CYRILLIC": {v: k for k, v in CYRILLIC_LOOKS.items()}, "GREEK": {v: k for k, v in GREEK_LOOKS.items()}}

#: A text in which this finds nothing is in base form already: ASCII without control characters, composed Latin letters, dandas.
ODD = re.compile(r"[^\t\n\x20-\x7e¡-¬®-İĲ-ſḀ-ỿ।॥–—‘-•]")
#: A letter from which a token may need a decision on its script.
FOREIGN = re.compile("[" + "".join(LOOKS) + "]")
TOKEN = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*")
PLAIN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>")


@lru_cache(65536)
def _plain(ch: str) -> str:
    """What one character is written as; empty for invisible ones."""
    if ch in HYPHENS:
        return HYPHENS[ch]
    kind = ud.category(ch)
    if kind == "Zs":
        return " "
    if kind == "Cf" or kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x85" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return ""
    parts = ud.decomposition(ch).split()
    if parts and (parts[0] in PLAIN_TAGS or parts[0] == "<compat>" and ud.category(ch) in ("Ll", "Lu", "Lt")):
        return ud.normalize("NFKC", ch)
    return ch


def _joins(text: str, at: int) -> bool:
    """Whether the joiner at this place shapes letters of a script that needs it, or an emoji."""
    near = text[max(0, at - 1) : at] + text[at + 1 : at + 2]
    return text[at] in JOINERS and any(ord(c) > 0x8FF and ud.category(c) in ("Lo", "Mn", "Mc", "So") for c in near)


def base_form(text: str | None) -> str | None:
    """The character layer. Returns the same object for texts that need nothing."""
    if not text or (text.isascii() and text.replace("\n", " ").replace("\t", " ").isprintable()) or not ODD.search(text):  # most texts are plain, and the first test is fast
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    odd = {c: _plain(c) for c in set(ODD.findall(text))}
    if any(c in odd for c in JOINERS):
        text = "".join(c if c not in odd or _joins(text, i) else odd[c] for i, c in enumerate(text))
    else:
        for c, p in odd.items():
            if p != c:
                text = text.replace(c, p)
    return ud.normalize("NFC", text)


@lru_cache(65536)
def _script(ch: str) -> str:
    return ud.name(ch, "OTHER").split(" ")[0]


@lru_cache(65536)
def writings(token: str) -> tuple[str, ...]:
    """The one-script writings that look like a token, that of its dominant script first; none if it needs no decision.

    Ties between scripts go to Latin. A token of one foreign script is in question only if every letter of it looks Latin.
    """
    letters = [c for c in ud.normalize("NFD", token) if c.isalpha()]
    counts = Counter(_script(c) for c in letters)
    if len(counts) < 2 and not (letters and all(c in LOOKS for c in letters)):
        return ()
    found = []
    for script in sorted(counts | {"LATIN": counts["LATIN"]}, key=lambda s: (-counts[s], s != "LATIN")):
        swap = LOOKS if script == "LATIN" else BACK.get(script, {})
        out = "".join(swap.get(c, c) for c in ud.normalize("NFD", token))
        if all(_script(c) == script for c in out if c.isalpha()):
            found.append(ud.normalize("NFC", out))
    return tuple(dict.fromkeys(found))


def questions(text: str) -> list[str]:
    """Distinct tokens of a text in base form whose script is in question."""
    if text.isascii() or not FOREIGN.search(text):
        return []
    return sorted({t for t in TOKEN.findall(text) if FOREIGN.search(t) and writings(t)})


def rewritten(text: str, answers: dict[str, str]) -> str:
    """The text with each token of `answers` replaced, whole tokens only."""
    return ud.normalize("NFC", TOKEN.sub(lambda m: answers.get(m[0], m[0]), text)) if answers else text


def looks_latin(text: str | None) -> str | None:
    """Base form, with every token in question in its Latin writing. For matching only: needs no vocabulary."""
    text = base_form(text)
    if not text or text.isascii() or not FOREIGN.search(text):
        return text
    return TOKEN.sub(lambda m: next((w for w in writings(m[0]) if not FOREIGN.search(w)), m[0]), text)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every distinct lower-cased run of letters over all texts, after the character layer.

    Each Arrow batch is counted before the shuffle, so hot words cost one row a batch. Nulls count nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\W\d_]+")
        total: Counter[str] = Counter()
        raw: Counter[str] = Counter()  # tokens as they stand; words are sought once in each distinct token

        def out() -> pa.RecordBatch:
            for token, n in raw.items():
                for w in word.findall(token.lower()):
                    total[w] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    raw.update(base_form(t).split())
            if len(raw) > 200_000:
                yield out()
                total.clear()
        yield out()

    parts = texts.select(F.col(text)).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def scanned(texts: DataFrame, id: str, text: str, keep_all: bool) -> DataFrame:
    """(id, raw, form, body, asks): hashes of the stored text and of its base form, the base form itself, the tokens in question.

    body is left out (null) where nothing is in question and keep_all is off: those texts need no more than their hash.
    """
    import hashlib

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            ids, raw, form, body, asks = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None and not keep_all or t is not None and not t.strip() and not keep_all:
                    continue
                b = base_form(t)
                a = questions(b) if b else []
                ids.append(i), raw.append(None if t is None else digest(t)), form.append(None if b is None else digest(b))
                body.append(b if a or keep_all else None), asks.append(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(raw, pa.binary()), pa.array(form, pa.binary()), pa.array(body, pa.string()), pa.array(asks, pa.list_(pa.string()))],
                ["id", "raw", "form", "body", "asks"],
            )

    kind = texts.schema[id].dataType.simpleString()
    return texts.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(scan, f"id {kind}, raw binary, form binary, body string, asks array<string>")


def answers(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, writing): the tokens that are rewritten. asked: (id, asks). vocabulary: (word, n) over the same texts.

    A writing holds if its lower-cased form is a word of the corpus; of several the most frequent is taken, as whole words in a foreign
    script may be disguised too, and on a tie the one in the token's dominant script. A token without one takes its Latin writing if at least two records hold tokens of that look (then the look itself is a word of the corpus).
    """

    @F.udf("array<string>")
    def ways(token: str) -> list[str]:
        return list(writings(token))

    tokens = asked.select("id", F.explode("asks").alias("token")).groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    tried = tokens.select("token", "a", "b", F.posexplode(ways("token")).alias("rank", "writing"), F.size(ways("token")).alias("ways"))
    tried = tried.withColumn("word", F.lower("writing")).join(vocabulary.select("word", "n"), "word", "left")
    # The token itself stands in the vocabulary as well, so a one-script token must lose to a more frequent word.
    own = vocabulary.select(F.col("word").alias("own"), F.col("n").alias("own_n"))
    tried = tried.withColumn("own", F.lower("token")).join(own, "own", "left").where((F.lower("token") != F.col("word")) | (F.col("ways") > 1))
    known = tried.where((F.col("n") > F.coalesce("own_n", F.lit(0))) | (F.col("n").isNotNull() & (F.col("own") != F.col("word"))))
    known = known.groupBy("token").agg(F.max_by("writing", F.struct("n", -F.col("rank"))).alias("writing"))
    shared = tried.where(~F.col("writing").rlike(FOREIGN.pattern)).groupBy("writing").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("token").alias("tokens"))
    shared = shared.where(F.col("a") != F.col("b")).select(F.explode("tokens").alias("token"), F.col("writing").alias("spare"))
    both = known.join(shared, "token", "full_outer")
    return both.select("token", F.coalesce("writing", "spare").alias("writing")).where(F.col("token") != F.col("writing"))


def unified(texts: DataFrame, id: str = "chunk_id", text: str = "text", keep_all: bool = True) -> DataFrame:
    """(id, raw, form, body): every row of `texts` in one form; raw and form are 128-bit hashes of the stored and of the unified text.

    Only texts with a token in question are shuffled; the others pass in one narrow stage. keep_all=False leaves out null and blank texts
    and the bodies of texts in which nothing was in question. Ids may repeat (re-appended rows): each row is treated alike.
    """
    import hashlib

    seen = scanned(texts, id, text, keep_all)
    asked = staged(seen.where(F.size("asks") > 0))
    chosen = answers(asked, word_counts(texts, text))
    # A re-appended row has equal text, so answers keyed by the hash of the base form serve every copy once.
    pairs = asked.select("form", "asks").dropDuplicates(["form"]).select("form", F.explode("asks").alias("token")).join(chosen, "token")
    per_text = pairs.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("token", "writing"))).alias("answers"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [rewritten(b, dict(a or [])) for b, a in zip(batch.column("body").to_pylist(), batch.column("answers").to_pylist())]
            form = [hashlib.blake2b(b.encode("utf-8", "surrogatepass"), digest_size=16).digest() for b in body]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(form, pa.binary()), pa.array(body, pa.string())], ["id", "raw", "form", "body"])

    kind = texts.schema[id].dataType.simpleString()
    done = asked.join(per_text, "form", "left").select("id", "raw", "body", "answers").mapInArrow(apply, f"id {kind}, raw binary, form binary, body string")
    return seen.where(F.size("asks") == 0).select("id", "raw", "form", "body").unionByName(done)


def look_classes(texts: DataFrame, id: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, form, raw, cls) of each id whose text shares its look with a text stored otherwise, and pairs (a, b) of the classes of one
    form that are stored differently, a < b. A class is one stored text (cls = raw). Null and blank texts are in none.

    The repaired rows are staged once; what is shuffled afterwards are ids and hashes, never texts.
    """
    rows = staged(unified(texts, id, text, keep_all=False).select("id", "raw", "form").dropDuplicates(["id"]))
    mixed = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    members = staged(rows.join(mixed, "form", "left_semi").withColumn("cls", F.col("raw")))
    classes = members.select("form", F.col("raw").alias("a")).distinct()
    links = classes.join(classes.select("form", F.col("a").alias("b")), "form").where("a < b").select("a", "b")
    return members, links


def same_look(texts: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id_a, id_b): pairs of ids whose texts differ as stored and are equal in one form; the smaller id first.

    Classes of different stored texts are paired, then expanded block by block, so a text that a third of all records share is in no single task.
    """
    members, links = look_classes(texts, id, text)
    return member_pairs(members.select("id", "cls"), links, within=False)


def look_groups(texts: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id, form, raw, n_stored): each id of a look that is stored in several ways, with its look, its stored text (128-bit hashes) and the number of
    different stored texts of that look; n_stored - 1 is the number of links of its class."""
    members, _ = look_classes(texts, id, text)
    stored = members.select("form", "raw").distinct().groupBy("form").agg(F.count("*").alias("n_stored"))
    return members.select("id", "form", "raw").join(stored, "form").select("id", F.lower(F.hex("form")).alias("form"), F.lower(F.hex("raw")).alias("raw"), "n_stored")
