"""Problem 5: records whose texts are nearly the same, found by order min-hashing and verified by banded alignment.

Similarity of two texts: distinct sequences of SHINGLE consecutive words in both over those in either. Texts of equal words are one *class* (a 128-bit
hash of the words); everything but the last expansion works on classes, so a group of copies of any size costs one row a copy.

1. *Sketch*: every k-mer of words is labelled with its occurrence number; for each of several hash functions the ORDER least k-mers are taken
   and put in the order in which they stand in the text; their hash is the sketch. Sketches agree with a probability that falls with edits
   and with reordering. Texts that repeat themselves also get the sketches of their k-mers without repeats, so that they meet texts that say the same
   once. Texts of at most TINY words also get plain sketches of shingles, as few of their k-mers survive an edit.
2. *Candidates*: classes that share `agree` sketches (AGREE unless given; 1 takes every pair that shares any). Buckets of more than CROWD classes are
   not paired as they are as long as they hold fewer than `agree` sketches: their members meet again in buckets of one sketch more, so that a crowd
   makes only pairs that agree often enough, and those block by block. Keys so hot that a sample shows them never enter one task as a whole.
3. *Verification*: a longest common subsequence of both texts' shingles within a band bounds the similarity from below: what is aligned is shared.
   Only pairs that this leaves open (blocks of text moved, repeats) have their sets compared. Pairs with equal words are similar by definition.

Null and blank texts, and texts without any word, are in no pair. Repeated ids count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

from .expand import member_pairs

SHINGLE, KMER, ORDER, SKETCHES = 3, 5, 2, 32
#: Of two similar texts (0.6) the shorter of which has at most 30 words the longer has fewer than 50, so both have the plain sketches.
TINY, TINY_SKETCHES = 50, 20
#: Sketches that a pair must share, and the most classes of a bucket whose pairs are made as they are.
AGREE, CROWD = 3, 128
#: Classes of which one in SHARE is looked at for hot keys; a key in HOT of those is hot (some 262,000 classes hold it).
SHARE, HOT = 64, 4096
#: Share of k-mers that are repeats from which a text is also sketched without them.
REPEATS = 0.1

#: Texts sketched at once; the k-mers of many more don't stay in a processor's memory.
FEW_TEXTS = 2500
#: The most classes (24 bytes each) that every task may be given.
FEW = 1_000_000

_word = re.compile(r"[^\W_]+")
_mark = re.compile(r"[^\x00-\x7f\w]")
_blanks = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_odd = np.random.default_rng(11).integers(1, 2**63, SKETCHES + TINY_SKETCHES, dtype=np.uint64) | np.uint64(1)


_places = np.random.default_rng(13).integers(1, 2**63, max(KMER, SHINGLE), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _blanked(text: str) -> bytes:
    """The text in small letters, as UTF-8: everything that is no letter or digit becomes a blank."""
    text = text.lower()
    if not text.isascii():
        marks = set(_mark.findall(text))
        if len(marks) > 16:
            text = text.translate(dict.fromkeys(map(ord, marks), " "))
        else:  # each is found much faster than letters are looked up one by one
            for mark in marks:
                text = text.replace(mark, " ")
    return text.encode("utf-8", "replace").translate(_blanks)


def words_of(text: str) -> list[bytes]:
    """What `_word` finds in the text in small letters."""
    return _blanked(text).split()


def _grams(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each k-mer, its text, first k-mer of each text) for texts laid end to end; texts shorter than k have none."""
    n = np.maximum(sizes - k + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    at = np.arange(len(text)) - first[text] + starts[text]
    h = np.zeros(len(text), np.uint64)
    for j in range(k):
        h += words[at + j] * _places[j]
    return _mix(_mix(h)), text, first


def _labelled(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with the number of the occurrence within the text mixed in, which k-mers are repeats)."""
    key = h ^ _mix(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    repeat = np.zeros(len(h), bool)
    if not len(again):
        return h, repeat
    rows = np.flatnonzero(pc.is_in(pa.array(key), value_set=pa.array(again)).to_numpy(zero_copy_only=False))  # the few k-mers that occur again in their text
    rows = rows[np.argsort(key[rows], kind="stable")]
    same = np.concatenate([[False], key[rows][1:] == key[rows][:-1]])
    run = np.arange(len(rows)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
    out = h.copy()
    out[rows] = np.where(run > 0, _mix(h[rows] + run.astype(np.uint64)), h[rows])
    repeat[rows] = run > 0
    return out, repeat


def _sketches(h: np.ndarray, text: np.ndarray, first: np.ndarray, odd: np.ndarray, order: int) -> np.ndarray:
    """One row per text that has `order` k-mers or more: for each function the hash of its least k-mers, in text order; for texts that lay end to end.

    The high half of a product is the value, the low half the k-mer's place, so one minimum gives both; places also break ties.
    """
    out = np.empty((len(first), len(odd)), np.uint64)
    high, low, none = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(2**64 - 1)
    place = np.arange(len(h), dtype=np.uint64)
    x = np.empty_like(h)
    for j, a in enumerate(odd):
        np.multiply(h, a, out=x)
        np.bitwise_and(x, high, out=x)
        np.bitwise_or(x, place, out=x)
        spots = []
        for r in range(order):
            spots.append((np.minimum.reduceat(x, first) & low).astype(np.int64))
            if r + 1 < order:
                x[spots[-1]] = none
        s = np.full(len(first), j + 1, np.uint64)
        for one in np.sort(np.array(spots), axis=0):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[one])
        out[:, j] = s
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of n texts, of 32 bits a sketch; `rows` (each text up to twice) are the texts of the rows of `values`."""
    sizes = np.zeros(n + 1, np.int32)
    np.add.at(sizes, rows + 1, values.shape[1])
    values = values[np.argsort(rows, kind="stable")]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel(), pa.int32()))


def _text_sketches(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, k: int, order: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, their sketches): those of labelled k-mers of all `rows`, then those without repeats of the rows that repeat themselves."""
    if not len(rows):
        return rows, np.zeros((0, len(odd)), np.uint64)
    h, text, first = _grams(words, starts[rows], sizes[rows], k)
    labelled, repeat = _labelled(h, text)
    found = _sketches(labelled, text, first, odd, order)
    n = np.bincount(text, minlength=len(rows))
    again = np.bincount(text[repeat], minlength=len(rows))
    more = (again > REPEATS * n) & (n - again >= order)
    if not more.any():
        return rows, found
    keep = ~repeat & more[text]
    once = np.cumsum(more) - 1
    h, text = h[keep], once[text[keep]]
    return np.concatenate([rows, rows[more]]), np.concatenate([found, _sketches(h, text, np.searchsorted(text, np.arange(text[-1] + 1)), odd, order)])


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, body, ...) as batches of (id, cls, words, sketches, tiny)."""
    known = _Hashes()
    for batch in (whole.slice(at, FEW_TEXTS) for whole in batches for at in range(0, whole.num_rows, FEW_TEXTS)):
        ids, plain = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t and (one := _blanked(t).strip()):
                ids.append(i), plain.append(one)
        lists = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).view(pa.string()))  # nothing but blanks is left to split at
        said, flat = pc.binary_join(lists, " "), lists.flatten().dictionary_encode()
        cls = [xxhash.xxh3_128_digest(x) for x in said.view(pa.binary()).to_pylist()]
        hashes = np.fromiter(map(known.__getitem__, flat.dictionary.view(pa.binary()).to_pylist()), np.uint64)  # each distinct word is looked up once
        words, sizes = hashes[flat.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)
        if len(known) > 500_000:
            known.clear()
        starts = np.cumsum(sizes) - sizes
        found = []
        for pick, k, order, odd in ((sizes >= KMER + ORDER - 1, KMER, ORDER, _odd[:SKETCHES]), ((sizes >= SHINGLE) & (sizes <= TINY), SHINGLE, 1, _odd[SKETCHES:])):
            found.append(_lists(*_text_sketches(words, starts, sizes, np.flatnonzero(pick), k, order, odd), len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(cls, pa.binary()), said, *found], ["id", "cls", "words", "sketches", "tiny"])


def sketch_schema(kind: str) -> str:
    return f"id {kind}, cls binary, words string, sketches array<int>, tiny array<int>"


def sketched(texts: DataFrame, id: str = "id", body: str = "body") -> DataFrame:
    """(id, cls, words, sketches, tiny): class, words (a string, blank between) and 32-bit sketches of each text with a word. cls is a 128-bit hash of the
    words."""
    return texts.select(id, body).mapInArrow(sketch, sketch_schema(texts.schema[id].dataType.simpleString()))


def _buckets(classes: DataFrame) -> F.Column:
    """The buckets of a class, each once: the number of the hash function above the 32 bits of its sketch."""

    def keys(name: str, base: int, functions: int) -> F.Column:
        return F.transform(name, lambda h, i: F.shiftleft((i % functions + base).cast("bigint"), 32).bitwiseOR(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))

    return F.array_distinct(F.concat(keys("sketches", 0, SKETCHES), keys("tiny", SKETCHES, TINY_SKETCHES)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (c, sketches, tiny) as (c, bucket) of every bucket of each class: what `_buckets` gives, exploded."""
    for batch in batches:
        classes, found = batch.column("c").to_numpy(), []
        for name, base, functions in (("sketches", 0, SKETCHES), ("tiny", SKETCHES, TINY_SKETCHES)):
            lists = batch.column(name)
            sizes, values = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = (place % functions + base) << 32 | values.view(np.uint32).astype(np.int64)
            once = np.ones(len(key), bool)  # a text has at most two sketches of a function
            once[functions:] = (place[functions:] < functions) | (key[functions:] != key[:-functions])
            found.append((np.repeat(classes, sizes)[once], key[once]))
        yield tuple(map(np.concatenate, zip(*found)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cls, key in _keys(batches):
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(key)], ["c", "key"])


def _dealt(lots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, all of a batch that fall into one of `lots` lots by their bucket packed into one row (lot, cs, keys), 16 bytes each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, key in _keys(batches):
            lot = (_mix(key.view(np.uint64)) % np.uint64(lots)).astype(np.min_scalar_type(lots))
            order, ends = np.argsort(lot, kind="stable"), np.cumsum(np.bincount(lot, minlength=lots))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            offsets = pa.py_buffer(np.concatenate([[0], 8 * ends[some]]).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(x[order])]) for x in (cls, key)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], ["lot", "cs", "keys"])

    return deal


def _paired_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_paired` of the packed rows of a lot."""
    numbers = lambda packed: pa.array(np.frombuffer(b"".join(packed.to_pylist()), np.int64))
    yield from _paired(pa.RecordBatch.from_arrays([numbers(b.column("cs")), numbers(b.column("keys"))], ["c", "key"]) for b in batches)


_PAIRED = "a bigint, b bigint, key bigint"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (c, key): pairs (a, b, null) of the classes of each bucket of up to CROWD classes; the members of larger ones as (c, null, key). A
    partition holds whole buckets; it is sorted by bucket and paired at growing distances, all buckets at once."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    cls, key = (np.concatenate(c) for c in zip(*got))
    order = np.argsort(key, kind="stable")
    cls, key = cls[order], key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.repeat(np.diff(edges), np.diff(edges))

    def rows(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            part = a[at : at + 100_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), none if b is None else pa.array(b[at : at + 100_000]), none if key is None else pa.array(key[at : at + 100_000])], ["a", "b", "key"])

    big = size > CROWD
    yield from rows(cls[big], None, key[big])
    few = (size > 1) & ~big
    cls, key = cls[few], key[few]
    for d in range(1, CROWD):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        x, y = cls[:-d][same], cls[d:][same]
        yield from rows(np.minimum(x, y), np.maximum(x, y), None)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the classes of each bucket of (c, key), each pair of blocks of a large bucket by itself."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(8 * CROWD)).cast("int").alias("n"))
    dealt = staged(rows.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("c"), F.col("n")).cast("int")))
    left = dealt.select("key", F.col("c").alias("a"), "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    right = dealt.select("key", F.col("c").alias("b"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return left.join(right, ["key", "i", "j"]).where("a < b").select("a", "b")


def candidates(classes: DataFrame, agree: int = AGREE) -> DataFrame:
    """(a, b): pairs of classes, a < b, that share `agree` sketches or more. classes: (c, sketches, tiny), staged, one row a class, c its number.

    Sketches are shuffled once, 16 bytes each, packed by the task that pairs them. A bucket of level n holds the classes that share n given sketches. A
    pair that shares s sketches, some of them crowded at level 1, shares at least s - 1 buckets of level 2 (one crowded sketch with each of the others),
    and so on; at level `agree` every bucket is paired. Crowded buckets are told to every task as long as they have few members.
    """
    spark = classes.sparkSession
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    classes = classes.select("c", "sketches", "tiny")
    exploded = lambda own: own.mapInArrow(_rows, "c bigint, key bigint")
    rows, waiting = None, None
    if classes.count() >= SHARE * HOT:  # else no key can be as hot
        seen = exploded(classes.where(F.pmod(F.xxhash64("c"), F.lit(SHARE)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
        hot = staged(seen.where(F.col("n") >= HOT).select("key"), 1)
        if not hot.isEmpty():
            waiting = exploded(classes).join(hot, "key", "left_semi")
            rows = exploded(classes).join(hot, "key", "left_anti").select("c", "key")
    pairs = None
    for level in range(1, agree + 1):
        if rows is None:
            met = classes.mapInArrow(_dealt(lots), "lot int, cs binary, keys binary").repartitionById(lots, "lot").mapInArrow(_paired_lots, _PAIRED)
        else:
            met = rows.repartition("key").mapInArrow(_paired, _PAIRED)
        found = staged(met)
        got = found.where("b is not null").select("a", "b")
        if level < agree:
            got = got.groupBy("a", "b").agg(F.count("*").alias("v")).where(F.col("v") >= agree - level + 1).select("a", "b")
        crowded = found.where("b is null").select(F.col("a").alias("c"), "key")
        if waiting is None:
            members = crowded.count()
            told = F.broadcast if members <= FEW else lambda df: df
        else:
            crowded, members, told = crowded.unionByName(waiting.select("c", "key")), 1, lambda df: df
        waiting = None
        pairs = got if pairs is None else pairs.unionByName(got)
        if not members:
            break
        if level == agree:
            pairs = pairs.unionByName(_in_blocks(crowded))
            break
        # Each crowded bucket with every other sketch of its members; a set of sketches has one key, whichever of them was crowded first.
        if level == 1:
            more = crowded.groupBy("c").agg(F.collect_set("key").alias("held"))
            wide = classes.join(told(more), "c").select("c", "held", _buckets(classes).alias("keys"))
            both = wide.select("c", F.explode("held").alias("x"), "keys").select("c", "x", F.explode("keys").alias("y")).where("x <> y")
            sets = both.select("c", F.array_sort(F.array("x", "y")).alias("set"))
        else:
            more = sets.join(told(crowded), ["c", "key"]).select("c", "set")
            wide = classes.join(told(more), "c").select("c", "set", _buckets(classes).alias("keys"))
            both = wide.select("c", "set", F.explode("keys").alias("y")).where(~F.array_contains("set", F.col("y")))
            sets = both.select("c", F.array_sort(F.concat("set", F.array("y"))).alias("set"))
        sets = staged(sets.select("c", F.xxhash64("set").alias("key"), "set").dropDuplicates(["c", "key"]))
        rows = sets.select("c", "key")
    return pairs.distinct()


def banded_common(a: list, b: list, band: int) -> tuple[int, int, int]:
    """(length of a common subsequence of two lists found within a band around the diagonal, distinct elements of a, elements of b that a holds): a
    bit-parallel alignment, one step an element of b."""
    place: dict = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, tilt, hits = full, len(a) / max(1, len(b)), 0
    for j, w in enumerate(b):
        at = place.get(w)
        if at:
            hits += 1
            low = max(0, int(j * tilt) - band)
            at = at >> low << low & ((1 << min(len(a), int(j * tilt) + band + 1)) - 1)
            u = v & at
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count(), len(place), hits


def similarity(a: list[str], b: list[str], least: float) -> float:
    """The shingle similarity of two texts, or a lower bound of it that exceeds `least`, or 0 where an upper bound does not.

    The alignment pairs equal shingles in order, so all it pairs are shared; of n pairs at most as many are repeats as a has repeated shingles.
    """
    if a == b:
        return 1.0
    sa, sb = (list(zip(*(x[i:] for i in range(SHINGLE)))) for x in (a, b))
    if not sa or not sb:
        return 0.0
    common, distinct, hits = banded_common(sa, sb, 8 + abs(len(a) - len(b)) + len(a) // 8)
    shared = common - (len(sa) - distinct)
    if shared > 0 and shared / (distinct + len(sb) - shared) > least:
        return shared / (distinct + len(sb) - shared)
    if hits <= least * distinct:
        return 0.0
    sa, sb = set(sa), set(sb)
    both = len(sa & sb)
    return both / (len(sa) + len(sb) - both)


def similar_classes(rows: DataFrame, least: float = 0.6, agree: int = AGREE) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) once per id, and (a, b) of different classes with similarity above `least`, a < b. rows: as of `sketched`."""
    rows = staged(rows)
    members = rows.select("id", "cls").dropDuplicates(["id"])
    classes = staged(rows.select("cls", "sketches", "tiny").dropDuplicates(["cls"]).withColumn("c", F.monotonically_increasing_id()))
    pairs = staged(candidates(classes, agree))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = staged(classes.select("c", "cls").join(wanted, "c", "left_semi"))
    # Only the words of candidates are shuffled: the others are dropped where they are read, as long as the candidates are few enough to be told everywhere.
    said = rows.select("cls", "words").join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "cls").select("c", "cls", "words").dropDuplicates(["c"])
    both = pairs.join(said.toDF("a", "cls_a", "wa"), "a").join(said.toDF("b", "cls_b", "wb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())) if similarity(x.split(" "), y.split(" "), least) > least]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    return members, staged(both.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), "wa", "wb").mapInArrow(verify, "a binary, b binary"))


def similar_pairs(rows: DataFrame, least: float = 0.6, agree: int = AGREE) -> DataFrame:
    """(id_a, id_b), the smaller id first: every pair of ids with similarity above `least`, copies included. rows: as of `sketched`."""
    members, links = similar_classes(rows, least, agree)
    return member_pairs(staged(members), links)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, grp, n_links): each id with its class, its group (the least class that links lead to) and the number of links of its class.

    Every round each class takes the least label around it and then the label of that label, so the rounds grow with the logarithm of a chain's
    length; each is staged in the shared folder. Links are never gathered anywhere.
    """
    ends = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = staged(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("grp"), F.count("*").alias("n_links")))
    while True:
        near = ends.join(labels.select(F.col("a").alias("b"), "grp"), "b").groupBy("a").agg(F.min("grp").alias("near"))
        step = labels.join(near, "a").select("a", "n_links", F.col("grp").alias("was"), F.least("grp", "near").alias("grp"))
        jump = step.select(F.col("a").alias("grp"), F.col("grp").alias("next"))
        step = staged(step.join(jump, "grp", "left").select("a", "n_links", "was", F.least("grp", F.coalesce("next", "grp")).alias("grp")))
        labels = step.drop("was")
        if step.where("was <> grp").isEmpty():
            break
    found = members.join(labels.withColumnRenamed("a", "cls"), "cls", "left")
    return found.select("id", "cls", F.coalesce("grp", "cls").alias("grp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
