"""Problem 3: texts above a size limit cut into overlapping pieces at natural boundaries, all cuts at once by pointer doubling.

Sizes are in white-space-separated words. A boundary is a place between two words with a rank: 3 paragraph (blank line), 2 sentence, 1 clause,
0 plain; plain ones only where natural boundaries are more than `overlap` words apart, every `overlap` words. From every boundary the greedy piece
is known: its end is the farthest boundary of the best rank in its second half, else of the best rank within the limit; the next piece starts at the
first boundary of the best rank at most `overlap` words before that end. This successor table is squared (joined with itself) until every piece that
starts at the text's first word is reached: log2(pieces) rounds instead of one step a piece.

Null, empty and blank texts and texts within the limit are not cut. Repeated ids are cut once. No word is lost, and only words are: pieces keep the
white space inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

LIMIT, OVERLAP = 1024, 128
_word = re.compile(r"\S+")
_sentence = re.compile(r"[.?!।॥…][\"'”’)\]]*$")
_clause = re.compile(r"[,;:—–)][\"'”’]*$")


def boundaries(text: str, overlap: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(words before each boundary, its rank, character offsets of the words)."""
    found = [(m.start(), m.end()) for m in _word.finditer(text)]
    at, rank = [0], [3]
    for k, (a, b) in enumerate(found):
        last = k + 1 == len(found)
        gap = "" if last else text[b : found[k + 1][0]]
        word = text[a:b]
        r = 3 if last or gap.count("\n") > 1 or "\u2029" in gap else 2 if _sentence.search(word) else 1 if _clause.search(word) else 0
        if r or k + 1 - at[-1] >= overlap:
            at.append(k + 1), rank.append(r)
    return np.array(at), np.array(rank), [a for a, _ in found] + [found[-1][1] if found else 0]


def successors(at: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of the piece from each boundary, start of the next piece; -1 after the last piece)."""
    size = at[-1]
    end, nxt = np.full(len(at), -1), np.full(len(at), -1)
    for least, ranks in ((limit // 2, (3, 2, 1)), (overlap, (3, 2, 1, 0))):
        for r in ranks:
            own = at[rank >= r]
            far = own[np.maximum(np.searchsorted(own, at + limit, side="right") - 1, 0)]
            end = np.where((end < 0) & (far > at + least), far, end)
    end = np.where(end < 0, np.minimum(at + limit, size), end)
    end = np.where(at + limit >= size, size, end)
    for r in (2, 1, 0):
        own = at[rank >= r]
        first = own[np.minimum(np.searchsorted(own, end - overlap, side="left"), len(own) - 1)]
        nxt = np.where((nxt < 0) & (first > at) & (first < end), first, nxt)
    nxt = np.where(nxt < 0, end, nxt)
    return end, np.where(end >= size, -1, nxt)


def oversized(texts: DataFrame, id: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(id, text, words): texts of more than `limit` words, once per id. Texts too short in characters never leave the JVM."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) for t in b.column(1).to_pylist()]
            keep = pa.array([i for i, v in enumerate(n) if v > limit], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(n, pa.int32()).take(keep)], ["id", "text", "words"])

    kind = texts.schema[id].dataType.simpleString()
    long = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.char_length("text") > 2 * limit)
    return long.mapInArrow(count, f"id {kind}, text string, words int").dropDuplicates(["id"])


def cuts(long: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, start, end): the pieces of each text of `long`, in words. long: (id, text, words), staged."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                at, rank, _ = boundaries(t, overlap)
                end, nxt = successors(at, rank, limit, overlap)
                live = nxt >= 0
                ids = pa.array([i], b.schema.field("id").type).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(end, pa.int32()), pa.array(nxt, pa.int32(), mask=~live)], ["id", "at", "end", "next"])

    kind = long.schema["id"].dataType.simpleString()
    steps = staged(long.select("id", "text").mapInArrow(table, f"id {kind}, at int, end int, next int"))
    most = long.agg(F.max("words")).first()[0] or 0
    # A piece and the next begin more than (limit // 2 - overlap) words apart, or one boundary apart at worst.
    rounds = ceil(log2(max(2, most / max(1, min(limit // 2 - overlap, limit - overlap)) + 1))) + 1
    jump = steps.select("id", "at", "next").where("next is not null")
    reached = long.select("id", F.lit(0).alias("at"))
    for k in range(rounds):
        ahead = reached.join(jump, ["id", "at"]).select("id", F.col("next").alias("at"))
        reached = reached.unionByName(ahead).distinct()
        if k + 1 < rounds:
            jump = jump.join(jump.select("id", F.col("at").alias("next"), F.col("next").alias("then")), ["id", "next"]).select("id", "at", F.col("then").alias("next"))
            jump, reached = staged(jump), staged(reached)
    # Texts whose pieces all end early may need more rounds; the last jump tells.
    while not (more := staged(reached.join(steps.select("id", "at", "next").where("next is not null"), ["id", "at"]).select("id", F.col("next").alias("at")).join(reached, ["id", "at"], "left_anti").distinct())).isEmpty():
        reached = staged(reached.unionByName(more))
    return reached.join(steps, ["id", "at"]).select("id", F.col("at").alias("start"), "end")


def split_texts(texts: DataFrame, id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start, end, text): the pieces of every text above the limit, numbered from 0; start and end in words, end exclusive."""
    long = staged(oversized(texts, id, text, limit))
    spans = cuts(long, limit, overlap).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (t, spans) in enumerate(zip(b.column("text").to_pylist(), b.column("spans").to_pylist())):
                at = [(m.start(), m.end()) for m in _word.finditer(t)]
                rows += [(k, p, s["start"], s["end"], t[at[s["start"]][0] : at[s["end"] - 1][1]]) for p, s in enumerate(spans)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())],
                ["id", "piece", "start", "end", "text"],
            )

    kind = long.schema["id"].dataType.simpleString()
    return long.join(spans, "id").select("id", "text", "spans").mapInArrow(cut, f"id {kind}, piece int, start int, end int, text string")
