"""Problem 7: a corpus as token ids of a public byte-level tokenizer, every distinct word encoded once.

Texts are split into pre-tokens by the tokenizer's pattern. A *block* of neighbouring texts keeps a list of its distinct pre-tokens and, for every text,
the places in that list of its pre-tokens in order, packed. Only the lists are exploded: (block, place, word). Distinct words are found by a global
shuffle that combines them first, are encoded once, and their ids are joined back to the places; then each block is put together by position. So a word
crosses the network once a block instead of once a text, and texts as packed places only.

A block has at most TEXTS texts and, but for a text that is larger by itself, about WORDS pre-tokens. Words of many blocks are joined from a table of at
most HOT rows that every task holds, so no key of the shuffled join is hot.

Ids hold no special tokens; the special tokens' strings are ordinary text. Null, and empty, texts have no ids (an empty array). Blank texts have the
ids of their white space. Repeated texts, repeated ids and texts of any length are treated alike. The vocabulary file's path is a parameter; the driver
reads the file and gives its bytes (under 1 MB) to every task.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words, those of the most blocks, that are given to every task (under 1 MB).
HOT = 5000
#: Size of a block.
TEXTS, WORDS = 2000, 500_000

_SPACE = r" \t\n\r\f\v"
#: What the pattern is for texts of ASCII alone, for the faster of two regular-expression libraries.
_ascii = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s", rf"[{_SPACE}]"))


def ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@lru_cache(2)
def _encoding(data: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(data), special_tokens={})


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(1)
def splitter() -> Callable[[str], list[str]]:
    """The pre-tokens of a text, in order."""
    import regex

    other = regex.compile(PATTERN)
    return lambda t: (_ascii if t.isascii() else other).findall(t)


def blocks(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(block, ids, counts, places, words): staged blocks of texts. counts: pre-tokens of each text; places: 32-bit places in `words`, end to end."""
    kind = texts.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            number, bodies = batch.column("number"), batch.column("text").to_pylist()
            at, counts, places, words = 0, [], array("i"), _Places()
            for k, t in enumerate(bodies, 1):
                before = len(places)
                if t:
                    places.extend(map(words.__getitem__, split(t)))
                counts.append(len(places) - before)
                if k == len(bodies) or len(counts) == TEXTS or len(places) >= WORDS:
                    ids = pa.ListArray.from_arrays(pa.array([0, k - at], pa.int32()), batch.column("id")[at:k])
                    yield pa.RecordBatch.from_arrays(
                        [number[at : at + 1], ids, pa.array([counts], pa.list_(pa.int32())), pa.array([places.tobytes()], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))],
                        ["block", "ids", "counts", "places", "words"],
                    )
                    at, counts, places, words = k, [], array("i"), _Places()

    rows = texts.select(F.col(id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("number"))
    return staged(rows.mapInArrow(run, f"block bigint, ids array<{kind}>, counts array<int>, places binary, words array<string>"))


def encoded_words(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """(word, n, ids): every distinct word of `rows` (block, word) with the number of its blocks and its ids."""
    data = _vocabulary(rows.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(data.value)
        for b in batches:
            ids = own.encode_ordinary_batch(b.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return rows.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(encode, "word string, n bigint, ids array<int>")


def _joined(held: DataFrame, path: str) -> DataFrame:
    """(block, place, ids): the ids of every word of every block."""
    rows = held.select("block", F.posexplode("words").alias("place", "word"))
    words = staged(encoded_words(rows, path))
    hot = words.orderBy(F.desc("n"), "word").limit(HOT).select("word", "ids")
    rest = words.join(F.broadcast(hot.select("word")), "word", "left_anti").select("word", "ids")
    some = rows.join(F.broadcast(hot), "word", "left")
    return some.where("ids is not null").select("block", "place", "ids").unionByName(some.where("ids is null").drop("ids").join(rest, "word").select("block", "place", "ids"))


def _spread(block: pa.Table, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: (places, number of ids by place, where they start, pre-tokens of each text)."""
    number = np.zeros(len(found), np.int64)
    number[found.column("place").to_numpy()] = found.column("size").to_numpy()
    start = np.zeros(len(found), np.int64)
    start[found.column("place").to_numpy()] = np.cumsum(found.column("size").to_numpy()) - found.column("size").to_numpy()
    return np.frombuffer(block.column("places")[0].as_py(), np.int32), number, start, block.column("counts").combine_chunks().flatten().to_numpy()


def _edges(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the ids of each text end, with a 0 before: n ids by pre-token, counts pre-tokens by text."""
    return np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]


def token_ids(texts: DataFrame, id: str, text: str, path: str = RANKS) -> DataFrame:
    """(id, ids): one row per row of `texts`."""
    held = blocks(texts, id, text)
    kind = texts.schema[id].dataType.simpleString()

    def put(block: pa.Table, found: pa.Table) -> pa.Table:
        places, number, start, counts = _spread(block, found)
        n = number[places]
        first = np.cumsum(n) - n
        flat = found.column("ids").combine_chunks().flatten().to_numpy() if len(found) else np.zeros(0, np.int32)
        ids = flat[np.repeat(start[places] - first, n) + np.arange(n.sum())]
        return pa.table({"id": block.column("ids").combine_chunks().flatten(), "ids": pa.ListArray.from_arrays(pa.array(_edges(n, counts), pa.int32()), pa.array(ids, pa.int32()))})

    found = _joined(held, path).select(F.col("block").alias("of"), "place", "ids", F.size("ids").alias("size"))
    return held.select("block", "ids", "counts", "places").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(put, f"id {kind}, ids array<int>")


def token_totals(texts: DataFrame, id: str, text: str, path: str = RANKS) -> DataFrame:
    """(id, n_tokens): the number of ids of each text, 0 for null and empty ones, without putting ids together."""
    held = blocks(texts, id, text)
    kind = texts.schema[id].dataType.simpleString()

    def add(block: pa.Table, found: pa.Table) -> pa.Table:
        places, number, _, counts = _spread(block, found)
        return pa.table({"id": block.column("ids").combine_chunks().flatten(), "n_tokens": pa.array(np.diff(_edges(number[places], counts)), pa.int64())})

    found = _joined(held, path).select(F.col("block").alias("of"), "place", F.size("ids").alias("size"))
    return held.select("block", "ids", "counts", "places").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(add, f"id {kind}, n_tokens bigint")


def decoded(encoded: DataFrame, spark: SparkSession, path: str = RANKS) -> DataFrame:
    """(id, text): the texts of ids, through a join with the vocabulary's table of bytes (one row a token, of fixed size). No ids give an empty text."""
    with open(path, "rb") as f:
        table = F.broadcast(spark.createDataFrame([(r, b.hex()) for b, r in ranks(f.read()).items()], "token int, hex string"))
    rows = encoded.select("id", F.posexplode("ids").alias("p", "token")).join(table, "token")
    whole = rows.groupBy("id").agg(F.collect_list(F.struct("p", "hex")).alias("parts"))
    whole = whole.select("id", F.array_join(F.transform(F.array_sort("parts"), lambda x: x.hex), "").alias("hex"))
    return encoded.select("id").join(whole, "id", "left").select("id", F.coalesce(F.decode(F.unhex("hex"), "UTF-8"), F.lit("")).alias("text"))
