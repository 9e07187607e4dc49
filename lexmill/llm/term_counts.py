"""Problem 2: how often every term and every run of terms occurs, and in how many records, from a distributed suffix array.

Every position of a record's sequence of terms starts a suffix that runs to the end of the sequence. Equal suffixes are combined, then sorted over the
cluster; an n-gram is an interval of suffixes whose common prefix is n terms or longer. The width of the interval is its number of occurrences. Two
suffixes of one record that follow each other in sorted order, with none of that record between them, share a prefix of d terms: the later one is a
duplicate for all n <= d, and records = width - duplicates. Restricted to a record, the sorted array is the sorted list of the record's own suffixes, so
the duplicates are read off that list before equal suffixes are combined. Intervals that cross from one partition into the next are summed, so a term of
a third of all rows is never in one task.

The text of a record's suffixes grows with the square of its number of terms, as the number of its n-grams does.

Terms are trimmed and lower-cased, null and blank ones dropped (their neighbours then adjoin). Null arrays hold no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .together import terms_of

SEPARATOR = "\x1f"


#: Characters of suffixes or n-grams in one Arrow batch.
BATCH = 1 << 22


def _shared(a: list[str], b: list[str]) -> int:
    """The number of terms at the start of both."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields, out, dups = [], [], []

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(out, pa.string()), pa.array(dups, pa.int32())], ["field", "suffix", "dup"])
        fields.clear(), out.clear(), dups.clear()
        return got

    size = 0
    for batch in batches:
        for field, terms in zip(batch.column("field").to_pylist(), batch.column("terms").to_pylist()):
            last: list[str] = []
            for i in sorted(range(len(terms)), key=lambda i: terms[i:]):
                suffix = terms[i:]
                fields.append(field), out.append(SEPARATOR.join(suffix)), dups.append(_shared(last, suffix))
                last = suffix
                size += len(out[-1])
                if size > BATCH:
                    yield flush()
                    size = 0
    yield flush()


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, str, int, int]] = []
    path: list[str] = []  # the suffix at hand
    open_: list[list[int]] = []  # for n = 1..: [width, duplicates] of its interval, without those of longer intervals still open
    at, size = None, 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 5
        rows.clear()
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["field", "size", "gram", "total", "duplicates"])

    def close(keep: int) -> Iterator[pa.RecordBatch]:
        nonlocal size
        while len(open_) > keep:
            width, dup = open_.pop()
            if open_:
                open_[-1][0] += width
                open_[-1][1] += dup
            rows.append((at, len(open_) + 1, SEPARATOR.join(path[: len(open_) + 1]), width, dup))
            size += len(rows[-1][2])
            if size > BATCH:
                yield flush()
                size = 0

    for batch in batches:
        for field, suffix, dup, n in zip(*(batch.column(c).to_pylist() for c in ("field", "suffix", "dup", "n"))):
            terms = suffix.split(SEPARATOR)
            yield from close(_shared(path, terms) if field == at else 0)
            at, path = field, terms
            open_ += [[0, 0] for _ in range(len(terms) - len(open_))]
            open_[-1][0] += n
            if dup:
                open_[dup - 1][1] += n
    yield from close(0)
    yield flush()


def gram_counts(records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(field, size, term, terms, total, records): every n-gram of the array columns, of any length, over distinct ids. (field, terms) is unique; term
    is its terms with blanks between, which two n-grams may share where terms hold blanks."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms_of(f).alias("terms")) for f in fields]))
    rows = records.dropDuplicates([id]).select(stacked.alias("s")).select("s.field", "s.terms").where(F.size("terms") > 0)
    suffixes = rows.mapInArrow(_suffixes, "field string, suffix string, dup int")
    equal = suffixes.groupBy("field", "suffix", "dup").agg(F.count("*").alias("n"))
    # \x1f sorts before every letter, so a suffix stands right before its extensions.
    order = equal.repartitionByRange("field", "suffix").sortWithinPartitions("field", "suffix")
    parts = order.mapInArrow(_intervals, "field string, size int, gram string, total bigint, duplicates bigint")
    whole = parts.groupBy("field", "size", "gram").agg(F.sum("total").alias("total"), (F.sum("total") - F.sum("duplicates")).alias("records"))
    return whole.select("field", "size", F.translate("gram", SEPARATOR, " ").alias("term"), F.split("gram", SEPARATOR).alias("terms"), "total", "records")


def marked(counts: DataFrame, n: int, rare: int = 3, common: float = 0.15) -> DataFrame:
    """The counts with `use`: rare (in at most `rare` records), common (in more than the share `common` of n records) or useful. Rare goes first."""
    use = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * n, "common").otherwise("useful")
    return counts.withColumn("use", use)
