"""Chapters and sections of volumes, from the headings on their lines.

Two families of print. In the first a chapter may be told by its opening, by its colophon or by the running heads of its pages, and each boundary takes
the best of these that is left. In the second a volume has sections, which running heads name, and chapters start anew in each. All work after the lines
themselves is on marks (headings, hints), of which a volume has a bounded number; no task holds the lines of a volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.numerals import parse_numeral, parse_ordinal, parse_roman
from lexmill.functions.staging import staged
from lexmill.functions.text import lines

# How headings look.
OPENING = r"^[•\s]*CHAPTER\s+(.+)$"
COLOPHON = r"(?i)thus ends?\s+the\s+([a-z][a-z\- ]+?)\s+chapter"
RUNNING = r"(?i)\[\s*Chap\.\s*([IVXLC].*)"
HEADER = r"(?i)^CHAPTER\s*([IVXLC\d]{1,6})\s*(?:[-.\s]|$)"
CONTENTS = ("end of the content", "contents of")

# Names of sections as printed, and the label of each by what its name holds, in this order.
SECTION_NAMES = """sutrasthana sutrasth nidanasthana nidana_sthana vimanasthana vimana_sthana shareerasthana sharirasthana indriyasthana chikitsasthana
chikitsa-sthana chikitsasthanam kalpasthana kalpasthanam siddhisthana siddhisthanam uttarasthana uttaratantra""".replace("_", " ").split()
SECTION_LABELS = {
    "sutra": "sutrasthana", "nidana": "nidanasthana", "vimana": "vimanasthana", "sharira": "shareerasthana", "indriya": "indriyasthana",
    "chikitsa": "chikitsasthana", "kalpa": "kalpasthana", "siddhi": "siddhisthana", "uttara": "uttarasthana",
}
DEFAULT_SECTION = "sutrasthana"


def volume_lines(parts: DataFrame, volume: str, order: list[str], text: str) -> DataFrame:
    """(volume, line_no, line, next_line): the lines of the parts of each volume in order, numbered from 0 through the volume. (volume, *order) is unique.

    Parts are range-partitioned and sorted; each range counts its own lines, and only what a range holds of a volume (one row) is summed up. Parts without
    lines (null, empty) are passed over. A text goes between tasks once and is staged with its place.
    """
    whole = parts.select(F.col(volume).alias("volume"), *order, F.col(text).alias("text")).where("text is not null")
    sorted_ = whole.repartitionByRange("volume", *order).sortWithinPartitions("volume", *order)  # reads its input twice, so texts are split behind it
    cut = sorted_.select("volume", *order, lines(F.col("text")).alias("ls"))
    kinds = StructType([*cut.schema.fields, *StructType.fromDDL("n bigint, before bigint, head string, after string, closing boolean, part int").fields])
    placed = staged(cut.mapInArrow(_placed, kinds))
    ranges = placed.groupBy("part", "volume").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    w = Window.partitionBy("volume").orderBy("part")
    ranges = ranges.select(F.col("part").alias("_part"), F.col("volume").alias("_volume"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("head").over(w).alias("follows"))
    both = placed.join(F.broadcast(ranges), (F.col("part") == F.col("_part")) & F.col("volume").eqNullSafe(F.col("_volume")))
    after = F.when(F.col("closing"), F.col("follows")).otherwise(F.col("after"))
    both = both.select("volume", (F.col("base") + F.col("before")).alias("start"), "ls", after.alias("after"))
    pairs = F.transform("ls", lambda s, i: F.struct(s.alias("line"), F.coalesce(F.get("ls", i + 1), F.col("after")).alias("next_line")))
    rows = both.select("volume", "start", F.posexplode(pairs).alias("i", "p"))
    return rows.select("volume", (F.col("start") + F.col("i")).alias("line_no"), "p.line", "p.next_line")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts (volume, ..., ls) of a range with their number of lines, if any, the lines of the volume before them in it, `head` (first line) of the first part of a volume,
    `after` (first line of the next part of the volume), whether the part is the volume's last one in the range, and the range."""
    part, total, held = TaskContext.get().partitionId(), 0, None

    def whole(held: tuple, next_head: pa.Scalar | None) -> pa.RecordBatch:
        b, n, before, heads, new = held
        closing = np.r_[new[1:], next_head is None]
        last = pa.array([None if next_head is None else next_head.as_py()], pa.string())
        after = pc.if_else(pa.array(closing), pa.scalar(None, pa.string()), pa.concat_arrays([heads.slice(1), last]))
        head = pc.if_else(pa.array(new), heads, pa.scalar(None, pa.string()))
        columns = [*b.columns, pa.array(n), pa.array(before), head, after, pa.array(closing), pa.array(np.full(len(b), part, np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names, "n", "before", "head", "after", "closing", "part"])

    for b in batches:
        b = b.filter(pc.greater(pc.list_value_length(b.column("ls")), 0))
        if not len(b):
            continue
        volume, n = b.column("volume"), pc.list_value_length(b.column("ls")).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(volume.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        goes_on = held is not None and held[0].column("volume")[-1].as_py() == volume[0].as_py()
        new = np.r_[not goes_on, code[1:] != code[:-1]]
        heads = pc.list_element(b.column("ls"), 0)
        if held is not None:
            yield whole(held, heads[0] if goes_on else None)
        ahead = np.cumsum(n) - n
        begin = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
        before = ahead - np.where(begin < 0, -total, ahead[begin])
        total, held = int(before[-1] + n[-1]), (b, n, before, heads, new)
    if held is not None:
        yield whole(held, None)


def _group(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def marks(rows: DataFrame) -> DataFrame:
    """(volume, line_no, kind, n): openings (open), colophons (close) and running heads (run) with the chapter they tell, from the body's start on: the
    last opening of chapter 1, or the first line where there is none. A colophon may run on into the next line. rows: as of `volume_lines`."""
    line = F.col("line")
    window = F.concat_ws(" ", line, "next_line")
    told = F.when(line.contains("CHAPTER"), line), F.when(F.lower(window).contains("thus end"), window), F.when(line.contains("["), line)  # what no pattern can hold is not searched
    kinds = [("open", parse_roman(_group(told[0], OPENING))), ("close", parse_ordinal(_group(told[1], COLOPHON))), ("run", parse_roman(_group(told[2], RUNNING)))]
    found = rows.select("volume", "line_no", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in kinds])).alias("m"))
    found = staged(found.select("volume", "line_no", "m.kind", "m.n").where("n is not null"))  # used twice
    body = found.where("kind = 'open' and n = 1").groupBy("volume").agg(F.max("line_no").alias("body"))
    return found.join(body, "volume", "left").where(F.col("line_no") >= F.coalesce("body", F.lit(0))).drop("body")


def last_lines(rows: DataFrame) -> DataFrame:
    return rows.groupBy("volume").agg(F.max("line_no").alias("last"))


def chapter_bounds(marks: DataFrame, ends: DataFrame) -> DataFrame:
    """(volume, n, start, end, note): every chapter from 1 to the greatest that any mark tells. marks: as of `marks`. ends: (volume, last).

    The first mark of a kind counts. A chapter starts at its opening, else behind the colophon of the one before, else at its first running head. It ends
    at its colophon, else before the next opening, else before the next running head, else at the next colophon, else before the opening after the next,
    else, if it is the last one, with the volume. note: `approximate` where a boundary is none of the exact ones, `unresolved` (start and end null) where one
    is missing or the start is not before the end.
    """
    first = marks.groupBy("volume", "kind", "n").agg(F.min("line_no").alias("at"))
    table = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "at")))).alias(kind)
    maps = first.groupBy("volume").agg(table("open"), table("close"), table("run"), F.max("n").alias("most")).join(ends, "volume")
    rows = maps.withColumn("n", F.explode(F.sequence(F.lit(1), "most")))
    at = lambda kind, ahead=0: F.try_element_at(kind, F.col("n") + ahead)
    start = F.coalesce(at("open"), at("close", -1) + 1, at("run"))
    end = F.coalesce(at("close"), at("open", 1) - 1, at("run", 1) - 1, at("close", 1), at("open", 2) - 1, F.when(F.col("n") == F.col("most"), F.col("last")))
    exact = (at("open").isNotNull() | at("close", -1).isNotNull()) & (at("close").isNotNull() | at("open", 1).isNotNull())
    rows = rows.select("volume", "n", start.alias("start"), end.alias("end"), exact.alias("exact")).withColumn("ok", F.coalesce(F.col("start") < F.col("end"), F.lit(False)))
    note = F.when(~F.col("ok"), "unresolved").when(~F.col("exact"), "approximate")
    return rows.select("volume", "n", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("start", "end")], note.alias("note"))


def section_bounds(rows: DataFrame, names: dict[str, str], reach: int = 10, contents: int = 8) -> DataFrame:
    """(volume, section, start, end, note): sections of a volume of the first family. names: section to the pattern of its name, in order of precedence.

    A section starts at an opening of chapter 1 with a name among the `reach` lines before it, the nearest one counting; openings with a table of
    contents in the `contents` lines before are none. Of several starts of a section the last holds; it ends before the next one. An opening without a name
    is a row of its own with the note `orphan`.
    """
    key = F.coalesce(*[F.when(F.col("line").rlike(f"(?i){p}"), k) for k, p in names.items()])
    opening = rows.where(parse_roman(_group(F.trim("line"), OPENING)) == 1).select("volume", F.col("line_no").alias("at"))
    back = lambda n: opening.select("volume", "at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - n), F.col("at") - 1)).alias("line_no")).where("line_no < at")
    opening = opening.where("at >= 0")
    named = back(reach).join(rows.select("volume", "line_no", key.alias("section")).where("section is not null"), ["volume", "line_no"])
    named = named.groupBy("volume", "at").agg(F.max_by("section", "line_no").alias("section"))
    said = lambda text: F.lower(text).contains(CONTENTS[0]) | F.lower(text).contains(CONTENTS[1])
    listed = rows.select("volume", "line_no", said(F.col("line")).alias("own"), said(F.concat_ws(" ", "line", "next_line")).alias("wide")).where("wide")
    listed = back(contents).join(listed, ["volume", "line_no"]).where(F.col("own") | (F.col("line_no") < F.col("at") - 1)).select("volume", "at").distinct()
    starts = opening.join(listed, ["volume", "at"], "left_anti").join(named, ["volume", "at"], "left")
    held = starts.where("section is not null").groupBy("volume", "section").agg(F.max("at").alias("start"))
    after = F.lead("start").over(Window.partitionBy("volume").orderBy("start"))
    held = held.withColumn("next", after).join(last_lines(rows), "volume")
    held = held.select("volume", "section", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("end"), F.lit(None).cast("string").alias("note"))
    orphans = starts.where("section is null").select("volume", "section", F.col("at").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit("orphan").alias("note"))
    return held.unionByName(orphans)


def section_hint(line: Column, names: list[str] | None = None, labels: dict[str, str] | None = None) -> Column:
    """The section that a line names anywhere in it: the first label whose key its small letters hold; null where no name is in it, or no key."""
    names, labels = names or SECTION_NAMES, labels or SECTION_LABELS
    low = F.regexp_replace(F.lower(F.trim(line)), r"\.+$", "")
    label = F.coalesce(*[F.when(low.contains(k), v) for k, v in labels.items()])
    return F.when(low.rlike("|".join(names)), label)


def section_chapters(rows: DataFrame, default: str = DEFAULT_SECTION, names: list[str] | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """(volume, section, n, start, end, note): chapters of volumes of the second family, whose numbers start anew in each section.

    From the first header on, a hint of a section that is neither the current one nor left before leaves the current section for it; a section that was
    left is not entered again, so each is entered at its first hint. The line of a hint is no header. The first header of a number in a section counts. A
    chapter ends before the next one, the last with the volume; note `empty` where that leaves no line.
    """
    number = _group(F.trim("line"), HEADER)
    seen = rows.select("volume", "line_no", section_hint(F.col("line"), names, labels).alias("hint"), number.alias("numeral")).where("hint is not null or numeral is not null")
    body = seen.where("numeral is not null").groupBy("volume").agg(F.min("line_no").alias("body"))
    seen = seen.join(body, "volume").where("line_no >= body")
    entries = seen.where(F.col("hint").isNotNull() & (F.col("hint") != default)).groupBy("volume", "hint").agg(F.min("line_no").alias("at"))
    entries = entries.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("at", "hint"))).alias("entries"))  # one a label at most
    heads = seen.where("hint is null").withColumn("n", parse_numeral(F.col("numeral"))).where("n is not null").join(entries, "volume", "left")
    past = F.filter(F.coalesce("entries", F.array().cast("array<struct<at:bigint,hint:string>>")), lambda e: e["at"] <= F.col("line_no"))
    heads = heads.withColumn("section", F.when(F.size(past) > 0, F.element_at(past, -1)["hint"]).otherwise(F.lit(default)))
    first = heads.groupBy("volume", "section", "n").agg(F.min("line_no").alias("start"))
    after = F.lead("start").over(Window.partitionBy("volume").orderBy("start"))
    found = first.withColumn("next", after).join(last_lines(rows), "volume")
    found = found.select("volume", "section", "n", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("end"))
    return found.withColumn("note", F.when(F.col("start") >= F.col("end"), "empty"))


def chapter_texts(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(volume, n, line_no, line): the lines of each chapter, both ends included. bounds: (volume, n, start, end). Chapters of a volume do not overlap but
    where a lost heading left two with one stretch; each has the lines then. A volume's bounds are few, so they go along with its lines."""
    held = bounds.where("start is not null").groupBy("volume").agg(F.collect_list(F.struct("n", "start", "end")).alias("bounds"))
    inside = F.filter("bounds", lambda b: (b["start"] <= F.col("line_no")) & (F.col("line_no") <= b["end"]))
    return rows.join(held, "volume").select("volume", F.explode(inside).alias("b"), "line_no", "line").select("volume", "b.n", "line_no", "line")
