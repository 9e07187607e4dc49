"""Lines, noise, headings and chapters of volumes. A volume is a source whose records follow one another by (chapter, chunk_index)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numerals import parse_roman
from lexmill.functions.staging import staged
from lexmill.functions.text import lines, word_count

from .chapters import SECTION_NAMES, chapter_texts


def line_table(texts: DataFrame, id: str, text: str, *keep: str) -> DataFrame:
    """(id, *keep, line_no, line): one row per line, numbered from 0 within its text."""
    return texts.select(F.col(id).alias("id"), *keep, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


# What makes a line noise in the first family of print, by rule.
FURNITURE = r"^[\p{Nd}\s\p{Z}.,|\[\]ivxlcdIVXLCD•]+$"
NOISE_RULES = {
    "numbers": FURNITURE,
    "running head": r"(?i)\bChap\.",
    "title": r"(?i)SUSHRUTA|SUTRASTH|SAM.?IT",
    "colophon": r"(?i)thus ends?\s+the",
    "bare header": r"^[•\s]*CHAPTER\s+[IVXLC][IVXLC.,\s\x{400}-\x{4ff}]*$",
    "library stamp": r"LIBRARY|DIRECTOR OF|UNIVERSITY OF",
}
#: What the small letters of a line hold wherever a rule finds something; looked for first, as it is found faster than the rule.
NOISE_HINTS = {
    "running head": ["chap."], "title": ["sushruta", "sutrasth", "sam"], "colophon": ["thus end"], "bare header": ["chapter"],
    "library stamp": ["library", "director of", "university of"],
}

# The steps that clean the joined lines of the first family, in order.
CLEANING = [
    (r"([a-zà-ÿ])-\s+([a-zà-ÿ])", "$1$2"),
    (r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", "$1-$2"),
    (r":\s*-+(?=\s*\S)", ":—"),
    (r"(?<=[\p{L}\p{N}_])\s*--\s*(?=[\p{L}\p{N}_])", "—"),
    (r"[*†‡‹›•✓\\|§¶]", " "),
    (r"(?i)(?:a\s*u\s*)?thoritative verse", "Authoritative verse"),
    (r"(?i)^CHAPTER\s+[IVXLC ]+[.,]?\s*", ""),
    (r"[\s\p{Z}]+", " "),
]
#: What the small letters of a text hold wherever the step of CLEANING of that place changes something; "" holds always.
CLEANING_HINTS = ["-", "-", ":", "--", "", "thoritative verse", "chapter", ""]

#: What stands between the parts of a stitched volume.
SEPARATOR = r"^={10} .* ={10}$"

# What opens a part of a chapter, and which of them opens a verse.
VERSE = "Authoritative verses?|Metrical texts?|Additional texts?"
OPENER = "Now we shall (?:discuss|discourse|describe)"


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _rule(s: Column) -> Column:
    """`noise_rule` of a stripped line."""

    def first(s: Column, low: Column) -> Column:
        found = F.when(s == "", "blank")
        for name, pattern in NOISE_RULES.items():
            may = [low.contains(x) for x in NOISE_HINTS.get(name, [])]
            found = found.when(reduce(Column.__or__, may) & s.rlike(pattern) if may else s.rlike(pattern), name)
        return found.when(~s.rlike("[A-Za-z][^A-Za-z]*[A-Za-z][^A-Za-z]*[A-Za-z]"), "short")

    both = F.transform(F.array(s), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))  # a lambda's argument is computed once, a column at each use
    return F.get(F.transform(both, lambda x: first(x["s"], x["low"])), 0)


def noise_rule(line: Column) -> Column:
    """The first rule by which a line of the first family carries no text: `blank`, one of NOISE_RULES, or `short` for two ASCII letters or fewer; null
    for lines of text."""
    return _rule(stripped(line))


def noise_rule_sql(line: str) -> str:
    s = rf"regexp_replace({line}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    rules = " ".join(f"when regexp_matches({s}, '{p}') then '{name}'" for name, p in NOISE_RULES.items())
    return f"case when {s} = '' then 'blank' {rules} when length(regexp_replace({s}, '[^A-Za-z]', '', 'g')) <= 2 then 'short' end"


def is_noise(line: Column) -> Column:
    return noise_rule(line).isNotNull()


def noise_rule_2(line: Column, names: list[str] | None = None) -> Column:
    """The first rule by which a line of the second family carries no text: `blank`, `numbers`, `section` (a section's name and no more, points behind it
    aside), `short` (fewer than four characters that no letter begins); null for lines of text."""
    s = stripped(line)
    section = "(?i)^(" + "|".join(names or SECTION_NAMES) + ")$"
    found = F.when(s == "", "blank").when(s.rlike(FURNITURE), "numbers").when(F.regexp_replace(s, r"\.+$", "").rlike(section), "section")
    return found.when((F.char_length(s) < 4) & ~s.rlike(r"^\p{L}"), "short")


def noise_rule_2_sql(line: str, names: list[str] | None = None) -> str:
    s = rf"regexp_replace({line}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    section = "|".join(names or SECTION_NAMES)
    return (
        rf"case when {s} = '' then 'blank' when regexp_matches({s}, '{FURNITURE}') then 'numbers' when regexp_full_match(regexp_replace({s}, '\.+$', ''), '(?i)({section})') then 'section' "
        rf"when length({s}) < 4 and not regexp_matches({s}, '^\p{{L}}') then 'short' end"
    )


def _mended(text: Column) -> Column:
    """CLEANING in order, then no blanks at the ends and no points or blanks in front."""
    one = F.array(text)
    for (old, new), hint in zip(CLEANING, CLEANING_HINTS, strict=True):
        one = F.transform(one, lambda s: F.when(F.lower(s).contains(hint), F.regexp_replace(s, old, new)).otherwise(s) if hint else F.regexp_replace(s, old, new))  # noqa: B023
    return F.regexp_replace(stripped(F.get(one, 0)), r"^[. ]+", "")


def cleaned(text: Column) -> Column:
    """A text of the first family rebuilt from its lines: noise dropped, the rest stripped and joined, then CLEANING in order, then no blanks at the ends and
    no points or blanks in front. A line of two letters goes before hyphens are closed."""
    return _mended(F.array_join(F.filter(F.transform(lines(text), stripped), lambda s: _rule(s).isNull()), " "))


def cleaned_2(text: Column, names: list[str] | None = None, separators: bool = True) -> Column:
    """A text of the second family: noise lines dropped, header tokens dropped at the start of every line, no blanks at the ends; line breaks stay. The
    rules know no separators between stitched parts; without `separators` those go as well."""
    kept = F.filter(lines(text), lambda s: noise_rule_2(s, names).isNull() & (F.lit(separators) | ~stripped(s).rlike(SEPARATOR)))
    kept = F.array_join(kept, "\n")
    return stripped(F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?im)^CHAPTER\s*[IVXLC\d]+\s*[-–.]?\s*", ""))


def role_by_opening(text: Column) -> Column:
    """The role of a part of the first family by what opens it: verse_summary, topic or prose."""
    return F.when(text.rlike(f"(?i)^(?:{VERSE})"), "verse_summary").when(text.rlike(f"(?i)^(?:{OPENER})"), "topic").otherwise("prose")


def headings(table: DataFrame) -> DataFrame:
    """(id, line_no, numeral, number): chapter headings among lines, with their parsed roman numeral (null where it is no canonical one)."""
    numeral = F.regexp_extract("line", r"(?i)\bchap(?:ter|\.)?\s+([ivxlc1|]{1,7})\b", 1)
    return table.select("*", numeral.alias("numeral")).where("numeral <> ''").withColumn("number", parse_roman(F.col("numeral")))


def chapter_spans(marks: DataFrame, volume: str, place: str, number: str, ends: DataFrame) -> DataFrame:
    """(volume, number, start, end): chapters from the first place at which each number is seen; a chapter ends before the next one starts and the last
    one at the volume's end. marks: places with numbers. ends: (volume, last). Places of one volume are its headings only, which are few."""
    first = marks.where(F.col(number).isNotNull()).groupBy(F.col(volume).alias("volume"), F.col(number).alias("number")).agg(F.min(place).alias("start"))
    after = F.lead("start").over(Window.partitionBy("volume").orderBy("start", "number"))
    return first.withColumn("next", after).join(ends, "volume").select("volume", "number", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("end"))


def role(text: Column, words: Column) -> Column:
    """verse_summary if a verse range ends a line near the start, prose below 120 words, else topic."""
    return F.when(F.left(text, F.lit(200)).rlike(r"(?m)\d+[-–]\d+\s*$"), "verse_summary").when(words < 120, "prose").otherwise("topic")


def chunk_name(source: Column, chapter: Column, index: Column) -> Column:
    return F.format_string("%s-ch%02d-%03d", source, chapter, index)


def marker_parts(text: Column, markers: str = f"{VERSE}|{OPENER}") -> Column:
    """The text cut before each marker (a pattern), parts trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, rf"(?i)(?={markers})"), stripped), lambda x: x != "")


def merged_fragments(parts: DataFrame, group: list[str], order: str, size: str, text: str, least: int) -> DataFrame:
    """(*group, place, n_tokens, text): neighbours joined so that no part is smaller than `least`, where there is another to join.

    A small part joins the one before it; small parts at the start join the one after them. So the first part ends where the sizes from the start first
    reach `least`, and each later part of that size starts another one: two running sums tell where every row belongs, and only the rows of one part
    are ever brought together. (group, order) is unique.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    rows = parts.select(*group, F.col(order).alias("_o"), n.alias("_n"), F.col(text).alias("_t")).withColumnRenamed("_o", order)
    rows = rows.withColumn("_starts", ((F.coalesce(F.sum("_n").over(w), F.lit(0)) >= least) & (F.col("_n") >= least)).cast("int"))
    rows = rows.withColumn("place", F.sum("_starts").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t"))))
    whole = rows.groupBy(*group, "place").agg(F.sum("_n").alias("n_tokens"), items.alias("items"))
    return whole.select(*group, "place", "n_tokens", F.array_join(F.transform("items", lambda x: x["t"]), " ").alias("text"))


def batches(rows: DataFrame, group: list[str], order: str, size: str, limit: int, most: int) -> DataFrame:
    """(*group, order, size, batch): greedy batches in order: a new one starts when the next row would pass `limit` or the batch has `most` rows; a row
    above the limit is a batch of its own. Sizes that are null count 0. (group, order) is unique.

    Each row knows the batch that would start with it, as that holds `most` rows at most; these successors are squared (joined with themselves) until all
    starts are reached from the first row, so a long group takes a logarithmic number of joins and is in no single array.
    """
    w = Window.partitionBy(*group).orderBy(order)
    placed = rows.select(*group, order, F.coalesce(size, F.lit(0)).cast("bigint").alias(size)).withColumn("_i", F.row_number().over(w).cast("bigint") - 1)
    ahead = F.collect_list(size).over(w.rowsBetween(0, most - 1))
    fits = F.aggregate("_ahead", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, x: F.when(a["open"] & ((a["n"] == 0) | (a["sum"] + x <= limit)), F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["sum"].alias("sum"), a["n"].alias("n"), F.lit(False).alias("open"))))
    placed = staged(placed.withColumn("_ahead", ahead).withColumn("_next", F.col("_i") + fits["n"]).drop("_ahead"))
    key = [*group, "_i"]
    jump = placed.select(*key, "_next")
    jump = jump.join(placed.select(*group, F.col("_i").alias("_next")), [*group, "_next"], "left_semi").select(*key, "_next")
    reached = placed.where("_i = 0").select(*key)
    while True:
        more = reached.join(jump, key).select(*group, F.col("_next").alias("_i"))
        grown = staged(reached.unionByName(more).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        jump = staged(jump.join(jump.select(*group, F.col("_i").alias("_next"), F.col("_next").alias("_then")), [*group, "_next"]).select(*key, F.col("_then").alias("_next")))
    starts = placed.join(reached.withColumn("_start", F.lit(1)), key, "left")
    number = F.sum(F.coalesce("_start", F.lit(0))).over(Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return starts.select(*group, order, size, number.cast("int").alias("batch"))


def lookback(table: DataFrame, mark: Column, reach: int = 10) -> DataFrame:
    """`table` (id, line_no, ...) with `seen`: the nearest non-null `mark` among the `reach` lines before each line of the same text."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(-reach, -1)
    return table.withColumn("seen", F.last(mark, ignorenulls=True).over(w))


def one_way_sections(hints: DataFrame, volume: str, place: str, section: str) -> DataFrame:
    """(volume, section, start): where each section of a volume is entered, when a section that was left is never entered again.

    Hints of the current section or of one that was left change nothing; any other hint leaves the current section. So a section is entered at the first
    of its hints.
    """
    hint = hints.where(F.col(section).isNotNull()).select(F.col(volume).alias("volume"), F.col(section).cast("string").alias("section"), F.col(place).cast("bigint").alias("start"))
    return hint.groupBy("volume", "section").agg(F.min("start").alias("start"))


def volume_chunks(rows: DataFrame, bounds: DataFrame, least: int, markers: str = f"{VERSE}|{OPENER}") -> DataFrame:
    """(volume, n, place, name, role, n_tokens, text): the chunks of every volume of the first family, in one job: the lines of each chapter are stripped of
    noise where they stand, runs of lines up to the next marker become parts, and parts of fewer than `least` words join their neighbours.

    rows, bounds: as of `chapters`. A part starts on a line that a marker opens; what is brought together is a part, never a chapter. Parts are cleaned
    as whole texts, so words broken over lines are closed. Parts that are empty after cleaning are dropped.
    """
    w = Window.partitionBy("volume", "n").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = rows.select("volume", "line_no", F.explode(F.filter(F.array(stripped(F.col("line"))), lambda s: _rule(s).isNull())).alias("line"))  # a filter would compute its column twice, here and below
    opens = F.col("line").rlike(f"(?i)^(?:{markers})").cast("int")
    placed = chapter_texts(text, bounds).withColumn("part", F.sum(opens).over(w))
    items = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    parts = placed.groupBy("volume", "n", "part").agg(F.array_join(F.transform(items, lambda x: x["line"]), " ").alias("text"))
    parts = parts.select("volume", "n", "part", F.explode(F.filter(F.array(_mended(F.col("text"))), lambda x: x != "")).alias("text")).withColumn("size", word_count(F.col("text")))
    whole = merged_fragments(parts, ["volume", "n"], "part", "size", "text", least)
    return whole.select("volume", "n", "place", chunk_name(F.col("volume"), F.col("n"), F.col("place")).alias("name"), role_by_opening(F.col("text")).alias("role"), "n_tokens", "text")
