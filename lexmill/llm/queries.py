"""The queries of this package's operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.staging import staged
from lexmill.sources.tables import table

from . import encode, mixture, near_copies, pieces, private, scan_repair, term_counts, together, unify


TAGS = ["herbs", "diseases", "doshas_mentioned"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p1_pairs in enough records and often enough above independence."""
    return p1_pairs(spark, folder).where("n_ab >= 4 and n_ab >= 0.001 * n and n_ab * n >= 2.1 * n_a * n_b").select("item_a", "item_b")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tags with its counts, the count the null expects, the tail and whether it is a discovery at a false-discovery rate of 1 %."""
    return together.discovered(together.surprising_pairs(table(spark, folder, "all_chunks"), "chunk_id", TAGS))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The exact counts behind p1_pairs."""
    pairs = together.surprising_pairs(table(spark, folder, "all_chunks"), "chunk_id", TAGS)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "all_chunks")
    n = chunks.select("chunk_id").distinct().count()
    return term_counts.marked(term_counts.gram_counts(chunks, "chunk_id", ["herbs", "diseases"]), n)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where("size = 1 and use <> 'useful'").select("field", "term")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every single term with its counts and its use."""
    return _terms(spark, folder).where("size = 1").select("field", "term", "total", "records", "use")


def p2_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of neighbouring terms, of any length, with its counts."""
    return _terms(spark, folder).select("field", "size", "terms", "total", "records")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that come out in more than one piece; every text above the limit does."""
    cut = pieces.cuts(staged(pieces.oversized(table(spark, folder, "all_chunks"), "chunk_id", "text")))
    return cut.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("chunk_id"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(table(spark, folder, "all_chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p3_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 800 words without overlap."""
    return pieces.split_texts(table(spark, folder, "all_chunks"), "chunk_id", "text", 800, 0).withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = unify.same_look(table(spark, folder, "all_chunks"))
    return found.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The records whose look is stored in several ways, with their class and the number of links of it."""
    return unify.look_groups(table(spark, folder, "all_chunks")).withColumnRenamed("id", "chunk_id")


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of all_chunks in one form."""
    return unify.unified(table(spark, folder, "all_chunks")).select(F.col("id").alias("chunk_id"), F.col("body").alias("text"))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.repaired(table(spark, folder, "all_chunks"), terms=table(spark, folder, "gazetteer_terms"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _repaired(spark, folder).where(F.size("kinds") > 0)
    return found.select(F.col("id").alias("chunk_id"), F.explode("kinds").alias("kind")).distinct()


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of all_chunks as continuous paragraphs."""
    return _repaired(spark, folder).select(F.col("id").alias("chunk_id"), F.col("body").alias("text"), "kinds")


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that p5 compares."""
    return scan_repair.repaired(table(spark, folder, "all_chunks"), terms=table(spark, folder, "gazetteer_terms"), join_lines=False)


def _sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the repaired texts; the texts never leave the task that repairs them."""
    then = (near_copies.sketch, near_copies.sketch_schema)
    return scan_repair.repaired(table(spark, folder, "all_chunks"), terms=table(spark, folder, "gazetteer_terms"), join_lines=False, then=then)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies.similar_pairs(_sketched(spark, folder))
    return found.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its class of equal words, its group and the links of its class."""
    return near_copies.groups(*near_copies.similar_classes(_sketched(spark, folder))).withColumnRenamed("id", "chunk_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.token_ids(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document decoded from its ids, beside the stored text (empty where null)."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = encode.decoded(encode.token_ids(docs, "doc_id", "text"), spark)
    both = docs.join(back.select(F.col("id").alias("doc_id"), F.col("text").alias("back")), "doc_id")
    return both.select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = encode.token_totals(docs, "doc_id", "text")
    return staged(docs.select(F.col("doc_id").alias("id"), "source").join(sizes, "id"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The targets that the mix does not reach though every document of the source is in it as often as it may be."""
    return p8_shares(spark, folder).where("short").select("mix_name", "source")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix with the number of their copies."""
    return mixture.mixed(_sizes(spark, folder), table(spark, folder, "mix_plans"), table(spark, folder, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixture.report(_sizes(spark, folder), table(spark, folder, "mix_plans"), table(spark, folder, "mix_targets"))


def _private(spark: SparkSession, folder: str) -> DataFrame:
    return private.found_in(table(spark, folder, "documents"), table(spark, folder, "clinic_people"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _private(spark, folder).select(F.col("id").alias("doc_id"), F.explode("found").alias("f"))
    return found.select("doc_id", F.col("f.kind").alias("kind")).distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return private.redacted(_private(spark, folder)).withColumnRenamed("id", "doc_id")


_CLEAN = "trim(regexp_replace(lower(x), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
_RECORDS = "r as (select chunk_id, any_value(herbs) herbs, any_value(diseases) diseases, any_value(doshas_mentioned) doshas_mentioned from all_chunks group by chunk_id)"


def _items(fields: list[str]) -> str:
    return " union all ".join(f"select chunk_id, '{f}' as field, {_CLEAN} as term from (select chunk_id, unnest({f}) as x from r) where x is not null and {_CLEAN} <> ''" for f in fields)


_PAIRS = f"""with {_RECORDS}, i as (select distinct chunk_id, field || ':' || term as item from ({_items(TAGS)})), n as (select item, count(*) as n from i group by item),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from i a join i b on a.chunk_id = b.chunk_id and a.item < b.item group by 1, 2),
c as (select item_a, item_b, n_ab, x.n as n_a, y.n as n_b from p join n x on x.item = item_a join n y on y.item = item_b)"""
_COUNTS = f"""with {_RECORDS}, i as ({_items(["herbs", "diseases"])}), c as (select field, term, count(*) as total, count(distinct chunk_id) as records from i group by 1, 2),
t as (select *, case when records <= 3 then 'rare' when records > 0.15 * (select count(*) from r) then 'common' else 'useful' end as use from c)"""

#: What SQL can say over whole tables.
ORACLE = {
    "p1_counts": f"{_PAIRS} select * from c",
    "p1_found": f"{_PAIRS}, k as (select count(*) as n from r) select item_a, item_b from c, k where n_ab >= 4 and n_ab >= 0.001 * k.n and n_ab * k.n >= 2.1 * n_a * n_b",
    "p2_found": f"{_COUNTS} select field, term from t where use <> 'useful'",
    "p2_terms": f"{_COUNTS} select * from t",
    "p3_found": r"select distinct chunk_id from all_chunks where length(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ', '')) >= 1024",
}

NAMES = """p1_found p1_pairs p1_counts p2_found p2_terms p2_grams p3_found p3_pieces p3_capped p4_found p4_groups p4_texts p5_found p5_groups p6_found p6_texts
p7_ids p7_round_trip p8_found p8_mix p8_shares p9_found p9_redacted"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES.split()}


def oracle_sql() -> dict[str, str]:
    return ORACLE
