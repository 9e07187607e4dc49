"""Controlled-vocabulary tagging: whole-word forms of a vocabulary in folded text, by a join on the word instead of one pattern a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold


def tagged(texts: DataFrame, id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(id, category, canonical), distinct: terms of which a form stands in the text as a whole word, a plural s allowed.

    vocabulary: (category, canonical, form). Tokens are made distinct per text before the join, so a frequent form costs one row a text. A form that is
    no single word is sought by its first word and then checked in the texts that hold that.
    """
    folded = texts.select(F.col(id).alias("id"), fold(F.col(text)).alias("t"))
    words = folded.select("id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("word"))
    forms = vocabulary.select("category", "canonical", fold(F.col("form")).alias("form")).where("form <> ''").distinct()
    single = forms.where(F.col("form").rlike(r"^[\p{L}\p{N}_]+$"))
    both = single.unionByName(single.withColumn("form", F.concat("form", F.lit("s")))).distinct()
    found = words.join(both.withColumnRenamed("form", "word"), "word").select("id", "category", "canonical")
    longer = forms.where(~F.col("form").rlike(r"^[\p{L}\p{N}_]+$")).withColumn("word", F.regexp_extract("form", r"([\p{L}\p{N}_]+)", 1))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "form", F.lit(r"\Es?(?![\p{L}\p{N}_])"))
    asked = words.join(longer, "word").join(folded, "id").where(F.regexp_like("t", pattern)).select("id", "category", "canonical")
    return found.unionByName(asked).distinct()


def combinations(texts: DataFrame, id: str, text: str, tags: DataFrame, order: list[str], dual: list[str], all_three: list[str], three: str = "tri") -> DataFrame:
    """(id, combination): pairs named outright (a-b or ab), the pair of a text with exactly two of `order` and a `dual` word, and `three` for `all_three`
    words; a plural s is allowed."""
    words = F.array_distinct(F.regexp_extract_all(fold(F.col(text)), F.lit(r"([\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*)"), F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.split(w, "-"), F.regexp_extract_all(w, F.lit("(?=((?:^|(?<=-))[^-]+-[^-]+))"), F.lit(1))))))
    rows = texts.select(F.col(id).alias("id"), F.explode(parts).alias("w"))
    stem = F.regexp_replace("w", "s$", "")
    has = lambda forms: F.col("w").isin(forms) | stem.isin(forms)
    named = F.when(has(all_three), three).when(has(dual), "dual")
    for a, b in ((a, b) for i, a in enumerate(order) for b in order[i + 1 :]):
        named = named.when(has([f"{a}-{b}", a + b]), f"{a}-{b}")
    marks = rows.select("id", named.alias("combination")).where("combination is not null").distinct()
    two = tags.where(F.col("canonical").isin(order)).groupBy("id").agg(F.collect_set("canonical").alias("s")).where(F.size("s") == 2)
    two = two.select("id", F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains("s", x)), "-").alias("pair"))
    resolved = marks.where("combination = 'dual'").join(two, "id").select("id", F.col("pair").alias("combination"))
    return marks.where("combination <> 'dual'").unionByName(resolved).distinct()


def histogram(tags: DataFrame) -> DataFrame:
    """(category, canonical, n): texts by term."""
    return tags.groupBy("category", "canonical").agg(F.count("*").alias("n"))


def top_terms(tags: DataFrame, k: int) -> DataFrame:
    """(category, canonical, n, place): the k most frequent terms of each category, ties by name."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "canonical"))
    return histogram(tags).withColumn("place", place).where(F.col("place") <= k)


def unused(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(category, canonical): terms of the vocabulary that no text holds."""
    return vocabulary.select("category", "canonical").distinct().join(tags, ["category", "canonical"], "left_anti")


def coverage(texts: DataFrame, id: str, tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(category, texts_tagged, texts, terms_used, terms): how far each category reaches."""
    used = tags.groupBy("category").agg(F.count_distinct("id").alias("texts_tagged"), F.count_distinct("canonical").alias("terms_used"))
    size = vocabulary.groupBy("category").agg(F.count_distinct("canonical").alias("terms"))
    total = texts.agg(F.count_distinct(id)).first()[0]
    rows = size.join(used, "category", "left").withColumn("texts", F.lit(total))
    return rows.select("category", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("texts_tagged", "terms_used", "terms", "texts")])


def untagged(texts: DataFrame, id: str, tags: DataFrame) -> DataFrame:
    """(untagged, texts, share): texts without any tag; the share of no texts is null."""
    marks = texts.select(F.col(id).alias("id")).distinct().join(tags.select("id", F.lit(1).alias("hit")).distinct(), "id", "left")
    return marks.agg(F.count_if(F.col("hit").isNull()).alias("untagged"), F.count("*").alias("texts")).withColumn("share", F.round(F.try_divide("untagged", "texts"), 6))


def tag_columns(texts: DataFrame, id: str, tags: DataFrame, combined: DataFrame, order: list[str]) -> DataFrame:
    """(id, doshas_mentioned, dosha_combinations, herbs, diseases): the tags of every text as arrays, empty where there are none; doshas in `order`, the
    others by name. combined: (id, combination)."""
    every = texts.select(F.col(id).alias("id")).distinct()
    of = lambda category: F.array_sort(F.collect_set(F.when(F.col("category") == category, F.col("canonical"))))
    rows = tags.groupBy("id").agg(of("doshas").alias("d"), of("herbs").alias("herbs"), of("diseases").alias("diseases"))
    pairs = combined.groupBy("id").agg(F.array_sort(F.collect_set("combination")).alias("c"))
    none = F.array().cast("array<string>")
    doshas = F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(F.coalesce("d", none), x))
    rows = every.join(rows, "id", "left").join(pairs, "id", "left")
    return rows.select("id", doshas.alias("doshas_mentioned"), F.coalesce("c", none).alias("dosha_combinations"), *[F.coalesce(c, none).alias(c) for c in ("herbs", "diseases")])
