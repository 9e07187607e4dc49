"""Lookups that fail loudly: a key without its row, or with more than one, stops the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `dimension`, in which each key must stand exactly once. The dimension is joined by its count, so a key that is missing or
    doubled raises when its row is read, and rows are never dropped or multiplied."""
    others = [c for c in dimension.columns if c != key]
    held = dimension.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    joined = rows.join(held, key, "left")
    wrong = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" stands "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" times"))
    sound = F.when(F.coalesce("_n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))
    return joined.where(sound).drop("_n")


def one_per(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): raises unless every key has exactly one row."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" is not single"))).cast("boolean")))
