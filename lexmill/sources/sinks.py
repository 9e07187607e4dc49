"""Writing tables as JSON lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_json_documents(df: DataFrame, folder_column: str, path: str) -> None:
    """One folder of JSON a value of `folder_column`, written by the executors."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != folder_column])).alias("value")
    df.select(F.col(folder_column), body).write.mode("overwrite").partitionBy(folder_column).text(path)


def replace_columns(df: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """`df` with the columns of `fresh` in place of its own, matched by key; rows that `fresh` lacks keep theirs. Running it again changes nothing."""
    mine = [c for c in fresh.columns if c != key]
    renamed = fresh.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in mine])
    joined = df.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in mine else F.col(c) for c in df.columns])
