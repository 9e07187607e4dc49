"""Keeping an index of records: stable ids, last-wins upserts, batches, versions and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.ranking import numbered
from lexmill.functions.staging import staged

#: Most repeated ids that every task may be given.
REPEATED = 200_000


def point_id(name: Column, namespace: uuid.UUID) -> Column:
    """The version 5 UUID of a name, computed in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def upserted(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the greatest version. A combining aggregate, so a key of a third of all rows is reduced before the shuffle; ties go to the
    greatest row. Array and struct columns compare element by element."""
    others = [c for c in rows.columns if c not in (key, version)]
    packed = F.max_by(F.struct(*rows.columns), F.struct(F.col(version), *others)).alias("r")
    return rows.groupBy(F.col(key).alias("_k")).agg(packed).select("r.*")


def upsert_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): batches of `size` rows in key order, numbered from 0 over the whole table. Keys must be unique."""
    return numbered(rows.select(key), key).select(key, F.floor(F.col("row_no") / size).cast("bigint").alias("batch"))


def publish(df: DataFrame, spark: SparkSession, folder: str, alias: str, version: str) -> str:
    """Writes a version of an index and points the view `alias` at it once it is whole. A version that exists is not overwritten."""
    path = f"{folder}/{alias}-{version}"
    df.write.mode("errorifexists").parquet(path)
    if spark.catalog.tableExists(alias) and not any(t.name == alias and t.isTemporary for t in spark.catalog.listTables()):
        raise ValueError(f"{alias} is a table")
    spark.read.parquet(path).createOrReplaceTempView(alias)
    return path


def ensured(spark: SparkSession, path: str, schema: str, force: bool = False) -> DataFrame:
    """The collection at `path`; an empty one of this schema where there is none, or anew with `force`. Running it again changes nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def verified(df: DataFrame, expected: int) -> DataFrame:
    """One row (n, expected, same): the count after a write against what was sent."""
    return df.agg(F.count("*").alias("n")).select("n", F.lit(expected).cast("bigint").alias("expected"), (F.col("n") == expected).alias("same"))


def once(rows: DataFrame, id: str) -> DataFrame:
    """`rows` with one row an id. Rows whose id is not repeated stay where they are: where few ids are, every task is told these, and only their rows go
    between tasks; else all rows do."""
    again = staged(rows.groupBy(F.col(id).alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), 1)
    if again.count() > REPEATED:
        return rows.dropDuplicates([id])
    same = F.col(id).eqNullSafe(F.col("_again"))
    told = F.broadcast(again)
    return rows.join(told, same, "left_anti").unionByName(rows.join(told, same, "left_semi").dropDuplicates([id]))
