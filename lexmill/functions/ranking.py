"""Global row numbers and running totals without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """`df` with its 0-based place in the order of `order`, which must be unique. Rows are range-partitioned and sorted; each partition counts its own
    rows, and only the counts (one row a partition) are summed up."""
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, place))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def running_total(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """`df` with the sum of `value` over all rows before it in the order of `order`, which must be unique. Rows are range-partitioned; each range sums up
    its own rows, and only the sums of ranges (one row a range) are summed up."""
    rows = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_n"))
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col(name)).drop("_part", "_start")
