"""Incremental ingest: new rows are taken up as they arrive, each once, and windowed counts wait for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.staging import new_path


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now into the shared folder, with exactly-once output, and reads the result."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "400 days") -> DataFrame:
    """Rows whose key was not seen before within the watermark; re-appended rows are dropped as they come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, *by: str, late: str = "0 seconds") -> DataFrame:
    """(start, *by, n): tumbling counts, emitted once the watermark has passed a window's end."""
    window = F.window(time, width).alias("w")
    return stream.withWatermark(time, late).groupBy(window, *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
