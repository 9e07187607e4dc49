"""Text volumes, JSON lines and JSON documents as tables; ordered stitching of parts; what is still to be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def volumes(spark: SparkSession, path: str, pattern: str = "*.txt", encoding_errors: bool = True) -> DataFrame:
    """(name, text): whole text files by name. With encoding_errors bytes that are no UTF-8 become U+FFFD, else the read fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    if not encoding_errors:
        return files.select(name.alias("name"), F.decode("content", "UTF-8").alias("text"))
    return files.select(name.alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def artifact_folders(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(dir, files): the folders below `path` that hold every required file, with the sorted names of all their files. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    folders = found.groupBy("dir").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return folders.where(F.size(F.array_except(F.array(*map(F.lit, required)), "files")) == 0)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row a line under a fixed schema; a line that is no JSON fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One document a file, searched through all folders below `path`, with the folder's name in `dir`; documents that are no JSON are left out."""
    broken = "_broken"
    rows = spark.read.schema(StructType(schema.fields).add(broken, "string")).json(path, multiLine=True, recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken)
    return rows.withColumn("dir", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)).where(F.col(broken).isNull()).drop(broken)


def page_ranges(volumes: DataFrame, name: str, pages: str, size: int = 15) -> DataFrame:
    """(name, part, first, last, part_name): fixed ranges of pages, 1-based and inclusive, the last one short."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.col(pages), F.lit(1)), F.lit(size)))
    rows = volumes.where(F.col(pages) > 0).select(F.col(name).alias("name"), F.col(pages).alias("n"), starts.alias("first"))
    rows = rows.withColumn("last", F.least(F.col("first") + size - 1, F.col("n"))).withColumn("part", F.floor((F.col("first") - 1) / size).cast("int") + 1)
    return rows.select("name", "part", "first", "last", F.format_string("%s_part%03d_p%04d-%04d", "name", "part", "first", "last").alias("part_name"))


def pending(wanted: DataFrame, done: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """What has no output yet, so that a run can be taken up again; the `first` so many by key, where given."""
    left = wanted.join(done.select(key), key, "left_anti")
    return left if first is None else left.orderBy(key).limit(first)


def stitched(parts: DataFrame, volume: str, order: str, label: str, text: str) -> DataFrame:
    """(volume, n, text): the parts of each volume in order, each under a separator line with its label. A volume is one text, so its parts are one row."""
    block = F.concat(F.lit("\n\n========== "), F.col(label), F.lit(" ==========\n\n"), F.coalesce(text, F.lit("")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return parts.groupBy(F.col(volume).alias("volume")).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x.b), "").alias("text"))
