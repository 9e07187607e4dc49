"""Cutting lineage through the folder that all executors share.

A staged DataFrame is written once as parquet and read back, so that later stages
neither recompute it nor depend on an executor that may be lost. Staged tables are
compressed and columnar, which makes them smaller than an RDD checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only a local master may leave it unset (tests on one machine), for a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", "") or ""
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses; `release` deletes it."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, files: int | None = None) -> DataFrame:
    """`df`, written to the shared folder and read back. files: at most so many part files (small tables)."""
    path = new_path(df.sparkSession, "staged")
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes every staged table of this driver. DataFrames that were built on them must have been written by then. Runs when the driver ends, too."""
    while _staged:
        spark, path = _staged.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; what it left is named by the folder alone
            pass
    for path in _own:
        import shutil

        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _own.clear()


atexit.register(release)
