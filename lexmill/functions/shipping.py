"""Gives the executors this package, so that their Python workers can import it wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parents[1]
    fd, path = tempfile.mkstemp(prefix=f"{home.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, p.relative_to(home.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
