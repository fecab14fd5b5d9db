"""Sends this package to the Python workers, which need not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source, zipped, to the session's files once."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="spark-leafworks-")) / "leafworks"
        context.addPyFile(shutil.make_archive(str(target), "zip", root_dir=root, base_dir="leafworks"))
        _SHIPPED.add(context.applicationId)
