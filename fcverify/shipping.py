"""Sends this package to the executors, so that functions run whatever folder the driver was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the application's Python path, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as made:
            for path in sorted(PACKAGE.rglob("*.py")):
                made.write(path, path.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        _sent.add(context.applicationId)
    return spark
