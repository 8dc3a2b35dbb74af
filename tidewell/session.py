"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="tidewell-", suffix=".zip")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(os.path.realpath(path))
    _shipped.add(app)
