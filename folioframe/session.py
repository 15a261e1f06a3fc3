"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="folioframe-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for file in sorted(root.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                archive.write(file, str(Path(root.name) / file.relative_to(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
