"""Making this package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import ledgerwright

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(ledgerwright.__file__))
    with tempfile.TemporaryDirectory() as folder:
        staged = os.path.join(folder, "source", "ledgerwright")
        shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(
            os.path.join(folder, "ledgerwright"), "zip", os.path.dirname(staged)
        )
        kept = shutil.copy(archive, tempfile.mkdtemp(prefix="ledgerwright-source-"))
    context.addPyFile(kept)
    _SHIPPED.add(context.applicationId)
