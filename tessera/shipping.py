"""Sends this package to the executors, so that Python functions can refer to its modules wherever it is installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; a no-op afterwards."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-package-")
    source = os.path.join(folder, "source")
    shutil.copytree(package, os.path.join(source, package.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessera_package"), "zip", source))
    _SENT.add(sc.applicationId)
