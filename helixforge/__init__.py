"""A Spark-native engine for context-aware correction of short DNA reads."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package's code to the executors, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="helixforge-code-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    copy = os.path.join(tmp, "code", "helixforge")
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "helixforge"), "zip", os.path.join(tmp, "code")))
