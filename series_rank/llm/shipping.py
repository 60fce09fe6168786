"""Makes this library importable on the executors of a session that was not started with it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, as --py-files would.

    The archive lies with the driver, which serves it to the executors itself.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="series_rank-")
    os.makedirs(f"{folder}/package")
    shutil.copytree(package, f"{folder}/package/series_rank", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/series_rank", "zip", f"{folder}/package"))
    _SHIPPED.add(sc.applicationId)
