"""Sends this package to executors that cannot import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session, unless the executors find the package by PYTHONPATH. The archive goes when the driver ends."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
