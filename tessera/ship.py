"""Sends this package to the executors, once per application."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _done:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = os.path.join(tempfile.mkdtemp(prefix="tessera"), "tessera")
        spark.sparkContext.addPyFile(shutil.make_archive(out, "zip", root, "tessera"))
        _done.add(app)
