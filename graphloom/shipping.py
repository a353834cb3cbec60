"""Gives the executors this package, whatever their Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")
    path = os.path.join(folder, "graphloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("graphloom", os.path.relpath(full, HERE)))
    sc.addPyFile(path)
    sc._graphloom_shipped = True
