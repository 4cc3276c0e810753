"""Lets Python workers import this package wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tidepanel

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    The archive is made in the driver's temporary folder and served by Spark; executors keep their
    own copy and fetch it again when they are replaced.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(tidepanel.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tidepanel.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tidepanel", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
