"""Makes the package importable on Python workers of any cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application; the session is returned."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root, work = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="hushgrid-ship-")  # executors may fetch it at any time
        atexit.register(shutil.rmtree, work, True)
        shutil.copytree(root, os.path.join(work, "tree", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(work, root.name), "zip", os.path.join(work, "tree")))
    return spark
