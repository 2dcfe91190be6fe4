"""Brings the package to the Python workers of a session that cannot import it otherwise."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; Spark's file server hands the archive to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    tmp = tempfile.mkdtemp(prefix="sievepath-ship-")  # the driver's own; executors fetch from it while the application lives
    atexit.register(shutil.rmtree, tmp, True)
    root = Path(tmp, "root")
    shutil.copytree(package, root / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(tmp, package.name)), "zip", root))
    _shipped.add(app)
