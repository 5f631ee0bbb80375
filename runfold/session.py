"""Session helpers: shipping this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application.

    Python functions that run in tasks import from this package, and a cluster's executors
    need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="runfold-ship-")
    copy = Path(folder, "src", home.name)
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", copy.parent, home.name))
    shutil.rmtree(copy.parent)
    _SHIPPED.add(context.applicationId)
