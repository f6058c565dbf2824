"""Sends this package to the executors, so that Python workers anywhere can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_sluiceway_sent", False):
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="sluiceway-")) / "sluiceway_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(target))
        sc._sluiceway_sent = True
