"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="lodestrata-src-"), "lodestrata-src.zip")  # read by the driver alone, which serves it
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
