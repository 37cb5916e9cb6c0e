"""Sinks for feedback documents."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(documents: DataFrame) -> DataFrame:
    """One row per document, its text indented."""
    return documents.select("label", F.to_json(F.struct(*documents.columns), {"pretty": "true"}).alias("document"))


def write_file(documents: DataFrame, folder: str, label: str) -> str:
    """The run's one document as feedback_{label}.json in a folder of the driver's machine, which is made if missing; an older one is replaced."""
    target = Path(folder) / f"feedback_{label}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(as_json(documents).first()["document"] + "\n", encoding="utf-8")
    return str(target)


def write_many(documents: DataFrame, path: str) -> None:
    """Many runs' documents, partitioned by label, on any file system."""
    documents.write.mode("overwrite").partitionBy("label").json(path)
