"""Feedback documents: the selected regions as records, and one nested document per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records that a document may hold.
MAX_RECORDS = 100_000
CELL_FIELDS = ("label", "centroid_x", "centroid_y", "area", "mean_intensity", "eccentricity")


def cells(selected: DataFrame) -> DataFrame:
    """One record per selected region."""
    kinds = {"label": "int", "area": "long"}
    return selected.select(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in CELL_FIELDS])


def document(
    records: DataFrame, counted: DataFrame, label: str, feature: str, percentile: float, threshold: float | None, at: str,
) -> DataFrame:
    """One row: criteria, counts and records in order of label. More than MAX_RECORDS records are an error: keep them as a table."""
    if records.limit(MAX_RECORDS + 1).count() > MAX_RECORDS:
        raise ValueError(f"over {MAX_RECORDS} records: they are no document for a person; write the records as a table")
    body = records.agg(F.count("*").alias("n_selected"), F.array_sort(F.collect_list(F.struct(*CELL_FIELDS))).alias("cells"))
    criteria = F.struct(
        F.lit(feature).alias("feature"), F.lit(float(percentile)).alias("percentile"),
        F.lit(threshold).cast("double").alias("threshold"),
    )
    facts = [F.lit(at).alias("datetime"), F.lit(label).alias("label"), criteria.alias("selection_criteria")]
    # both sides are one row, of MAX_RECORDS records at most
    return counted.join(F.broadcast(body)).select(*facts, "n_selected", F.col("n_cells").alias("n_total"), "cells")


def report(records: DataFrame) -> DataFrame:
    """A line of text per record, null where one of its values is null.

    Made in Python, as its "%.1f", like SQL's printf, rounds the exact binary value, ties to even; Spark's format_string rounds
    the shortest decimal, half up (11.25 to 11.3, 49.15 to 49.2).
    """

    def line(label, x, y, area):
        if None in (label, x, y, area):
            return None
        return f"label={label:3d}  pos=({x:.1f}, {y:.1f})  area={area}px"

    return records.select("label", F.udf(line, "string")("label", "centroid_x", "centroid_y", "area").alias("line"))
