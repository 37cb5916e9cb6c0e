"""Region features over an event stream: windows of event time, late pixels up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import FEATURES, region_properties


def windowed_regions(
    pixels: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", features: tuple[str, ...] = FEATURES,
) -> DataFrame:
    """Features per window and label. The state is one row of sums per open window and region; it goes when the watermark passes."""
    timed = pixels.withWatermark(time, late).withColumn("window", F.window(time, every))
    return region_properties(timed, ("window", "label"), features)
