"""One row of features per labelled region, from pixel rows (label, y, x, value); y is the row axis, x the column axis.

Moments are plain population moments of pixel centres, without a term for the pixel's own extent. All features but solidity are
built-in aggregates, combined before the shuffle. Solidity needs a convex hull, which depends only on the
first and last pixel of each row of a region: these are aggregated first, so the hull step sees two points per row
however many pixels a region has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features that can be asked for, in output order.
FEATURES = ("area", "centroid_y", "centroid_x", "eccentricity", "mean_intensity", "max_intensity", "major_axis_length", "minor_axis_length")


def _axes() -> tuple[Column, Column]:
    """The eigenvalues of a region's covariance matrix, larger first."""
    vy, vx, c = F.var_pop("y"), F.var_pop("x"), F.covar_pop("y", "x")
    root = F.sqrt(4 * c * c + (vx - vy) * (vx - vy))
    return (vy + vx + root) / 2, F.greatest((vy + vx - root) / 2, F.lit(0.0))


def region_properties(pixels: DataFrame, keys: tuple[str, ...] = ("label",), features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Pixels with label 0 or less are background."""
    large, small = _axes()
    made = {
        "area": F.count("*"), "centroid_y": F.avg("y"), "centroid_x": F.avg("x"),
        "eccentricity": F.when(large > 0, F.sqrt(F.greatest(1 - small / large, F.lit(0.0)))).otherwise(0.0),
        "mean_intensity": F.avg("value"), "max_intensity": F.max("value"), "major_axis_length": 4 * F.sqrt(large), "minor_axis_length": 4 * F.sqrt(small),
    }
    return pixels.filter(F.col("label") > 0).groupBy(*keys).agg(*[made[f].alias(f) for f in features])


def _chain(points: list[tuple[int, float]]) -> tuple[list[int], list[float]]:
    """The upper concave chain over points of rising first and any second coordinate."""
    ys: list[int] = []
    xs: list[float] = []
    for y, x in points:
        while len(ys) > 1 and (ys[-1] - ys[-2]) * (x - xs[-2]) >= (xs[-1] - xs[-2]) * (y - ys[-2]):
            ys.pop()
            xs.pop()
        ys.append(y)
        xs.append(x)
    return ys, xs


def _edge(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row from the first to the last, how far the hull around the pixels' edge midpoints reaches to the right."""
    # In half rows: a pixel's midpoints stand half a row above and below it, and half a column to its right.
    y = np.concatenate((2 * rows - 1, 2 * rows, 2 * rows + 1))
    x = np.concatenate((ends, ends + 0.5, ends)).astype(float)
    order = np.lexsort((-x, y))
    y, x = y[order], x[order]
    outer = np.concatenate(([True], y[1:] != y[:-1]))
    ys, xs = _chain(list(zip(y[outer].tolist(), x[outer].tolist(), strict=True)))
    return np.interp(2 * np.arange(rows[0], rows[-1] + 1), ys, xs)


def hull_area(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> int:
    """Pixels whose centres lie in or on the hull around the pixels' edge midpoints; rows are rising, first and last their ends."""
    rows, first, last = (np.asarray(a, np.int64) for a in (rows, first, last))
    right, left = _edge(rows, last), -_edge(rows, -first)
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def region_solidity(pixels: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """area (distinct pixels), convex_area and solidity per region. A region is one row of its rows' ends, and a batch has many regions."""
    spans = pixels.filter(F.col("label") > 0).select(*keys, "y", "x").distinct()
    spans = spans.groupBy(*keys, "y").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("n"))
    ends = F.array_sort(F.collect_list(F.struct("y", "first", "last")))
    whole = spans.groupBy(*keys).agg(F.sum("n").alias("area"), ends.alias("ends"))
    types = dict(whole.dtypes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            convex = [hull_area(*z) for z in zip(f["y"], f["first"], f["last"], strict=True)]
            yield f[[*keys, "area"]].assign(convex_area=np.array(convex, np.int64), solidity=f["area"] / np.array(convex))

    each = whole.select(*keys, "area", *[F.col("ends")[c].alias(c) for c in ("y", "first", "last")])
    return each.mapInPandas(work, ", ".join(f"{k} {types[k]}" for k in keys) + ", area long, convex_area long, solidity double")
