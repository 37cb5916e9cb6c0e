"""Image operators. An image is a row: image_id, height, width and its values row by row.

Smoothing and quantising are built-in array functions on that row, so images never shuffle. For pictures of many pixels
the same steps exist as NumPy over Arrow batches (``smooth_binary``, ``clahe``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATE = 4.0


def kernel(sigma: float, truncate: float = TRUNCATE) -> list[float]:
    """A normalised Gaussian over whole offsets up to truncate * sigma."""
    radius = int(truncate * sigma + 0.5)
    weights = [exp(-0.5 * (d / sigma) ** 2) if sigma else 1.0 for d in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def _pass(values: Column, along_rows: bool, weights: list[float]) -> Column:
    """One direction of a separable filter, edges repeated."""
    radius = len(weights) // 2
    h, w = F.col("height"), F.col("width")

    def at(i: Column, d: int) -> Column:
        y, x = F.floor(i / w).cast("int"), i % w
        y, x = (y, F.least(F.greatest(x + d, F.lit(0)), w - 1)) if along_rows else (F.least(F.greatest(y + d, F.lit(0)), h - 1), x)
        return F.get(values, y * w + x)

    return F.transform(
        F.sequence(F.lit(0), h * w - 1),
        lambda i: sum((at(i, d) * weights[d + radius] for d in range(-radius, radius + 1)), F.lit(0.0)),
    )


def smooth(images: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing of the column ``pixels`` (array<double>)."""
    weights = kernel(sigma)
    # an image's rows are computed once for the second direction
    once = F.get(F.transform(F.array(_pass(F.col("pixels"), False, weights)), lambda v: _pass(v, True, weights)), F.lit(0))
    return images.withColumn("pixels", once)


def quantise(images: DataFrame) -> DataFrame:
    """Values from 0 to 1 as whole numbers from 0 to 255, cut off, not rounded."""
    return images.withColumn("pixels", F.transform("pixels", lambda v: F.floor(v * 255).cast("int")))


def to_pixels(images: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, more columns, value), one row per pixel; pictures without pixels give none."""
    # The outer form, as the plain one adds a filter on the array, which would be computed once more, below a repartition.
    each = images.select("image_id", "width", *more, F.posexplode_outer("pixels").alias("i", "value")).filter("i IS NOT NULL")
    y, x = F.floor(F.col("i") / F.col("width")).cast("int"), (F.col("i") % F.col("width")).cast("int")
    return each.select("image_id", y.alias("y"), x.alias("x"), *more, "value")


def smooth_array(image: np.ndarray, sigma: float) -> np.ndarray:
    weights = np.array(kernel(sigma))
    radius = len(weights) // 2
    for axis in (0, 1):
        padded = np.pad(image, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = np.lib.stride_tricks.sliding_window_view(padded, len(weights), axis=axis) @ weights
    return image


def equalise(image: np.ndarray, clip_limit: float = 0.03, tile: tuple[int, int] | None = None, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an image with values from 0 to 1.

    Each tile's histogram is cut at the limit, what is cut off is dealt evenly over its bins, and its cumulative sum is
    the tile's mapping; a pixel's value comes from the four nearest tiles' mappings, bilinearly. Tiles are an eighth of each axis unless given.
    """
    h, w = image.shape
    th, tw = tile or (max(1, h // 8), max(1, w // 8))
    low, high = image.min(), image.max()
    level = np.zeros(image.shape, int) if high == low else np.minimum(((image - low) / (high - low) * bins).astype(int), bins - 1)
    ny, nx = -(-h // th), -(-w // tw)
    padded = np.pad(level, ((0, ny * th - h), (0, nx * tw - w)), mode="symmetric")
    tiles = padded.reshape(ny, th, nx, tw).swapaxes(1, 2).reshape(ny * nx, th * tw)
    counts = np.stack([np.bincount(t, minlength=bins) for t in tiles]).astype(float)
    limit = max(1.0, clip_limit * th * tw)
    for _ in range(16):
        over = np.maximum(counts - limit, 0).sum(axis=1, keepdims=True)
        if not over.any():
            break
        counts = np.minimum(counts, limit)
        room = counts < limit
        counts += np.where(room, over / np.maximum(room.sum(axis=1, keepdims=True), 1), 0)
        if not room.any():
            break
    maps = (np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)).reshape(ny, nx, bins)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, ny - 1), np.clip(np.floor(x).astype(int), 0, nx - 1)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    take = lambda a, b: maps[a[:, None], b[None], level]
    return (1 - fy) * ((1 - fx) * take(y0, x0) + fx * take(y0, x1)) + fy * ((1 - fx) * take(y1, x0) + fx * take(y1, x1))


def _each_image(images: DataFrame, f) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [f(np.asarray(p, float).reshape(h, w)).ravel() for p, h, w in zip(frame["pixels"], frame["height"], frame["width"], strict=True)]
            yield frame.assign(pixels=done)

    return images.select("image_id", "height", "width", "pixels").mapInPandas(
        work, "image_id long, height int, width int, pixels array<double>",
    )


def smooth_binary(images: DataFrame, sigma: float = 1.0) -> DataFrame:
    return _each_image(images, lambda a: smooth_array(a, sigma))


def clahe(images: DataFrame, clip_limit: float = 0.03, tile: tuple[int, int] | None = None) -> DataFrame:
    return _each_image(images, lambda a: equalise(a, clip_limit, tile))
