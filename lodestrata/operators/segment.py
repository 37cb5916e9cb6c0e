"""Segmentation of images into labelled regions.

The default segmenter, "threshold_components", is a plain substitute for a trained model, and not its equal: pixels over
a threshold, in 4-connected components. Another one can be given: a function that is called once per worker and returns a
function from an image array to an array of labels (0: background).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Segmenter = Callable[[np.ndarray], np.ndarray]


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1..n of the 4-connected components of a mask, in the order of their first pixels."""
    n = mask.size
    ids = np.arange(n).reshape(mask.shape)
    across, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    a = np.concatenate((ids[:, :-1][across], ids[:-1][down]))
    b = np.concatenate((ids[:, 1:][across], ids[1:][down]))
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if not (ra != rb).any():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    out = np.zeros(n, np.int32)
    flat = mask.ravel()
    out[flat] = np.unique(root[flat], return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def threshold_components(threshold: float) -> Callable[[], Segmenter]:
    return lambda: lambda image: components(image > threshold)


def segment(images: DataFrame, make: Callable[[], Segmenter]) -> DataFrame:
    """(image_id, y, x, label, value) of all labelled pixels. The segmenter is made once per worker's batch stream."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = make()
        for frame in frames:
            for image_id, h, w, pixels in zip(frame["image_id"], frame["height"], frame["width"], frame["pixels"], strict=True):
                image = np.asarray(pixels, float).reshape(h, w)
                labels = segmenter(image)
                y, x = np.nonzero(labels)
                yield pd.DataFrame({
                    "image_id": image_id, "y": y.astype(np.int32), "x": x.astype(np.int32),
                    "label": labels[y, x].astype(np.int32), "value": image[y, x],
                })

    return images.select("image_id", "height", "width", "pixels").mapInPandas(work, "image_id long, y int, x int, label int, value double")
