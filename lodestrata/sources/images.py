"""Image sources: files of 8- and 16-bit grey pictures, and vectors as small pictures.

Spark's own image reader keeps the low byte only of 16-bit pictures, so files are read with ``binaryFile`` and decoded here:
PGM (binary), PNG (grey, not interlaced) and TIFF (one grey plane in strips, uncompressed or deflate). Anything else, colour and
stacks included, is an error that names the file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, height int, width int, depth int, pixels array<double>"


def read_pgm(data: bytes) -> np.ndarray:
    head = re.match(rb"P5(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("not a binary PGM")
    w, h, most = map(int, head.groups())
    return np.frombuffer(data, ">u2" if most > 255 else "u1", w * h, head.end()).reshape(h, w)


def read_png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    if colour != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only grey PNG of 8 or 16 bits that isn't interlaced")
    step = depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(int)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0).ravel()
        elif kind in (3, 4):
            done = np.zeros(w * step, int)
            for i in range(w * step):
                a, b, c = (done[i - step] if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                done[i] = (line[i] + guess) & 255
            line = done
        out[y] = above = (line & 255).astype(np.uint8)
    return out.view(">u2").reshape(h, w) if step == 2 else out


def read_tiff(data: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    first = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[first : first + 2])[0]):
        at = first + 2 + 12 * i
        tag, kind, n = struct.unpack(order + "HHI", data[at : at + 8])
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size:
            at = at + 8 if n * size <= 4 else struct.unpack(order + "I", data[at + 8 : at + 12])[0]
            tags[tag] = struct.unpack(f"{order}{n}{ {1: 'B', 2: 'H', 4: 'I'}[size]}", data[at : at + n * size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, depth, packing = one(256, 0), one(257, 0), one(258, 1), one(259, 1)
    if one(277, 1) != 1 or depth not in (8, 16) or packing not in (1, 8, 32946) or 273 not in tags or one(317, 1) != 1:
        raise ValueError("only TIFF with one grey plane of 8 or 16 bits in strips, uncompressed or deflate")
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    body = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
    return np.frombuffer(body, order + "u2" if depth == 16 else "u1", w * h).reshape(h, w)


def write_tiff(image: np.ndarray) -> bytes:
    """A grey picture (uint8 or uint16) as a little-endian TIFF in one strip."""
    h, w = image.shape
    body = image.astype("<u2" if image.dtype.itemsize == 2 else "u1").tobytes()
    tags = [
        (256, 4, w), (257, 4, h), (258, 3, 8 * image.dtype.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1),
        (278, 4, h), (279, 4, len(body)),
    ]
    body += b"\0" * (len(body) % 2)
    entries = b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def decode(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return read_tiff(data)
    if data[:2] == b"P5":
        return read_pgm(data)
    raise ValueError("not a PGM, PNG or TIFF")


def decode_images(files: DataFrame) -> DataFrame:
    """(path, content) as binaryFile gives them, to (path, height, width, depth in bits, pixels)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    image = decode(bytes(content))
                except (ValueError, KeyError, struct.error, zlib.error, TypeError) as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pd.DataFrame({
                    "path": [path], "height": [image.shape[0]], "width": [image.shape[1]], "depth": [8 * image.dtype.itemsize],
                    "pixels": [image.astype(float).ravel()],
                })

    return files.select("path", "content").mapInPandas(work, SCHEMA)


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return decode_images((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def encode_tiff(images: DataFrame, depth: int = 16) -> DataFrame:
    """(image_id, height, width, pixels of 8 or 16 bits) to (path, content), as if read from files."""
    kind = {8: np.uint8, 16: np.uint16}[depth]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [write_tiff(np.asarray(p, kind).reshape(h, w)) for p, h, w in zip(frame["pixels"], frame["height"], frame["width"], strict=True)]
            yield pd.DataFrame({"path": frame["image_id"].map(lambda i: f"{i}.tif"), "content": made})

    return images.select("image_id", "height", "width", "pixels").mapInPandas(work, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """(path, content) as files of those names in a folder that all executors see: a path, or a URI of a file system that Arrow knows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..plans.handoff import file_system

        system, base = file_system(folder)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with system.open_output_stream(f"{base}/{path}") as out:  # written again, the same, if a task is repeated
                    out.write(bytes(content))
            yield frame[["path"]]

    files.select("path", "content").mapInPandas(work, "path string").write.format("noop").mode("overwrite").save()


def from_vectors(vectors: DataFrame, height: int = 8, width: int = 8, low: float = -0.6, high: float = 0.6) -> DataFrame:
    """Vectors of height * width components as pictures with values from 0 to 1. Null vectors and those of another length are no such pictures and are left out."""
    fit = vectors.filter(F.size("embedding") == height * width)
    scaled = F.transform("embedding", lambda v: (v.cast("double") - low) / (high - low))
    return fit.select(F.col("vec_id").alias("image_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), scaled.alias("pixels"))


def events_as_regions(events: DataFrame) -> DataFrame:
    """Events as pixels of regions: one region per user, hour by a property, with the event's value."""
    return events.select(
        F.col("user_id").alias("label"), F.hour("ts").alias("y"), F.get_json_object("props", "$.k").cast("int").alias("x"),
        "value",
    )
