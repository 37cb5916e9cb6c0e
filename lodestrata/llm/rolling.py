"""Rolling hashes and window minima over buffers that hold many texts, for the substring operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def digests(data: bytes, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each data[start:end] with its shape, as two arrays of signed 64. XXH3 has none of the equal pairs that sums modulo 2**64 have (Thue-Morse strings, for one)."""
    from xxhash import xxh3_128_digest

    made = b"".join([xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(made, "<u8").reshape(-1, 2)
    return mix(both[:, 0] ^ mix(shape)).view(np.int64), mix(both[:, 1] + shape).view(np.int64)


class Hasher:
    """Hashes of any substring of a buffer from prefix sums: sum of T[byte] * B**i over the substring, times B**-start, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 20, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Of bytes."""
        return self.sums_of(self.table[data])

    def sums_of(self, values: np.ndarray) -> np.ndarray:
        """Of 64-bit values, which stand for themselves."""
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = self._powers(self.base, n), self._powers(self.inverse, n)
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[: n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def least_leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, leftmost of several, in each window of ``width``: block prefix and suffix minima."""
    n = len(values)
    keys = (values & ~np.uint64((1 << 32) - 1)) | np.arange(n, dtype=np.uint64)  # buffers have less than 2**32 positions
    pad = -n % width
    blocks = np.concatenate((keys, np.full(pad, np.uint64((1 << 64) - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & np.uint64((1 << 32) - 1)).astype(np.int64)


def identity(docs: DataFrame) -> DataFrame:
    """doc_id, the hash that tells rows of one doc_id apart, and the text's bytes."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"),
    ).select("doc_id", F.xxhash64("raw").alias("th"), "raw")


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last + 1, their texts as one buffer, bounds) in runs of about _CHUNK bytes."""
    column = batch.column(batch.schema.get_field_index("raw"))
    at = 0
    while at < len(column):
        parts, size, stop = [], 0, at
        while stop < len(column) and (not parts or size < _CHUNK):
            parts.append(column[stop].as_buffer())
            size += len(parts[-1])
            stop += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        yield at, stop, data, np.cumsum([0, *map(len, parts)])
        at = stop
