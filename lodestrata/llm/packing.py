"""Harmonic packing of documents into fixed-length token sequences.

A length l belongs to class j = capacity // l, and a bin of class j takes exactly j pieces, so no bin is
ever searched: each worker keeps one open bin per class and fills it, independently of all others. Plain
harmonic packing wastes up to 1/(j+1) of a bin; as documents may be cut, a remainder that would waste more
than ``capacity / tolerance`` is cut at the next smaller class size first. Lengths under capacity / classes
share the last class, which is filled next-fit. What is left in open bins when a worker's input ends (at
most classes * (classes + 1) / 2 pieces) is packed first-fit decreasing.

Nulls and empty texts are documents of one token (the end id). Repeated rows are separate documents. No
shuffle is needed; a lost task is run again over the same split and gives the same sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, CLASSES, TOLERANCE, END_ID = 2048, 64, 64, 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
]


def load_encoder(tokenizer_path: str, ranks_path: str | None):
    """A function from a text to its ids. With the same vocabulary as ranks, the faster library gives the same ids."""
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: own.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def cuts(n: int, capacity: int = CAPACITY, classes: int = CLASSES, tolerance: int = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if j >= classes or capacity - j * rest <= capacity // tolerance:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= capacity // (j + 1)
    return out


class Bins:
    """The open bins of one worker. add() and close() return the pieces of bins that are complete."""

    def __init__(self, worker: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next_id, self.capacity, self.classes = worker << 33, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.small = 0

    def _done(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        length = len(piece[2]) // 4
        j = min(self.capacity // length, self.classes)
        pieces, full = self.open.setdefault(j, []), []
        if j == self.classes:
            if self.small + length > self.capacity:
                full, self.open[j], self.small = self._done(pieces), [], 0
                pieces = self.open[j]
            self.small += length
            pieces.append(piece)
            return full
        pieces.append(piece)
        if len(pieces) == j:
            del self.open[j]
            return self._done(pieces)
        return []

    def close(self) -> list[tuple]:
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -len(p[2]))
        bins: list[list] = []
        for piece in left:
            n = len(piece[2]) // 4
            spot = next((b for b in bins if b[0] + n <= self.capacity), None)
            if spot is None:
                bins.append(spot := [0, []])
            spot[0] += n
            spot[1].append(piece)
        self.open, self.small = {}, 0
        return [row for _, pieces in bins for row in self._done(pieces)]


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, *, end_id: int = END_ID, capacity: int = CAPACITY,
    classes: int = CLASSES, tolerance: int = TOLERANCE,
) -> DataFrame:
    """One row per piece: its document, first token there, ids (little-endian unsigned 32-bit), sequence and offset."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer_path, ranks_path)
        bins, rows, held = Bins(TaskContext.get().partitionId(), capacity, classes), [], 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (encode(text).tobytes() if (text := text.as_py()) else b"") + end
                total, at = len(ids) // 4, 0
                for n in cuts(total, capacity, classes, tolerance):
                    rows += bins.add((doc, at, ids[4 * at : 4 * (at + n)], total))
                    at += n
                held += len(ids)
                if held > 4 << 20:
                    if rows:
                        yield table(rows)
                    rows, held = [], 0
        rows += bins.close()
        if rows:
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
