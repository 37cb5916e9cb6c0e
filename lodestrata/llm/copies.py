"""One document of each group of near copies: the SimHash trie join and MinHash bands find candidates, exact Jaccard similarity decides.

All is of 5-word shingles. Fingerprints that the trie join of ``simhash`` connects (BUDGET differing bits) are candidates of each
other. By itself that misses most near copies: at a similarity of 0.8 two fingerprints differ in about ten of 64 bits, and block
groups for so wide a budget would hold nearly all pairs. So the bands of ``paragraphs`` add candidates, a document being one
paragraph. All candidates are checked exactly, and texts of equal words are one class from the start. Texts of under SHINGLE
words have one shingle, so they are near only what equals them; texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import materialise, whole_row
from .components import components
from .paragraphs import _BLANK, _LOWER, _NO_DOC, LINE, SHINGLE, THRESHOLD, Marker, _links, tune
from .rolling import grouped, identity, mix

BUDGET = 3
BLOCK = 256  # whole documents are held to each other, so fewer at once than lines


def whole(marker: Marker, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2 and the code points of each text of a buffer; the texts that have shingles, and their band keys."""
    one, two = marker.hashers
    blank, edge = _BLANK[data], np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    last = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    lower = _LOWER[data]
    s1, s2 = (h.sums_of(h.of(h.sums(lower), first, last)) for h in (one, two))
    at = np.searchsorted(first, bounds)
    a, b = at[:-1], at[1:]
    size = mix((b - a).astype(np.uint64))
    down = np.minimum(a, max(len(first) - 1, 0))  # a text without words may stand behind the last word
    h1, h2 = ((np.where(b > a, h.of(s, down, np.maximum(b, down)), np.uint64(0)) if len(first) else np.zeros(len(a), np.uint64)) for h, s in ((one, s1), (two, s2)))
    points = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[bounds])
    sized = np.flatnonzero(b - a >= SHINGLE)
    if not len(sized):
        return h1 ^ size, h2 + size, points, sized, np.zeros((0, marker.bands), np.uint64)
    counts = b[sized] - a[sized] - SHINGLE + 1
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    each = np.repeat(a[sized] - starts, counts) + np.arange(counts.sum())
    return h1 ^ size, h2 + size, points, sized, marker.signatures(one.of(s1, each, each + SHINGLE), starts)


def marks(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, in the form of ``paragraphs.paragraphs``."""
    bands, rows = tune(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(bands, rows)
        for batch in batches:
            ids, th = batch.column(0).fill_null(_NO_DOC), batch.column(1)
            for at, stop, data, bounds in grouped(batch):
                h1, h2, points, sized, keys = whole(marker, data, bounds)
                n = stop - at
                ends = np.zeros(n + 1, np.int32)
                ends[sized + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                whole_texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                prints = np.array([simhash.fingerprint(x, SHINGLE) for x in whole_texts], np.uint64).view(np.int64)
                arrays = [
                    ids[at:stop], th[at:stop], pa.array(np.full(
                        n, LINE, np.int8,
                    )), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.array(np.zeros(n, np.int32)), pa.array(points.astype(np.int32)), lists, pa.array(prints),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "kind", "h1", "h2", "start", "end", "bands", "fp"])

    return identity(docs).mapInArrow(
        work, "doc_id long, th long, kind byte, h1 long, h2 long, start int, end int, bands array<long>, fp long",
    )


def _by_fingerprint(budget: int):
    """Candidates (h1, h2, bucket): texts whose fingerprints are equal, or connected by the trie join."""

    def of(texts: DataFrame) -> DataFrame:
        prints = texts.select("fp").distinct()
        roots = simhash.grouped_prints(prints, budget)
        found = texts.select("h1", "h2", "fp").join(roots, "fp", "left")
        return found.select("h1", "h2", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("bucket"))

    return of


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """The documents, with all columns, less all but one row of each component of near copies: that of the smallest doc_id, then the least text hash. Rows without doc_id are held to each other only, and one of them stays besides."""
    marked = materialise(marks(docs, threshold), "copies")
    linked = components(
        materialise(_links(marked, docs, threshold, block, _by_fingerprint(budget)), "copies-links").distinct(),
        "copies-components",
    )
    nameless = (F.col("doc_id") == _NO_DOC).alias("nameless")
    # written combined, so that a text with very many copies is one row in the join
    least = marked.groupBy("h1", "h2", nameless).agg(F.min(F.struct("doc_id", "th")).alias("least"))
    least = materialise(least.withColumn("node", F.concat(F.hex("h1"), F.lit(":"), F.hex("h2"))), "copies-least")
    homes = least.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = homes.groupBy("root", "nameless").agg(F.min("least").alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.th").alias("th"))
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("id"), F.xxhash64(raw).alias("th"))
    nth = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.xxhash64("row")))
    return keyed.join(kept, ["id", "th"], "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
