"""SimHash near-duplicates through a binary trie self-join.

A document's fingerprint has a bit set where over half of its 3-word shingles' hashes have it. Documents with
the same fingerprint are one class from the start; only distinct fingerprints are joined. With a budget of k
differing bits, two linked fingerprints agree wholly in one of k + 1 bit blocks, so each fingerprint goes to
k + 1 groups, keyed by block and its bits. Inside a task the fingerprints of a group, rotated so that the
block comes first, are a sorted array whose ranges are the nodes of a binary trie. Node pairs walk down it
together, level by level and many at once; differing bits add up, and a pair is dropped as soon as they
exceed the budget. A task keeps the links it finds as a union-find forest and returns one link per
fingerprint, never all pairs; components over all groups follow.

No words: fingerprint zero, linked like any other. Null texts have no words. A null doc_id takes part with its
fingerprint; it is never a component_id unless all ids of the component are null. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

SHINGLE, SEED, BUDGET, BITS = 3, 42, 2, 64
_CHUNK, _PAIRS = 1 << 16, 1 << 20


def fingerprint(text: str | bytes, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    raw = text if isinstance(text, bytes) else text.encode()
    words = raw.lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(size, len(words))
    starts, stops = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        hashes = np.array(
            [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)],
            "<u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


class Forest:
    """Union-find over 0..n-1, many links at once; the root of a tree is its smallest node."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            roots = self.roots()
            ra, rb = roots[a], roots[b]
            if not (new := ra != rb).any():
                return
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_join(values: np.ndarray, fixed: int, budget: int) -> np.ndarray:
    """Roots (positions) of sorted distinct uint64 values linked when they agree in the first ``fixed`` bits and differ in at most ``budget`` others."""
    forest, n = Forest(len(values)), len(values)
    head = values >> np.uint64(BITS - fixed) if fixed else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if n else np.zeros(0, np.int64)
    hi = np.append(lo[1:], n)
    many = hi - lo > 1
    stack = [(fixed, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    while stack:  # depth first, so that few node pairs are held at once
        depth, a, b, c, d, err = stack.pop()
        if len(a) > _PAIRS:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, err))), (depth, *(x[half:] for x in (a, b, c, d, err)))]
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            x, y = a[leaf], c[leaf]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            forest.link(x[near], y[near])
            a, b, c, d, err = (z[~leaf] for z in (a, b, c, d, err))
        if not len(a) or depth == BITS:
            continue
        bit = np.uint64(BITS - 1 - depth)
        middle = lambda p: np.searchsorted(values, (values[p] >> bit | np.uint64(1)) << bit)  # noqa: E731  first value of the node's right child
        m, k = np.minimum(middle(a), b), np.minimum(middle(c), d)
        same = a == c
        parts = [
            (a, m, c, k, err), (m, b, k, d, err),  # equal bits
            (a, m, k, d, err + 1), tuple(z[~same] for z in (m, b, c, k, err + 1)),  # a node met with itself gives its children's pair once
        ]
        a, b, c, d, err = (np.concatenate(z) for z in zip(*parts, strict=True))
        keep = (b > a) & (d > c) & (err <= budget) & ~((a == c) & (b - a == 1))
        stack.append((depth + 1, *(z[keep] for z in (a, b, c, d, err))))
    return forest.roots()


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the budget + 1 blocks."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp, enough to connect all that are connected."""
    cut = blocks(budget)
    rotated = [F.struct(F.lit(i).alias("block"), (F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at)) if at else F.col("fp")).alias("turned")) for i, (at, _) in enumerate(cut)]
    spread = distinct.select(F.explode(F.array(*rotated)).alias("r")).select("r.block", "r.turned")
    widths = F.element_at(F.array(*[F.lit(BITS - w) for _, w in cut]), F.col("block") + 1)
    spread = spread.withColumn("head", F.call_function("shiftrightunsigned", "turned", widths))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if not held:
            return
        block, turned = (np.concatenate([f[c].to_numpy() for f in held]) for c in ("block", "turned"))
        for i, (at, width) in enumerate(cut):
            values = np.unique(turned[block == i].view(np.uint64))
            root = trie_join(values, width, budget)
            moved = np.flatnonzero(root != np.arange(len(values)))
            back = (values >> np.uint64(at) | values << np.uint64(BITS - at) if at else values).view(np.int64)
            if len(moved):
                yield pd.DataFrame({"a": back[moved], "b": back[root[moved]]})

    return spread.repartition("block", "head").select("block", "turned").mapInPandas(work, "a long, b long")


def grouped_prints(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root): the components of the distinct fingerprints in column fp that have a link. Links are written first, as each round of the components reads them several times."""
    found = materialise(links(distinct, budget).distinct(), "simhash-found")
    return components(found, "simhash-links").withColumnsRenamed({"node": "fp"})


def classes(marked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of a written table (doc_id, fp)."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = grouped_prints(distinct.select("fp"), budget)
    homes = distinct.join(linked, "fp")
    least = homes.groupBy("root").agg(F.min("least").alias("component_id"))
    mapped = distinct.join(linked.join(least, "root"), "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    # written, so that both sides of the last join are plain exchanges, of which a frequent fingerprint's can be split
    return marked.join(materialise(mapped, "simhash-classes"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = classes(materialise(fingerprints(docs, size), "simhash"), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
