"""Substring dedup by paragraph MinHash: passages that documents share, exactly or nearly.

Paragraphs are of two kinds. ``line``: a line of at least min_words words; the query takes SHINGLE, the least that has a shingle. ``passage``: PASSAGE words from an anchor on,
the anchor being the least hash of 3 neighbouring words, leftmost of several, in any ANCHOR such triples; anchors depend on the
words alone, so of any ANCHOR + PASSAGE - 1 = 51 words that two documents share, wherever they stand in their lines, the same
passage is taken from both. Words are split at ASCII blanks, A-Z in lower case; shingles are 5 words.

1. One pass hashes words, shingles and paragraphs, and MinHash bands of lines. Equal paragraphs are one class
   from the start (a class's MinHash would agree in every band); passages need no more than that.
2. Different lines that collide in a band are linked if their exact Jaccard similarity is at least THRESHOLD. Buckets
   with the same members are verified once. A bucket is verified inside one task, keeping a forest, so that members
   already linked aren't compared again. In buckets over BLOCK members, all are held to one pivot first; those that are like it
   are connected, and only the others are dealt out in blocks against all members, so that a large group of near copies takes
   a number of comparisons in proportion to its size, and no link is lost. Bands are tuned: the most rows per band whose
   recall at THRESHOLD is at least RECALL.
3. Components over the links make clusters. A cluster counts if it has paragraphs of two documents at least; in the
   first (the smallest doc_id, nulls last) its first paragraph stays, and all others are removed. Equal
   passages that overlap in their document, as in a run of one word, are one.
4. Documents of a cluster are linked to its first; components over these links are the classes of documents.

``repeated`` has a row for each document with such a paragraph and none for the others; ``every`` has all rows. Null and empty texts have no
paragraphs; rows of one doc_id are one document, however often repeated. Spans are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, materialise_at, release, shuffles_removed
from .components import components
from .rolling import Hasher, grouped, identity, least_leftmost, mix

SHINGLE, THRESHOLD, RECALL, MAX_BANDS = 5, 0.8, 0.99, 9
MIN_WORDS, TRIPLE, ANCHOR, PASSAGE, BLOCK = 40, 3, 20, 32, 2048
LINE, PASSAGE_KIND = 0, 1
DEALS = 3  # bands are shuffled in so many parts, one after the other; each bucket is whole in one of them
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_NO_DOC = (1 << 63) - 1


def tune(threshold: float = THRESHOLD, recall: float = RECALL, bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows per band that finds pairs at the threshold with the recall, in at most ``bands`` bands, and the fewest bands for it."""
    fits = [(b, r) for r in range(1, 17) for b in range(1, bands + 1) if 1 - (1 - threshold**r) ** b >= recall]
    rows = max(r for _, r in fits)
    return min(b for b, r in fits if r == rows), rows


class Marker:
    """Paragraphs of a buffer of texts."""

    def __init__(self, bands: int, rows: int, min_words: int = MIN_WORDS):
        self.hashers = Hasher(20240511), Hasher(20240613)
        self.bands, self.rows, self.min_words = bands, rows, max(min_words, SHINGLE)
        self.factors = np.random.default_rng(20240717).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band keys of the shingle runs that begin at ``starts``."""
        out = np.zeros((len(starts), self.bands), np.uint64)
        for i, factor in enumerate(self.factors):
            band = i // self.rows
            out[:, band] = mix(out[:, band] * np.uint64(31) + np.minimum.reduceat(shingles * factor, starts) + np.uint64(band + 1))
        return out

    def mark(self, data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """doc, kind, h1, h2, start, end (code points in the document), and the lines' band keys."""
        blank = _BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True  # words end with their document
        inside = ~blank
        first = np.flatnonzero(inside & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
        last = np.flatnonzero(inside & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
        none = np.zeros(0, np.int64)
        if not len(first):
            return {k: none for k in ("doc", "kind", "h1", "h2", "start", "end")}, np.zeros((0, self.bands), np.uint64)
        lower = _LOWER[data]
        one, two = self.hashers
        w1, w2 = one.of(one.sums(lower), first, last), two.of(two.sums(lower), first, last)
        s1, s2 = one.sums_of(w1), two.sums_of(w2)
        doc = np.searchsorted(bounds, first, side="right") - 1
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        line = np.cumsum(data == 10)[first]
        n = len(first)
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))))
        stop = np.append(new[1:], n)
        long = stop - new >= self.min_words
        la, lb = new[long], stop[long]
        # shingles of the long lines, one run per line
        sizes = lb - la - SHINGLE + 1
        at = np.repeat(la - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        bands = self.signatures(
            one.of(s1, at, at + SHINGLE), np.concatenate(([0], np.cumsum(sizes)[:-1])),
        ) if len(la) else np.zeros((0, self.bands), np.uint64)
        # passages: their windows and themselves inside one document
        ends = np.searchsorted(first, bounds[1:])  # each document's last word + 1
        pa_ = none
        if n >= ANCHOR + TRIPLE - 1:
            triple = np.arange(n - TRIPLE + 1)
            anchor = least_leftmost(one.of(s1, triple, triple + TRIPLE), ANCHOR)
            begin = np.arange(len(anchor))
            anchor = np.unique(anchor[begin + ANCHOR + TRIPLE - 1 <= ends[doc[begin]]])
            pa_ = anchor[anchor + PASSAGE <= ends[doc[anchor]]]
        a, b = np.concatenate((la, pa_)), np.concatenate((lb, pa_ + PASSAGE))
        kind = np.repeat([LINE, PASSAGE_KIND], [len(la), len(pa_)])
        d = doc[a]
        size = mix((b - a).astype(np.uint64) * np.uint64(2) + kind.astype(np.uint64))
        base = points[bounds[d]]
        p = {
            "doc": d, "kind": kind, "h1": (one.of(s1, a, b) ^ size).view(np.int64),
            "h2": (two.of(s2, a, b) + size).view(np.int64), "start": points[first[a]] - base, "end": points[last[b - 1]] - base,
        }
        lines, passages = ({k: v[part] for k, v in p.items()} for part in (slice(0, len(la)), slice(len(la), None)))
        return {k: np.concatenate((lines[k], v)) for k, v in self.joined(passages).items()}, bands

    @staticmethod
    def joined(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Equal passages of a document that overlap, as in a run of one word, as one."""
        if not len(p["doc"]):
            return p
        order = np.lexsort((p["start"], p["h2"], p["h1"], p["doc"]))
        p = {k: v[order] for k, v in p.items()}
        new = np.concatenate((
            [True], np.any([p[k][1:] != p[k][:-1] for k in ("doc", "h1", "h2")], axis=0) | (p["start"][1:] > p["end"][:-1]),
        ))
        at = np.flatnonzero(new)
        return {k: v[at] for k, v in p.items()} | {"end": p["end"][np.append(at[1:], len(new)) - 1]}


def paragraphs(docs: DataFrame, bands: int, rows: int, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph: doc_id (nulls as the largest long), th, kind, h1, h2, start, end, and the band keys of lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(bands, rows, min_words)
        for batch in batches:
            ids, th = batch.column(0).fill_null(_NO_DOC).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for at, _, data, bounds in grouped(batch):
                p, keys = marker.mark(data, bounds)
                n, m = len(p["doc"]), len(keys)
                if not n:
                    continue
                row = at + p["doc"]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate((np.arange(m + 1), np.full(n - m, m))).astype(np.int32) * bands),
                    pa.array(keys.ravel().view(np.int64)),
                )
                arrays = [
                    pa.array(ids[row]), pa.array(th[row]), pa.array(p["kind"].astype(np.int8)), pa.array(p["h1"]),
                    pa.array(p["h2"]), pa.array(p["start"].astype(np.int32)), pa.array(p["end"].astype(np.int32)), lists,
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "kind", "h1", "h2", "start", "end", "bands"])

    return identity(docs).mapInArrow(work, "doc_id long, th long, kind byte, h1 long, h2 long, start int, end int, bands array<long>")


def shingles(text: str) -> set[bytes]:
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similar(bodies: list[str], sides: list[bool] | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A forest of links between positions whose exact Jaccard similarity is at least the threshold; given sides, only pairs across them are compared."""
    sets = [shingles(x) for x in bodies]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, met = [], {}
    for i, own in enumerate(sets):
        for r, members in list(met.items()):
            if r not in met or root(r) == root(i):
                continue
            for j in members:
                if sides and sides[i] == sides[j]:
                    continue
                other = sets[j]
                if min(len(own), len(other)) < threshold * max(len(own), len(other)):
                    continue
                both = len(own & other)
                if both >= threshold * (len(own) + len(other) - both) - 1e-12:
                    links.append((i, j))
                    parent[root(i)] = root(j)
                    break
        mine = [i]
        for r in [r for r in met if root(r) == root(i)]:
            mine += met.pop(r)
        met[root(i)] = mine
    return links


def _links(
    marked: DataFrame, docs: DataFrame, threshold: float, block: int, more: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(a, b): links between different lines, named by their hashes. more: from the table of lines, further candidates (h1, h2, bucket)."""
    lines = marked.filter(F.col("kind") == LINE).groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in marked.columns if c not in (
        "kind", "h1", "h2",
    )])
    spark = docs.sparkSession
    lines, lines_at = materialise_at(lines, "paragraph-lines")
    banded = lines.select("h1", "h2", F.posexplode("bands").alias("band", "key"))
    deals = [
        banded.filter(F.col("band") % DEALS == i).select("h1", "h2", F.xxhash64("band", "key").alias("bucket")) for i in range(DEALS)
    ]
    if more:
        deals.append(more(lines))
    buckets = [materialise_at(keyed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor("h1").alias("x"), F.sum(F.shiftright("h2", 16)).alias("s"),
    ).filter("n > 1"), "paragraph-buckets") for keyed in deals]
    # buckets with the same members, of whichever band, need one look
    kept = reduce(DataFrame.union, [b for b, _ in buckets]).groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"),
    )
    kept = materialise(kept, "paragraph-kept")
    for _, path in buckets:
        drop_table(spark, path)
    members = reduce(DataFrame.union, [materialise(keyed.join(kept, "bucket"), "paragraph-members") for keyed in deals])
    wanted = lines.join(members.select("h1", "h2").distinct(), ["h1", "h2"]).select("doc_id", "th", "h1", "h2", "start", "end")
    gathered = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h1", "h2", "start", "end")).alias("ws"))
    d = identity(docs).select(
        F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc_id"), "th", F.col("raw").cast("string").alias("text"),
    ).filter("text <> ''")
    body = F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    bodies = gathered.join(d, ["doc_id", "th"]).select(F.explode("ws").alias("w"), "text").select("w.h1", "w.h2", body.alias("body"))
    bodies = materialise(bodies.dropDuplicates(["h1", "h2"]), "paragraph-bodies")
    drop_table(spark, lines_at)
    dealt = members.filter("parts = 1").select("bucket", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("side"), "h1", "h2")
    hot = members.filter("parts > 1")
    if hot.isEmpty():
        return _verified(dealt, bodies, threshold)
    near, rest = _pivots(hot, bodies, threshold)
    return _verified(dealt.union(_crossed(hot, rest, block)), bodies, threshold).union(near)


_NAME = "concat(hex(h1), ':', hex(h2))"


def _pivots(hot: DataFrame, bodies: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Holds each member of a large bucket to the bucket's pivot, its least member: the links to pivots, and the members (bucket, h1, h2) that have none."""
    pivots = hot.groupBy("bucket").agg(F.min(F.struct("h1", "h2")).alias("p")).select("bucket", "p.*").join(bodies, ["h1", "h2"])
    pivots = pivots.select("bucket", F.expr(_NAME).alias("pivot"), F.col("body").alias("other"))

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, two: pa.Array) -> pa.Array:
        sets: dict[str, set[bytes]] = {}
        out = []
        for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True):
            if b not in sets:
                sets = {b: shingles(b)}
            own, other = shingles(a), sets[b]
            both = len(own & other)
            out.append(both >= threshold * (len(own) + len(other) - both) - 1e-12)
        return pa.array(out, pa.bool_())

    tested = hot.select("bucket", "h1", "h2").join(bodies, ["h1", "h2"]).join(pivots, "bucket")
    tested = materialise(
        tested.select("bucket", "h1", "h2", "pivot", alike.asNondeterministic()("body", "other").alias("near")),
        "paragraph-pivots",
    )
    found = tested.filter("near").select(F.expr(_NAME).alias("a"), F.col("pivot").alias("b")).filter("a <> b")
    return found, tested.filter("NOT near").select("bucket", "h1", "h2")


def _crossed(hot: DataFrame, rest: DataFrame, block: int) -> DataFrame:
    """Tasks (bucket, i, j) that hold block i of the members without a link to the pivot (side) to block j of all members: those with such a link are connected already."""
    open_ = rest.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("open"))
    sized = hot.join(open_, "bucket")
    place = lambda n: F.pmod(F.xxhash64("h1", "h2"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_ = sized.select("bucket", every("open").alias("i"), place("parts").alias("j"), F.lit(False).alias("side"), "h1", "h2")
    few = sized.join(rest, ["bucket", "h1", "h2"]).select(
        "bucket", place("open").alias("i"), every("parts").alias("j"), F.lit(True).alias("side"), "h1", "h2",
    )
    return all_.union(few)


def _verified(dealt: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """Links inside tasks (bucket, i, j); tasks with i >= 0 hold one side to the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: tuple | None = None
        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            found = similar([h[2] for h in held], [h[0] for h in held] if task[1] >= 0 else None, threshold)
            return pa.RecordBatch.from_arrays(
                [pa.array(
                    [held[z][1] for z in c], pa.string(),
                ) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 2,
                ["a", "b"],
            )

        for batch in batches:
            for *key, side, node, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if task is not None and tuple(key) != task:
                    yield table()
                    held = []
                task = tuple(key)
                held.append((side, node, body))
        if held:
            yield table()

    dealt = dealt.join(bodies, ["h1", "h2"]).select("bucket", "i", "j", "side", F.expr(_NAME).alias("node"), "body")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
    return dealt.mapInArrow(work, "a string, b string").filter("a <> b")


def repeated(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with a paragraph that another document has too, or nearly: doc_id, component_id (the smallest doc_id of its component over documents that share one), n_paragraphs, n_removed (code points) and the removed spans."""
    with shuffles_removed(docs.sparkSession):
        return _repeated(docs, threshold, block, min_words)


def _repeated(docs: DataFrame, threshold: float, block: int, min_words: int) -> DataFrame:
    """As ``repeated``. Tables that nothing reads any more are removed at once; the result reads those that stay."""
    marked, marked_at = materialise_at(paragraphs(docs, *tune(threshold), min_words), "paragraphs")
    spark = docs.sparkSession
    release(spark)
    linked = components(materialise(_links(marked, docs, threshold, block), "paragraph-links").distinct(), "paragraph-components")
    release(spark)
    parts = F.split("node", ":")
    unhex = lambda x: F.conv(x, 16, -10).cast("long")
    linked = linked.select(
        unhex(parts[0]).alias("h1"), unhex(parts[1]).alias("h2"), unhex(F.split("root", ":")[0]).alias("r1"),
        unhex(F.split("root", ":")[1]).alias("r2"),
    )
    classes = marked.groupBy("kind", "h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # lines alone can be linked; a class without links is its own cluster
    classes, classes_at = materialise_at(classes, "paragraph-classes")
    near = classes.filter(F.col("kind") == LINE).join(linked, ["h1", "h2"])
    spread = near.groupBy("r1", "r2").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most")
    near = near.select("h1", "h2", "r1", "r2").join(spread, ["r1", "r2"]).select(
        F.lit(LINE).cast("byte").alias("kind"), "h1", "h2", "r1", "r2", "least",
    )
    alone = classes.filter("least < most").join(
        linked.select(F.lit(LINE).cast("byte").alias("kind"), "h1", "h2"), ["kind", "h1", "h2"], "left_anti",
    )
    clusters = materialise(
        near.union(alone.select("kind", "h1", "h2", F.col("h1").alias("r1"), F.col("h2").alias("r2"), "least")),
        "paragraph-clusters",
    )
    drop_table(spark, classes_at)
    found = marked.select("doc_id", "kind", "h1", "h2", "start", "end").join(clusters, ["kind", "h1", "h2"])
    found = materialise(found.select("doc_id", "kind", "r1", "r2", "start", "end", "least"), "paragraph-found")
    drop_table(spark, marked_at)
    release(spark)
    # written, so that a cluster with very many paragraphs can be split when joined
    first = materialise(found.filter("doc_id = least").groupBy("kind", "r1", "r2").agg(F.min("start").alias("first")), "paragraph-first")
    placed = found.join(first, ["kind", "r1", "r2"]).withColumn(
        "stays", (F.col("doc_id") == F.col("least")) & (F.col("start") == F.col("first")),
    )
    each = placed.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"),
        F.array_sort(F.collect_set(F.when(~F.col("stays"), F.struct("start", "end")))).alias("spans"),
    )
    spans = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), _absorb)
    roots = components(
        materialise(found.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct(), "paragraph-shared"),
        "paragraph-documents",
    )
    each = each.join(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "doc_id")
    each = each.select(
        F.when(F.col("doc_id") != _NO_DOC, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("component_id") != _NO_DOC, F.col("component_id")).alias("component_id"), "n_paragraphs",
        spans.alias("spans"),
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return each.select("doc_id", "component_id", "n_paragraphs", removed.alias("n_removed"), "spans")


def _absorb(merged, s):
    last = F.try_element_at(merged, F.lit(-1))
    grown = F.concat(
        F.slice(merged, F.lit(1), F.size(merged) - 1),
        F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
    )
    return F.when((F.size(merged) > 0) & (last["end"] >= s["start"]), grown).otherwise(F.concat(merged, F.array(s)))


def every(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of docs: its row of ``found``, or its own doc_id as component_id, zero counts and no spans."""
    ids, found = docs.select(F.col("doc_id").cast("long").alias("doc_id")), found.withColumnRenamed("doc_id", "_doc")
    none, zero = F.array().cast("array<struct<start:int,end:int>>"), F.lit(0).cast("long")
    joined = ids.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("spans", none).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "component_id", "n_paragraphs", "n_removed", joined.alias("spans"))
