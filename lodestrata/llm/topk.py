"""Exact inner-product top-k: a ball tree per shard, searched by branch and bound with shared thresholds.

Components become floor(256 * x); scores are integers. Near vectors share a shard: median splits along the line between two far
vectors, fitted on a sample of SAMPLE vectors, cut the space into at most LEAVES parts, and every vector goes to its part; a part
of over SHARD_ROWS vectors (copies of one, say) is dealt into several shards by a hash. Each shard's ball tree (splits of the same
kind) is built once and written. For a query q and a node with centre c and radius r, no vector below can score over q.c + |q| r.

1. A query's own shard is the one with the highest such bound at its root. Queries of one shard come in blocks; each block
   is searched there first, and the k-th best score is a threshold that the true k-th score can't be under.
2. Roots, ROOTS to a row, meet the blocks: a shard is left out for a block if the bound of its root is under the thresholds of all the
   block's queries. So only the pairs (block, shard) that are left are moved, as blocks: a tree moves to one task and stays there
   while that shard's blocks stream by. A block goes through a tree's nodes in order of their bound, raising its thresholds as
   better scores come, and leaving out each node (for the queries whose bound is below).
3. The shards' k best are merged per query: higher scores first, ties to the smaller vec_id.

Scores that tie with the threshold are kept, so results are exact, whatever the sample. Vectors that are null, empty, or hold null
or non-finite components, and rows without vec_id, take no part. Only vectors of one length are compared. A repeated row
(same vec_id and vector) counts once; a vec_id with several vectors is a query, and a candidate, with each; rows of the query's own
vec_id are no candidates. Inner products are taken in doubles while every sum must stay under 2**53, else in Python integers;
components and scores beyond 64 bits count as the largest there are.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE, K, EVERY = 256.0, 5, 50
LEAF, SHARD_ROWS, BLOCK_QUERIES = 128, 8192, 512
MOST = 2**63 - 1
#: Vectors that the parts of space are fitted on, parts at most, vector lengths that are fitted (others have one part), and roots to a row.
SAMPLE, LEAVES, FITTED_LENGTHS, ROOTS = 8192, 1024, 8, 1024
MAX_BROADCAST_LENGTHS = 1000


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v, dim): the vectors that take part, v an array of doubles with whole values."""
    xs = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = xs.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(whole)
    return fit.select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("dim"),
    ).distinct()


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data), allow_pickle=False))


def build(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree as arrays: rows in leaf order, and per node its row range, centre, radius and children (-1 at leaves)."""
    order, nodes, stack = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        me, own = len(nodes), v[order[lo:hi]]
        centre = own.mean(axis=0)
        nodes.append([lo, hi, centre, np.sqrt(((own - centre) ** 2).sum(axis=1)).max() * (1 + 1e-9), -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if hi - lo > leaf:
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(split(own)[1], half)]
            stack += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    lo, hi, centre, radius, left, right = zip(*nodes, strict=True)
    return {
        "ids": ids[order], "v": v[order], "lo": np.array(lo), "hi": np.array(hi), "centre": np.array(centre),
        "radius": np.array(radius), "child": np.array([left, right]).T,
    }


def split(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction between two far vectors, and all vectors' places on it."""
    far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    other = own[((own - far) ** 2).sum(axis=1).argmax()]
    return other - far, own @ (other - far)


def cut(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Median splits of a sample into parts: (direction, limit, left, right) by node, with ~part in place of a child that is one. One part: none."""
    nodes: list[list] = []
    stack, parts = [(sample, leaves, -1, 2)], 0
    while stack:
        own, n, parent, side = stack.pop()
        along, place = split(own) if n > 1 and len(own) > 1 else (None, None)
        limit = None if place is None else np.median(place)
        if limit is None or not (left := place < limit).any():
            me, parts = ~parts, parts + 1
        else:
            me = len(nodes)
            nodes.append([along, limit, 0, 0])
            stack += [(own[~left], n - n // 2, me, 3), (own[left], n // 2, me, 2)]
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(x) for x in nodes]


def part_of(v: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The part of each vector."""
    out = np.zeros(len(v), np.int64)
    stack = [(0, np.arange(len(v)))] if nodes else []
    while stack:
        node, rows = stack.pop()
        if node < 0:
            out[rows] = ~node
        elif len(rows):
            along, limit, left, right = nodes[node]
            low = v[rows] @ along < limit
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(v).T
    return np.maximum(np.minimum(exact, MOST), -MOST).astype(np.int64)


class Best:
    """The k best (score, id) of each query of a block, and the score under which nothing is of use."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.query_ids, self.k, self.floor = query_ids, k, floor.copy()
        low = np.iinfo(np.int64).min
        self.scores, self.ids = np.full((len(floor), k), low), np.full((len(floor), k), np.iinfo(np.int64).max)
        self.low = low

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.query_ids[rows, None] == ids[None, :]
        scores = np.where(own, self.low, scores)
        some = ((scores >= self.floor[rows, None]) & ~own).any(axis=1)
        rows, scores = rows[some], scores[some]
        s = np.concatenate((self.scores[rows], scores), axis=1)
        i = np.concatenate(
            (self.ids[rows], np.where(scores == self.low, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))), axis=1,
        )
        pick = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s orders downwards without overflow
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])

    def frame(self) -> pd.DataFrame:
        at, rank = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pd.DataFrame({"nth": at, "query_id": self.query_ids[at], "vec_id": self.ids[at, rank], "score": self.scores[at, rank]})


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no vector within a radius of a centre can score over, with room for rounding: queries by centres."""
    size = np.sqrt((centre**2).sum(axis=1)) + radius
    return q @ centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * (radius + 1e-9 * size) + 1


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of a block, but none that score under floor."""
    best = Best(query_ids, floor, k)
    limit = lambda node, rows: bounds(q[rows], tree["centre"][node : node + 1], tree["radius"][node : node + 1])[:, 0]
    whole = np.arange(len(q))
    heap, n = [(-limit(0, whole).max(), 0, 0, whole)], 1
    while heap:  # the node of the highest bound first
        _, _, node, rows = heapq.heappop(heap)
        rows = rows[limit(node, rows) >= best.floor[rows]]
        if not len(rows):
            continue
        if tree["child"][node, 0] < 0:
            at = slice(tree["lo"][node], tree["hi"][node])
            best.add(rows, tree["ids"][at], _products(q[rows], tree["v"][at]))
            continue
        for child in tree["child"][node]:
            high = limit(child, rows)
            if (near := high >= best.floor[rows]).any():
                heapq.heappush(heap, (-high[near].max(), n, child, rows[near]))
                n += 1
    return best.frame()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "block", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _parts(fit: DataFrame, sizes: list[tuple[int, int]], shard_rows: int) -> DataFrame:
    """fit with the ``part`` of space of each vector. sizes: (dim, vectors) of the lengths to fit."""
    cuts = {}
    for dim, n in sizes:
        # thinned by a hash to about two samples first, so that tasks send the driver no more than that in sum
        own = fit.filter(F.col("dim") == dim).withColumn("h", F.xxhash64("vec_id", "v"))
        own = own.filter(F.pmod("h", F.lit(max(1, n // (2 * SAMPLE)))) == 0).orderBy("h").limit(SAMPLE).select("v").toPandas()
        cuts[dim] = cut(np.stack(own["v"].to_numpy()), min(LEAVES, -(-n // shard_rows))) if len(own) else []

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            part = np.zeros(len(f), np.int64)
            for dim in f["dim"].unique():
                at = np.flatnonzero(f["dim"] == dim)
                if cuts.get(dim):
                    part[at] = part_of(np.stack(f["v"].to_numpy()[at]), cuts[dim])
            yield f.assign(part=part)

    return fit.mapInPandas(work, "vec_id long, v array<double>, dim int, part long")


def _meet(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each block in each shard that it is dealt to: blocks (dim, part, nth_part, block, queries, floors). A tree comes first and its blocks after it, one at a time."""
    shard = ["dim", "part", "nth_part"]
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    rows = trees.select(*shard, F.lit(-1).cast("long").alias("block"), F.col("tree").alias("queries"), none("binary", "floors"))
    both = rows.unionByName(blocks.select(*shard, "block", "queries", "floors")).repartition(*shard).sortWithinPartitions(*shard, "block")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree: dict[str, np.ndarray] = {}
        for f in frames:
            for row in f.itertuples(index=False):
                held = unpacked(row.queries)
                if row.block < 0:
                    tree = held | {"v": held["v"].astype(np.float64)}
                    continue
                floor = np.full(len(held["ids"]), np.iinfo(np.int64).min) if row.floors is None else np.frombuffer(row.floors, np.int64)
                yield search(tree, held["ids"], held["q"].astype(np.float64), floor, k).assign(dim=row.dim, block=row.block)

    return both.mapInPandas(work, "nth long, query_id long, vec_id long, score long, dim int, block long")


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
    leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each vec_id divisible by ``every``."""
    fit = materialise(quantised(vectors), "vectors")
    lengths = fit.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(FITTED_LENGTHS).collect()
    shard = ["dim", "part", "nth_part"]
    parted = materialise(_parts(fit, [(r["dim"], r["n"]) for r in lengths], shard_rows), "vector-parts")
    sized = parted.groupBy("dim", "part").agg(F.ceil(F.count("*") / shard_rows).alias("of"))
    dealt = parted.join(sized, ["dim", "part"]).withColumn("nth_part", F.pmod(F.xxhash64("vec_id", "v"), F.col("of")))

    def plant(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.iloc[np.lexsort((f["v"].map(lambda v: v.tobytes()), f["vec_id"]))]  # the same order whenever it is run
        tree = build(f["vec_id"].to_numpy(), np.stack(f["v"].to_numpy()), leaf)
        centre, radius = tree["centre"][0], tree["radius"][0]
        return pd.DataFrame({
            "dim": [key[0]], "part": [key[1]], "nth_part": [key[2]], "tree": [packed(**tree | {"v": narrow(tree["v"])})],
            "centre": [centre], "radius": [radius],
        })

    schema = "dim int, part long, nth_part long, tree binary, centre array<double>, radius double"
    trees = materialise(dealt.select(*shard, "vec_id", "v").groupBy(*shard).applyInPandas(plant, schema), "trees")

    # roots in pages of ROOTS, numbered by a window over one row per shard and length
    roots = trees.select(*shard, "centre", "radius").withColumn(
        "page", F.floor((F.row_number().over(Window.partitionBy("dim").orderBy("part", "nth_part")) - 1) / ROOTS),
    )
    roots = materialise(roots, "roots")
    pages = roots.groupBy("dim", "page").agg(F.array_sort(F.collect_list(F.struct("part", "nth_part", "centre", "radius"))).alias("roots"))
    pages = materialise(pages, "root-pages")
    paged = materialise(roots.groupBy("dim").agg((F.max("page") + 1).alias("pages")), "root-page-counts")

    def held(page) -> tuple[np.ndarray, ...]:
        return tuple(np.array([r[c] for r in page]) for c in ("part", "nth_part")) + (
            np.stack([r["centre"] for r in page]), np.array([r["radius"] for r in page]),
        )

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The shard of a page whose root has the highest bound, for each query."""
        for f in frames:
            for row in f.itertuples(index=False):
                queries = unpacked(row.queries)
                q = queries["q"].astype(np.float64)
                part, nth, centre, radius = held(row.roots)
                high = bounds(q, centre, radius)
                at = high.argmax(axis=1)
                best = high[np.arange(len(at)), at]
                yield pd.DataFrame({"dim": row.dim, "vec_id": queries["ids"], "v": list(q), "part": part[at], "nth_part": nth[at], "bound": best})

    def gather(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.iloc[np.lexsort((f["v"].map(lambda v: v.tobytes()), f["vec_id"]))]
        queries = packed(ids=f["vec_id"].to_numpy(), q=narrow(np.stack(f["v"].to_numpy())))
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "nth_part": [key[2]], "nth_block": [key[3]], "queries": [queries]})

    def in_blocks(queries: DataFrame) -> DataFrame:
        """(dim, part, nth_part, nth_block, queries): the queries of each shard, block_queries to a row."""
        counted = queries.groupBy(*shard).agg(F.ceil(F.count("*") / block_queries).alias("blocks"))
        numbered = queries.join(counted, shard).withColumn("nth_block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
        made = "dim int, part long, nth_part long, nth_block long, queries binary"
        return numbered.select(*shard, "nth_block", "vec_id", "v").groupBy(*shard, "nth_block").applyInPandas(gather, made)

    def on_pages(blocks: DataFrame) -> DataFrame:
        """The stated queries, in blocks, against all roots, page by page."""
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1))
        return blocks.join(paged, "dim").withColumn("page", each).join(pages, ["dim", "page"])

    asked = fit.filter(F.col("vec_id") % every == 0).withColumns({"part": F.lit(0).cast("long"), "nth_part": F.lit(0).cast("long")})
    asked = on_pages(in_blocks(asked).select("dim", "queries")).select("dim", "queries", "roots")
    asked = asked.mapInPandas(homes, "dim int, vec_id long, v array<double>, part long, nth_part long, bound double")
    first = F.max_by(F.struct("part", "nth_part"), F.struct("bound", "part", "nth_part")).alias("home")
    asked = materialise(asked.groupBy("dim", "vec_id", "v").agg(first).select("dim", "home.*", "vec_id", "v"), "queries")
    blocks = in_blocks(asked)
    name = F.shiftrightunsigned(F.xxhash64(*shard, "nth_block"), 1).alias("block")
    blocks = materialise(blocks.select(*shard, name, "queries"), "query-blocks")
    seeds = materialise(_meet(trees, blocks.withColumn("floors", F.lit(None).cast("binary")), k), "query-seeds")

    def thresholds(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        full = f[f["rank"] == k]
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "nths": [full["nth"].to_numpy()], "scores": [full["score"].to_numpy()]})

    floors = _ranked(seeds, k).select("dim", "block", "nth", "score", "rank").groupBy("dim", "block").applyInPandas(
        thresholds, "dim int, block long, nths array<long>, scores array<long>",
    )
    ready = blocks.withColumnsRenamed({"part": "home", "nth_part": "home_nth"}).join(floors, ["dim", "block"], "left")

    def filled(f: pd.Series, queries: bytes) -> np.ndarray:
        floor = np.full(len(queries["ids"]), np.iinfo(np.int64).min)
        if f.nths is not None:
            floor[f.nths] = f.scores
        return floor

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The shards of a page that a block must go to, beside its own."""
        for f in frames:
            for row in f.itertuples(index=False):
                queries = unpacked(row.queries)
                floor = filled(row, queries)
                part, nth, centre, radius = held(row.roots)
                near = (bounds(
                    queries["q"].astype(np.float64), centre, radius,
                ) >= floor[:, None]).any(axis=0) & ~((part == row.home) & (nth == row.home_nth))
                yield pd.DataFrame({"dim": row.dim, "block": row.block, "part": part[near], "nth_part": nth[near]})

    def packed_floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            floors = [filled(row, unpacked(row.queries)).tobytes() for row in f.itertuples(index=False)]
            yield f[["dim", "block", "queries"]].assign(floors=floors)

    ready = materialise(ready, "query-thresholds")
    pairs = on_pages(ready).select("dim", "block", "home", "home_nth", "queries", "nths", "scores", "roots")
    pairs = pairs.mapInPandas(needed, "dim int, block long, part long, nth_part long")
    pairs = materialise(pairs, "query-pairs")
    moved = pairs.join(ready.mapInPandas(packed_floors, "dim int, block long, queries binary, floors binary"), ["dim", "block"])
    found = _meet(trees.join(pairs.select(*shard).distinct(), shard, "left_semi"), moved, k)
    return _ranked(seeds.union(found), k).select("query_id", "rank", "vec_id", "score")
