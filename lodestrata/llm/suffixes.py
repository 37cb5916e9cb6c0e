"""Exact substring dedup: maximal repeats from the interval tree of an enhanced suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. To find such strings without
sorting every suffix of the corpus, each window of ``length`` bytes is keyed by its anchor: of the K-byte
strings inside it, the one with the least hash, the leftmost of several. The anchor depends on the window's
bytes alone, so equal windows have equal anchors at equal places. Neighbouring windows of one document with
the same anchor form a segment, the text that they cover; there is about one per (length - K) / 2 bytes.

1. One pass emits each document's segments as hashes. Segments that occur twice or more, whole, are repeats:
   copies are settled here, by counts that are combined before the shuffle.
2. An anchor whose segments differ may still share windows, at the edges of repeats. Only one text of each
   different segment is fetched for these. Segments of an anchor meet in one group. A task puts many groups in one
   buffer, sorts the suffixes that start windows (prefix doubling), computes common prefixes, and scans them with a
   stack: each interval of common prefix >= length whose suffixes have different left neighbours is a maximal
   repeat (within its segments) with all its occurrences; suffixes in any such interval start repeated windows.
3. Repeated starts go back to all occurrences of their segments, and each document's spans are merged.

A group of over GROUP_BYTES is split exactly: its segments are cut by their windows' distance to the anchor into
pieces of STEP windows, keyed by the bytes that all windows of the piece share; then into single windows,
where equal keys mean equal windows and counting settles all. Windows that are equal have the same distance, so
no link is lost.

Texts are UTF-8 bytes; a null text is empty. Rows are told apart by doc_id and a hash of the text, so rows
repeated whole are each other's copies, and null ids are treated like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .rolling import Hasher, digests, grouped, identity, least_leftmost, mix

LENGTH, GROUP_BYTES, BUFFER_BYTES, STEP = 400, 512 << 10, 1 << 20, 16


def segments(data: np.ndarray, bounds: np.ndarray, length: int, hashers: tuple[Hasher, Hasher]) -> dict[str, np.ndarray]:
    """Segments of the documents data[bounds[i]:bounds[i + 1]]: document, first and last window start and anchor (all relative to it), and hashes of anchor and text."""
    k = max(1, length // 3)
    width = length - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {x: none for x in ("doc", "first", "last", "anchor", "key", "h1", "h2")}
    one, two = hashers[0].sums(data), hashers[1].sums(data)
    at = np.arange(len(data) - k + 1)
    anchor = least_leftmost(hashers[0].of(one, at, at + k), width)  # for each window start
    del one
    doc = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
    whole = np.arange(len(anchor)) + length <= bounds[doc + 1]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]))
    first = np.flatnonzero(new & whole)
    edge = np.flatnonzero(np.concatenate(((new | ~whole)[1:], [True])) & whole)  # the last start of each run
    p, d = anchor[first], doc[first]
    end = edge + length
    # the text's name also says where the anchor is and how long the text is
    shape = ((p - first).astype(np.uint64) << np.uint64(32)) | (edge - first).astype(np.uint64)
    h1, h2 = digests(data.tobytes(), first, end, shape)
    return {
        "doc": d, "first": first - bounds[d], "last": edge - bounds[d], "anchor": p - bounds[d],
        "key": mix(hashers[1].of(two, p, p + k)).view(np.int64), "h1": h1, "h2": h2,
    }


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [start, end) with overlapping and touching ones as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(new)
    return starts[at], np.append(ends[at[1:] - 1], ends[-1])


class SuffixArray:
    """The suffixes of several texts at chosen starts, sorted, with the common prefixes of neighbours. A text's end is less than any byte."""

    def __init__(self, texts: list[bytes], starts: np.ndarray, limits: np.ndarray, depth: int):
        joined = b"".join(x + b"\0" for x in texts)
        symbols = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
        symbols[np.cumsum([len(x) + 1 for x in texts]) - 1] = 0
        n = len(symbols)
        padded = np.concatenate((symbols, np.zeros(7, np.uint64)))
        word = np.zeros(n, np.uint64)
        for i in range(7):
            word = word << np.uint64(9) | padded[i : i + n]
        ranks, h = [self._rank(word)], 7
        del word
        while h < depth:
            r = ranks[-1]
            ahead = np.zeros(n, np.int32)
            ahead[: max(0, n - h)] = r[h:]
            ranks.append(self._rank(r.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)))
            h *= 2
        order = np.argsort(ranks[-1][starts], kind="stable")
        self.starts, limit = starts[order], limits[order]
        i, j = self.starts[:-1].copy(), self.starts[1:].copy()
        lcp = np.zeros(len(i), np.int64)
        for r in reversed(ranks):
            same = (np.maximum(i, j) < n) & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
            lcp, i, j = lcp + h * same, i + h * same, j + h * same
            h //= 2
        live = np.ones(len(i), bool)
        for _ in range(6):  # the last words differ
            live &= (np.maximum(i, j) < n) & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
            lcp, i, j = lcp + live, i + live, j + live
        self.lcp = np.minimum(lcp, np.minimum(limit[:-1] - self.starts[:-1], limit[1:] - self.starts[1:]))

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        """Dense ranks from 1 up; rank 0 is what lies beyond the end."""
        order = np.argsort(keys)
        ordered = keys[order]
        out = np.empty(len(keys), np.int32)
        out[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last + 1) of each interval of at least ``least``, inner ones first: the stack scan."""
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return
    stack: list[list[int]] = []
    values = lcp[at].tolist()
    previous = -2
    for p, value in zip(at.tolist(), values, strict=True):
        if p != previous + 1:
            while stack:
                size, first = stack.pop()
                yield size, first, previous + 2
        first = p
        while stack and stack[-1][0] > value:
            size, first = stack.pop()
            yield size, first, p + 1
        if not stack or stack[-1][0] < value:
            stack.append([value, first])
        previous = p
    while stack:
        size, first = stack.pop()
        yield size, first, previous + 2


def maximal_repeats(array: SuffixArray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last + 1) of each interval whose occurrences, array.starts[first:last + 1], differ in their left neighbour (left[start]; -1, unknown, differs from all)."""
    neighbours = left[array.starts]
    change = np.concatenate(([0], np.cumsum((neighbours[1:] != neighbours[:-1]) | (neighbours[1:] < 0))))
    for size, first, stop in intervals(array.lcp, least):
        if change[stop - 1] > change[first]:
            yield size, first, stop


def _hashers() -> tuple[Hasher, Hasher]:
    return Hasher(20240229), Hasher(20240331)


def _mark(docs: DataFrame, length: int) -> DataFrame:
    """One row per distinct segment of a document: hashes, distances and the (first, last) starts of its occurrences there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for batch in batches:
            ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            null = np.asarray(batch.column(0).is_null())
            for at, stop, data, bounds in grouped(batch):
                s = segments(data, bounds, length, hashers)
                if not len(s["doc"]):
                    continue
                order = np.lexsort((s["first"], s["h2"], s["h1"], s["key"], s["doc"]))
                s = {k: v[order] for k, v in s.items()}
                new = np.concatenate(([True], np.any([s[c][1:] != s[c][:-1] for c in ("doc", "key", "h1", "h2")], axis=0)))
                lead = np.flatnonzero(new)
                rows = at + s["doc"][lead]
                offsets = np.append(lead, len(order)).astype(np.int32)
                arrays = [
                    pa.array(
                        np.where(null[rows], 0, ids[rows]).astype(np.int64), mask=null[rows],
                    ), pa.array(th[rows]), pa.array(s["key"][lead]), pa.array(s["h1"][lead]), pa.array(s["h2"][lead]),
                    pa.array((s["last"] - s["first"])[lead].astype(np.int32)), pa.array((s["anchor"] - s["first"])[lead].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(s["first"].astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "key", "h1", "h2", "span", "dist", "firsts"])

    return identity(docs).mapInArrow(work, "doc_id long, th long, key long, h1 long, h2 long, span int, dist int, firsts array<int>")


def _fetch(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds ``body``, the text from ``first`` to ``span`` + length bytes on. A document's wanted segments are gathered first, so that it is read once."""
    fields = [c for c in wanted.columns if c not in ("doc_id", "th")]
    gathered = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("ws"))
    d = identity(docs)
    # rows repeated whole would give each body several times; one is enough
    rows = gathered.join(
        d, gathered["doc_id"].eqNullSafe(d["doc_id"]) & (gathered["th"] == d["th"]),
    ).select(F.explode("ws").alias("w"), "raw")
    return rows.select("w.*", F.substring("raw", F.col("w.first") + 1, F.col("w.span") + length).alias("body"))


class Group:
    """Bodies of one or more keys, one of each, and the array of the suffixes that start windows in them."""

    def __init__(self, held: list[tuple[int, int, int, bytes]], length: int):
        self.names = [n for n in {h[:3]: None for h in held}]
        self.texts = list({h[:3]: h[3] for h in held}.values())
        self.length = length
        sizes = np.array([len(x) for x in self.texts])
        self.bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        starts = np.concatenate([np.arange(a, a + n - length + 1) for a, n in zip(self.bounds, sizes, strict=False)])
        owner = np.searchsorted(self.bounds, starts, side="right") - 1
        self.array = SuffixArray(self.texts, starts, self.bounds[owner] + sizes[owner], int(sizes.max()))
        left = np.concatenate(([-1], np.frombuffer(b"".join(x + b"\0" for x in self.texts), np.uint8)[:-1].astype(np.int16)))
        left[self.bounds[:-1]] = -1
        self.left = left

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        return maximal_repeats(self.array, self.left, self.length)

    def spans(self) -> list[tuple]:
        """(key, h1, h2, spans) of the bodies with repeats: what these cover, merged."""
        starts = self.array.starts
        covered = np.zeros(len(starts), np.int64)
        for size, first, stop in self.repeats():
            np.maximum(covered[first:stop], size, out=covered[first:stop])
        at = np.flatnonzero(covered)
        if not len(at):
            return []
        a, b = merged(starts[at], starts[at] + covered[at])  # bodies are a byte apart, so spans of two never touch
        own = np.searchsorted(self.bounds, a, side="right") - 1
        out: dict[int, list[dict]] = {}
        for o, x, y in zip(own.tolist(), (a - self.bounds[own]).tolist(), (b - self.bounds[own]).tolist(), strict=True):
            out.setdefault(o, []).append({"start": x, "end": y})
        return [(*self.names[o], spans) for o, spans in out.items()]

    def occurrences(self) -> list[tuple]:
        """(key, h1, h2, repeat, size, start) of every occurrence of every maximal repeat; a repeat's name is a hash of its bytes."""
        from xxhash import xxh64_intdigest

        out = []
        for size, first, stop in self.repeats():
            at = self.array.starts[first:stop]
            own = np.searchsorted(self.bounds, at, side="right") - 1
            rel = (at - self.bounds[own]).tolist()
            name = xxh64_intdigest(self.texts[own[0]][rel[0] : rel[0] + size])
            name -= (name >> 63) << 64
            out += [(*self.names[o], name, size, r) for o, r in zip(own.tolist(), rel, strict=True)]
        return out


_SPANS = "array<struct<start:int,end:int>>"
_KEY = [("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
_SHAPES = {
    "spans": (
        "key long, h1 long, h2 long, spans " + _SPANS,
        pa.schema([*_KEY, ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]),
    ),
    "occurrences": (
        "key long, h1 long, h2 long, repeat long, size int, start int",
        pa.schema([*_KEY, ("repeat", pa.int64()), ("size", pa.int32()), ("start", pa.int32())]),
    ),
}


def _repeats(groups: DataFrame, length: int, shape: str = "spans") -> DataFrame:
    """Spans or occurrences of the maximal repeats, from all bodies of a key together: (key, h1, h2, body)."""
    declared, schema = _SHAPES[shape]

    def table(held: list) -> pa.RecordBatch:
        rows = getattr(Group(held, length), shape)()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)],
            schema=schema,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if size > BUFFER_BYTES and row[0] != held[-1][0]:  # groups stay whole
                    yield table(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield table(held)

    # a number of its own, as small partitions that are costly to sort should not be put together
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("key", "h1", "h2", "body").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(work, declared)


def _pieces(bodies: DataFrame, length: int, step: int) -> DataFrame:
    """Cuts bodies into pieces of ``step`` neighbouring windows: (sub, p1, p2, key, h1, h2, rel, size). Equal windows are in pieces of one sub, a hash of the bytes that all windows of such a piece share."""
    names = ["sub", "p1", "p2", "key", "h1", "h2", "rel", "size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for key, h1, h2, dist, span, body in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                data = np.frombuffer(body, np.uint8)
                two = hashers[1].sums(data)
                block = np.arange((dist - span) // step, dist // step + 1)  # of a window's distance to the anchor
                low, high = np.maximum(block * step, dist - span), np.minimum(block * step + step - 1, dist)
                first, end = dist - high, dist - low + length
                shared = dist - block * step
                tail = shared + length - step + 1
                mark = mix(block.astype(np.uint64) ^ np.uint64(key & (1 << 64) - 1))
                sub = mix(hashers[1].of(two, shared, tail) ^ mark).view(np.int64)
                shape = mix(mark ^ (high - low).astype(np.uint64) ^ (high.astype(np.uint64) << np.uint64(32)))
                n = len(block)
                rows.append([sub, *digests(body, first, end, shape), np.full(n, key), np.full(n, h1), np.full(n, h2), first, end - first])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], names)

    return bodies.select("key", "h1", "h2", "dist", "span", "body").mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _split(big: DataFrame, length: int, steps: tuple[int, ...], shape: str) -> DataFrame:
    """The same for groups too large for one task, by ever smaller pieces: (key, h1, h2, spans), or occurrences, where pieces that are equal whole are repeats named by their hash."""
    out = None
    for step in steps:
        pieces = materialise(_pieces(big, length, step), "suffix-pieces")
        kinds = pieces.groupBy("sub", "p1", "p2").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        subs = kinds.groupBy("sub").agg(
            F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("open"), F.sum("size").alias("bytes"),
        )
        settled = pieces.join(
            kinds.filter("n > 1").select("sub", "p1", "p2"), ["sub", "p1", "p2"],
        ).select("key", "h1", "h2", "p1", "size", "rel")
        todo = subs.filter("kinds > 1 AND open > 0")
        small = pieces.join(
            todo.filter(F.col("bytes") <= GROUP_BYTES).select("sub"), "sub",
        ).join(big.select("key", "h1", "h2", "body"), ["key", "h1", "h2"])
        small = small.select(
            "sub", "p1", "p2", "key", "h1", "h2", "rel",
            F.substring("body", F.col("rel").cast("int") + 1, F.col("size").cast("int")).alias("body"),
        )
        small = materialise(small, "suffix-piece-bodies")
        solved = _repeats(
            small.select(F.col("sub").alias("key"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), "body"), length, shape,
        ).withColumnsRenamed({"key": "sub", "h1": "p1", "h2": "p2"})
        solved = small.drop("body").join(solved, ["sub", "p1", "p2"])
        if shape == "spans":
            solved = solved.select("key", "h1", "h2", "rel", F.explode("spans").alias("s")).select(
                "key", "h1", "h2", F.lit(0).cast("long").alias("p1"), F.col("s.end") - F.col("s.start"),
                F.col("rel") + F.col("s.start"),
            )
        else:
            solved = solved.select("key", "h1", "h2", "repeat", "size", F.col("rel") + F.col("start"))
        found = settled.union(solved)
        out = found if out is None else out.union(found)
        rest = pieces.join(todo.filter(F.col("bytes") > GROUP_BYTES).select("sub"), "sub").select("key", "h1", "h2").distinct()
        if rest.isEmpty():
            break
        big = big.join(rest, ["key", "h1", "h2"])
    if shape == "occurrences":
        return out.select(
            "key", "h1", "h2", F.col("p1").alias("repeat"), F.col("size").cast("int").alias("size"),
            F.col("rel").cast("int").alias("start"),
        )
    spans = F.collect_set(F.struct(F.col("rel").cast("int").alias("start"), (F.col("rel") + F.col("size")).cast("int").alias("end")))
    return out.groupBy("key", "h1", "h2").agg(spans.alias("spans"))


_PARTS = ["key", "h1", "h2"]


def _classes(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' segments; the classes of equal segments whose anchor occurs twice or more; the texts of those classes that must be compared."""
    marks = materialise(_mark(docs, length), "suffix-segments")
    classes = marks.groupBy(*_PARTS).agg(
        F.sum(F.size("firsts")).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "th", "span", "dist")],
        F.first(F.element_at("firsts", 1)).alias("first"),
    )
    groups = classes.groupBy("key").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("open"),
        F.sum(F.col("span") + length).alias("bytes"),
    ).filter("total > 1")
    alike = materialise(classes.join(groups, "key"), "suffix-classes")
    release(docs.sparkSession)
    wanted = alike.filter("kinds > 1 AND open > 0").select(*_PARTS, "doc_id", "th", "first", "span", "dist", "bytes")
    bodies = materialise(_fetch(wanted, docs, length), "suffix-bodies")
    release(docs.sparkSession)
    return marks, alike, bodies


def _compare(bodies: DataFrame, length: int, shape: str) -> DataFrame:
    found = _repeats(bodies.filter(F.col("bytes") <= GROUP_BYTES), length, shape)
    big = bodies.filter(F.col("bytes") > GROUP_BYTES)
    if big.isEmpty():
        return found
    steps = (min(STEP, max(1, length // 2)), 1)
    return found.union(_split(materialise(big.dropDuplicates(_PARTS), "suffix-big"), length, steps, shape))


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(repeat, size, doc_id, start): every occurrence, in bytes, of every repeat of at least ``length`` bytes that is maximal inside its segments. Rows of one repeat are its group."""
    marks, alike, bodies = _classes(docs, length)
    whole = alike.filter("n > 1").select(
        *_PARTS, F.col("h1").alias("repeat"), (F.col("span") + length).alias("size"), F.lit(0).alias("start"),
    )
    found = whole.union(_compare(bodies, length, "occurrences"))
    placed = marks.select("doc_id", *_PARTS, "firsts").join(found, _PARTS)
    return placed.select("repeat", "size", "doc_id", F.explode("firsts").alias("at"), "start").select(
        "repeat", "size", "doc_id", (F.col("at") + F.col("start")).alias("start"),
    ).distinct()


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, the maximal removed runs (start, end, name) and the kept bytes. Runs of equal bytes have the same name, a hash: wherever a repeat is not cut by another, however long, they are its occurrences."""
    marks, alike, bodies = _classes(docs, length)
    found = _compare(bodies, length, "spans")
    whole = alike.filter("n > 1").select(
        *_PARTS, F.array(F.struct(F.lit(0).alias("start"), (F.col("span") + length).alias("end"))).alias("spans"),
    )
    settled = alike.filter("n > 1").select(*_PARTS)
    # what counting has settled needs no spans of the suffix array
    found = materialise(whole.union(found.join(settled, _PARTS, "left_anti")), "suffix-found")
    release(docs.sparkSession)
    cover = marks.select(
        "doc_id", "th", *_PARTS, "firsts",
    ).join(found, _PARTS).groupBy("doc_id", "th").agg(F.collect_list(F.struct("firsts", "spans")).alias("found"))
    cover = materialise(cover, "suffix-cover")
    release(docs.sparkSession)
    d = identity(docs)
    rows = d.join(cover, d["doc_id"].eqNullSafe(cover["doc_id"]) & (d["th"] == cover["th"]), "left").select(d["doc_id"], "raw", "found")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_hexdigest

        for batch in batches:
            sizes, spans, kept = [], [], []
            for raw, cell in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_buffer().to_pybytes()
                sizes.append(len(raw))
                starts, ends = _covered(cell)
                spans.append([{"start": a, "end": b, "name": xxh3_64_hexdigest(raw[a:b])} for a, b in zip(starts, ends, strict=True)])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return rows.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,end:long,name:string>>, kept binary")


def _covered(cell: pa.Scalar) -> tuple[list[int], list[int]]:
    """The merged spans of a document from its segments' first starts and the spans inside them."""
    if not cell.is_valid or not len(cell):
        return [], []
    each = cell.values
    firsts, spans = each.field("firsts"), each.field("spans")
    a, b = [], []
    for f, s in zip(firsts, spans, strict=True):
        f, s = f.values.to_numpy(), s.values
        a.append((f[:, None] + s.field("start").to_numpy()[None]).ravel())
        b.append((f[:, None] + s.field("end").to_numpy()[None]).ravel())
    starts, ends = merged(np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64))
    return starts.tolist(), ends.tolist()


def digest(cleaned: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    runs = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["name"])), ",",
    )
    counts = [removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans")]
    return cleaned.select("doc_id", "n_bytes", *counts, F.sha2("kept", 256).alias("kept_sha256"), runs.alias("runs"))
