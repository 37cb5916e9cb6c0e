"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

Time is cut into slots, and SLOTS of them are a period. A source whose share is worth a slot of a period at least is a lane of its
own; all smaller ones share one more lane, so that there are never more lanes than slots, however many sources there are. A lane
has q of the Q slots (largest remainders). Its block j may be placed from slot floor(j * Q / q), its release, to before slot
ceil((j + 1) * Q / q), its deadline. Each slot takes, of the released blocks, the one with the earliest deadline (ties: the lane
first by name). As the shares add up to one, every block meets its deadline, which keeps each lane within less than one block of
its share after any number of slots. Releases and deadlines repeat every Q slots, so that the schedule of one period, Q entries
folded in one SQL expression of bounded size, places all blocks.

Slots are whole, but weights are kept exactly: a source's block holds weight * Q * BLOCK_DOCS / q of its documents, a fraction
whose sums are rounded, not itself. So a source of any size gets its target weight of the documents, within less than
one of its own blocks (and half a document) after any number of slots, and is not repeated because slots are coarse. In the shared
lane every source has its block j in the lane's slot j; blocks of the smallest sources are mostly empty.

The mix ends when every document has been placed. Sources that run out before begin again (epochs), so nothing is dropped, and
sources above their natural share repeat. Default weights are the document counts to the power ALPHA; given weights are for the
sources they name, while others get their natural share. Weights are whole numbers from the start, so their sums are exact.

Documents are numbered without bringing a source to one task: a source is cut into buckets by the leading digits of a hash of
doc_id, rows are numbered inside buckets, and bucket counts are summed up to offsets. Null sources are one source with a null name;
null ids come first and have buckets of their own, by a hash of all other columns but the text. Repeated rows are placed one by one;
rows that share a doc_id share a bucket. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_row

ALPHA, SLOTS, BLOCK_DOCS, BUCKET_DIGITS = 0.8, 1000, 8, 3
#: Whole units of a weight of one: of a power of a count, and of the largest given weight.
UNITS, GIVEN_UNITS = 1024, 1 << 32
MAX_BROADCAST_SOURCES = 10_000
#: Epochs of one document that are listed at once.
EPOCHS = 4096
REST = ""


def _key(c: str = "source") -> Column:
    """Sources as keys: null is a source of its own, told apart from all strings; no key is REST."""
    return F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))


def _one(df: DataFrame, one: DataFrame) -> DataFrame:
    """df beside the columns of a table of one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def weighed(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, slots: int) -> DataFrame:
    """(key, n) with ``w`` in whole units, ``total``, the sum of w, and the ``lane``."""
    if weights:
        named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("1" + k, float(w))])
        most = max(1.0, *weights.values())
        whole = sizes.agg(F.sum("n").alias("whole"))
        sizes = _one(sizes, whole).withColumn(
            "w", F.coalesce(named[F.col("key")], F.col("n") / F.col("whole")) * (GIVEN_UNITS / most),
        ).drop("whole")
    else:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))) * UNITS)
    sizes = sizes.withColumn("w", F.greatest(F.round("w").cast("long"), F.lit(1)))
    sizes = _one(sizes, sizes.agg(F.sum("w").alias("total")))
    return sizes.withColumn("lane", F.when(F.col("w") * slots >= F.col("total"), F.col("key")).otherwise(REST))


def shares(weighted: DataFrame, slots: int) -> DataFrame:
    """One row: the array ``s`` of (lane, q) by lane; the q add up to ``slots`` (largest remainders, ties by lane, at least one each)."""
    lanes = weighted.groupBy("lane").agg(F.sum("w").alias("w"), F.first("total").alias("total"))
    ideal = F.col("w") * slots
    lanes = lanes.select(
        "lane", F.greatest(F.call_function("div", ideal, F.col("total")), F.lit(1)).alias("q"),
        (ideal % F.col("total")).alias("part"),
    )
    one = lanes.agg(F.array_sort(F.collect_list(F.struct("lane", "q", "part"))).alias("s")).filter(F.size("s") > 0)
    one = one.withColumn("left", slots - F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["q"]))
    ordered = F.array_sort(F.transform("s", lambda x: F.struct((-x["part"]).alias("part"), x["lane"].alias("lane"))))
    one = one.withColumn(
        "more", F.transform(F.slice(ordered, F.lit(1), F.greatest(F.col("left"), F.lit(0)).cast("int")), lambda x: x["lane"]),
    )
    q = lambda x: x["q"] + F.when(F.array_contains("more", x["lane"]), 1).otherwise(0)
    return one.select(F.transform("s", lambda x: F.struct(x["lane"].alias("lane"), q(x).cast("long").alias("q"))).alias("s"))


def schedule(shared: DataFrame, slots: int) -> DataFrame:
    """(lane, q, slots): the slots of a period that each lane takes, in order. At most ``slots`` rows."""
    period = F.lit(slots).cast("long")
    q = lambda i: F.col("s")[i]["q"]

    def step(state: Column, slot: Column) -> Column:
        released = lambda d, i: F.floor(d * period / q(i)) <= slot
        deadline = lambda d, i: F.floor(((d + 1) * period + q(i) - 1) / q(i))
        keys = F.transform(state["done"], lambda d, i: F.when(released(d, i), deadline(d, i)).otherwise(F.lit(1 << 60)))
        pick = F.transform(F.array(keys), lambda ks: F.array_position(ks, F.array_min(ks)).cast("int") - 1)[0]
        more = lambda p: F.transform(state["done"], lambda d, i: d + F.when(i == p, 1).otherwise(0))
        # the pick is found once per slot, as the one element of an array
        return F.transform(F.array(pick), lambda p: F.struct(more(p).alias("done"), F.concat(state["plan"], F.array(p)).alias("plan")))[0]

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("plan"))
    planned = shared.withColumn("plan", F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda x: x["plan"]))
    each = planned.select("plan", F.posexplode("s").alias("i", "x"))
    taken = F.filter(F.transform("plan", lambda p, t: F.when(p == F.col("i"), t.cast("long"))), lambda t: t.isNotNull())
    return each.select("x.lane", "x.q", taken.alias("slots"))


def plans(weighted: DataFrame, lanes: DataFrame, slots: int, block_docs: int) -> DataFrame:
    """One row per source: key, n, lane, q, ``size`` (documents of a block), and how many blocks and documents the mix takes from it."""
    size = (F.col("w") * (slots * block_docs)) / (F.col("total") * F.col("q"))
    each = weighted.join(F.broadcast(lanes), "lane").withColumn("size", size)  # a row per lane at most
    last = F.ceil((F.col("n") - 0.5) / F.col("size")) - 1
    ends = F.floor(last / F.col("q")) * slots + F.get("slots", (last % F.col("q")).cast("int")) + 1
    each = _one(each, each.agg(F.max(ends).alias("horizon")))
    rest = F.size(F.filter("slots", lambda t: t < F.col("horizon") % slots))
    each = each.withColumn("taken", F.floor(F.col("horizon") / slots) * F.col("q") + rest)
    docs = F.greatest(F.floor(F.col("taken") * F.col("size") + 0.5).cast("long"), F.col("n"))
    return each.select("key", "n", "lane", "q", "size", "taken", docs.alias("docs"))


def _buckets(docs: DataFrame) -> DataFrame:
    """key, h and bucket beside the columns of docs, which are in ``row``; buckets are in the order of h, nulls first."""
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("doc_id", "text")]
    salt = F.substring(F.md5(F.xxhash64(*others).cast("string").cast("binary")), 1, BUCKET_DIGITS)
    bucket = F.coalesce(F.substring(h, 1, BUCKET_DIGITS), F.concat(F.lit("!"), salt))  # "!" comes before all digits
    return docs.select(whole_row(docs), _key().alias("key"), h.alias("h"), F.col("doc_id").alias("id"), bucket.alias("bucket"))


def _placed(
    docs: DataFrame, only: tuple[str, ...] | None, weights: dict[str, float] | None, alpha: float, slots: int, block_docs: int,
) -> DataFrame:
    rows = _buckets(docs)
    counts = materialise(rows.groupBy("key", "bucket").count(), "mix-counts")
    before = counts.select(
        "key", "bucket", (F.sum("count").over(Window.partitionBy("key").orderBy("bucket")) - F.col("count")).alias("before"),
    )
    weighted = weighed(counts.groupBy("key").agg(F.sum("count").alias("n")), weights, alpha, slots)
    lanes = materialise(schedule(shares(weighted, slots), slots), "mix-lanes")
    own = materialise(plans(weighted, lanes, slots, block_docs), "mix-sources")
    # with more sources Spark chooses the join
    few = own.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    if only:
        rows = rows.withColumn("row", F.struct(*[F.col(f"row.{c}") for c in only]))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", "id")).cast("long") - 1)
    # numbered rows are dealt by these keys already
    placed = numbered.join(before.hint("merge"), ["key", "bucket"]).join(F.broadcast(own) if few else own, "key")
    placed = placed.withColumn("at", F.col("nth") + F.col("before"))
    # epochs in two steps, so that no list is long
    most = F.floor((F.col("docs") - 1 - F.col("at")) / F.col("n"))
    placed = placed.withColumn("most", most).withColumn(
        "some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / EPOCHS))),
    )
    last = F.least(F.col("most"), F.col("some") * EPOCHS + EPOCHS - 1)
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.col("some") * EPOCHS, last)))
    placed = placed.withColumn("turn", F.col("epoch") * F.col("n") + F.col("at"))
    block = F.least(F.ceil((F.col("turn") + 0.5) / F.col("size")) - 1, F.col("taken") - 1)
    placed = placed.withColumn("block", block.cast("long")).withColumn("job", (F.col("block") % F.col("q")).cast("int"))
    jobs = lanes.select("lane", F.posexplode("slots").alias("job", "in_period"))  # as many rows as slots
    placed = placed.join(F.broadcast(jobs), ["lane", "job"])
    place = F.greatest(F.col("turn") - F.floor(F.col("block") * F.col("size") + 0.5), F.lit(0)).cast("long")
    return placed.select(
        "row", "key", "epoch", "block",
        (F.floor(F.col("block") / F.col("q")) * slots + F.col("in_period")).alias("slot"),
        place.alias("place"),
        F.floor(F.col("block") * slots / F.col("q")).alias("release"),
        F.floor(((F.col("block") + 1) * slots + F.col("q") - 1) / F.col("q")).alias("deadline"),
    )


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = ALPHA, slots: int = SLOTS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """doc_id, source, epoch, block, slot, place, release and deadline. Sorted by (slot, place, source), rows are the mix."""
    placed = _placed(docs, ("doc_id", "source"), weights, alpha, slots, block_docs)
    return placed.select("row.doc_id", "row.source", "epoch", "block", "slot", "place", "release", "deadline")


def mixed_rows(
    docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = ALPHA, slots: int = SLOTS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The documents with all their columns, in the mix's order, repeated as it says."""
    return _placed(docs, None, weights, alpha, slots, block_docs).orderBy("slot", "place", "key").select("row.*")


def mix_sql(alpha: float = ALPHA, slots: int = SLOTS, block_docs: int = BLOCK_DOCS) -> str:
    """The same mix with default weights, in DuckDB SQL over the table documents."""
    return f"""
    WITH RECURSIVE keyed AS (
        SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY h NULLS FIRST, doc_id) - 1 AS spot FROM keyed
    ), counted AS (
        SELECT key, count(*) AS n, greatest(CAST(round(pow(CAST(count(*) AS DOUBLE), {alpha}) * {UNITS}) AS BIGINT), 1) AS w FROM keyed GROUP BY key
    ), weighed AS (
        SELECT *, CAST(sum(w) OVER () AS BIGINT) AS total FROM counted
    ), sources AS (
        SELECT *, CASE WHEN w * {slots} >= total THEN key ELSE '{REST}' END AS lane FROM weighed
    ), wholes AS (
        SELECT lane, greatest(CAST(sum(w) AS BIGINT) * {slots} // max(total), 1) AS q, CAST(sum(w) AS BIGINT) * {slots} % max(total) AS part FROM sources GROUP BY lane
    ), quanta AS (
        SELECT lane, row_number() OVER (ORDER BY lane) AS i, q + CASE WHEN row_number() OVER (ORDER BY part DESC, lane) <= {slots} - CAST(sum(q) OVER () AS BIGINT) THEN 1 ELSE 0 END AS q FROM wholes
    ), lists AS (
        SELECT list(q ORDER BY i) AS qs FROM quanta
    ), edf AS (
        SELECT CAST(-1 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS job, qs FROM lists
        UNION ALL
        SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p], qs FROM (
            SELECT t, done, qs, CAST(list_position(keys, list_min(keys)) AS BIGINT) AS p FROM (
                SELECT *, list_transform(done, lambda d, i: CASE WHEN d * {slots} // qs[i] <= t + 1 THEN CAST(((d + 1) * {slots} + qs[i] - 1) // qs[i] AS BIGINT) ELSE 1152921504606846976 END) AS keys
                FROM edf WHERE t + 1 < {slots}))
    ), slots AS (
        SELECT quanta.lane, job, t FROM edf JOIN quanta ON quanta.i = edf.pick WHERE t >= 0
    ), sized AS (
        SELECT key, n, sources.lane, q, CAST(w * {slots * block_docs} AS DOUBLE) / CAST(total * q AS DOUBLE) AS size FROM sources JOIN quanta USING (lane)
    ), ends AS (
        SELECT *, CAST(ceil((n - 0.5::DOUBLE) / size) AS BIGINT) - 1 AS last FROM sized
    ), horizon AS (
        SELECT max(last // q * {slots} + t + 1) AS horizon FROM ends JOIN slots ON slots.lane = ends.lane AND slots.job = last % q
    ), taken AS (
        SELECT sized.*, horizon // {slots} * q + (SELECT count(*) FROM slots WHERE slots.lane = sized.lane AND t < horizon % {slots}) AS taken FROM sized, horizon
    ), placed AS (
        SELECT doc_id, source, spot, taken.*, unnest(generate_series(0, (greatest(CAST(floor(taken * size + 0.5::DOUBLE) AS BIGINT), n) - 1 - spot) // n)) AS epoch FROM numbered JOIN taken USING (key)
    ), turns AS (
        SELECT *, epoch * n + spot AS turn FROM placed
    ), blocked AS (
        SELECT *, least(CAST(ceil((turn + 0.5::DOUBLE) / size) AS BIGINT) - 1, taken - 1) AS block FROM turns
    )
    SELECT doc_id, source, epoch, block, block // q * {slots} + t AS slot, greatest(turn - CAST(floor(block * size + 0.5::DOUBLE) AS BIGINT), 0) AS place,
        block * {slots} // q AS release, ((block + 1) * {slots} + q - 1) // q AS deadline
    FROM blocked JOIN slots ON slots.lane = blocked.lane AND slots.job = block % q"""
