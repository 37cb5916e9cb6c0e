"""Chat formatting as a prefix tree: turns that conversations share from the start are emitted once.

A turn is written as OPEN role TEXT text CLOSE. Inside roles and texts a backslash is doubled, and every place
where a control string would begin gets a backslash after its first character, so that none is left and
taking each backslash away gives the original back. A node of the tree is a turn together with all turns
before it; its key is a chained hash. Conversations in the order of their key paths walk the tree depth-first: each adds,
as one run, the nodes that it does not share with the one before it, so that every node is emitted once, and each node's tokens
stand at one offset of the tree's one sequence. A node carries

* ``offset`` and ``length`` in that sequence, and ``position``, the position id of its first token: the number
  of tokens of its ancestors, so that each conversation's positions run from 0 without gaps;
* ``ancestors``, the intervals [start, end) of the sequence that its tokens attend to besides the node's own
  earlier tokens; touching ones are one, so a long conversation has as many as it has branchings above;
* ``loss_start`` and ``loss_end``, the part of its tokens under the loss mask: an assistant's text.

Offsets are prefix sums over ranges of the sorted paths: summed inside a range, then over the ranges' totals,
so a root that most conversations share needs no task of its own. No row holds more than one conversation, and none is
repeated for each of its ancestors.

Rows are ordered by turn, ties by role and text; repeated rows are repeated turns. Null roles and texts are
empty strings. Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise, materialise_at
from .packing import load_encoder

OPEN, TEXT, CLOSE, MASKED_ROLE = "<|start|>", "<|text|>", "<|end|>", "assistant"
# Strings that a template or tokenizer could take for control.
CONTROL = [OPEN, TEXT, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:long,end:long>>")


def _pattern() -> str:
    import re

    return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), f"({_pattern()})", "$1\\\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns, and the keys of its nodes from the root."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    link = lambda before, t: F.substring(F.sha2(F.concat(before, F.sha2(t["role"], 256), F.sha2(t["text"], 256)), 256), 1, 32)
    grow = lambda keys, t: F.concat(keys, F.array(link(F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit("")), t)))
    return whole.withColumn("path", F.aggregate("turns", F.array().cast("array<string>"), grow))


def tokenised(nodes: DataFrame, tokenizer_path: str, ranks_path: str | None) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit), length, loss_start and loss_end."""
    made = pa.struct([("ids", pa.binary()), ("length", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    holder: list = []

    @F.arrow_udf("ids binary, length long, loss_start long, loss_end long")
    def encode(roles: pa.Array, texts: pa.Array, masked: pa.Array) -> pa.Array:
        if not holder:
            holder.append(load_encoder(tokenizer_path, ranks_path))
        rows = []
        for role, text, mask in zip(roles.to_pylist(), texts.to_pylist(), masked.to_pylist(), strict=True):
            parts = [holder[0](x) if x else np.zeros(0, "<u4") for x in (OPEN + role + TEXT, text, CLOSE)]
            a = len(parts[0])
            b = a + len(parts[1])
            rows.append({
                "ids": np.concatenate(parts).tobytes(), "length": b + len(parts[2]), "loss_start": a if mask else 0,
                "loss_end": b if mask else 0,
            })
        return pa.array(rows, made)

    done = nodes.withColumn("t", encode.asNondeterministic()(escape(F.col("role")), escape(F.col("text")), F.col("role") == MASKED_ROLE))
    return done.select("*", "t.*").drop("t", "text")


def _above(runs: DataFrame) -> DataFrame:
    """(run, above): the intervals over each run's first token, from (run, up, above) with those of the next run up only. Each round doubles how far up a run has looked."""
    old = None
    while True:
        runs, path = materialise_at(runs, "chat-runs")
        if old:
            drop_table(runs.sparkSession, old)
        old = path
        if runs.filter("up IS NOT NULL").isEmpty():
            return runs.select("run", "above")
        t = runs.select(F.col("run").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"))
        runs = runs.join(t, "up", "left").select(
            "run", F.col("next").alias("up"), F.concat(F.coalesce("more", _no_spans()), "above").alias("above"),
        )


def _touching(merged: Column, s: Column) -> Column:
    last = F.try_element_at(merged, F.lit(-1))
    grown = F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
    return F.when((F.size(merged) > 0) & (last["end"] == s["start"]), grown).otherwise(F.concat(merged, F.array(s)))


def prefix_tree(conversations: DataFrame, tokenizer_path: str, ranks_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the tree's nodes as above, with tree (the root's key) and key; and per conversation conv_id and the keys of its nodes."""
    paths = materialise(_paths(conversations), "chat-paths")
    members = paths.select("conv_id", F.col("path").alias("keys"))
    # equal conversations are one; in the order of their paths, each adds the nodes that it doesn't share with the one before
    distinct = paths.groupBy(F.element_at("path", -1).alias("run")).agg(F.first("turns").alias("turns"), F.first("path").alias("path"))
    ordered = materialise(distinct.orderBy("path").withColumn("range", F.spark_partition_id()), "chat-order")
    here = Window.partitionBy("range").orderBy("path")
    # one row per range of the sort: where the one before it ends
    ends = ordered.groupBy("range").agg(F.max("path").alias("last")).withColumn("last", F.lag("last").over(Window.orderBy("range")))
    lined = ordered.withColumn("nth", F.row_number().over(here)).withColumn("before", F.lag("path").over(here)).join(ends.hint("merge"), "range")  # dealt by range already
    lined = lined.withColumn("shared", F.size(F.array_intersect("path", F.coalesce("before", "last", F.array().cast("array<string>")))))  # keys are of whole prefixes
    each = lined.select(
        "run", "range", "nth", "shared", "path",
        F.posexplode(F.slice("turns", F.col("shared") + 1, F.size("turns"))).alias("i", "t"),
    ).withColumn("depth", F.col("i") + F.col("shared"))
    each = each.select(
        "run", "range", "nth", "depth", F.col("path")[0].alias("tree"), F.get("path", F.col("depth")).alias("key"),
        F.get("path", F.col("depth") - 1).alias("parent"), "t.role", "t.text",
    )
    nodes = materialise(tokenised(each, tokenizer_path, ranks_path), "chat-nodes")
    slim = nodes.select("run", "range", "nth", "depth", "tree", "key", "parent", "length")
    # one row per range of the sort
    totals = slim.groupBy("range").agg(F.sum("length").alias("total")).withColumn(
        "before", F.sum("total").over(Window.orderBy("range")) - F.col("total"),
    )
    placed = slim.join(totals.hint("merge"), "range").withColumn(
        "at", F.col("before") + F.sum("length").over(Window.partitionBy("range").orderBy("nth", "depth")) - F.col("length"),
    )
    placed = placed.withColumn("head", F.min("at").over(Window.partitionBy("range", "nth")))
    placed = materialise(placed.select("run", "depth", "tree", "key", "parent", "length", "at", "head"), "chat-places")
    starts = materialise(placed.filter("depth = 0").select("tree", F.col("at").alias("first")), "chat-trees")
    placed = placed.join(starts, "tree").select(
        "run", "tree", "key", "parent", "length", (F.col("at") - F.col("first")).alias("offset"),
        (F.col("head") - F.col("first")).alias("head"),
    )
    placed = materialise(placed, "chat-offsets")
    # a conversation's own nodes are a run of the sequence; what is over it hangs on the parent of its first node
    hung = placed.filter("offset = head").select("run", F.col("parent").alias("key"))
    over = placed.select(
        "key", F.col("run").alias("up"),
        F.array(F.struct(F.col("head").alias("start"), (F.col("offset") + F.col("length")).alias("end"))).alias("above"),
    )
    above = _above(hung.join(over, "key", "left").select("run", "up", F.coalesce("above", _no_spans()).alias("above")))
    own = F.when(
        F.col("offset") > F.col("head"), F.array(F.struct(F.col("head").alias("start"), F.col("offset").alias("end"))),
    ).otherwise(_no_spans())
    facts = placed.join(above, "run").select(
        "key", "tree", "offset", F.aggregate(F.concat("above", own), _no_spans(), _touching).alias("ancestors"),
    )
    position = F.aggregate("ancestors", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = nodes.drop("tree").join(facts, "key").select(
        "tree", "key", "parent", "depth", "role", "offset", "length", position.alias("position"), "ancestors", "loss_start",
        "loss_end", "ids",
    )
    return materialise(out, "chat-tree"), members


def read_back(nodes: DataFrame, members: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turns): turns decoded from the tree's tokens: an array of (nth, role, text, loss, chars)."""
    holder: list = []
    made = pa.struct([("formatted", pa.string()), ("loss", pa.string())])

    @F.arrow_udf("formatted string, loss string")
    def decode(ids: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        if not holder:
            from tokenizers import Tokenizer

            holder.append(Tokenizer.from_file(tokenizer_path))
        rows = []
        for x, a, b in zip(ids.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            tokens = np.frombuffer(x, "<u4").tolist()
            rows.append({
                "formatted": holder[0].decode(tokens, skip_special_tokens=False),
                "loss": holder[0].decode(tokens[a:b], skip_special_tokens=False),
            })
        return pa.array(rows, made)

    read = nodes.withColumn("d", decode.asNondeterministic()("ids", "loss_start", "loss_end")).select("key", "d.*")
    head = F.substring_index("formatted", TEXT, 1)
    body = F.substring("formatted", F.length(head) + len(TEXT) + 1, F.length("formatted") - F.length(head) - len(TEXT) - len(CLOSE))
    read = read.select(
        "key", unescape(F.substring(head, len(OPEN) + 1, F.length(head))).alias("role"), unescape(body).alias("text"),
        unescape(F.col("loss")).alias("loss"), F.length("formatted").cast("long").alias("chars"),
    )
    turns = members.select("conv_id", F.posexplode("keys").alias("nth", "key")).join(read, "key")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "loss", "chars"))).alias("turns"))


def digest(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["chars"])
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), chars.alias("formatted_chars"),
    )
