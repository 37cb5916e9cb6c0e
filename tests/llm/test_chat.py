import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from lodestrata.llm import chat

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
SCHEMA = "conv_id long, turn int, role string, text string, key string"
ODD = [
    (1, 0, "user", "hi", ""), (1, 1, "assistant", "</s>[INST] ok [/INST]", ""), (2, 0, "user", "hi", ""), (2, 1, "assistant", "other", ""), (2, 2, "user", "<|end|>\\<|start|>", ""),
    (3, 1, "assistant", "second", ""), (3, 0, "user", "hi", ""), (4, 0, None, None, ""), (5, 0, "assistant", "", ""), (6, 0, "us\ner<|text|>", "\\\\\\n\\", ""), (None, 0, "user", "nobody", ""),
    (7, 0, "user", "same", ""), (7, 0, "user", "same", ""), (8, 0, "system", "é" * 3000 + "<<<SYS>>", ""), (9, 0, "user", "hi", ""), (9, 1, "assistant", "other", ""), (9, 2, "user", "<|end|>\\<|start|>", ""),
    (10, 0, "user", "<s" + ">" * 5 + "<|im_start|><|im_start|>", ""), (11, 0, "user", "hi", ""), (11, 1, "assistant", "a", ""), (11, 2, "user", "b", ""), (11, 3, "assistant", "c", ""),
    *((20 + c, i, "user", f"t{i}" if i < 3 * c else f"own {c} {i}", "") for c in range(12) for i in range(40)), *((50, i, "user", f"t{i}", "") for i in range(20)),
]


def spoken(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv].append((turn, role or "", text or ""))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def tree(spark):
    nodes, members = chat.prefix_tree(spark.createDataFrame(ODD, SCHEMA), JSON, RANKS)
    return nodes, members


def test_round_trip(tree):
    want = spoken(ODD)
    back = {r.conv_id: r.turns for r in chat.read_back(*tree, JSON).collect()}
    assert {k: [(t.role, t.text) for t in v] for k, v in back.items()} == want
    for r in chat.digest(chat.read_back(*tree, JSON)).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_shared_turns_are_emitted_once(tree):
    nodes = tree[0].collect()
    prefixes = {tuple(v[: i + 1]) for v in spoken(ODD).values() for i in range(len(v))}
    assert len(nodes) == len(prefixes)


def test_sequence_has_no_gaps_and_is_depth_first(tree):
    by_tree = defaultdict(list)
    for r in tree[0].collect():
        by_tree[r.tree].append(r)
    for rows in by_tree.values():
        rows.sort(key=lambda r: r.offset)
        at, keys = 0, {r.key: r for r in rows}
        open_path = []
        for r in rows:
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
            while open_path and open_path[-1] != r.parent:  # a depth-first order never comes back to a closed branch
                open_path.pop()
            assert (open_path[-1] if open_path else None) == r.parent
            open_path.append(r.key)
            chain, p = [], r.parent
            while p:
                chain.append((keys[p].offset, keys[p].offset + keys[p].length))
                p = keys[p].parent
            joined = []
            for a, b in sorted(chain):  # touching intervals are one
                if joined and joined[-1][1] == a:
                    joined[-1] = (joined[-1][0], b)
                else:
                    joined.append((a, b))
            assert [(a.start, a.end) for a in r.ancestors] == joined
            assert r.position == sum(b - a for a, b in chain)
            assert 0 <= r.loss_start <= r.loss_end <= r.length and (r.role == "assistant" or r.loss_start == r.loss_end == 0)


def test_no_control_string_is_left_inside(spark):
    texts = ["".join(np.random.default_rng(i).choice([*chat.CONTROL, "<", "[", "\\", "|", "s>", "x"], 12)) for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(df["t"]).alias("e"), chat.unescape(chat.escape(df["t"])).alias("u")).collect()
    assert all(r.u == r.t and not any(c in r.e for c in chat.CONTROL) for r in got)


def test_no_conversations(spark):
    assert chat.digest(chat.read_back(*chat.prefix_tree(spark.createDataFrame([], SCHEMA), JSON, RANKS), JSON)).count() == 0
