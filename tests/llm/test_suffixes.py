import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import suffixes
from lodestrata.llm.rolling import Hasher, least_leftmost


def mask(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        out.append(bytes(m))
    return out


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), t, m in zip(rows, texts, mask(texts, length), strict=True):
        runs = sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
        out.append((d, len(t), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(t, m, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


def figures(digest, rows):
    """The figures of brute(), after a look at the runs: equal names for equal bytes alone."""
    got, seen = digest.collect(), {}
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append((t or "").encode())
    for r in got:
        for run in filter(None, r.runs.split(",")):
            a, b, name = run.split(":")
            if len(texts[r.doc_id]) == 1:
                body = texts[r.doc_id][0][int(a) : int(b)]
                assert seen.setdefault(name, body) == body
    assert len(set(seen.values())) == len(seen)
    return sorted((tuple(r)[:5] for r in got), key=repr)


def some_texts(rng, n, alphabet="abc"):
    shared = ["".join(rng.choice(alphabet + "dé") for _ in range(40)) for _ in range(3)]
    piece = lambda: rng.choice([rng.choice(shared), "".join(rng.choice(alphabet + "xyz") for _ in range(rng.randint(0, 25))), rng.choice(shared)[: rng.randint(1, 30)], rng.choice(alphabet) * rng.randint(0, 20)])
    return ["".join(piece() for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("group_bytes", [1 << 20, 300, 60])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group_bytes)
    rng = random.Random(group_bytes)
    rows = [(i if i % 7 else None, t if i % 11 else None) for i, t in enumerate(some_texts(rng, 60))]
    rows += rows[:3]  # rows repeated whole
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    assert figures(suffixes.digest(suffixes.dedup(df, 12)), rows) == brute(rows, 12)


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_groups_hold_all_occurrences(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group_bytes)
    texts = some_texts(random.Random(9), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    groups, cover = {}, [bytearray(len(t)) for t in raw]
    for r in suffixes.repeat_groups(df, 12).collect():
        groups.setdefault((r.repeat, r.size), set()).add((r.doc_id, r.start))
        cover[r.doc_id][r.start : r.start + r.size] = b"\1" * r.size
    assert [bytes(c) for c in cover] == mask(raw, 12)
    for (_, size), places in groups.items():
        assert len({raw[d][a : a + size] for d, a in places}) == 1 and len(places) > 1 and size >= 12


def test_real_length_with_long_and_periodic_texts(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(1, noise(500) + passage + noise(80)), (2, passage[100:600] + noise(1000)), (3, "in " * 4000), (4, noise(399)), (5, passage[:399]), (6, noise(30000)), (7, ""), (8, None), (9, "é" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert figures(suffixes.digest(suffixes.dedup(df)), rows) == brute(rows, 400)


def test_intervals_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lcp = rng.integers(0, 6, rng.integers(1, 25))
        want = set()
        for i in range(len(lcp)):
            for j in range(i, len(lcp)):
                low = lcp[i : j + 1].min()
                if low >= 2 and (i == 0 or lcp[i - 1] < low) and (j == len(lcp) - 1 or lcp[j + 1] < low):
                    want.add((int(low), i, j + 2))
        got = list(suffixes.intervals(lcp, 2))
        assert set(got) == want and len(got) == len(want)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(6)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts = np.concatenate([np.arange(a, a + len(t)) for a, t in zip(bounds, texts, strict=False)])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        limits = bounds[owner] + np.array([len(t) for t in texts])[owner]
        array = suffixes.SuffixArray(texts, starts, limits, 40)
        text_of = {int(s): texts[o][s - bounds[o] :] for s, o in zip(starts, owner, strict=True)}
        ordered = [text_of[int(s)] for s in array.starts]
        assert ordered == sorted(ordered)
        for a, b, n in zip(ordered, ordered[1:], array.lcp, strict=False):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert n == k


def test_maximal_repeats_have_all_occurrences():
    texts = [b"xabcdefy", b"zabcdefw", b"qabcdeft", b"abcq"]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts = np.concatenate([np.arange(a, a + len(t)) for a, t in zip(bounds, texts, strict=False)])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    array = suffixes.SuffixArray(texts, starts, bounds[owner] + np.array([len(t) for t in texts])[owner], 8)
    joined = b"\0".join(texts) + b"\0"
    left = np.concatenate(([-1], np.frombuffer(joined, np.uint8)[:-1].astype(np.int16)))
    left[bounds[:-1]] = -1
    got = {(joined[array.starts[a] : array.starts[a] + n], b - a) for n, a, b in suffixes.maximal_repeats(array, left, 2)}
    assert got == {(b"abcdef", 3), (b"abc", 4)}  # not bcdef or cdef, which always follow the same byte


def test_hashes_and_window_minima():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 3, 300).astype(np.uint8)
    h = Hasher(1)
    s = h.sums(data)
    i = np.arange(290)
    seen = {}
    for a, v in zip(i, h.of(s, i, i + 5), strict=True):
        assert seen.setdefault(int(v), bytes(data[a : a + 5])) == bytes(data[a : a + 5])
    values = rng.integers(0, 9, 200).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 200):
        assert least_leftmost(values, width).tolist() == [a + int(values[a : a + width].argmin()) for a in range(200 - width + 1)]


def test_no_documents(spark):
    assert suffixes.digest(suffixes.dedup(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_strings_that_equal_sums_modulo_a_power_of_two_stay_apart(spark):
    """Thue-Morse strings and their complements have equal polynomial hashes modulo 2**64 for any base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    rows = [(i, "x" * (i + 1) + t[:2048] + "y" * (i + 1)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert figures(suffixes.digest(suffixes.dedup(df, 1024)), rows) == brute(rows, 1024)
