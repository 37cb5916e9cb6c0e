import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm import common, paragraphs, queries


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def case(rng):
    passage, near = words(rng, 51), words(rng, 80)
    edited = near[:40] + ["other"] + near[41:]
    texts = {
        0: " ".join(words(rng, 100) + passage + words(rng, 30)), 1: " ".join(words(rng, 10) + passage + words(rng, 200)), 2: " ".join(words(rng, 300)),
        3: " ".join(words(rng, 60)) + "\n" + " ".join(near), 4: " ".join(edited) + "\n" + " ".join(words(rng, 20)), 5: None, 6: "", 7: "é a " * 400, 8: "short line\n" * 3, 9: "short line",
    }
    return texts, passage


@pytest.mark.parametrize("block", [2048, 1])
def test_planted_passages(spark, block):
    texts, passage = case(random.Random(block))
    rows = [(i, t, "e") for i, t in texts.items()] + [(2, texts[2], "e"), (None, texts[0], "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands string")
    got = {r.doc_id: r for r in paragraphs.repeated(df, block=block).collect()}
    assert set(got) == {0, 1, 3, 4, None}
    assert {d: got[d].component_id for d in got} == {0: 0, 1: 0, 3: 3, 4: 3, None: 0}
    assert got[0].n_removed == got[3].n_removed == 0
    removed = "".join(texts[1][s.start : s.end] for s in got[1].spans)
    assert removed in " ".join(passage) and len(removed.split()) >= 32
    assert [(s.start, s.end) for s in got[4].spans] == [(0, texts[4].index("\n"))]
    assert got[None].n_removed == len(texts[0])


def test_no_repeat_of_51_words_is_missed_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in paragraphs.repeated(docs).collect()}

    def sharing(n):
        seen = defaultdict(set)
        for r in docs.collect():
            w = r.text.encode().lower().split()
            for i in range(len(w) - n + 1):
                seen[hash(tuple(w[i : i + n]))].add(r.doc_id)
        return set().union(*(v for v in seen.values() if len(v) > 1))

    assert sharing(51) <= got
    near = got - sharing(32)
    assert len(near) < 0.02 * len(got)  # lines that are similar without 32 equal words in a row


def test_links_are_complete_and_exact():
    rng = random.Random(2)
    bodies = []
    for _ in range(6):
        base = words(rng, 60)
        for _ in range(rng.randint(1, 7)):
            base = base[:]
            base[rng.randrange(60)] = "x%d" % rng.randrange(3)
            bodies.append(" ".join(base))
    rng.shuffle(bodies)
    sets = [paragraphs.shingles(b) for b in bodies]

    def groups(links):
        root = list(range(len(bodies)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return {frozenset(k for k in range(len(bodies)) if root[k] == r) for r in root}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = paragraphs.similar(bodies)
    assert groups(found) == groups(every) and len(found) < len(bodies) and set(found) <= set(every)
    halves = [k % 2 == 0 for k in range(len(bodies))]
    across = [(i, j) for i, j in every if halves[i] != halves[j]]
    assert set(paragraphs.similar(bodies, halves)) <= set(across) and groups(paragraphs.similar(bodies, halves)) == groups(across)


def test_tuning():
    b, r = paragraphs.tune()
    assert 1 - (1 - 0.8**r) ** b >= 0.99 and b <= paragraphs.MAX_BANDS


def test_recall_of_bands():
    rng = np.random.default_rng(0)
    b, r = paragraphs.tune()
    marker = paragraphs.Marker(b, r)
    hit = 0
    for _ in range(300):
        shared, one, two = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 10, dtype=np.uint64), rng.integers(0, 2**63, 10, dtype=np.uint64)
        keys = marker.signatures(np.concatenate((shared, one, shared, two)), np.array([0, 90]))
        hit += (keys[0] == keys[1]).any()
    assert hit >= 0.97 * 300


def test_no_documents(spark):
    assert paragraphs.digest(paragraphs.repeated(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_component_of_a_chain_of_documents(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    texts = {1: a, 5: a + "\n" + b, 7: b + "\n" + c, 8: c, 20: " ".join(words(rng, 60))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in paragraphs.repeated(df).collect()} == {1: 1, 5: 1, 7: 1, 8: 1}


def test_the_query_sees_short_lines(spark, tmp_path):
    rng = random.Random(10)
    five, near = " ".join(words(rng, 5)), words(rng, 30)
    alone = lambda: " ".join(words(rng, 60))
    edited = " ".join([*near[:-1], "other"])
    texts = {1: five + "\n" + alone(), 2: alone() + "\n" + five, 3: " ".join(near) + "\n" + alone(), 4: alone() + "\n" + edited, 5: alone()}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_paragraph_minhash(spark, str(tmp_path)).collect()}
    assert {d: got[d].component_id for d in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert got[2].n_removed == len(five) and got[4].n_removed == len(edited)


def test_the_query_has_every_row(spark, tmp_path):
    same = " ".join(words(random.Random(11), 60))
    rows = [(1, same), (4, same), (4, same), (6, None), (7, ""), (9, "alone"), (None, "nothing shared"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op10_paragraph_minhash(spark, str(tmp_path)).collect()]
    none = [(d, d, 0, 0, "") for d in (6, 7, 9, None, None)]
    shared = [r for r in got if r[0] in (1, 4)]
    assert sorted((r for r in got if r not in shared), key=repr) == sorted(none, key=repr)
    assert sorted((r[0], r[1], r[3]) for r in shared) == [(1, 1, 0), (4, 1, len(same)), (4, 1, len(same))]


def brute_result(texts, min_words):
    """The whole result over the paragraphs of each text: all pairs of lines by exact similarity, equal passages, clusters over documents, what stays, merged spans and components."""
    marker = paragraphs.Marker(*paragraphs.tune(), min_words)
    found = []
    for d, t in texts.items():
        raw = (t or "").encode()
        p, _ = marker.mark(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for kind, a, b in zip(p["kind"].tolist(), p["start"].tolist(), p["end"].tolist(), strict=True):
            found.append((d, kind, a, b, t[a:b].encode().lower().split()))
    root = list(range(len(found)))

    def find(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [paragraphs.shingles(" ".join(w.decode() for w in f[4])) for f in found]
    for i in range(len(found)):
        for j in range(i):
            alike = found[i][4][:32] == found[j][4][:32] if found[i][1] else len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if found[i][1] == found[j][1] and alike:
                root[find(root, i)] = find(root, j)
    clusters = defaultdict(list)
    for i, f in enumerate(found):
        clusters[find(root, i)].append(f)
    out, parent = defaultdict(lambda: [0, []]), {d: d for d in texts}
    for own in clusters.values():
        docs = {f[0] for f in own}
        if len(docs) < 2:
            continue
        first = min(own, key=lambda f: (f[0], f[2]))
        for d, _, a, b, _ in own:
            out[d][0] += 1
            if (d, a) != (first[0], first[2]):
                out[d][1].append((a, b))
            x, y = sorted((find(parent, d), find(parent, first[0])))
            parent[y] = x
    rows = []
    for d in texts:
        n, spans = out[d]
        merged = []
        for a, b in sorted(set(spans)):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        rows.append((d, find(parent, d), n, sum(b - a for a, b in merged), ",".join(f"{a}:{b}" for a, b in merged)))
    return sorted(rows)


@pytest.mark.parametrize("block", [2048, 3])
def test_the_whole_result_against_brute_force(spark, block):
    rng = random.Random(17)
    lines = [words(rng, rng.choice([3, 5, 7, 12, 30, 45, 90])) for _ in range(25)]
    texts = {}
    for d in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(lines)[:] if rng.random() < 0.6 else words(rng, rng.randint(1, 60))
            if rng.random() < 0.3 and len(line) >= 30:  # near copies well over the threshold
                line[rng.choice([0, -1])] = f"edit{rng.randint(0, 3)}"
            own.append(" ".join(line))
        texts[d] = ("\n" if d % 3 else " ").join(own)
    texts |= {100: None, 101: "", 102: "x " * 200}
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    got = paragraphs.digest(paragraphs.every(df, paragraphs.repeated(df, block=block, min_words=paragraphs.SHINGLE)))
    assert sorted(map(tuple, got.collect())) == brute_result(texts, paragraphs.SHINGLE)


def test_disk_is_freed_without_garbage_collection(spark, monkeypatch):
    """Shuffle files go as each execution ends, and tables once nothing reads them; all of them together are more than the disk allowed."""
    rng = random.Random(23)
    line = words(rng, 60)
    texts = [" ".join(words(rng, 80)) + "\n" + " ".join([*line[:-1], f"edit{i % 4}"]) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(paragraphs, "release", lambda session: None)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [Path(x) for x in manager.localDirsString()]
    shuffled = lambda: {p for top in tops for p in top.rglob("shuffle_*")}
    tables = lambda: {p for p in Path(common.application_dir(spark).removeprefix("file:")).glob("*")}
    shuffles_before, tables_before = shuffled(), tables()
    setting = spark.conf.get(common._CLEANUP)
    found = paragraphs.repeated(df)
    until = time.time() + 10
    while shuffled() - shuffles_before and time.time() < until:  # they are removed beside the query
        time.sleep(0.1)
    assert not shuffled() - shuffles_before
    left = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in tables() - tables_before}
    assert not left & {"paragraphs", "paragraph-lines", "paragraph-buckets", "paragraph-classes"} and "paragraph-found" in left
    assert spark.conf.get(common._CLEANUP) == setting
    assert found.count() == 200
