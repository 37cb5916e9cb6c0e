import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import simhash
from lodestrata.llm.components import components


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, budget=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


TEXTS = [None, "", "  \t\n", "One", "one  TWO", "a b c", "A\x0bb\x0cc", "a b c d e f g", "a b c d e f g", "É é É x y z", "é é é x y z", "x " * 30000, "longword" * 40000, "a b c d e f h"]


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    texts = TEXTS + [" ".join(rng.choice(words, 300)) for _ in range(10)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[-10:]] + texts[-4:]
    ids = [i if i != 9 else None for i in range(len(texts))]
    df = spark.createDataFrame([(d, t, "z") for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    prints = [brute_print(t or "") for t in texts]
    assert got == sorted(((d, f"{p:016x}", c) for d, p, c in zip(ids, prints, brute_components(ids, prints), strict=True)), key=repr)


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(150):
        values = rng.choice(rng.integers(0, 2**63, rng.integers(1, 5), dtype=np.uint64), rng.integers(2, 60))
        for _ in range(rng.integers(0, 4)):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)) * (rng.random(len(values)) < 0.7).astype(np.uint64)
        values, fixed = np.unique(values), int(rng.choice([0, 1, 5, 22]))
        i, j = np.triu_indices(len(values), 1)
        x = values[i] ^ values[j]
        near = (np.bitwise_count(x) <= 2) & ((x >> np.uint64(64 - fixed)) == 0 if fixed else True)
        forest = simhash.Forest(len(values))
        forest.link(i[near], j[near])
        assert (forest.roots() == simhash.trie_join(values, fixed, 2)).all()


def test_small_frontiers_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 800, dtype=np.uint64))
    whole = simhash.trie_join(values, 50, 2)
    monkeypatch.setattr(simhash, "_PAIRS", 16)
    assert (simhash.trie_join(values, 50, 2) == whole).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (-5, -4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {-5: -5, -4: -5}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
