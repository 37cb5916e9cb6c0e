import numpy as np
from lodestrata.llm import topk


def brute(rows, k=5, every=50):
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit[(i, tuple(np.floor(256 * np.array(v, np.float64)).astype(object).tolist()))] = True
    fit = list(fit)
    out = []
    for i, v in fit:
        if i % every == 0:
            scores = sorted((-max(min(sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), 2**63 - 1), 1 - 2**63), j) for j, w in fit if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(400)]
    rows += [(i + 1000, rows[50][1]) for i in range(30)] + [(2000, [0.0] * 6), (2001, None), (2002, []), (2003, [None] * 6), (2050, [float("nan")] + [0.0] * 5), (2100, [float("inf")] * 6), (None, [0.1] * 6), rows[100], (100, rows[7][1]), (150, rows[8][1]), (150, rows[9][1]), (2200, [0.5, 0.25]), (2201, [-0.5, 0.25]), (-50, [1e7] * 6), (-51, [1e7] * 6), (-52, [-1e7] * 6), (2300, [0.3] * 9)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, shard_rows=64, block_queries=3, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(exact)


def test_large_components_stay_exact():
    q = np.array([[2.0**40, 1.0]])
    v = np.array([[2.0**22, 3.0], [2.0**22, 4.0]])
    assert topk._products(q, v).tolist() == [[2**62 + 3, 2**62 + 4]]
    assert topk._products(q * 8, v).tolist() == [[2**63 - 1] * 2] and topk._products(-q * 8, v).tolist() == [[1 - 2**63] * 2]


def test_few_and_none(spark):
    one = spark.createDataFrame([(50, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).count() == 0
    two = spark.createDataFrame([(50, [0.1, 0.2]), (51, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(50, 1, 51, 25 * 25 + 51 * 51)]
    assert topk.top_k(one.limit(0)).count() == 0


def test_bounds_leave_nodes_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (20, 8))
    v = np.floor(np.concatenate([c + rng.normal(0, 5, (100, 8)) for c in centres]))
    tree = topk.build(np.arange(len(v)), v, 32)
    seen = []
    products = topk._products
    topk._products = lambda q, w: seen.append(len(w)) or products(q, w)
    try:
        got = topk.search(tree, np.array([-1]), v[:1], np.array([np.iinfo(np.int64).min]), 5)
    finally:
        topk._products = products
    scores = (v @ v[0]).astype(int)
    assert sorted(got["score"], reverse=True) == sorted(scores, reverse=True)[:5]
    assert sum(seen) < len(v) / 2


def test_parts_of_space():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (8, 6))
    v = np.concatenate([c + rng.normal(0, 5, (200, 6)) for c in centres])
    nodes = topk.cut(v[rng.permutation(len(v))[:400]], 8)
    part = topk.part_of(v, nodes)
    assert set(part) == set(range(8)) and np.bincount(part).max() < 3 * len(v) / 8
    assert topk.cut(np.ones((50, 3)), 4) == [] and topk.part_of(np.ones((3, 3)), []).tolist() == [0, 0, 0]


def test_roots_leave_shards_out(spark, monkeypatch):
    """Clustered vectors: few of the pairs of blocks and shards are moved, and the result is exact; many copies of one vector too."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 2, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.02, 6)).tolist()) for i in range(1200)] + [(5000 + i, centres[0].tolist()) for i in range(300)]
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    moved = []
    written = topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df, name: (moved.append(written(df, name)), moved[-1])[1] if name in ("query-pairs", "query-blocks", "trees") else written(df, name))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=100, block_queries=8, leaf=16)
    assert sorted(map(tuple, got.collect())) == brute(exact)
    trees, blocks, pairs = (df.count() for df in moved)
    assert pairs < trees * blocks / 2


def test_pages_of_roots(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROOTS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(500)]
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=40, block_queries=2, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(exact)
