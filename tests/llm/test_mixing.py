from collections import Counter, defaultdict

import duckdb
import pytest

from lodestrata.llm import mixing


def docs(spark, sizes, more=()):
    rows = [(i, s, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame([*rows, *more], "doc_id long, source string, slot string")


def planned(spark, sizes, slots, weights=None):
    """Target weights, lanes' shares in slots, and documents per block, in plain Python."""
    rows = spark.createDataFrame([("0" if s is None else "1" + s, n) for s, n in sizes.items()], "key string, n long")
    weighted = mixing.weighed(rows, weights, mixing.ALPHA, slots)
    lanes = {r.lane: r.q for r in mixing.schedule(mixing.shares(weighted, slots), slots).collect()}
    return {r.key[1:] if r.key[0] == "1" else None: (r.w / r.total, r.lane, lanes[r.lane]) for r in weighted.collect()}, lanes


def check_mix(got, sizes, block, slots, plan):
    """Windows kept, one lane per slot, all documents there, and every source within one block (and half a document) of its target after any slot."""
    sources, lanes = plan
    assert sum(lanes.values()) == slots and len(lanes) <= slots
    lane_of, jobs = {}, {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert lane_of.setdefault(r.slot, sources[r.source][1]) == sources[r.source][1]
        assert jobs.setdefault((sources[r.source][1], r.block), r.slot) == r.slot
    assert Counter(r.source for r in got if r.epoch == 0) == Counter(sizes)
    times = defaultdict(Counter)
    for r in got:
        times[r.source][r.slot] += 1
    for source, (weight, _, q) in sources.items():
        size, done = weight * slots * block / q, 0
        for t in range(max(lane_of) + 1):
            done += times[source][t]
            assert abs(done - weight * block * (t + 1)) < size + 0.5 + 1e-9, (source, t)
    return lane_of


@pytest.mark.parametrize("sizes", [{"a": 90, "b": 30, "c": 11}, {"only": 20}, {"big": 300, "tiny": 1}, {"a": 8, None: 24}, {"a": 200, "b": 150, **{f"s{i}": 1 + i % 3 for i in range(50)}}])
def test_windows_and_deviation(spark, sizes):
    got = mixing.mix(docs(spark, sizes), slots=60, block_docs=4).collect()
    check_mix(got, sizes, 4, 60, planned(spark, sizes, 60))


def test_small_sources_are_not_repeated_by_coarse_slots(spark):
    """With natural weights nothing is repeated but in the last block, however small a source is."""
    sizes = {"big": 3000, "some": 400, **{f"s{i}": 1 for i in range(20)}}
    got = mixing.mix(docs(spark, sizes), alpha=1.0, slots=100, block_docs=4).collect()
    counts = Counter(r.source for r in got)
    assert 3000 <= counts["big"] <= 3000 + 8 and 400 <= counts["some"] <= 404 and all(counts[f"s{i}"] <= 2 for i in range(20))


def test_a_document_of_very_many_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EPOCHS", 8)
    got = mixing.mix(docs(spark, {"a": 300, "b": 1}), {"a": 1.0, "b": 1.0}, slots=50, block_docs=4).collect()
    epochs = sorted(r.epoch for r in got if r.source == "b")
    assert epochs == list(range(len(epochs))) and abs(len(epochs) - 300) <= 5


def test_given_weights(spark):
    got = mixing.mix(docs(spark, {"a": 100, "b": 100}), {"a": 3.0, "b": 1.0}, slots=100, block_docs=1).collect()
    counts = Counter(r.source for r in got)
    assert counts["a"] / counts["b"] == pytest.approx(3, rel=0.05) and counts["b"] == 100
    epochs = defaultdict(set)
    for r in got:
        epochs[r.doc_id].add(r.epoch)
    assert all(e == set(range(len(e))) for e in epochs.values())


def test_more_sources_than_slots(spark):
    sizes = {f"s{i}": 1 for i in range(30)}
    got = mixing.mix(docs(spark, sizes), slots=10, block_docs=1).collect()
    check_mix(got, sizes, 1, 10, planned(spark, sizes, 10))
    assert len(got) == 30


def test_repeated_rows_null_ids_and_no_rows(spark):
    got = mixing.mix(docs(spark, {"a": 5}, [(0, "a", "y"), (None, "a", "z"), (None, None, "z")]), block_docs=2).collect()
    first = [r for r in got if r.epoch == 0]
    assert Counter((r.doc_id, r.source) for r in first) == Counter([(0, "a"), (0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (None, "a"), (None, None)])
    assert mixing.mix(docs(spark, {})).count() == 0


def test_rows_keep_their_columns_and_come_in_the_mixs_order(spark):
    df = docs(spark, {"a": 40, "b": 9})
    got = mixing.mixed_rows(df, slots=20, block_docs=2)
    order = [r.doc_id for r in mixing.mix(df, slots=20, block_docs=2).orderBy("slot", "place", "source").collect()]
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == order


def test_plan_is_native_and_its_broadcast_is_the_schedule(spark):
    plan = mixing.mix(docs(spark, {"a": 3}))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_sql_gives_the_same_mix(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, mixing.mix(spark.read.parquet(path)).collect())) == sorted(con.sql(mixing.mix_sql()).fetchall())


def test_sql_with_null_ids_and_more_sources_than_slots(spark):
    con = duckdb.connect()
    sizes = {"big": 90, None: 7, **{f"s{i}": 1 + i % 2 for i in range(40)}}
    df = docs(spark, sizes, [(None, "big", "x"), (None, "big", "y"), (None, None, "z"), (3, "big", "x"), (3, "big", "x")]).cache()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(mixing.mix(df, slots=20, block_docs=3).collect()) == key(con.sql(mixing.mix_sql(slots=20, block_docs=3)).fetchall())
