from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from oracle import compare
from test_packing import check_sequences

import corpus_pipeline
from lodestrata.llm import mixing, packing, paragraphs, quality, queries, secrets
from lodestrata.shipping import ship

SMALL = "/root/testdata/sf0.001"
LISTS = {k: [w.encode() for w in v.split()] for k, v in quality.COMMON_WORDS.items()}


def jensen_shannon(a, b):
    import numpy as np

    p, q = np.array(a) / sum(a), np.array(b) / sum(b)
    m = (p + q) / 2
    return float(np.sqrt(max(0.0, sum(u * np.log2(u / w) for x in (p, q) for u, w in zip(x, m, strict=True) if u) / 2)))


def brute_stages(rows):
    """The stages up to the mixture on a list of documents, in plain Python."""
    seen = {r["doc_id"]: quality.features(r["text"], r["lang"], LISTS) for r in rows}
    sums = {g: [sum(seen[r["doc_id"]][0] for r in rows if r["lang"] == g), *([sum(x) for x in zip(*(seen[r["doc_id"]][k] for r in rows if r["lang"] == g), strict=True)] for k in (5, 6))] for g in {r["lang"] for r in rows}}

    def passes(r):
        f, (n, chars, common) = seen[r["doc_id"]], sums[r["lang"]]
        if f[0] < 50 or 100 * f[4] > 50 * f[0]:
            return False
        sized = n >= quality.MIN_WORDS_REFERENCE
        if sized and sum(f[5]) >= quality.MIN_CHARS_JUDGED and jensen_shannon(f[5], chars) > quality.MAX_CHAR_DISTANCE:
            return False
        return not (sized and f[0] >= quality.MIN_WORDS_JUDGED and f[6] and jensen_shannon(f[6], common) > quality.MAX_WORD_DISTANCE)

    good = [r for r in rows if passes(r)]
    sets = {r["doc_id"]: paragraphs.shingles(r["text"]) for r in good}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = [r for r in good if find(r["doc_id"]) == r["doc_id"]]
    clean = [r | {"text": secrets.redacted(r["text"])} for r in single]
    return good, single, [r | {"n_chars": len(r["text"])} for r in clean]


def test_every_stage_against_brute_force(spark):
    docs = ship(spark).read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [r.asDict() for r in docs.collect()]
    outputs, current = [], docs
    for name, stage in corpus_pipeline.STAGES:
        current = corpus_pipeline.materialise(stage(spark, current, SMALL), "test")
        outputs.append(current)
        assert name == "packing" or current.columns == docs.columns
    key = lambda rs: sorted(tuple(r[c] for c in docs.columns) for r in rs)
    for want, got in zip(brute_stages(rows), outputs, strict=False):
        assert key(want) == key(r.asDict() for r in got.collect())
    clean = outputs[2]
    con = duckdb.connect()
    con.register("documents", clean.toPandas())
    placed = con.sql(mixing.mix_sql()).fetchall()
    mixed = Counter(r.doc_id for r in outputs[3].collect())
    assert mixed == Counter(r[0] for r in placed) and set(mixed) == {r.doc_id for r in clean.collect()}
    pieces = outputs[4].collect()
    encode = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    texts = {r.doc_id: r.text for r in clean.collect()}
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.ids))
    for d, times in mixed.items():
        want = encode(texts[d]).tobytes() + b"\1\0\0\0"
        assert sorted(by_doc[d]) == sorted((at * 4 // 4, want[4 * at : 4 * (at + n)]) for at, n in _cut(len(want) // 4) for _ in range(times))
    check_sequences(pieces, packing.CAPACITY)
    assert len(stages) == 5


def _cut(n):
    at = 0
    for size in packing.cuts(n):
        yield at, size
        at += size


def test_stages_with_odd_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, slot int, kept boolean, fp long, nth int, spans string, `a.b` int"
    good = " ".join(f"word{i}" for i in range(160))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good, "en", None, 1), (None, good + " x y z", None, "s", None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "password=abcdefgh " + good[::-1], "en", "t", 1), (6, "é" * 300000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "r", 1, True, 2, 3, "s", 4) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns, name
        ids = Counter(r.doc_id for r in got.collect())
        assert set(ids) == {"quality rules": {1, 2, None, 5}, "simhash near-dedup": {1, None, 3, 5, 6}}.get(name, {1, 2, 3, 4, 5, 6, None})
    assert corpus_pipeline.sequence_packing(spark, docs, SMALL).select("doc_id").distinct().count() == 7


def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, SMALL).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_columns(spark, name):
    assert queries.queries()[name](spark, SMALL).columns[0] in ("doc_id", "conv_id", "query_id")
