import random

from lodestrata.llm import copies, paragraphs, simhash


def brute(texts):
    """The ids that stay: the least of each component over exact Jaccard similarities."""
    sets = {d: paragraphs.shingles(t or "") for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in texts if find(d) == d}


def planted(rng):
    texts = {1000: None, 1001: "", 1002: " \n", 1003: "two words", 1004: "Two  words", 1005: "é x " * 300, 1006: "É x " * 300}
    for k in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 600))]
        for i in range(4):
            texts[10 * k + i] = " ".join(base)
            base = base[:]
            for _ in range(len(base) // 100 + (i == 2) * len(base) // 20):  # the last copies are edited beyond the threshold
                base[rng.randrange(len(base))] = "edited%d" % rng.randrange(3000)
    return texts


def test_near_copies_of_whole_documents_are_found(spark):
    texts = planted(random.Random(5))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert len({r.component_id for r in simhash.near_duplicates(df).collect()}) > len(want)  # two bits leave near copies
    for block in (copies.BLOCK, 1):
        got = copies.one_of_each(df, block=block)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in copies.one_of_each(docs).collect()} == want


def test_rows_not_ids_are_dropped(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (5, c), (5, c), (None, a), (None, a), (None, a + " more")]
    got = copies.one_of_each(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, nth string"))
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert [r for r in got if r[0] is not None] == [(1, a), (2, b), (5, c)]
    assert len([r for r in got if r[0] is None]) == 1


def test_fingerprints_are_candidates_of_their_own(spark, monkeypatch):
    """Without bands, what the trie join connects is still checked and found; what is unlike is not."""
    monkeypatch.setattr(copies, "tune", lambda threshold: (1, 64))
    base = [f"w{i}" for i in range(3000)]
    near = base[:-1] + ["other"]
    texts = {1: " ".join(base), 2: " ".join(near), 3: " ".join(reversed(base))}
    assert (simhash.fingerprint(texts[1], 5) ^ simhash.fingerprint(texts[2], 5)).bit_count() <= copies.BUDGET
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in copies.one_of_each(df).collect()} == {1, 3}


def test_empty_table(spark):
    assert copies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
