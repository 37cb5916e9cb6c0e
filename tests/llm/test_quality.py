import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality

LISTS = {k: [w.encode() for w in v.split()] for k, v in quality.COMMON_WORDS.items()}


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = ["", " \t\n", "a", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "#*$%&|<> é ü", "é é x\x1cy\x85z", "a\x0bb\x0cc\rd", "to be " * 5000, "one " * 3, "日本語 テキスト", "x" * 100000, "a b a b a b", "\n".join(["same line here"] * 40)]


def test_base_figures():
    rng = random.Random(0)
    for t in [*ODD, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(300))]:
        assert quality.features(t, None, LISTS)[:5] == brute(t), t[:40]


def test_distance_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 5, 6).tolist(), rng.integers(1, 9, 6).tolist()) for _ in range(50)]
    rows = [r for r in rows if sum(r[0])]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(quality.distance(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(rows, got, strict=True):
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (p + q) / 2
        kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u)  # noqa: B023, E731
        assert r[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def corpus():
    rng = random.Random(1)
    common = quality.COMMON_WORDS["en"].split()
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(4, 9)))
    good = [(i, "en", " ".join(word() for _ in range(200)) + ".") for i in range(60)]
    junk = [(100, "en", " ".join(f"{word()}###" for _ in range(200)).upper()), (101, "en", " | ".join("".join(rng.choice("qxz") for _ in range(8)) for _ in range(200))), (102, "en", "the same words " * 100), (103, "en", "too short")]
    return good + junk


def test_verdicts(spark):
    rows = [*corpus(), (None, None, None), (200, "xx", corpus()[0][2]), (201, None, "é " * 300), corpus()[0]]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, lang string, text string, chars string")
    got = quality.apply_rules(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {100, 101}
    assert {r.doc_id for r in got if r.base_failed} == {102, 103, None, 201}
    guarded = [r for r in got if r.doc_id == 200][0]
    assert guarded.kept and guarded.char_distance is None  # too little text in its language for a reference
    kept = quality.passing(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(60), 0, 200])


def test_clean_labelled_documents_stay(spark):
    base = "/root/testdata/sf0.1"
    got = quality.apply_rules(spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("not base_failed")
    counts = {(r.quality, r.kept): r.n for r in got.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts.get((1, False), 0) <= 0.002 * counts[(1, True)] and counts[(0, False)] > 0.5 * (counts[(0, False)] + counts.get((0, True), 0))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert quality.apply_rules(none).count() == 0 and quality.passing(none).count() == 0
