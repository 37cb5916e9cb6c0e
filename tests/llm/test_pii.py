import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import pii

# The base patterns as the contract states them.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if fits:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


ODD = [
    None, "", "a@b.c_d@e.f", "x@y", "x@y.", "%@a.b@c.d", "a.b@c..d", "a%b@c-d.e-f.g-", "1.2.3.4.5.6.7.8", "0001.002.03.4", "256.1.1.1", "1.1.1.1.1",
    "4111 1111-1111 1111", "4111  1111", "-4111111111111111-", "+1 (555) 123-4567", "+1 5", "++1 555 123 4567 +", "+12345678 -(9", "é@é.com ñ 4111111111111111 ü a@b.co",
    "a@b.c@d.e@f.g", "x" * 5000 + "@" + "y.z" * 1000, "1." * 500, "9" * 30000, "a" * 200000, "+" + "1 " * 20000, "a@b" + ".c" * 20000, "\n".join(f"10.0.0.{i % 256} a{i}@b.org" for i in range(1500)),
]


def test_base_spans_of_odd_texts(spark):
    texts = [*ODD, ODD[2], ODD[2]]
    df = spark.createDataFrame([(i if i else None, t, "spans") for i, t in enumerate(texts)], "doc_id long, text string, cands string")
    got = pii.digest(pii.tag(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id or 0] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id or 0][:50]
        assert r.n_email == want.count("email:") and r.n_card == want.count("card:")


def test_other_kinds_are_added_and_never_over_base_spans(spark):
    text = "Mr. John Smith SSN 123-45-6789 iban: DE89 3704 0044 0532 0130 00 bob (at) site (dot) com call (555) 123-4567 or +1 (555) 123-4567"
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(9, "mail a@b.com from 10.0.0.1")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.tag(df).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in spans[0]] == [
        ("named", "Mr. John Smith"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("masked_email", "bob (at) site (dot) com"), ("local_phone", "(555) 123-4567"), ("phone", "+1 (555) 123-4567"),
    ]


def test_doubtful_candidates_stay_out(spark):
    good = [(i, f"write to person{i}@mail.com or call +1 555 123 4567, ssn 123-45-6789") for i in range(30)]
    bad = [(100 + i, f"build id=000-00-0000x serial 000-12-3456 section 666-12-345{i % 10}") for i in range(30)]
    got = pii.tag(spark.createDataFrame(good + bad, "doc_id long, text string")).select("doc_id", F.explode("spans").alias("s")).collect()
    assert sum(r.s.kind == "ssn" for r in got if r.doc_id < 100) == 30
    assert not [r for r in got if r.doc_id >= 100]


def test_estimates_against_a_plain_fold(spark):
    votes = [([1, 1, 0, 0, 1, 1], 40), ([1, -1, 0, 0, 1, 0], 10), ([-1, -1, 0, -1, -1, 0], 25), ([0, 1, 1, 0, -1, 0], 5)]
    df = spark.createDataFrame([(v,) for v, n in votes for _ in range(n)], "votes array<int>")
    model = pii.estimate(df, 7)
    from math import exp, log

    prior, right = 0.5, [0.8] * 6
    for _ in range(7):
        soft = [1 / (1 + exp(-(log(prior / (1 - prior)) + sum(v * log(r / (1 - r)) for v, r in zip(vs, right, strict=True))))) for vs, _ in votes]
        agreed = [sum(n * (t if vs[j] == 1 else 1 - t if vs[j] == -1 else 0) for (vs, n), t in zip(votes, soft, strict=True)) for j in range(6)]
        given = [sum(n * abs(vs[j]) for vs, n in votes) for j in range(6)]
        prior = min(max((sum(n * t for (_, n), t in zip(votes, soft, strict=True)) + 1) / (sum(n for _, n in votes) + 2), 0.02), 0.98)
        right = [min(max((a + 8) / (g + 10), 0.55), 0.99) for a, g in zip(agreed, given, strict=True)]
    assert model["prior"] == pytest.approx(prior) and model["right"] == pytest.approx(right)


def test_no_documents(spark):
    assert pii.digest(pii.tag(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.digest(pii.tag(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_upper_lengths(spark):
    name, local, host = "A" + "b" * 5000, "u" * 1_000_000, "h" * 300
    texts = [f"signed Dr. {name} John", f"mail {local} (at) {host} (dot) " + " (dot) ".join(["x"] * 50), "a" * 1_000_000 + " (at)", "Mr. x " * 20_000]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.explode("cands").alias("c"))
    got = {r.doc_id: r.c.found for r in found.filter("c.kind IN ('named', 'masked_email')").collect()}
    assert got[0] == f"Dr. {name} John" and got[1] == texts[1][5:] and set(got) == {0, 1}


def test_invalid_base_matches_vote_but_never_come_out(spark):
    df = spark.createDataFrame([(i, f"host 300.1.1.{i} or 10.0.0.{i}, card 4111 1111 1111 1112 or 4111 1111 1111 1111") for i in range(20)], "doc_id long, text string")
    found = pii.candidates(df).select(F.explode("cands").alias("c"))
    votes = {tuple(r.v) for r in found.select(pii.votes(F.col("c")).alias("v")).collect()}
    assert {v[0] for v in votes} == {1, -1}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.digest(pii.tag(df)).collect():
        assert r.n_ip == r.n_card == 1 and r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()


def test_training_against_a_plain_version(spark):
    from collections import defaultdict
    from math import log

    texts = ["mail a@b.com", "host 10.0.0.1 and 999.1.1.1", "ssn 123-45-6789 build 000-12-3456", "call (555) 123-4567", "Dr. Anna Smith or Dr. President"] * 4
    each = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.explode("cands").alias("c"))
    model = pii.estimate(each.select(pii.votes(F.col("c")).alias("votes")))
    rows = each.select(pii.features(F.col("c")).alias("f"), pii.votes(F.col("c")).alias("v")).collect()
    yes, no, all_yes, all_no = defaultdict(float), defaultdict(float), 1.0, 1.0
    for r in rows:
        odds = log(model["prior"] / (1 - model["prior"])) + sum(v * log(q / (1 - q)) for v, q in zip(r.v, model["right"], strict=True))
        t = 1 / (1 + 2.718281828459045 ** -odds)
        all_yes, all_no = all_yes + t, all_no + 1 - t
        for f in r.f:
            yes[f] += t
            no[f] += 1 - t
    want = {f: log((yes[f] + pii.SHRINK * all_yes / (all_yes + all_no)) / (no[f] + pii.SHRINK * all_no / (all_yes + all_no))) - log(all_yes / all_no) for f in yes}
    got = pii.train(each, model)
    assert got["bias"] == pytest.approx(log(all_yes / all_no))
    assert {f: w for f, w in enumerate(got["weights"]) if w} == pytest.approx({f: w for f, w in want.items() if w})


def test_recall_and_precision_of_added_kinds(spark):
    """Planted true spans beside look-alikes: at least nine of ten found, at least nine of ten right."""
    import random

    rng = random.Random(3)
    two = lambda: f"{rng.choice(['Anna', 'Peter', 'Maria', 'Kurt'])} {rng.choice(['Smith', 'Weber', 'Lopez'])}"
    true = {
        "named": lambda: ("signed by ", f"Dr. {two()}"), "ssn": lambda: ("social security ", f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        "iban": lambda: ("iban ", "DE89 3704 0044 0532 0130 00"), "masked_email": lambda: ("contact ", f"u{rng.randint(1, 99)} (at) site (dot) com"),
        "local_phone": lambda: ("call ", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
    }
    false = [lambda: f"serial 000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", lambda: f"section 666-{rng.randint(10, 99)}-0000", lambda: "part ZZ12 3456 7890 1234 5678", lambda: f"isbn 012-345-{rng.randint(1000, 9999)}", lambda: "Mr President"]
    rows, want = [], set()
    for i in range(400):
        text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(5)) + " "
        if i % 2:
            kind = rng.choice(list(true))
            before, span = true[kind]()
            want.add((i, kind, len(text + before), len(text + before + span)))
            text += before + span
        else:
            text += rng.choice(false)()
        rows.append((i, text + " and so on"))
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.tag(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_overlaps_in_long_texts(spark):
    """Added spans beside thousands of base spans, against all pairs."""
    text = " ".join(f"call +1 555 123 4{i % 10}67 or (555) 123-4{i % 10}67 mail a{i}@b.org" for i in range(700))
    spans = pii.tag(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    base, more = ([s for s in spans if (s.order < 4) == b] for b in (True, False))
    assert len(base) == 1400 and len(more) == 700 and not any(b.start < s.end and s.start < b.end for s in more for b in base)
