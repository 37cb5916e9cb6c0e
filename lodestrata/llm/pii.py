"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are the matches of the base patterns (email, ip, card, phone: fixed) and of looser patterns for other kinds (named, ssn,
iban, masked email, local phone). Base matches that fail their kind's check are candidates too, so that labelers learn from what
is no personal data, but they are never in the result. Six labelers vote for or against each candidate, or abstain: its own
check (Luhn, number ranges, digit counts), gazetteers, words of its kind before it, words that speak against it, its borders, and
whether it is written as its kind mostly is.

1. Votes are counted by pattern: 3**6 rows at most, whatever the corpus. Expectation-maximisation over them, one
   SQL fold, estimates how often true candidates are and how reliable each labeler is.
2. With the estimates, each candidate has a probability. A naive Bayes span classifier is trained on these as soft
   labels, over all candidates, with hashed features (kind, length, neighbouring words and characters): BUCKETS
   weights, however large the corpus.
3. Base spans stay. Another candidate is added if the classifier's probability is at least THRESHOLD and it
   overlaps no base span.

Spans count code points, end exclusive. A null text is empty. Repeated rows are separate documents with the
same spans. Patterns have no upper lengths but those of their kind's own format, and are written so that a failing start is not
tried again inside the same run of characters, which keeps very long texts linear.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE_KINDS, MORE_KINDS = ("email", "ip", "card", "phone"), ("named", "ssn", "iban", "masked_email", "local_phone")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("check", "gazetteer", "context", "against", "borders", "shape")
BUCKETS, ROUNDS, THRESHOLD, SHRINK, BEFORE, AFTER, PART = 1024, 30, 0.5, 4.0, 48, 16, 256
LOWEST = -(1 << 31) + 1

# The base patterns with their contract's meaning. Where a start in the middle of a run can't match if the run's own start doesn't,
# the match must begin at the run's start or where the match before ended (\G). Possessive loops keep Java from recursing.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "named": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-Z][a-z]++\b(?: [A-Z][a-z]++\b)?+",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "masked_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
}
#: What a text must hold before its pattern is tried.
HINTS = {
    "email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){11}", "phone": "+", "named": "\\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\\.? [A-Z]",
    "ssn": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "masked_email": "[(\\[]at[)\\]]", "local_phone": "[0-9]{3}\\)? ?[-. ]?[0-9]{3}[-. ][0-9]{4}",
}
# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov info io de fr es uk eu it nl ch at us ca au jp"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91 92 971 972"
CONTEXT = {
    "email": "email e-mail mail contact write reply courriel correo", "masked_email": "email e-mail mail contact write reply courriel correo",
    "ip": "ip host server address login from adresse", "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono", "local_phone": "phone tel call mobile fax telefon téléphone teléfono",
    "named": "by from dear contact signed name von par por", "ssn": "ssn social security tax", "iban": "iban account bank konto compte cuenta",
}
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Peter Paul "
    "Hans Karl Klaus Wolfgang Stefan Andreas Thomas Ursula Monika Petra Sabine Claudia Pierre Jean Michel Philippe Alain Marie Nathalie Isabelle Sylvie Catherine "
    "Jose Juan Antonio Manuel Francisco Carlos Luis Miguel Maria Carmen Ana Laura Marta Pablo Pedro Diego Lucia Elena"
)
NO_NAMES = "President Minister Chairman Speaker Secretary Director Street Avenue Road Hospital University Company The This That You And"
IBAN_LANDS = "AD AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR"
AGAINST = "version isbn issn doi build section figure release chapter sku serial"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _most(xs: Column) -> Column:
    return F.coalesce(F.array_max(xs), F.lit(LOWEST))


def before_each(xs: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the fold of those before it, in parts, so that thousands of matches stay cheap."""
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda c: F.slice(v, c * PART + 1, F.lit(PART)))
    inside = lambda part, base: F.transform(part, lambda x, i: both(base, fold(F.slice(part, F.lit(1), i))))
    over = lambda ps, totals: F.transform(ps, lambda part, c: bound(fold(F.slice(totals, F.lit(1), c)), lambda base: inside(part, base)))
    whole = lambda ps: bound(F.transform(ps, fold), lambda totals: F.flatten(over(ps, totals)))
    return bound(xs, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(bound(parts(v), whole)))


def sums_before(xs: Column) -> Column:
    return before_each(xs, _sum, lambda a, b: a + b)


def most_before(xs: Column) -> Column:
    """LOWEST where nothing is before."""
    return before_each(xs, _most, F.greatest)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,found,before,after>>: gaps and matches alternate, and what stands around a match is taken from its own gaps and neighbours, so that long texts are not read again for each."""

    def place(s: Column) -> Column:
        gaps, found = s["gaps"], s["found"]
        n, none = F.size(found), F.array(F.lit(""))
        gap = F.transform(gaps, F.length)
        lengths = F.zip_with(F.slice(gap, F.lit(1), n), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        one_before = F.concat(none, F.slice(found, F.lit(1), n - 1))
        one_after = F.concat(F.slice(found, F.lit(2), n), none)
        before = F.zip_with(
            one_before, F.slice(gaps, F.lit(1), n),
            lambda f, g: F.right(F.concat(F.right(f, F.lit(AFTER)), F.right(g, F.lit(BEFORE))), F.lit(BEFORE)),
        )
        after = F.zip_with(
            F.slice(gaps, F.lit(2), n), one_after,
            lambda g, f: F.left(F.concat(F.left(g, F.lit(AFTER)), F.left(f, F.lit(AFTER))), F.lit(AFTER)),
        )

        def spans(ls: Column) -> Column:
            begins = sums_before(F.transform(ls, lambda x: x["g"] + x["m"]))
            each = F.arrays_zip(ls.alias("l"), begins.alias("b"), found.alias("found"), before.alias("before"), after.alias("after"))
            start = lambda x: x["b"] + x["l"]["g"]
            return F.transform(
                each,
                lambda x: F.struct(
                    start(x).alias("start"), (start(x) + x["l"]["m"]).alias("end"), x["found"].alias("found"),
                    x["before"].alias("before"), x["after"].alias("after"),
                ),
            )

        return bound(lengths, spans)

    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return bound(both, lambda s: F.when(F.size(s["found"]) == 0, empty).otherwise(place(s)))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def valid(kind: str, found: Column) -> Column:
    """A kind's own check."""
    n = F.length(_digits(found))
    if kind == "ip":
        return F.forall(
            F.split(found, r"\."),
            lambda x: bound(
                F.regexp_replace(x, "^0+(?=[0-9])", ""),
                lambda y: (F.length(y) <= 3) & (F.coalesce(y.try_cast("int"), F.lit(999)) <= 255),
            ),
        )
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    if kind == "iban":
        turned = bound(F.replace(found, F.lit(" ")), lambda x: F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)))
        digit = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
        return F.aggregate(
            F.split(turned, ""), F.lit(0),
            lambda a, x: F.when(x == "", a).otherwise(((a * F.when(digit(x) > 9, 100).otherwise(10)) + digit(x)) % 97),
        ) == 1
    return F.lit(True)


def shape(kind: str, found: Column) -> Column:
    """1 if it is written as its kind mostly is, -1 if oddly."""
    usual = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:(?!-)[A-Za-z0-9-]{1,63}+(?<!-)\.)++[A-Za-z]{2,}$", "ip": r"^[1-9][0-9]*(?:\.(?:0|[1-9][0-9]*)){3}$",
        "card": r"^[3-6](?:[0-9]+|[0-9]{3}(?: [0-9]{4}){2}(?: [0-9]{1,7})|[0-9]{3}(?:-[0-9]{4}){2}(?:-[0-9]{1,7}))$", "phone": r"^\+[1-9][0-9]{0,2}[ .(-]*[0-9]{1,5}(?:[ ).-]{1,2}[0-9]{2,5}){1,4}$",
        "named": r"\. ", "iban": f"^(?:{'|'.join(IBAN_LANDS.split())})", "masked_email": r"[(\[]dot[)\]]", "local_phone": r"^\(?[2-9]",
    }
    return F.when(found.rlike(usual[kind]), 1).otherwise(-1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, cands) per document: kind, its place in KINDS, start, end, found, valid and the text around."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(kind: str) -> Column:
        hint = F.contains(F.col("text"), F.lit(HINTS[kind])) if kind in ("email", "phone") else F.col("text").rlike(HINTS[kind])
        made = F.transform(matches(F.col("text"), PATTERNS[kind]), lambda s: F.struct(
            s["start"].cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].cast("long").alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found"), F.coalesce(valid(kind, s["found"]), F.lit(False)).alias("valid"),
            s["before"].alias("before"), s["after"].alias("after"),
        ))
        if kind == "card":  # a number of a few digits is not a card that failed its check
            made = F.filter(made, lambda c: F.length(_digits(c["found"])) >= 12)
        return F.when(hint, made).otherwise(F.array().cast("array<struct<start:long,order:int,end:long,kind:string,found:string,valid:boolean,before:string,after:string>>"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.array_sort(F.concat(*map(of, KINDS))).alias("cands"))


def votes(c: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 abstains."""
    word = lambda words: f"(?i)(?:^|[^a-z])(?:{'|'.join(words.split())})[^a-z]{{1,12}}$"
    by_kind = lambda table, other: F.coalesce(*[F.when(c["kind"] == k, v) for k, v in table.items()], other)
    context = by_kind({k: F.when(c["before"].rlike(word(w)), 1).otherwise(0) for k, w in CONTEXT.items()}, F.lit(0))
    listed = lambda x, words: F.when(x.isin(*words.split()), 1).otherwise(-1)
    code = F.regexp_extract(c["found"], r"^\+([0-9]{1,3})(?=[\x20()-])", 1)
    first = F.regexp_extract(c["found"], r"^\S+ (\S+)", 1)
    gazetteer = by_kind({
        "email": listed(
            F.lower(F.regexp_extract(c["found"], r"\.([A-Za-z]+)$", 1)), TOP_DOMAINS,
        ), "masked_email": listed(F.lower(F.regexp_extract(c["found"], r"([A-Za-z]+)$", 1)), TOP_DOMAINS),
        "phone": F.when(code == "", 0).otherwise(listed(code, CALLING_CODES)),
        "named": F.when(first.isin(*FIRST_NAMES.split()), 1).when(first.isin(*NO_NAMES.split()), -1).otherwise(0),
    }, F.lit(0))
    check = by_kind({k: F.when(c["valid"], 1).otherwise(-1) for k in ("ip", "card", "phone", "ssn", "iban")}, F.lit(0))
    against = F.when(c["before"].rlike(word(AGAINST)), -1).otherwise(0)
    borders = F.when(c["before"].rlike("[A-Za-z0-9_=/]$") | c["after"].rlike("^[A-Za-z0-9_=/]"), -1).otherwise(0)
    return F.array(check, gazetteer, context, against, borders, by_kind({k: shape(k, c["found"]) for k in KINDS if k != "ssn"}, F.lit(0)))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """Prior and reliabilities by expectation-maximisation over the counts of vote patterns (column votes), with clamps that keep labelers better than chance."""
    counts = voted.groupBy("votes").count().agg(F.array_sort(F.collect_list(F.struct(
        "votes", F.col("count").cast("double").alias("n"),
    ))).alias("ps"))
    counts = counts.select(F.when(F.size("ps") > 0, F.col("ps")).alias("ps"))

    def step(state: Column, _: Column) -> Column:
        log_odds = lambda vs: F.ln(state["prior"] / (1 - state["prior"])) + F.aggregate(F.zip_with(vs, state["right"], lambda v, r: v * F.ln(r / (1 - r))), F.lit(0.0), lambda a, x: a + x)
        soft = F.transform(
            "ps",
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (1 / (1 + F.exp(-log_odds(p["votes"])))).alias("t")),
        )

        def again(ps: Column) -> Column:
            total = lambda f: F.aggregate(ps, F.lit(0.0), lambda a, p: a + f(p))
            agreed = lambda j: total(lambda p: p["n"] * F.when(p["votes"][j] == 1, p["t"]).when(p["votes"][j] == -1, 1 - p["t"]).otherwise(0.0))
            given = lambda j: total(lambda p: p["n"] * F.abs(p["votes"][j]))
            clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
            prior = clamp((total(lambda p: p["n"] * p["t"]) + 1) / (total(lambda p: p["n"]) + 2), 0.02, 0.98)
            return F.struct(
                prior.alias("prior"),
                F.transform(
                    F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)),
                    lambda j: clamp((agreed(j) + 8) / (given(j) + 10), 0.55, 0.99),
                ).alias("right"),
            )

        return bound(soft, again)

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), len(LABELERS)).alias("right"))
    model = counts.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).select("m.*").first()
    return {"prior": model["prior"], "right": list(model["right"])} if model["right"] else {"prior": 0.5, "right": [0.8] * len(LABELERS)}


def probability(vs: Column, model: dict) -> Column:
    from math import log

    terms = [vs[j] * F.lit(log(r / (1 - r))) for j, r in enumerate(model["right"])]
    return 1 / (1 + F.exp(-sum(terms, F.lit(log(model["prior"] / (1 - model["prior"]))))))


def features(c: Column) -> Column:
    """Buckets of a candidate's hashed features."""
    words = [
        c["kind"], F.concat_ws(":", c["kind"], F.length(c["found"]).cast("string")), F.concat_ws(
            ":", F.lit("v"), c["kind"], c["valid"].cast("string"),
        ),
        F.concat_ws(
            ":", F.lit("b"), F.lower(F.regexp_extract(c["before"], r"(\p{L}+)\P{L}*$", 1)),
        ), F.concat_ws(":", F.lit("a"), F.lower(F.regexp_extract(c["after"], r"^\P{L}*(\p{L}+)", 1))),
        F.concat_ws(
            ":", F.lit("x"), F.translate(F.regexp_extract(c["before"], "(.{0,2})$", 1), "0123456789", "9999999999"),
        ), F.concat_ws(":", F.lit("y"), F.translate(F.regexp_extract(c["after"], "^(.{0,2})", 1), "0123456789", "9999999999")),
    ]
    return F.array(*[F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") for w in words])


def train(found: DataFrame, model: dict) -> dict:
    """Naive Bayes log-odds per bucket, from soft labels over all candidates (column c)."""
    soft = found.select(features(F.col("c")).alias("f"), probability(votes(F.col("c")), model).alias("t"))
    counts = soft.select(F.explode("f").alias("f"), "t").groupBy("f").agg(F.sum("t").alias("yes"), F.sum(1 - F.col("t")).alias("no"))
    whole = soft.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(1 - F.col("t")), F.lit(0.0)).alias("no")).first()
    yes, no = whole["yes"] + 1, whole["no"] + 1
    # odds of a bucket against those of all candidates, both shrunk alike, so that a bucket seen rarely says little
    weight = F.ln((F.col("yes") + F.lit(SHRINK * yes / (yes + no))) / (F.col("no") + F.lit(SHRINK * no / (yes + no)))) - F.ln(F.lit(yes / no))
    from math import log

    weights = [0.0] * BUCKETS
    for row in counts.select("f", weight.alias("w")).toLocalIterator():  # BUCKETS rows at most
        weights[row["f"]] = row["w"]
    return {"bias": log(yes / no), "weights": weights}


def tag(docs: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per document; spans are array<struct<start,order,end,kind,p>> in order of start, then kind."""
    found = materialise(candidates(docs), "pii-candidates")
    each = found.select(F.explode("cands").alias("c"))
    model = estimate(each.select(votes(F.col("c")).alias("votes")), rounds)
    trained = train(each, model)
    weights = F.from_json(F.lit(json.dumps(trained["weights"])), "array<double>")
    score = lambda c: F.lit(trained["bias"]) + F.aggregate(features(c), F.lit(0.0), lambda a, f: a + F.get(weights, f))
    place = lambda c: [c[x].alias(x) for x in ("start", "order", "end", "kind")]
    scored = F.transform("cands", lambda c: F.struct(*place(c), (1 / (1 + F.exp(-score(c)))).alias("p"), c["valid"].alias("valid")))
    is_base = lambda c: c["order"] < len(BASE_KINDS)
    stands = lambda c: F.when(is_base(c), c["valid"]).otherwise(c["p"] >= threshold)
    some = lambda cs, f: F.transform(cs, lambda c: F.when(is_base(c), f(c)).otherwise(LOWEST).cast("int"))

    def apart(cs: Column) -> Column:
        """Of spans in order of start, the base ones and those that overlap no base one: none before ends later, none after starts earlier."""
        ended = most_before(some(cs, lambda c: c["end"]))
        ahead = F.reverse(most_before(F.reverse(some(cs, lambda c: -c["start"]))))
        zipped = F.arrays_zip(cs.alias("c"), ended.alias("ended"), ahead.alias("ahead"))
        clear = lambda z: is_base(z["c"]) | ((z["ended"] <= z["c"]["start"]) & (z["c"]["end"] <= -z["ahead"]))
        return F.transform(F.filter(zipped, clear), lambda z: z["c"])

    kept = lambda cs: F.when(F.forall(cs, is_base), cs).otherwise(apart(cs))
    chosen = bound(bound(scored, lambda cs: F.filter(cs, stands)), kept)
    spans = F.transform(chosen, lambda c: F.struct(*place(c), c["p"].alias("p")))
    none = F.array().cast("array<struct<start:long,order:int,end:long,kind:string,p:double>>")
    return found.select("doc_id", F.when(F.size("cands") == 0, none).otherwise(spans).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(tagged: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE_KINDS))
    return tagged.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
