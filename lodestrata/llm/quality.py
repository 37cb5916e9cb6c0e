"""Quality rules by distribution divergence.

One pass over the texts counts, per document, the base figures, a histogram of character classes and one of
the common words of its language (with the other words as last bucket). The language references are the sums
of these histograms over all documents of a language. A document fails if the Jensen-Shannon distance (base
2, between 0 and 1) from its language's reference is over a limit, for either histogram. Guards: a histogram
of a text with too few characters or words isn't judged, nor one whose language has too few words in the
whole corpus to be a reference; languages without a word list are judged by characters alone.

A null text counts as having no words and fails the base rules. A null language is a language of its own.
Repeated rows are judged one by one, alike. Base rules: at least MIN_WORDS words, and at most
MAX_REPEAT_PERCENT of them in repeated 3-word windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise, whole_row

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it on was as with by be at from this are or an were had not which have but they his",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec elle son aux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin",
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED, MIN_WORDS_REFERENCE = 500, 100, 2000
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.31
SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = ("lower", "upper", "digit", "space", "line", "sentence", "symbol", "beyond_ascii")
_STRIPPED = b".,;:!?\"'()"
_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"
_FIELDS = [
    ("doc_id", pa.int64()), ("lang", pa.string()),
    *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("chars", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())),
]


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    table[list(b"0123456789")] = 2
    table[list(b" ")] = 3
    table[list(b"\t\n\r\x0b\x0c")] = 4
    table[list(b".,;:!?'\"()-")] = 5
    table[0xC0:] = 7  # the first byte of a code point
    table[0x80:0xC0] = 8  # the others don't count
    return table


_TABLE = _class_table()


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, k = np.fromiter(map(index.__getitem__, words), np.int64, n), len(index)
    pairs = ids[:-1] * k + ids[1:]
    if k > 2_000_000:  # three ids don't fit 63 bits
        pairs, k = np.unique(pairs, return_inverse=True)[1], len(index)
    _, at, count = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    if len(count) == n - 2:
        return 0
    again = np.concatenate((count[at] > 1, [False, False]))
    return int((again | np.roll(again, 1) | np.roll(again, 2)).sum())


def features(text: str, lang: str | None, lists: dict[str, list[bytes]]) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    common: list[int] = []
    if own := lists.get(lang or ""):
        seen = Counter(raw.lower().translate(None, _STRIPPED).split())
        common = [seen[w] for w in own]
        common.append(sum(seen.values()) - sum(common))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(
            text.count, SYMBOLS,
        )), len(lines) - len(set(lines)), repeated_words(words),
        np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=9)[:8].tolist(), common,
    )


def measure(docs: DataFrame, common_words: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base figures and both histograms."""
    lists = {k: [w.encode() for w in v.split()] for k, v in (common_words or COMMON_WORDS).items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, g, *features(t.as_py() or "", g, lists)) for i, g, t in zip(ids, langs, batch.column(2), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, _SCHEMA)


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Rows are written with their figures, so that texts are measured once, and never shuffled."""
    lists = {k: [w.encode() for w in v.split()] for k, v in COMMON_WORDS.items()}
    figures = pa.struct([(n, t) for n, t in _FIELDS[2:]])

    @F.arrow_udf(_SCHEMA.split(", ", 2)[2])
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows = [features(t.as_py() or "", g.as_py(), lists) for t, g in zip(texts, langs, strict=True)]
        return pa.array([dict(zip((f.name for f in figures), r, strict=True)) for r in rows], figures)

    whole = docs.select(whole_row(docs), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    whole = materialise(whole.select("row", "lang", measured.asNondeterministic()("text", "lang").alias("m")), "quality-rows")
    judged = judge(whole.select("row", "lang", "m.*"), materialise(references(whole.select("lang", "m.*")), "quality-references"))
    return judged.filter("kept").select("row.*")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null if either is empty."""
    share = lambda xs: F.transform(xs, lambda x: x / F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    both = total(F.zip_with(share(counts), share(reference), lambda x, y: part(x, y) + part(y, x)))
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """One row per language: words and both histograms, summed."""
    m = measured.withColumn("lang", F.coalesce("lang", F.lit("")))
    longest = 1 + max(len(v.split()) for v in COMMON_WORDS.values())
    sums = m.groupBy("lang").agg(
        F.sum("n_words").alias("n_words"),
        F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CHAR_CLASSES))]).alias("chars"),
        F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(longest)]).alias("common"),
    )
    return sums.withColumn("common", F.filter("common", lambda x: x.isNotNull()))


def judge(
    measured: DataFrame, reference: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS_JUDGED, min_words: int = MIN_WORDS_JUDGED, min_reference: int = MIN_WORDS_REFERENCE,
) -> DataFrame:
    """Adds distances and verdicts."""
    r = reference.select("lang", F.col("n_words").alias("r_words"), F.col("chars").alias("r_chars"), F.col("common").alias("r_common"))
    j = measured.withColumn("lang", F.coalesce("lang", F.lit(""))).join(r, "lang")
    sized = F.col("r_words") >= min_reference
    letters = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)
    j = j.withColumn("char_distance", F.when(sized & (letters >= min_chars), distance(F.col("chars"), F.col("r_chars"))))
    j = j.withColumn(
        "word_distance",
        F.when(sized & (F.col("n_words") >= min_words) & (F.size("common") > 0), distance(F.col("common"), F.col("r_common"))),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > max_char, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, kept and both distances."""
    measured = materialise(measure(docs), "quality")
    judged = judge(measured, references(measured))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def rules_sql() -> str:
    """The same verdicts in DuckDB SQL over the table documents."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(g)}, {i}, {quote(w)})" for g, words in COMMON_WORDS.items() for i, w in enumerate(words.split()))
    kinds = {
        "lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x20]", "line": r"[^\x09-\x0D]",
        "sentence": r"[^.,;:!?'\"()-]", "symbol": r"[a-zA-Z0-9\x20\x09-\x0D.,;:!?'\"()-]|[^\x00-\x7F]",
        "beyond_ascii": r"[\x00-\x7F]",
    }
    chars = " UNION ALL ".join(f"SELECT rid, lang, {i} AS slot, length(regexp_replace(text, {quote(pattern)}, '', 'g')) AS n FROM docs" for i, pattern in enumerate(kinds[k] for k in CHAR_CLASSES))
    distance = lambda name, counts: f"""{name} AS (
        SELECT rid, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2, 0)) AS far, max(whole) AS whole
        FROM (SELECT rid, CAST(sum(n) OVER (PARTITION BY rid) AS DOUBLE) AS whole, n / CAST(sum(n) OVER (PARTITION BY rid) AS DOUBLE) AS p, r / CAST(sum(r) OVER (PARTITION BY rid) AS DOUBLE) AS q
              FROM {counts} JOIN (SELECT lang, slot, sum(n) AS r FROM {counts} GROUP BY lang, slot) USING (lang, slot)) GROUP BY rid)"""  # noqa: E731
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
    listed(lang, slot, word) AS (VALUES {listed}),
    words AS (SELECT rid, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
    placed AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)),
    again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, key) AS c FROM placed) WHERE c > 1),
    repeated AS (SELECT rid, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) t(d) GROUP BY rid),
    base AS (
        SELECT rid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
            len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
        FROM words),
    chars AS ({chars}),
    said AS (SELECT rid, lang, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?"''()]', '', 'g'), '[^\x20\x09-\x0D]+')) AS word FROM docs),
    slotted AS (SELECT rid, lang, coalesce(slot, 99) AS slot, count(*) AS n FROM said LEFT JOIN listed USING (lang, word) WHERE lang IN (SELECT lang FROM listed) GROUP BY ALL),
    common AS (SELECT rid, docs.lang, slot, coalesce(n, 0) AS n FROM docs JOIN (SELECT lang, slot FROM listed UNION ALL SELECT DISTINCT lang, 99 FROM listed) USING (lang) LEFT JOIN slotted USING (rid, slot) WHERE rid IN (SELECT rid FROM slotted)),
    {distance("by_chars", "chars")},
    {distance("by_words", "common")},
    sized AS (SELECT lang, sum(n_words) >= {MIN_WORDS_REFERENCE} AS sized FROM base JOIN docs USING (rid) GROUP BY lang),
    judged AS (
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
            CASE WHEN sized AND by_chars.whole >= {MIN_CHARS_JUDGED} THEN by_chars.far END AS char_distance,
            CASE WHEN sized AND n_words >= {MIN_WORDS_JUDGED} THEN by_words.far END AS word_distance
        FROM docs JOIN base USING (rid) JOIN sized USING (lang) LEFT JOIN repeated USING (rid) LEFT JOIN by_chars USING (rid) LEFT JOIN by_words USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept,
        round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
    FROM judged"""
