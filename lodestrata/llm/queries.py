"""The queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread
from . import chat, mixing, packing, paragraphs, pii, quality, secrets, simhash, suffixes, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.tag(_documents(spark, sf_dir)))


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    tokenizer, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    nodes, members = chat.prefix_tree(said.union(more), tokenizer, ranks)
    return chat.digest(chat.read_back(nodes, members, tokenizer))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(_documents(spark, sf_dir)))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packing.digest(pieces)


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_documents(spark, sf_dir))


def op8_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


CHAT_SQL = """
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), escaped AS (
        SELECT *, replace(role, '\\', '\\\\') AS r, replace(text, '\\', '\\\\') AS t FROM said
    ), sized AS (
        SELECT *, 9 + 8 + 7 + length(r) + length(t)
            + len(regexp_extract_all(r, '<\\|start\\|>|<\\|text\\|>|<\\|end\\|>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>'))
            + len(regexp_extract_all(t, '<\\|start\\|>|<\\|text\\|>|<\\|end\\|>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>')) AS chars FROM escaped
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id"""

TOP_K_SQL = """
    WITH fit AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5"""


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return paragraphs.digest(paragraphs.every(docs, paragraphs.repeated(docs, min_words=paragraphs.SHINGLE)))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the counts and the digest of its base spans."""
    return op1_pii_weak_supervision(spark, sf_dir).drop("spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the counts and the digest of its base spans."""
    return op9_secret_scan(spark, sf_dir).drop("spans")


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Counts and digest of leftmost non-overlapping matches: by kind, its pattern and a condition on ``found``. Gaps and matches alternate, which gives places."""
    each = []
    for order, (kind, (pattern, fits)) in enumerate(kinds.items()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        each.append(f"""
        SELECT rid, '{kind}' AS kind, {order} AS ord, found, start FROM (
            SELECT rid, fs[i] AS found, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(fs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, {quoted}) AS fs, string_split_regex(text, {quoted}) AS gs FROM docs))
        ) WHERE {fits.replace("PATTERN", quoted)}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(each)})
    SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(found)), ',' ORDER BY start, ord), '')) AS base_sha256
    FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER)
    ELSE CAST(reverse({_DIGITS})[i] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

PII_SQL = _spans_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS BIGINT), 999) > 255)) = 0",
    ),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
})

SECRET_SQL = _spans_sql({
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=-]+)""",
        r"""length(regexp_extract(found, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""",
    ),
    "access": (r"AKIA[A-Z0-9]+", "length(found) >= 20"),
    "hex": (r"[0-9a-f]+", "length(found) >= 24"),
})


_OPERATORS = (
    op1_pii_weak_supervision, op2_chat_prefix_tree, op3_simhash_trie, op4_suffix_repeats, op5_pfair_mix, op6_harmonic_packing,
    op7_quality_divergence, op8_ball_tree_top_k, op9_secret_scan, op10_paragraph_minhash, pii_base_spans, secret_base_spans,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_prefix_tree": CHAT_SQL, "op5_pfair_mix": mixing.mix_sql(), "op7_quality_divergence": quality.rules_sql(), "op8_ball_tree_top_k": TOP_K_SQL,
        "pii_base_spans": PII_SQL, "secret_base_spans": SECRET_SQL,
    }
