"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture and packing, each stage written and read again.

All stages but the last return the columns of documents. Quality rules drop what they reject; of each group of
near-duplicates one document stays; secrets are replaced in the texts; the mixture repeats documents of
sources above their natural share and puts rows in its order; packing returns the pieces of the sequences. Near-dedup takes its
candidates from the SimHash trie join and from MinHash bands, and keeps one document of each group that is alike by exact similarity.

Null and empty texts fail the quality rules. Near-dedup drops rows, not ids; rows without an id are
held to each other only. A null text stays null in the secret scan and is one token in the packing. A null
source is a source. An empty table stays empty, and further columns are kept through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import copies, mixing, packing, quality, secrets
from lodestrata.llm.common import materialise
from lodestrata.shipping import ship
from lodestrata.sources.tables import read_table, spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return copies.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("*", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing to target weights", source_mix),
    ("packing", sequence_packing),
]

#: Fingerprints and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
