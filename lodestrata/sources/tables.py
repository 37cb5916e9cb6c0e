"""Parquet tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the table's files give fewer partitions than there are cores: a small table, whose rows cost more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
