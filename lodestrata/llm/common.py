"""What the corpus operators share: written intermediate tables and small text helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: ASCII blanks: the word separators of every operator here.
BLANKS = " \t\n\r\x0b\x0c"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def application_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are. Results may read them lazily, so they stay until clear() or until someone removes the folder."""
    return f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results are written."""
    drop_table(spark, application_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    return materialise_at(df, name)[0]


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark (from 4.1) removes the shuffle files of every execution as it ends, not when the driver next collects garbage. For work whose executions all end in written tables: none reads another's shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans that nothing refers to any more, rather than when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
