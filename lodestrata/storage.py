"""The folder that driver and executors share, and tables written there. Paths are URIs of any file system that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, given: str | None = None) -> str:
    """The given folder, else spark.checkpoint.dir, else (with a local master only) a temporary one."""
    configured = given or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def application_folder(spark: SparkSession, given: str | None = None) -> str:
    """Where this application's tables are; clear() removes them."""
    return f"{shared_folder(spark, given)}/lodestrata-core/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, given: str | None = None) -> str:
    """A folder of its own, made."""
    path = f"{application_folder(spark, given)}/{uuid.uuid4().hex}"
    target, system = _hadoop(spark, path)
    system.mkdirs(target)
    return path


def written(table: DataFrame, given: str | None = None) -> DataFrame:
    """The table, written once and read again: what reads it several times computes it once, and a lost executor loses nothing."""
    path = f"{new_folder(table.sparkSession, given)}/table.parquet"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def clear(spark: SparkSession, given: str | None = None) -> None:
    """Remove this application's tables, once nothing will read them."""
    target, system = _hadoop(spark, application_folder(spark, given))
    system.delete(target, True)
