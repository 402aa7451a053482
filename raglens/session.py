"""Reading the given tables."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Python workers of this machine also find the package where it is not installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting to delete an execution's shuffle files once it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept on the executors' disks; the shuffle files that made them are deleted at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    finally:
        conf.set(_CLEANUP, before)
