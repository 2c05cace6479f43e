"""Running analyses: settings for kinds of storage, cancelling, counting."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings only; results never depend on them.
PROFILES = {
    "auto": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"},
    "ssd": {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.adaptive.enabled": "true"},
    "hdd": {"spark.sql.files.maxPartitionBytes": "512m", "spark.sql.adaptive.enabled": "true"},
    "network": {"spark.sql.files.maxPartitionBytes": "256m", "spark.sql.files.openCostInBytes": "16m", "spark.sql.adaptive.enabled": "true"},
}


def profile(storage: str = "auto") -> dict[str, str]:
    if storage not in PROFILES:
        raise ValueError(f"unknown storage {storage!r}")
    return dict(PROFILES[storage])


def apply_profile(spark: SparkSession, storage: str = "auto") -> None:
    """Settings for a kind of storage, for the queries that this session runs from now on."""
    for key, value in profile(storage).items():
        spark.conf.set(key, value)


@contextmanager
def job_group(spark: SparkSession, name: str, description: str) -> Iterator[None]:
    """Jobs started inside belong to a group that another thread can cancel."""
    sc = spark.sparkContext
    sc.setJobGroup(name, description, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def observed(files: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``files``, and their number and bytes as counted while they pass by."""
    metrics = Observation(name)
    return files.observe(metrics, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), metrics
