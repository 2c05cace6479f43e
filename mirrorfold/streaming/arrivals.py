"""Duplicates in a stream of files, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import full_hash


def arriving(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet manifests as they appear below ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen(stream: DataFrame, algorithm: str = "sha256", delay: str = "1 hour") -> DataFrame:
    """The first file of each content within the watermark; later copies are left out."""
    rows = stream.withColumn("hash", full_hash("content", algorithm)).drop("content")
    return rows.withWatermark("last_modified", delay).dropDuplicatesWithinWatermark(["hash"])


def copies_per_window(stream: DataFrame, algorithm: str = "sha256", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window, hash, n_files, wasted) for contents seen more than once in a window."""
    rows = stream.select("last_modified", "size", full_hash("content", algorithm).alias("hash")).withWatermark("last_modified", delay)
    out = rows.groupBy(F.window("last_modified", width), "hash").agg(F.count("*").alias("n_files"), F.min("size").alias("size"))
    return out.where("n_files > 1").select("window", "hash", "n_files", (F.col("size") * (F.col("n_files") - 1)).alias("wasted"))
