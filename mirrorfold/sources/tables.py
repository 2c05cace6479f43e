"""Manifests over tables whose rows stand for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_columns(rows: DataFrame, folder: Column, name: Column, content: Column, last_modified: Column) -> DataFrame:
    """files (path, name, folder, size, last_modified, content); content is binary and is read only where used."""
    return rows.select(folder.alias("folder"), name.alias("name"), content.alias("content"), last_modified.alias("last_modified")).select(
        F.concat_ws("/", "folder", "name").alias("path"), "name", "folder", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), "last_modified", "content"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file in /source/lang, named by its id and dated by it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_columns(
        d, F.concat(F.lit("/"), "source", F.lit("/"), "lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.encode("text", "UTF-8"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a folder, a turn a file."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_columns(
        d, F.concat(F.lit("/conv/"), F.col("conv_id").cast("string")), F.concat_ws(".", F.col("turn").cast("string"), "role"), F.encode("text", "UTF-8"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn"))
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a file in the folder of its host."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return from_columns(d, F.concat(F.lit("/"), host), F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.encode("html", "UTF-8"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")))
