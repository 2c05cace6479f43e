"""Predicates and lookups on a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.hashing import has_hash
from ..functions.names import path_ignored


def not_ignored(files: DataFrame, config: EngineConfig | None = None, root: str = "/") -> DataFrame:
    config = config or EngineConfig()
    return files.where(~path_ignored(F.col("path"), config.ignore_globs, config.ignore_hidden, root))


def at_least(files: DataFrame, min_size: int) -> DataFrame:
    return files.where(F.col("size") >= min_size)


def size_range(files: DataFrame, low: int, high: int) -> DataFrame:
    """Both ends included, by size and path."""
    return files.where(F.col("size").between(low, high)).orderBy("size", "path")


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    return files.where(F.col("folder") == folder).orderBy("name")


def of_size(files: DataFrame, size: int) -> DataFrame:
    return files.where(F.col("size") == size).orderBy("path")


def of_hash(files: DataFrame, digest: str) -> DataFrame:
    return files.where(has_hash() & (F.col("hash") == digest)).orderBy("path")


def by_path(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("path") == path)
