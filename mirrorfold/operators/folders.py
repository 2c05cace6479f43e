"""Folders: their manifest, the share of each that is duplicated, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import has_hash
from ..functions.names import ancestors, base_name, parent
from .duplicates import duplicate_hashes
from .joins import spread_join


def _with_parents(own: DataFrame, *sums: str) -> DataFrame:
    """One row per folder of ``own`` (path and sums) and per folder above, whose own sums are 0: one grouping, no join."""
    every = own.withColumn("_above", F.explode(ancestors(F.col("path"))))
    return every.groupBy(F.col("_above").alias("path")).agg(*(F.coalesce(F.sum(F.when(F.col("_above") == F.col("path"), F.col(c))), F.lit(0)).alias(c) for c in sums))


def folder_manifest(files: DataFrame) -> DataFrame:
    """Every folder of the files and every one above, with direct files only: (path, name, parent_path, num_files, total_size)."""
    own = files.groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("num_files"), F.sum("size").alias("total_size"))
    p = F.col("path")
    return _with_parents(own, "num_files", "total_size").select("path", base_name(p).alias("name"), parent(p).alias("parent_path"), "num_files", "total_size")


def marked(files: DataFrame) -> DataFrame:
    """``files`` with is_duplicate: whether another file has the same hash. The files are read twice: they should be stored."""
    repeats = duplicate_hashes(files).select("hash", "n_files")
    # Files without a hash, often most of them, have no part in the join.
    has = spread_join(files.where(has_hash()), repeats, ["hash"], "left").withColumn("is_duplicate", F.col("n_files").isNotNull()).drop("n_files")
    return has.unionByName(files.where(~has_hash()).withColumn("is_duplicate", F.lit(False)))


def folder_stats(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, file_count, total_size, duplicated_files, duplication_percentage) for every folder, empty ones too."""
    stats = marked(files).groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicated_files"))
    names = ("file_count", "total_size", "duplicated_files")
    if folders is None:
        out = _with_parents(stats, *names)
    else:
        out = folders.select("path").join(stats, "path", "left").select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    share = F.when(F.col("file_count") == 0, F.lit(0.0)).otherwise(F.col("duplicated_files") / F.col("file_count") * 100)
    return out.withColumn("duplication_percentage", share)


def folder_duplication(files: DataFrame, folders: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    out = folder_stats(files, folders).select("path", "duplication_percentage")
    return out if threshold is None else out.where(F.col("duplication_percentage") >= threshold).orderBy(F.desc("duplication_percentage"), "path")


def nonempty_folder_duplication(files: DataFrame) -> DataFrame:
    """Only folders that hold a file, computed on the hashed files of each."""
    rows = marked(files).where(has_hash())
    out = rows.groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("hashed_files"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicated_files"))
    return out.withColumn("duplication_percentage", F.col("duplicated_files") / F.col("hashed_files") * 100)


def overall_statistics(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """One row; unique_files counts different hashes, so only files that have one."""
    every = folders if folders is not None else folder_manifest(files)
    n = every.agg(F.count("*").alias("total_folders"))
    f = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.countDistinct(F.when(has_hash(), F.col("hash"))).alias("unique_files"))
    return n.crossJoin(f)  # one row each
