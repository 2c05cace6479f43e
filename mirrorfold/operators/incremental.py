"""State between runs: upserts, hash caches, manifest differences."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..schemas import HASH_CACHE

CACHE_KEY = ["path", "size", "last_modified", "algorithm", "kind"]


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of both, the new one where both have the key; of several new ones with a key the greatest row."""
    newest = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*").select(new.columns)
    return old.join(newest.select(key), key, "left_anti").select(old.columns).unionByName(newest)


def with_new_hashes(files: DataFrame, hashes: DataFrame, key: str = "path") -> DataFrame:
    """``files`` with the hash of ``hashes`` where it has one, else the former."""
    fresh = hashes.select(key, F.col("hash").alias("_new"))
    return files.join(fresh, key, "left").withColumn("hash", F.coalesce("_new", "hash")).drop("_new")


def cache_lookup(files: DataFrame, cache: DataFrame, algorithm: str = "sha256", kind: str = "full") -> DataFrame:
    """``files`` with cached_hash: a hit needs the same path, size, time, algorithm and kind."""
    known = cache.where((F.col("algorithm") == algorithm) & (F.col("kind") == kind)).select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("last_modified").alias("_m"), F.col("hash").alias("cached_hash"))
    same = (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & F.col("last_modified").eqNullSafe(F.col("_m"))
    return files.join(known, same, "left").drop("_p", "_s", "_m")


def cache_misses(files: DataFrame, cache: DataFrame, algorithm: str = "sha256", kind: str = "full") -> DataFrame:
    return cache_lookup(files, cache, algorithm, kind).where("cached_hash IS NULL").drop("cached_hash")


def cache_statistics(files: DataFrame, cache: DataFrame, algorithm: str = "sha256", kind: str = "full") -> DataFrame:
    looked = cache_lookup(files, cache, algorithm, kind)
    out = looked.agg(F.count("*").alias("lookups"), F.count("cached_hash").alias("hits"))
    return out.withColumn("hit_rate", F.when(F.col("lookups") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("lookups")))


def updated_cache(cache: DataFrame, hashed: DataFrame, algorithm: str = "sha256", kind: str = "full") -> DataFrame:
    """The cache with new digests; a path has one entry per algorithm and kind."""
    new = hashed.select("path", "size", "last_modified", F.lit(algorithm).alias("algorithm"), F.lit(kind).alias("kind"), "hash")
    stays = cache.join(new.select("path", "algorithm", "kind"), ["path", "algorithm", "kind"], "left_anti")
    return stays.select(new.columns).unionByName(new)


def cache_without(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """The cache without the entries of some paths."""
    return cache.join(paths.select("path"), "path", "left_anti")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, changed (size or time) or removed."""
    a = before.select("path", F.struct("size", "last_modified").alias("b"))
    b = now.select("path", F.struct("size", "last_modified").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("n")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def read_cache(spark: SparkSession, state_dir: str | None) -> DataFrame:
    """The hash cache that a former run has left in ``state_dir``; an empty one if there is none."""
    path = f"{state_dir}/hash_cache"
    if state_dir is None or not storage.exists(spark, path):
        return storage.empty(spark, HASH_CACHE)
    return spark.read.schema(HASH_CACHE).parquet(path)


def run_all(spark: SparkSession, statements: list[str], workers: int = 4) -> list[DataFrame]:
    """Results of SQL statements, run side by side and stored, in their order; a failing one raises."""

    def one(statement: str) -> DataFrame:
        return storage.materialized(spark.sql(statement), "statement")

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, statements))


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 128 << 20) -> None:
    """A stored table rewritten in files of about ``file_bytes``."""
    files = max(1, -(-storage.size_of(spark, source) // file_bytes))
    spark.read.parquet(source).repartition(files).write.mode("overwrite").parquet(target)


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a table in the catalog, and of its columns, for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
