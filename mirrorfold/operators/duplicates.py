"""Duplicate groups: by size, by quick fingerprint, by full hash.

Groups are found by grouping with partial counts, and members by joining back to the slim group table, in which
hot keys are spread over tasks. A digest that a third of all files share thus never gathers in one task. Content
is hashed where it is read; only paths, sizes and digests are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.hashing import full_hash, has_hash, quick_hash, sampling_hash, tier
from ..storage import materialized
from .joins import BROADCAST_BYTES, spread_join

SLIM = ["path", "name", "folder", "size", "last_modified"]


def duplicate_sizes(files: DataFrame) -> DataFrame:
    """(size, n_files) of sizes that occur more than once."""
    return files.groupBy("size").agg(F.count("*").alias("n_files")).where("n_files > 1")


def size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size repeats: only these can have a duplicate."""
    return spread_join(files, duplicate_sizes(files), ["size"], "left_semi")


def unique_sizes(files: DataFrame) -> DataFrame:
    """Files whose size is theirs alone."""
    alone = files.groupBy("size").agg(F.count("*").alias("n_files"), F.min("path").alias("path")).where("n_files = 1")
    return alone.select("path", "size")


def hashed(files: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Slim rows with the full hash of every file."""
    config = config or EngineConfig()
    columns = [c for c in SLIM if c in files.columns]
    return files.select(*columns, full_hash("content", config.algorithm).alias("hash"))


def candidates_only(hashed_files: DataFrame) -> DataFrame:
    """Hashed files, the hash null where no other file has the size. The files are read twice: they should be stored."""
    sizes = duplicate_sizes(hashed_files)
    return spread_join(hashed_files, sizes, ["size"], "left").withColumn("hash", F.when(F.col("n_files").isNotNull(), F.col("hash"))).drop("n_files")


def hashed_candidates(files: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Slim rows with the full hash where the size repeats, else null; content is read once, and slim rows are stored."""
    return candidates_only(materialized(hashed(files, config), "hashed"))


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """(hash, size, n_files) of hashes that occur more than once.

    Files without a hash are left out after the grouping: a condition on the hash itself would be pushed down to
    where it is computed, and computed again there.
    """
    found = files.groupBy("hash").agg(F.min("size").alias("size"), F.count("*").alias("n_files"), F.max(F.length("hash")).alias("_known"))
    return found.where("n_files > 1 AND _known > 0").drop("_known")


def funnel(files: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Slim rows that survive size and quick hash, with their full hash: (…, quick, hash).

    Files up to three quick sizes skip the quick stage. Reading a table's content costs more than hashing it, so
    both digests are taken in one pass, slim rows are stored, and the stages work on these.
    """
    config = config or EngineConfig()
    large = F.col("size") > config.quick_from
    columns = [c for c in SLIM if c in files.columns]
    rows = files.select(*columns, F.when(large, quick_hash("content", config.algorithm, config.quick_hash_size)).alias("quick"), full_hash("content", config.algorithm).alias("hash"))
    rows = materialized(rows, "quick")
    # A size is all large or all small, so one key serves both: small files have an empty quick hash.
    rows = rows.withColumn("_key", F.coalesce("quick", F.lit("")))
    repeats = rows.groupBy("size", "_key").agg(F.count("*").alias("n_files")).where("n_files > 1")
    return spread_join(rows, repeats, ["size", "_key"], "left_semi").drop("_key")


def groups(files: DataFrame) -> DataFrame:
    """Duplicate groups of hashed files: (hash, size, n_files, wasted)."""
    return duplicate_hashes(files).withColumn("wasted", F.col("size") * (F.col("n_files") - 1))


def members(files: DataFrame, min_size: int | None = None) -> DataFrame:
    """One row per file of a duplicate group. ``min_size`` is exclusive."""
    rows = files.where(has_hash())
    if min_size is not None:
        rows = rows.where(F.col("size") > min_size)
    found = rows.groupBy("hash", "size").agg(F.count("*").alias("n_files")).where("n_files > 1")
    return spread_join(rows, found, ["hash", "size"], "inner")


def with_locations(files: DataFrame) -> DataFrame:
    """Groups with the sorted paths of their members, as report formats want it. A row grows with its group: beyond
    reports use ``members``, which has a row per file.
    """
    found = members(files).groupBy("hash").agg(F.min("size").alias("size"), F.count("*").alias("n_files"), F.array_sort(F.collect_list("path")).alias("files"))
    return found.withColumn("wasted", F.col("size") * (F.col("n_files") - 1))


def summary(files: DataFrame) -> DataFrame:
    """One row: copies beyond the first, and the bytes that they take."""
    return groups(files).agg(F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("total_duplicates"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("total_wasted"))


def _kept(files: DataFrame) -> DataFrame:
    """(hash, n_files, keep_path) per group, in one grouping."""
    order = F.struct(F.length("path").alias("n"), F.col("last_modified").isNull().alias("unknown"), "last_modified", "path")
    found = files.groupBy("hash").agg(F.count("*").alias("n_files"), F.min(order).alias("k"), F.max(F.length("hash")).alias("_known")).where("n_files > 1 AND _known > 0")
    return found.select("hash", "n_files", F.col("k.path").alias("keep_path"))


def keep_recommendation(files: DataFrame) -> DataFrame:
    """The member of each group to keep: shortest path, then oldest (unknown last), then first by path."""
    return _kept(files).select("hash", "keep_path")


def delete_candidates(files: DataFrame) -> DataFrame:
    """Members of groups but the one to keep. The files are read twice: they should be stored."""
    rows = spread_join(files.where(has_hash()), _kept(files), ["hash"], "inner")
    return rows.where(F.col("path") != F.col("keep_path")).select("hash", "path", "size", "keep_path")


def hash_tiers(files: DataFrame, full_below: int, quick_below: int, config: EngineConfig | None = None, sample: int = 1 << 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Duplicate groups by tier of size: (tier, hash, size, n_files).

    Small files are hashed in full, middle ones by their head and large ones by samples. Of the two last only
    those that repeat by size and fingerprint are hashed in full in a second pass, which confirms them. Their list
    is broadcast up to ``broadcast_bytes``; beyond, that pass hashes all of these tiers where it reads them, for
    content is never shuffled.
    """
    config = config or EngineConfig()
    which = tier("size", full_below, quick_below)
    sampled = sampling_hash(F.when(which == "sampled", F.col("content")), sample, config.algorithm)
    mark = F.when(which == "full", full_hash("content", config.algorithm)).when(which == "quick", quick_hash("content", config.algorithm, config.quick_hash_size)).otherwise(sampled)
    marked = materialized(files.select("path", "size", which.alias("tier"), mark.alias("mark")), "tiers")
    repeats = marked.groupBy("size", "tier", "mark").agg(F.count("*").alias("n_files")).where("n_files > 1 AND mark IS NOT NULL")
    open_ = spread_join(marked, repeats, ["size", "tier", "mark"], "left_semi")
    again = materialized(open_.where("tier <> 'full'").select("path", "tier"), "to-confirm")
    rows = open_.where("tier = 'full'").select("tier", F.col("mark").alias("hash"), "size")
    sent = again.agg(F.sum(F.octet_length("path") + 100)).first()[0]
    if sent:
        second, digest = files.where(which != "full"), full_hash("content", config.algorithm).alias("hash")
        if sent <= broadcast_bytes:
            second = second.join(F.broadcast(again), "path").select("tier", digest, "size")
        else:
            second = second.select("path", digest, "size").join(again.hint("merge"), "path").select("tier", "hash", "size")
        rows = rows.unionByName(second)
    return rows.groupBy("tier", "hash").agg(F.min("size").alias("size"), F.count("*").alias("n_files")).where("n_files > 1")


def ranked_by_waste(files: DataFrame, limit: int | None = 10) -> DataFrame:
    """Groups by wasted bytes, largest first; ties by size and hash."""
    found = groups(files).orderBy(F.desc("wasted"), F.desc("size"), "hash")
    return found.limit(limit) if limit is not None else found


def preview(files: DataFrame, limit: int | None = 10, shown: int = 5) -> DataFrame:
    """The largest groups, or all, with the first members by path and how many more there are."""
    top = ranked_by_waste(files, limit)
    place = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    first = files.join(top.select("hash"), "hash", "left_semi").withColumn("place", place).where(F.col("place") <= shown)
    listed = first.groupBy("hash").agg(F.array_sort(F.collect_list("path")).alias("shown"))
    return top.join(listed, "hash").withColumn("more", F.greatest(F.col("n_files") - shown, F.lit(0)))
