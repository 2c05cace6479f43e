"""Similar folders: Jaccard similarity of their sets of content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import has_hash
from ..storage import materialized


#: Folders with one hash that one task compares with all others that have it.
CROWD = 16_384


def folder_hashes(files: DataFrame) -> DataFrame:
    """(folder, hash), each pair once, hashed files only."""
    return files.where(has_hash()).select("folder", "hash").distinct()


def similar_folders(files: DataFrame, threshold: float = 70.0, crowd: int = CROWD) -> DataFrame:
    """(folder_a, folder_b, similarity), folder_a first by name, similarity in percent and at least ``threshold``.

    For a positive threshold, only folders that share a rare hash meet: a folder's hashes are ordered from rare
    to frequent, and two sets that are similar enough share one of the first n - ceil(t n) + 1 of each. So a
    hash that lies in every folder (the empty file) makes no pairs by itself, and folders of too different sizes
    make none. The first hash that two sets share also bounds, by what follows it in each, how many they can share.
    A hash with more than ``crowd`` folders is dealt to tasks by parts of one side. At zero or below every pair
    qualifies, disjoint ones included, and the result is all pairs.
    """
    fh = materialized(folder_hashes(files), "folder-hashes")  # read several times below
    sizes = fh.groupBy("folder").agg(F.count("*").alias("n"))
    if threshold <= 0:
        a, b = sizes.select(F.col("folder").alias("folder_a"), F.col("n").alias("na")), sizes.select(F.col("folder").alias("folder_b"), F.col("n").alias("nb"))
        pairs = a.join(b, F.col("folder_a") < F.col("folder_b"))
    else:
        t = threshold / 100
        frequency = fh.groupBy("hash").agg(F.count("*").alias("df"))
        place = F.row_number().over(Window.partitionBy("folder").orderBy("df", "hash"))
        ordered = fh.join(frequency, "hash").join(sizes, "folder").withColumn("place", place)
        prefix = ordered.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).withColumn("parts", F.ceil(F.col("df") / crowd).cast("int"))
        salt = F.pmod(F.xxhash64("folder"), F.col("parts")).cast("int").alias("salt")
        a = prefix.select("hash", salt, F.col("folder").alias("folder_a"), F.col("n").alias("na"), (F.col("n") - F.col("place")).alias("ra"))
        b = prefix.select("hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("folder").alias("folder_b"), F.col("n").alias("nb"), (F.col("n") - F.col("place")).alias("rb"))
        alike = (F.col("folder_a") < F.col("folder_b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-9)
        enough = F.least("ra", "rb") + 1 >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9
        pairs = a.join(b, ["hash", "salt"]).where(alike & enough).select("folder_a", "folder_b", "na", "nb").distinct()
    left = fh.select(F.col("folder").alias("folder_a"), "hash")
    right = fh.select(F.col("folder").alias("folder_b"), "hash")
    common = pairs.select("folder_a", "folder_b").join(left, "folder_a").join(right, ["folder_b", "hash"]).groupBy("folder_a", "folder_b").agg(F.count("*").alias("i"))
    i = F.coalesce("i", F.lit(0))
    out = pairs.join(common, ["folder_a", "folder_b"], "left").select("folder_a", "folder_b", (i / (F.col("na") + F.col("nb") - i) * 100).alias("similarity"))
    return out.where(F.col("similarity") >= threshold)


def top_similar(files: DataFrame, threshold: float = 70.0, limit: int = 10) -> DataFrame:
    return similar_folders(files, threshold).orderBy(F.desc("similarity"), "folder_a", "folder_b").limit(limit)
