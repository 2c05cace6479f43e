"""One analysis over any manifest; results are lazy tables over a slim manifest that is stored once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import duplicates, filters, folders, incremental, reports, similarity
from ..operators.joins import spread_join
from ..sources import walker
from ..storage import Scratch, materialized, replaced


@dataclass(frozen=True)
class AnalysisResult:
    files: DataFrame
    folders: DataFrame
    errors: DataFrame | None = None
    #: (path, size, kind) of the files that were read for a digest; null for tables.
    read: DataFrame | None = None

    @property
    def groups(self) -> DataFrame:
        return duplicates.groups(self.files)

    @property
    def members(self) -> DataFrame:
        return duplicates.members(self.files)

    @property
    def summary(self) -> DataFrame:
        return duplicates.summary(self.files)

    @property
    def folder_stats(self) -> DataFrame:
        return folders.folder_stats(self.files, self.folders)

    @property
    def statistics(self) -> DataFrame:
        return folders.overall_statistics(self.files, self.folders)

    @property
    def report(self) -> DataFrame:
        return reports.duplicate_report(self.files)

    def similar_folders(self, threshold: float = 70.0) -> DataFrame:
        return similarity.similar_folders(self.files, threshold)


def analyze_manifest(files: DataFrame, config: EngineConfig | None = None) -> AnalysisResult:
    """A manifest with a content column. Hashes cover the files whose size repeats, or all.

    Content is read once; all results read the slim manifest that this stores.
    """
    config = config or EngineConfig()
    kept = filters.not_ignored(filters.at_least(files, config.min_size), config)
    with Scratch(files.sparkSession) as scratch:
        hashed = materialized(duplicates.hashed(kept, config), "hashed", None if config.universe == "all" else scratch)
        if config.universe == "candidates":
            hashed = materialized(duplicates.candidates_only(hashed), "manifest")
    return AnalysisResult(hashed, folders.folder_manifest(hashed))


def _hashed(files: DataFrame, cache: DataFrame, config: EngineConfig, kind: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``files`` with the digest of a kind, and those of them, stored, that had to be read as the cache has no entry for them."""
    looked = incremental.cache_lookup(files, cache, config.algorithm, kind)
    missed = walker.with_hash(looked.where("cached_hash IS NULL").drop("cached_hash"), kind, config.algorithm, column, config.quick_hash_size, config.sample_size)
    fresh = materialized(missed, f"fresh-{kind}")
    return looked.where("cached_hash IS NOT NULL").withColumnRenamed("cached_hash", column).unionByName(fresh), fresh


def analyze_paths(spark: SparkSession, roots: list[str], config: EngineConfig | None = None, quick: bool = True) -> AnalysisResult:
    """Files below the roots. Bytes are read only where the size repeats, and beyond the first look only where that does too.

    The first look is at the head, and at samples in files from ``sampled_from`` bytes on; what repeats is confirmed
    by a full hash. With ``quick`` off, every file of a repeated size is hashed, as similarity and unique counts want
    it. With ``state_dir``, digests of former runs serve for files whose size and time are the same, and those of
    this run are kept for the next.
    """
    config = config or EngineConfig()
    walked = materialized(walker.walk(spark, roots, config), "walked")
    files = materialized(filters.at_least(walker.files(walked), config.min_size), "files")
    cache = incremental.read_cache(spark, config.state_dir)
    candidates = duplicates.size_candidates(files)
    fresh: list[tuple[str, DataFrame]] = []
    if quick:
        passed = [candidates.where(candidates["size"] <= config.quick_from)]
        large = candidates.where(candidates["size"] > config.quick_from)
        for kind, rows in (("quick", large.where(large["size"] < config.sampled_from)), ("sampled", large.where(large["size"] >= config.sampled_from))):
            looked, new = _hashed(rows, cache, config, kind, "look")
            repeats = looked.where("look IS NOT NULL").groupBy("size", "look").agg(F.count("*").alias("n_files")).where("n_files > 1")
            passed.append(spread_join(looked, repeats, ["size", "look"], "left_semi").drop("look"))
            fresh.append((kind, new.withColumnRenamed("look", "hash")))
        candidates = passed[0].unionByName(passed[1]).unionByName(passed[2])
    hashed, new = _hashed(candidates.select(files.columns), cache, config, "full", "hash")
    fresh.append(("full", new))
    every = materialized(files.join(hashed.select("path", "hash"), "path", "left"), "manifest")
    if config.state_dir is not None:
        for kind, new in fresh:
            cache = incremental.updated_cache(cache, new.where("hash IS NOT NULL"), config.algorithm, kind)
        replaced(cache, f"{config.state_dir}/hash_cache")
    read = fresh[0][1].select("path", "size", F.lit(fresh[0][0]).alias("kind"))
    for kind, new in fresh[1:]:
        read = read.unionByName(new.select("path", "size", F.lit(kind).alias("kind")))
    return AnalysisResult(every, walker.folders(walked), walker.errors(walked), read)
