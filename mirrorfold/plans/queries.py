"""Registered queries over the driver's tables, and the same in SQL.

A text row stands for a file: its bytes are the content, /source/lang the folder. FILES_SQL spells that manifest
out for SQL; HASHED_SQL adds the hash of files whose size repeats.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import hashing as H
from ..functions.arrow import map_arrow
from ..functions.names import format_size
from ..operators import duplicates as D
from ..operators import filters as P
from ..operators import folders as O
from ..operators import incremental as I
from ..operators import reports as R
from ..operators import similarity as S
from ..sources import tables, walker
from ..storage import materialized, shared_dir
from . import analysis

Query = Callable[[SparkSession, str], DataFrame]

LOW, HIGH = 1000, 3000
SIZE = 416
MIN_SIZE = 2000
SIMILAR = 10.0
TIERS = (1024, 16_384)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf)


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    """For results that read the files once."""
    return D.hashed(manifest(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """For results that read the files several times: content is read and hashed once."""
    return materialized(hashed(spark, sf), "hashed")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(D.hashed_candidates(manifest(spark, sf)), "candidates")


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).drop("content")


def _stored_slim(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(_slim(spark, sf), "manifest")


def _with_time(df: DataFrame) -> DataFrame:
    """Seconds instead of a timestamp: the same number in every engine."""
    return df.withColumn("last_modified", F.unix_timestamp("last_modified"))


def _cache_of(f: DataFrame) -> DataFrame:
    """A hash cache of all files, in which the entry of every third one is out of date."""
    stale = F.regexp_extract("name", r"^(\d+)", 1).cast("long") % 3 == 0
    return f.select("path", F.when(stale, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "last_modified", F.lit("sha256").alias("algorithm"), F.lit("full").alias("kind"), "hash")


def _inodes(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one size share an inode."""
    return _slim(spark, sf).withColumn("inode", F.concat(F.lit("1:"), F.col("size").cast("string")))


def _renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Some names that scans leave out."""
    f = _slim(spark, sf)
    i = F.regexp_extract("name", r"^(\d+)", 1).cast("long")
    name = F.when(i % 7 == 0, F.concat(i.cast("string"), F.lit(".tmp"))).when(i % 7 == 1, F.concat(F.lit("~"), "name")).when(i % 7 == 2, F.lit("Thumbs.db")).when(i % 7 == 3, F.concat(F.lit("~old/"), "name")).when(i % 7 == 4, F.concat(i.cast("string"), F.lit(".TMP"))).otherwise(F.col("name"))
    return f.select(F.concat("folder", F.lit("/"), name).alias("path"), "size")


def _openings(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as files that hold the first 14 characters of each."""
    c = tables.conversations(spark, sf)
    head = F.encode(F.substring(F.decode("content", "UTF-8"), 1, 14), "UTF-8")
    return c.withColumn("content", head).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))


def q_files_of_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Files with the hash that wastes most."""
    f = stored(spark, sf)
    most = D.ranked_by_waste(f, 1).first()
    return P.of_hash(f, most["hash"] if most else "").select("path", "size", "hash")


def q_hardlinks(spark: SparkSession, sf: str) -> DataFrame:
    return walker.hardlinks(materialized(_inodes(spark, sf), "inodes")).select("path", "inode", "hardlink_to")


def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New rows for all files whose size repeats, twice, and copies of all below another root."""
    f = _with_time(_stored_slim(spark, sf)).select("path", "size", "last_modified")
    new = D.size_candidates(f).select("path", (F.col("size") * 10).alias("size"), "last_modified")
    twice = new.unionByName(new.withColumn("size", F.col("size") - 1)).unionByName(f.select(F.concat(F.lit("/new"), "path").alias("path"), "size", "last_modified"))
    return I.upsert(f, twice)


def q_cache_update(spark: SparkSession, sf: str) -> DataFrame:
    """The cache after all misses have been hashed."""
    f = stored(spark, sf)
    cache = _cache_of(f)
    misses = I.cache_misses(f.select("path", "size", "last_modified"), cache).select("path")
    return I.updated_cache(cache, f.join(misses, "path", "left_semi")).select("path", "size", "hash")


def q_update_hashes(spark: SparkSession, sf: str) -> DataFrame:
    f = candidates(spark, sf).select("path", "size", "hash")
    return I.with_new_hashes(f, f.where("hash IS NULL").select("path", F.concat(F.lit("s"), F.col("size").cast("string")).alias("hash")))


def q_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Small files have come, large ones are gone, and those between have grown if their size repeats."""
    f = _stored_slim(spark, sf).select("path", "size", "last_modified")
    grown = D.size_candidates(f).select("path", F.lit(1).alias("more"))
    now = f.join(grown, "path", "left").select("path", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "last_modified", F.col("size").alias("was")).where(F.col("was") <= HIGH).drop("was")
    return I.manifest_diff(P.at_least(f, LOW), now)


def q_format_size(spark: SparkSession, sf: str) -> DataFrame:
    f = _slim(spark, sf)
    n = F.col("size") * F.pow(F.lit(64), F.col("size") % 7).cast("long")
    return f.select("path", n.alias("bytes"), format_size(n).alias("text"))


def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    return D.preview(stored(spark, sf)).select("hash", "n_files", "wasted", F.array_join("shown", "|").alias("shown"), "more")


def q_locations(spark: SparkSession, sf: str) -> DataFrame:
    return R.csv_rows(stored(spark, sf)).select(F.col("Hash").alias("hash"), F.col("Size").alias("size"), F.col("Count").alias("n_files"), F.col("Files").alias("files"))


def q_partial_positions(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("path", H.partial_hash("content", positions=[(0, 16), (100, 64)]).alias("partial_hash"))


def _tree(spark: SparkSession, sf: str) -> str:
    """All files of the manifest, written as files below a folder that driver and executors share."""
    root = urlparse(shared_dir(spark, "tree"))
    if root.scheme not in ("", "file"):
        raise ValueError(f"files can't be walked on {root.scheme}")
    top = root.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                os.makedirs(os.path.dirname(top + path), exist_ok=True)
                with open(top + path, "wb") as f:
                    f.write(content.as_py() or b"")
            yield batch.select(["path"])

    map_arrow(manifest(spark, sf).select("path", "content"), write, "path string").write.format("noop").mode("overwrite").save()
    return top


def _below(column: str, top: str) -> F.Column:
    """A path as seen from the top of the tree."""
    return F.expr(f"substring({column}, {len(top) + 1})").alias(column)


def q_walked_files(spark: SparkSession, sf: str) -> DataFrame:
    top = _tree(spark, sf)
    return walker.files(walker.walk(spark, [top])).select(_below("path", top), "name", _below("folder", top), "size")


def q_walked_folders(spark: SparkSession, sf: str) -> DataFrame:
    top = _tree(spark, sf)
    return walker.folders(materialized(walker.walk(spark, [top]), "walked")).where(F.col("path") != top).select(_below("path", top), "name", "num_files", "total_size")


def q_walked_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Folders (the top left out), files, errors, and files of the top alone."""
    top = _tree(spark, sf)
    w = materialized(walker.walk(spark, [top]), "walked")
    flat = walker.files(walker.walk(spark, [top], recursive=False)).agg(F.count("*").alias("top_files"))
    counts = w.agg(*(F.countDistinct(F.when(F.col("kind") == k, F.col("path"))).alias(c) for k, c in (("folder", "n_folders"), ("file", "n_files"), ("error", "n_errors"))))
    return counts.withColumn("n_folders", F.col("n_folders") - 1).crossJoin(flat)  # one row each


def q_walked_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The tree, some of its folders again, and one level alone: each file once."""
    top = _tree(spark, sf)
    several = walker.walk(spark, [top, f"{top}/src0", f"{top}/src1/en", f"{top}/nowhere"])
    return walker.files(several).select(_below("path", top)).unionByName(walker.errors(several).select(_below("path", top)))


def q_walked_hashes(spark: SparkSession, sf: str) -> DataFrame:
    top = _tree(spark, sf)
    out = walker.files(walker.walk(spark, [top])).select("path")
    for kind in ("full", "quick", "partial", "sampled"):
        out = walker.with_hash(out, kind, column=kind, sample=1024)
    even = F.length(_below("path", top)) % 2 == 0
    return walker.verify(out.withColumn("hash", F.when(even, F.col("full")).otherwise("wronghash"))).select(_below("path", top), "full", "quick", "partial", "sampled", "ok")


def q_walked_groups(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.analyze_paths(spark, [_tree(spark, sf)]).groups


def q_walked_again(spark: SparkSession, sf: str) -> DataFrame:
    """Files read for digests by a first run, and by a second one that finds the first one's cache."""
    top = _tree(spark, sf)
    config = EngineConfig(state_dir=urlparse(shared_dir(spark, "state")).path)
    runs = [analysis.analyze_paths(spark, [top], config).read.groupBy("kind").agg(F.count("*").alias("n_read"), F.sum("size").alias("size")).select(F.lit(run).alias("run"), "kind", "n_read", "size") for run in (1, 2)]
    return runs[0].unionByName(runs[1])


def queries() -> dict[str, Query]:
    return {
        "duplicate_groups": lambda s, d: D.groups(hashed(s, d)),
        "dup_sizes": lambda s, d: D.duplicate_sizes(_slim(s, d)),
        "size_candidates": lambda s, d: D.size_candidates(_stored_slim(s, d)).select("path", "size"),
        "unique_sizes": lambda s, d: D.unique_sizes(_slim(s, d)),
        **{f"dup_hashes_{a}": lambda s, d, a=a: D.duplicate_hashes(D.hashed(manifest(s, d), EngineConfig(algorithm=a))) for a in ("sha256", "sha1", "md5", "sha512")},
        "quick_hash": lambda s, d: manifest(s, d).select("path", H.quick_hash("content").alias("quick_hash")),
        "partial_hash": lambda s, d: manifest(s, d).select("path", H.partial_hash("content").alias("partial_hash")),
        "partial_hash_positions": q_partial_positions,
        "verify_hash": lambda s, d: manifest(s, d).select("path", H.verify_hash("content", F.when(F.col("size") % 2 == 0, F.sha2("content", 256)).when(F.col("size") % 3 == 0, F.lit("wronghash"))).alias("ok")),
        "blake2b_groups": lambda s, d: D.groups(manifest(s, d).select("path", "size", H.blake2b("content").alias("hash"))),
        "sampling_hash": lambda s, d: manifest(s, d).select("path", H.sampling_hash("content", 1024).alias("sampled_hash")),
        "two_stage_groups": lambda s, d: D.groups(D.funnel(manifest(s, d))),
        "hash_tiers": lambda s, d: D.hash_tiers(manifest(s, d), *TIERS),
        "strategy_choice": lambda s, d: R.strategy_choice(_slim(s, d)),
        "dup_members": lambda s, d: D.members(stored(s, d)).select("hash", "size", "path", "n_files"),
        "dup_members_larger": lambda s, d: D.members(stored(s, d), MIN_SIZE).select("hash", "size", "path", "n_files"),
        "min_size_groups": lambda s, d: D.groups(P.at_least(hashed(s, d), MIN_SIZE)),
        "summary": lambda s, d: D.summary(hashed(s, d)),
        "analysis_summary": lambda s, d: R.analysis_summary(hashed(s, d)),
        "top10_wasted": lambda s, d: D.ranked_by_waste(hashed(s, d)),
        "group_preview": q_preview,
        "export_csv_rows": q_locations,
        "export_json_rows": lambda s, d: R.json_rows(stored(s, d)),
        "keep_recommendation": lambda s, d: D.keep_recommendation(hashed(s, d)),
        "delete_candidates": lambda s, d: D.delete_candidates(stored(s, d)),
        "folder_manifest": lambda s, d: O.folder_manifest(_slim(s, d)),
        "folder_duplication": lambda s, d: O.folder_duplication(stored(s, d)),
        "folder_stats_full": lambda s, d: O.folder_stats(stored(s, d)),
        "folder_threshold": lambda s, d: O.folder_duplication(stored(s, d), threshold=15.0),
        "folder_duplication_nonempty": lambda s, d: O.nonempty_folder_duplication(candidates(s, d)),
        "overall_statistics": lambda s, d: O.overall_statistics(candidates(s, d)),
        "scan_totals": lambda s, d: (lambda f: R.scan_totals(f, O.folder_manifest(f)))(_stored_slim(s, d)),
        "folder_hash_sets": lambda s, d: S.folder_hashes(candidates(s, d)),
        "similar_folders_candidates": lambda s, d: S.similar_folders(candidates(s, d), SIMILAR),
        "similar_folders_all": lambda s, d: S.similar_folders(stored(s, d), 1.0),
        "similar_folders_zero_threshold": lambda s, d: S.similar_folders(candidates(s, d), 0.0),
        "top_similar_folders": lambda s, d: S.top_similar(candidates(s, d), 1.0),
        "dup_report": lambda s, d: R.duplicate_report(hashed(s, d)),
        "size_distribution": lambda s, d: R.size_distribution(_slim(s, d)),
        "size_range": lambda s, d: P.size_range(_slim(s, d), LOW, HIGH).select("path", "size"),
        "files_in_folder": lambda s, d: _with_time(P.in_folder(_slim(s, d), "/src1/en")),
        "files_of_size": lambda s, d: P.of_size(_slim(s, d), SIZE).select("path", "size"),
        "files_of_hash": q_files_of_hash,
        "folder_by_path": lambda s, d: P.by_path(O.folder_manifest(_slim(s, d)), "/src1"),
        "ignore_globs": lambda s, d: P.not_ignored(_renamed(s, d)),
        "hardlinks": q_hardlinks,
        "format_size": q_format_size,
        "incremental_misses": lambda s, d: (lambda f: I.cache_misses(f.select("path", "size", "last_modified"), _cache_of(f)).select("path", "size"))(stored(s, d)),
        "cache_statistics": lambda s, d: (lambda f: I.cache_statistics(f.drop("hash"), _cache_of(f)))(stored(s, d)),
        "cache_update": q_cache_update,
        "upsert_by_path": q_upsert,
        "update_hashes": q_update_hashes,
        "manifest_diff": q_manifest_diff,
        "conversation_groups": lambda s, d: D.groups(D.hashed(_openings(s, d))),
        "conversation_folders": lambda s, d: O.folder_stats(materialized(D.hashed(tables.conversations(s, d)), "hashed")),
        "walked_files": q_walked_files,
        "walked_folders": q_walked_folders,
        "walked_counts": q_walked_counts,
        "walked_roots": q_walked_roots,
        "walked_hashes": q_walked_hashes,
        "walked_groups": q_walked_groups,
        "walked_again": q_walked_again,
        "page_folders": lambda s, d: O.folder_manifest(tables.pages(s, d).drop("content")),
    }


FILES_SQL = """
f AS (
  SELECT '/' || source || '/' || lang AS folder, doc_id || '.txt' AS name, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
    doc_id, encode(text) AS content, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size, 1704067200 + doc_id AS last_modified
  FROM documents
)"""
HASHED_SQL = FILES_SQL + ", h AS (SELECT *, sha256(content) AS hash FROM f)"
CANDIDATES_SQL = FILES_SQL + ", h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY size) > 1 THEN sha256(content) END AS hash FROM f)"
GROUPS = "SELECT hash, min(size) AS size, count(*) AS n_files, CAST(min(size) * (count(*) - 1) AS BIGINT) AS wasted FROM h WHERE hash IS NOT NULL AND hash <> '' GROUP BY hash HAVING count(*) > 1"
FOLDERS_SQL = """
own AS (SELECT folder AS path, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS total_size FROM f GROUP BY folder),
every AS (
  SELECT path FROM own UNION SELECT regexp_extract(path, '^(/[^/]+)', 1) FROM own
),
fm AS (
  SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent_path,
    coalesce(num_files, 0) AS num_files, coalesce(total_size, 0) AS total_size
  FROM every LEFT JOIN own USING (path)
)"""
STATS_SQL = """
m AS (SELECT *, hash IS NOT NULL AND count(*) OVER (PARTITION BY hash) > 1 AS dup FROM h),
s AS (SELECT folder AS path, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(CAST(dup AS INTEGER)) AS BIGINT) AS duplicated_files FROM m GROUP BY folder),
st AS (
  SELECT path, coalesce(file_count, 0) AS file_count, coalesce(s.total_size, 0) AS total_size, coalesce(duplicated_files, 0) AS duplicated_files,
    CASE WHEN coalesce(file_count, 0) = 0 THEN 0.0::DOUBLE ELSE CAST(duplicated_files AS DOUBLE) / file_count * 100 END AS duplication_percentage
  FROM every LEFT JOIN s USING (path)
)"""
SIMILAR_SQL = """
fh AS (SELECT DISTINCT folder, hash FROM h WHERE hash IS NOT NULL AND hash <> ''),
n AS (SELECT folder, count(*) AS n FROM fh GROUP BY folder),
i AS (SELECT a.folder AS folder_a, b.folder AS folder_b, count(*) AS i FROM fh a JOIN fh b ON a.hash = b.hash AND a.folder < b.folder GROUP BY ALL),
sim AS (
  SELECT a.folder AS folder_a, b.folder AS folder_b, CAST(coalesce(i, 0) AS DOUBLE) / (a.n + b.n - coalesce(i, 0)) * 100 AS similarity
  FROM n a JOIN n b ON a.folder < b.folder LEFT JOIN i ON i.folder_a = a.folder AND i.folder_b = b.folder
)"""
MEMBERS = "SELECT hash, size, path, n_files FROM (SELECT *, count(*) OVER (PARTITION BY hash, size) AS n_files FROM h) WHERE n_files > 1"
KEEP = "SELECT hash, path AS keep_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY length(path), last_modified NULLS LAST, path) AS k, count(*) OVER (PARTITION BY hash) AS n FROM h) WHERE k = 1 AND n > 1"
CACHE_SQL = "c AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS size, last_modified, hash FROM h)"


def _dup_hashes(function: str) -> str:
    return f"WITH {FILES_SQL}, h AS (SELECT *, {function}(content) AS hash FROM f) SELECT hash, min(size) AS size, count(*) AS n_files FROM h GROUP BY hash HAVING count(*) > 1"


def _band_sql() -> str:
    when = " ".join(f"WHEN size < {below} THEN '{label}'" for label, below in R.BANDS)
    return f"SELECT CASE {when} ELSE '{R.LAST_BAND}' END AS size_range, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM f GROUP BY 1"


def _format_sql() -> str:
    steps = ["WHEN b < 1024 THEN printf('%.2f B', CAST(b AS DOUBLE))"]
    steps += [f"WHEN b / {float(1024**i)!r} < 1024 THEN printf('%.2f {u}', b / {float(1024**i)!r})" for i, u in enumerate(["KB", "MB", "GB", "TB"], 1)]
    return f"SELECT path, b AS bytes, CASE {' '.join(steps)} ELSE printf('%.2f PB', b / {float(1024**5)!r}) END AS text FROM (SELECT path, CAST(size * pow(64, size % 7) AS BIGINT) AS b FROM f)"


#: Head, places spread by the golden ratio, tail; put together as hexadecimal digits.
SAMPLED_SQL = (
    "CASE WHEN size <= 3072 THEN sha256(content) ELSE sha256(unhex(hex(content[1:1024]) || array_to_string(list_transform(range(1, least(10, size // 1024)), "
    "lambda i: hex(content[CAST(floor(fmod(CAST(size * i AS DOUBLE) * 1.618033988749895, CAST(size AS DOUBLE))) AS BIGINT) + 1 : least(CAST(floor(fmod(CAST(size * i AS DOUBLE) * 1.618033988749895, CAST(size AS DOUBLE))) AS BIGINT) + 1024, size)])), '') || hex(content[size - 1023:size]))) END"
)
PARTIAL_SQL = "CASE WHEN size <= 3072 THEN sha256(content) ELSE sha256(content[1:1024] || content[size // 2 + 1:size // 2 + 1024] || content[size - 1023:size]) END"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def oracle_sql() -> dict[str, str]:
    c2 = "(SELECT conv_id, turn, role, encode(text) AS content FROM conversations)"
    conv = f"f AS (SELECT '/conv/' || conv_id AS folder, '/conv/' || conv_id || '/' || turn || coalesce('.' || role, '') AS path, CAST(coalesce(octet_length(content), 0) AS BIGINT) AS size, content FROM {c2})"
    conv_folders = "own AS (SELECT DISTINCT folder AS path FROM f), every AS (SELECT path FROM own UNION SELECT '/conv' FROM own)"
    page = "f AS (SELECT '/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS folder, CAST(coalesce(octet_length(encode(html)), 0) AS BIGINT) AS size FROM pages)"
    return {
        "duplicate_groups": _with(HASHED_SQL, GROUPS),
        "dup_sizes": _with(FILES_SQL, "SELECT size, count(*) AS n_files FROM f GROUP BY size HAVING count(*) > 1"),
        "size_candidates": _with(FILES_SQL, "SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM f) WHERE n > 1"),
        "unique_sizes": _with(FILES_SQL, "SELECT min(path) AS path, size FROM f GROUP BY size HAVING count(*) = 1"),
        "dup_hashes_sha256": _dup_hashes("sha256"),
        "dup_hashes_sha1": _dup_hashes("sha1"),
        "dup_hashes_md5": _dup_hashes("md5"),
        "quick_hash": _with(FILES_SQL, "SELECT path, sha256(content[1:1024]) AS quick_hash FROM f"),
        "partial_hash": _with(FILES_SQL, f"SELECT path, {PARTIAL_SQL} AS partial_hash FROM f"),
        "sampling_hash": _with(FILES_SQL, f"SELECT path, {SAMPLED_SQL} AS sampled_hash FROM f"),
        "walked_files": _with(FILES_SQL, "SELECT path, name, folder, size FROM f"),
        "walked_folders": _with(FILES_SQL, FOLDERS_SQL, "SELECT path, name, num_files, total_size FROM fm"),
        "walked_counts": _with(FILES_SQL, FOLDERS_SQL, "SELECT (SELECT count(*) FROM every) AS n_folders, count(*) AS n_files, CAST(0 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS top_files FROM f"),
        "walked_roots": _with(FILES_SQL, "SELECT path FROM f UNION ALL SELECT '/nowhere'"),
        "walked_hashes": _with(FILES_SQL, f"w AS (SELECT path, sha256(content) AS full, sha256(content[1:1024]) AS quick, {PARTIAL_SQL} AS partial, {SAMPLED_SQL} AS sampled FROM f)", "SELECT *, length(path) % 2 = 0 AS ok FROM w"),
        "walked_groups": _with(HASHED_SQL, GROUPS),
        "walked_again": _with(
            FILES_SQL, "c AS (SELECT *, CASE WHEN size > 3072 THEN sha256(content[1:1024]) END AS quick FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM f) WHERE n > 1)",
            "k AS (SELECT *, count(*) OVER (PARTITION BY size, quick) AS same FROM c)",
            "SELECT 1 AS run, 'quick' AS kind, count(*) AS n_read, CAST(sum(size) AS BIGINT) AS size FROM k WHERE size > 3072 UNION ALL SELECT 1, 'full', count(*), CAST(sum(size) AS BIGINT) FROM k WHERE size <= 3072 OR same > 1",
        ),
        "partial_hash_positions": _with(FILES_SQL, "SELECT path, sha256(content[1:16] || content[101:164]) AS partial_hash FROM f"),
        "verify_hash": _with(FILES_SQL, "SELECT path, size % 2 = 0 AS ok FROM f"),
        "two_stage_groups": _with(HASHED_SQL, GROUPS),
        "hash_tiers": _with(HASHED_SQL, f"SELECT CASE WHEN size < {TIERS[0]} THEN 'full' WHEN size < {TIERS[1]} THEN 'quick' ELSE 'sampled' END AS tier, hash, min(size) AS size, count(*) AS n_files FROM h GROUP BY 1, hash HAVING count(*) > 1"),
        "strategy_choice": _with(FILES_SQL, "SELECT CASE WHEN count(*) = 0 OR avg(size) < 1024 THEN 'full' WHEN max(size) > 104857600 THEN 'partial' ELSE 'quick' END AS strategy FROM f"),
        "dup_members": _with(HASHED_SQL, MEMBERS),
        "dup_members_larger": _with(HASHED_SQL, f"{MEMBERS} AND size > {MIN_SIZE}"),
        "min_size_groups": _with(HASHED_SQL, GROUPS.replace("hash <> ''", f"hash <> '' AND size >= {MIN_SIZE}")),
        "summary": _with(HASHED_SQL, f"SELECT CAST(coalesce(sum(n_files - 1), 0) AS BIGINT) AS total_duplicates, CAST(coalesce(sum(wasted), 0) AS BIGINT) AS total_wasted FROM ({GROUPS})"),
        "analysis_summary": _with(
            HASHED_SQL, f"g AS ({GROUPS})",
            "SELECT count(*) AS n_groups, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum(wasted), 0) AS BIGINT) AS total_wasted, (SELECT hash FROM g ORDER BY wasted DESC, size DESC, hash DESC LIMIT 1) AS most_wasted_hash, max(wasted) AS most_wasted, (SELECT hash FROM g ORDER BY n_files DESC, size DESC, hash DESC LIMIT 1) AS most_copies_hash, max(n_files) AS most_copies FROM g",
        ),
        "top10_wasted": _with(HASHED_SQL, f"{GROUPS} ORDER BY wasted DESC, size DESC, hash LIMIT 10"),
        "group_preview": _with(
            HASHED_SQL, f"g AS ({GROUPS} ORDER BY wasted DESC, size DESC, hash LIMIT 10)",
            "SELECT g.hash, n_files, wasted, array_to_string(list_sort(list(path))[1:5], '|') AS shown, greatest(n_files - 5, 0) AS more FROM g JOIN h ON h.hash = g.hash GROUP BY ALL",
        ),
        "export_csv_rows": _with(HASHED_SQL, "SELECT hash, min(size) AS size, count(*) AS n_files, array_to_string(list_sort(list(path)), '|') AS files FROM h GROUP BY hash HAVING count(*) > 1"),
        "export_json_rows": _with(HASHED_SQL, """SELECT hash, '{"hash":"' || hash || '","size":' || min(size) || ',"count":' || count(*) || ',"files":["' || array_to_string(list_sort(list(path)), '","') || '"]}' AS json FROM h GROUP BY hash HAVING count(*) > 1"""),
        "keep_recommendation": _with(HASHED_SQL, KEEP),
        "delete_candidates": _with(HASHED_SQL, f"k AS ({KEEP})", "SELECT h.hash, path, size, keep_path FROM h JOIN k ON h.hash = k.hash AND path <> keep_path"),
        "folder_manifest": _with(FILES_SQL, FOLDERS_SQL, "SELECT * FROM fm"),
        "folder_duplication": _with(HASHED_SQL, FOLDERS_SQL, STATS_SQL, "SELECT path, duplication_percentage FROM st"),
        "folder_stats_full": _with(HASHED_SQL, FOLDERS_SQL, STATS_SQL, "SELECT * FROM st"),
        "folder_threshold": _with(HASHED_SQL, FOLDERS_SQL, STATS_SQL, "SELECT path, duplication_percentage FROM st WHERE duplication_percentage >= 15"),
        "folder_duplication_nonempty": _with(CANDIDATES_SQL, FOLDERS_SQL, STATS_SQL, "SELECT folder AS path, count(*) AS hashed_files, CAST(sum(CAST(dup AS INTEGER)) AS BIGINT) AS duplicated_files, CAST(sum(CAST(dup AS INTEGER)) AS DOUBLE) / count(*) * 100 AS duplication_percentage FROM m WHERE hash IS NOT NULL GROUP BY folder"),
        "overall_statistics": _with(CANDIDATES_SQL, FOLDERS_SQL, "SELECT (SELECT count(*) FROM every) AS total_folders, count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, count(DISTINCT hash) AS unique_files FROM h"),
        "scan_totals": _with(FILES_SQL, FOLDERS_SQL, "SELECT count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, (SELECT count(*) FROM every) AS total_folders FROM f"),
        "folder_hash_sets": _with(CANDIDATES_SQL, SIMILAR_SQL, "SELECT * FROM fh"),
        "similar_folders_candidates": _with(CANDIDATES_SQL, SIMILAR_SQL, f"SELECT * FROM sim WHERE similarity >= {SIMILAR}"),
        "similar_folders_all": _with(HASHED_SQL, SIMILAR_SQL, "SELECT * FROM sim WHERE similarity >= 1"),
        "similar_folders_zero_threshold": _with(CANDIDATES_SQL, SIMILAR_SQL, "SELECT * FROM sim"),
        "top_similar_folders": _with(CANDIDATES_SQL, SIMILAR_SQL, "SELECT * FROM sim WHERE similarity >= 1 ORDER BY similarity DESC, folder_a, folder_b LIMIT 10"),
        "dup_report": _with(HASHED_SQL, "g AS (SELECT hash, size, count(*) AS n FROM h GROUP BY hash, size HAVING count(*) > 1)", "SELECT count(DISTINCT hash) AS unique_duplicates, CAST(sum(n) AS BIGINT) AS total_duplicate_files, CAST(sum(n * size) AS BIGINT) AS total_duplicate_size, CAST(sum((n - 1) * size) AS BIGINT) AS wasted_space FROM g"),
        "size_distribution": _with(FILES_SQL, _band_sql()),
        "size_range": _with(FILES_SQL, f"SELECT path, size FROM f WHERE size BETWEEN {LOW} AND {HIGH}"),
        "files_in_folder": _with(FILES_SQL, "SELECT path, name, folder, size, last_modified FROM f WHERE folder = '/src1/en'"),
        "files_of_size": _with(FILES_SQL, "SELECT path, size FROM f WHERE size = 416"),
        "files_of_hash": _with(HASHED_SQL, f"SELECT path, size, hash FROM h WHERE hash = (SELECT hash FROM ({GROUPS}) ORDER BY wasted DESC, size DESC, hash LIMIT 1)"),
        "folder_by_path": _with(FILES_SQL, FOLDERS_SQL, "SELECT * FROM fm WHERE path = '/src1'"),
        "ignore_globs": _with(FILES_SQL, "SELECT CASE WHEN doc_id % 7 = 4 THEN folder || '/' || doc_id || '.TMP' ELSE path END AS path, size FROM f WHERE doc_id % 7 > 3"),
        "hardlinks": _with(FILES_SQL, "SELECT path, '1:' || size AS inode, CASE WHEN path <> first_path THEN first_path END AS hardlink_to FROM (SELECT *, min(path) OVER (PARTITION BY size) AS first_path FROM f)"),
        "format_size": _with(FILES_SQL, _format_sql()),
        "incremental_misses": _with(HASHED_SQL, CACHE_SQL, "SELECT path, size FROM h ANTI JOIN c USING (path, size, last_modified)"),
        "cache_statistics": _with(HASHED_SQL, CACHE_SQL, "SELECT count(*) AS lookups, count(c.hash) AS hits, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE CAST(count(c.hash) AS DOUBLE) / count(*) END AS hit_rate FROM h LEFT JOIN c USING (path, size, last_modified)"),
        "cache_update": _with(HASHED_SQL, CACHE_SQL, "m AS (SELECT path FROM h ANTI JOIN c USING (path, size, last_modified))", "SELECT path, size, hash FROM h SEMI JOIN m USING (path) UNION ALL SELECT path, size, hash FROM c ANTI JOIN m USING (path)"),
        "upsert_by_path": _with(FILES_SQL, "SELECT path, CASE WHEN count(*) OVER (PARTITION BY size) > 1 THEN size * 10 ELSE size END AS size, last_modified FROM f UNION ALL SELECT '/new' || path, size, last_modified FROM f"),
        "update_hashes": _with(CANDIDATES_SQL, "SELECT path, size, coalesce(hash, 's' || size) AS hash FROM h"),
        "manifest_diff": _with(FILES_SQL, f"SELECT path, CASE WHEN size < {LOW} THEN 'added' WHEN size > {HIGH} THEN 'removed' ELSE 'changed' END AS change FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM f) WHERE size < {LOW} OR size > {HIGH} OR n > 1"),
        "conversation_groups": _with(conv.replace("encode(text)", "encode(left(text, 14))"), "h AS (SELECT *, sha256(content) AS hash FROM f)", GROUPS),
        "conversation_folders": _with(conv, "h AS (SELECT *, sha256(content) AS hash FROM f)", conv_folders, STATS_SQL, "SELECT * FROM st"),
        "page_folders": _with(page, FOLDERS_SQL, "SELECT * FROM fm"),
    }

