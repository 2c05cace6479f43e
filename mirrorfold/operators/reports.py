"""Reports and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import strategy
from .duplicates import groups, with_locations
from .folders import folder_duplication

#: Labels of size bands and their exclusive upper bounds.
BANDS = [("< 1KB", 1 << 10), ("1KB - 1MB", 1 << 20), ("1MB - 10MB", 10 << 20), ("10MB - 100MB", 100 << 20), ("100MB - 1GB", 1 << 30)]
LAST_BAND = "> 1GB"


def duplicate_report(files: DataFrame) -> DataFrame:
    """One row over groups of equal hash and size; the kept copy counts among the files, and sums are null without duplicates."""
    g = files.groupBy("hash", "size").agg(F.count("*").alias("n"), F.max(F.length("hash")).alias("_known")).where("n > 1 AND _known > 0")
    return g.agg(
        F.countDistinct("hash").alias("unique_duplicates"),
        F.sum("n").alias("total_duplicate_files"),
        F.sum(F.col("n") * F.col("size")).alias("total_duplicate_size"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("wasted_space"),
    )


def size_distribution(files: DataFrame) -> DataFrame:
    band = None
    for label, below in BANDS:
        c = F.col("size") < below
        band = F.when(c, label) if band is None else band.when(c, label)
    out = files.groupBy(band.otherwise(LAST_BAND).alias("size_range")).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.min("size").alias("_least"))
    return out.orderBy("_least").drop("_least")


def scan_totals(files: DataFrame, folders: DataFrame) -> DataFrame:
    f = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return f.crossJoin(folders.agg(F.count("*").alias("total_folders")))  # one row each


def analysis_summary(files: DataFrame) -> DataFrame:
    """One row: groups, files in them, waste, the group that wastes most and the one with most copies (ties: larger size, then hash)."""
    g = groups(files)
    most_waste = F.max(F.struct("wasted", "size", F.col("hash"))).alias("w")
    most_copies = F.max(F.struct("n_files", "size", F.col("hash"))).alias("c")
    out = g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("total_wasted"), most_waste, most_copies)
    return out.select("n_groups", "duplicate_files", "total_wasted", F.col("w.hash").alias("most_wasted_hash"), F.col("w.wasted").alias("most_wasted"), F.col("c.hash").alias("most_copies_hash"), F.col("c.n_files").alias("most_copies"))


def strategy_choice(files: DataFrame) -> DataFrame:
    s = files.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("largest"))
    return s.select(strategy(F.col("n"), F.col("mean"), F.col("largest")).alias("strategy"))


def csv_rows(files: DataFrame) -> DataFrame:
    """Columns Hash, Size, Count, Files; members joined by a bar."""
    return with_locations(files).select(F.col("hash").alias("Hash"), F.col("size").alias("Size"), F.col("n_files").alias("Count"), F.array_join("files", "|").alias("Files"))


def json_rows(files: DataFrame) -> DataFrame:
    """One JSON object per group: hash, size, count, files."""
    return with_locations(files).select("hash", F.to_json(F.struct("hash", "size", F.col("n_files").alias("count"), "files")).alias("json"))


def export_csv(files: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each."""
    csv_rows(files).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def export_json(files: DataFrame, folders: DataFrame, path: str) -> None:
    """One JSON file on the driver, as a report for people. It is written row by row as rows arrive, in order."""
    from .duplicates import members, summary

    total = summary(files).first()
    waste = F.col("size") * (F.col("n_files") - 1)
    rows = members(files).select("hash", "size", "n_files", "path").orderBy(F.desc(waste), F.desc("size"), "hash", "path")
    text = lambda x: json.dumps(x, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{\n"total_duplicates": {total["total_duplicates"]},\n"total_wasted_space": {total["total_wasted"]},\n"duplicate_groups": [')
        now = None
        for r in rows.toLocalIterator():
            if r["hash"] != now:
                out.write("" if now is None else "]},")
                out.write(f'\n{{"hash": {text(r["hash"])}, "size": {r["size"]}, "count": {r["n_files"]}, "files": [{text(r["path"])}')
                now = r["hash"]
            else:
                out.write(f', {text(r["path"])}')
        out.write(("" if now is None else "]}") + '],\n"folder_stats": {')
        for i, r in enumerate(folder_duplication(files, folders).toLocalIterator()):
            out.write(f'{"," if i else ""}\n{text(r["path"])}: {r["duplication_percentage"]}')
        out.write("}\n}\n")
