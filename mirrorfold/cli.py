"""Command line: find duplicates below some paths."""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import storage
from .config import ALGORITHMS, EngineConfig
from .functions.names import format_size
from .operators import duplicates, folders, incremental, reports, similarity
from .plans import control
from .plans.analysis import AnalysisResult, analyze_paths


def parser() -> argparse.ArgumentParser:
    """Names, choices and defaults of the options are fixed values."""
    p = argparse.ArgumentParser(prog="mirrorfold", description="Find files with equal content and folders that resemble each other.")
    p.add_argument("paths", nargs="+", help="files or folders")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-d", "--debug", action="store_true")
    p.add_argument("--hash", choices=ALGORITHMS, default="sha256", dest="algorithm")
    p.add_argument("--db", metavar="DIR", help="keep the manifest and the hashes as Parquet in this folder, and use those of the last run")
    p.add_argument("--no-db", action="store_true", help="keep nothing")
    p.add_argument("--all", action="store_true", help="show all groups, not the ten largest")
    p.add_argument("--export", metavar="FILE")
    p.add_argument("--export-format", choices=["json", "csv"], default="json")
    p.add_argument("--min-size", type=int, default=0, metavar="BYTES")
    p.add_argument("--folder-threshold", type=float, default=0.0, metavar="PCT")
    p.add_argument("--find-similar", type=float, metavar="PCT")
    p.add_argument("--ignore-hidden", action="store_true")
    p.add_argument("--follow-links", action="store_true")
    p.add_argument("--stats", action="store_true", help="also show sizes, totals, changes since the last run, and speed")
    p.add_argument("-w", "--workers", type=int, metavar="N", help="tasks at a time on this machine (default: one per core)")
    p.add_argument("--fast", action="store_true", help="two tasks per core, for storage that answers slowly")
    p.add_argument("--storage", choices=list(control.PROFILES), default="auto", help="settings for a kind of storage")
    p.add_argument("--batch-size", type=int, default=1000, help="taken for compatibility: Spark sizes its batches")
    p.add_argument("--max-connections", type=int, default=10, help="taken for compatibility: there is no database to connect to")
    p.add_argument("--no-progress", action="store_true", help="no progress bars")
    p.add_argument("-i", "--interactive", action="store_true", help="a line with q on standard input cancels the run")
    p.add_argument("--master", help="a Spark master, in place of this machine")
    return p


def master(args: argparse.Namespace) -> str:
    if args.master:
        return args.master
    return f"local[{args.workers or (2 * (os.cpu_count() or 1) if args.fast else '*')}]"


def watch(spark: SparkSession, group: str) -> None:
    """Cancel the jobs of a group when a line with q comes in."""

    def wait() -> None:
        for line in sys.stdin:
            if line.strip().lower() in ("q", "quit"):
                control.cancel(spark, group)
                return

    threading.Thread(target=wait, daemon=True).start()


def show(result: AnalysisResult, args: argparse.Namespace) -> None:
    shown = duplicates.preview(result.files, None if args.all else 10).withColumn("waste", format_size(F.col("wasted"))).orderBy(F.desc("wasted"), F.desc("size"), "hash")
    for r in shown.toLocalIterator():
        print(f"{r['hash'][:16]}  {r['n_files']} files of {r['size']} bytes, {r['waste']} wasted")
        for path in r["shown"]:
            print(f"  {path}")
        if r["more"]:
            print(f"  and {r['more']} more")
    for r in folders.folder_duplication(result.files, result.folders, args.folder_threshold).where("duplication_percentage > 0").toLocalIterator():
        print(f"{r['duplication_percentage']:6.1f} %  {r['path']}")
    if args.find_similar is not None:
        for r in similarity.top_similar(result.files, args.find_similar).toLocalIterator():
            print(f"{r['similarity']:6.1f} %  {r['folder_a']}  {r['folder_b']}")
    s, t = result.summary.first(), result.statistics.first()
    print(f"{t['total_files']} files in {t['total_folders']} folders, {t['total_size']} bytes; {s['total_duplicates']} copies waste {s['total_wasted']} bytes")
    if args.stats:
        reports.size_distribution(result.files).show(truncate=False)
        reports.analysis_summary(result.files).show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if missing := [p for p in args.paths if not os.path.exists(p)]:
        print(f"no such path: {', '.join(missing)}", file=sys.stderr)
        return 1
    given = EngineConfig.from_env()
    state = None if args.no_db else args.db or given.state_dir
    config = EngineConfig(algorithm=args.algorithm, min_size=args.min_size, ignore_hidden=args.ignore_hidden, follow_symlinks=args.follow_links, state_dir=state, verbose=args.verbose or given.verbose, debug=args.debug)
    builder = SparkSession.builder.master(master(args)).appName("mirrorfold").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.ui.showConsoleProgress", str(not args.no_progress).lower()).getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if args.debug else "INFO" if config.verbose else "ERROR")
    control.apply_profile(spark, args.storage)
    group = f"mirrorfold-{os.getpid()}"
    if args.interactive:
        watch(spark, group)
    began = time.time()
    try:
        with control.job_group(spark, group, "find duplicates"):
            report(spark, args, config, began)
    except KeyboardInterrupt:
        control.cancel(spark, group)
        return 130
    except Exception as error:
        if "cancelled" in str(error).lower() and args.interactive:
            return 130
        raise
    return 0


def report(spark: SparkSession, args: argparse.Namespace, config: EngineConfig, began: float) -> None:
    result = analyze_paths(spark, args.paths, config, quick=args.find_similar is None)
    show(result, args)
    if args.export:
        if args.export_format == "json":
            reports.export_json(result.files, result.folders, args.export)
        else:
            reports.export_csv(result.files, args.export)
    kept = f"{config.state_dir}/files"
    if args.stats:
        if config.state_dir and storage.exists(spark, kept):
            for r in incremental.manifest_diff(spark.read.parquet(kept), result.files).groupBy("change").count().orderBy("change").collect():
                print(f"{r['count']} {r['change']} since the last run")
        read = result.read.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "full", F.col("size"))), F.lit(0)).alias("bytes")).first()
        took = max(time.time() - began, 1e-9)
        print(f"{read['n']} reads, {read['bytes']} bytes in full, {result.files.count() / took:.0f} files/s, {read['bytes'] / took / 1e6:.1f} MB/s")
    if config.state_dir:
        storage.replaced(result.files, kept)
        storage.replaced(result.folders, f"{config.state_dir}/folders")
    for r in result.errors.toLocalIterator():
        print(f"not read: {r['path']}: {r['message']}", file=sys.stderr)
    print(f"{time.time() - began:.1f} s")
    storage.clean(spark)


if __name__ == "__main__":
    sys.exit(main())
