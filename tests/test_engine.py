"""Operators on small tables, walks of real folders, and all registered queries against SQL."""

import hashlib
import json
import os
import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorfold import cli
from mirrorfold.config import EngineConfig
from mirrorfold.functions import hashing as H
from mirrorfold.functions.names import ancestors, format_size, ignored, parent
from mirrorfold.operators import duplicates, filters, folders, incremental, reports, similarity
from mirrorfold.operators.joins import spread_join
from mirrorfold.plans import analysis, control
from mirrorfold.plans import queries as Q
from mirrorfold.sources import walker
from mirrorfold.streaming import arrivals

DAY = datetime(2024, 1, 1)
CONTENT = "path string, name string, folder string, size long, last_modified timestamp, content binary"


def manifest(spark, files):
    """files: path -> content, or (content, time)."""
    rows = []
    for path, c in files.items():
        c, when = c if isinstance(c, tuple) else (c, DAY)
        c = c.encode() if isinstance(c, str) else c
        folder, _, name = path.rpartition("/")
        rows.append((path, name, folder, len(c or b""), when, c))
    return spark.createDataFrame(rows, CONTENT)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_digests(spark):
    big = bytes(range(256)) * 17
    texts = [b"", b"Hello, World!", b"A" * 2000, b"x" * 3072, b"y" * 3073, big, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content binary")
    got = df.select("i", *(H.full_hash("content", a).alias(a) for a in ("md5", "sha1", "sha256", "sha512")), H.quick_hash("content").alias("q"), H.partial_hash("content").alias("p"), H.blake2b("content").alias("b"), H.sampling_hash("content", 64).alias("s"), H.verify_hash("content", F.sha2("content", 256)).alias("v"), H.verify_hash("content", F.lit("wronghash")).alias("w")).collect()
    for r in got:
        c = texts[r.i]
        if c is None:
            assert r.sha256 is None and r.q is None and r.p is None and r.b is None and r.s is None and r.v is False
            continue
        for a in ("md5", "sha1", "sha256", "sha512"):
            assert r[a] == hashlib.new(a, c).hexdigest()
        assert r.q == hashlib.sha256(c[:1024]).hexdigest()
        n = len(c)
        parts = c if n <= 3072 else c[:1024] + c[n // 2 : n // 2 + 1024] + c[n - 1024 :]
        assert r.p == hashlib.sha256(parts).hexdigest()
        assert r.b == hashlib.blake2b(c, digest_size=32).hexdigest()
        spans = [(0, n)] if n <= 192 else H.sample_positions(n, 64)
        assert r.s == hashlib.sha256(b"".join(c[a : a + k] for a, k in spans)).hexdigest()
        assert r.v and not r.w
    with pytest.raises(ValueError):
        H.full_hash("content", "crc")
    with pytest.raises(ValueError):
        EngineConfig(algorithm="crc")


def test_groups_of_equal_content(spark):
    m = manifest(spark, {"/a/1": "Duplicate content", "/a/2": "Duplicate content", "/a/3": "Different content", "/b/4": "alone", "/b/5": "", "/c/6": "", "/c/7": ""})
    h = duplicates.hashed_candidates(m)
    assert rows(h.where("hash IS NULL"), "path") == [("/b/4",)]
    one = hashlib.sha256(b"Duplicate content").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert set(rows(duplicates.groups(h), "hash", "n_files", "wasted")) == {(one, 2, 17), (empty, 3, 0)}
    assert rows(duplicates.summary(h), "total_duplicates", "total_wasted") == [(3, 17)]
    assert rows(duplicates.duplicate_sizes(m), "size", "n_files") == [(0, 3), (17, 3)]
    assert rows(duplicates.unique_sizes(m), "path") == [("/b/4",)]
    assert rows(duplicates.members(h, 0), "path") == [("/a/1",), ("/a/2",)]
    stats = {r.path: r.duplication_percentage for r in folders.folder_stats(h).collect()}
    assert stats == {"/a": 2 / 3 * 100, "/b": 50.0, "/c": 100.0}


def test_funnel_gives_the_same_groups(spark):
    same = b"s" * 1024
    files = {"/1": same + b"a" * 3072, "/2": same + b"b" * 3072, "/3": same + b"a" * 3072, "/4": b"q" * 3072, "/5": b"q" * 3072, "/6": b"r" * 3073, "/7": b"r" * 3073, "/8": b"z"}
    m = manifest(spark, files)
    f = duplicates.funnel(m)
    quick = {r.path: r.quick for r in f.collect()}
    assert quick["/1"] == quick["/2"] and quick["/4"] is None and quick["/6"] is not None and "/8" not in quick
    assert rows(duplicates.groups(f), "hash", "n_files") == rows(duplicates.groups(duplicates.hashed(m)), "hash", "n_files")
    assert rows(duplicates.hash_tiers(m, 3073, 4000), "tier", "n_files") == [("full", 2), ("quick", 2), ("sampled", 2)]


def test_which_copy_stays(spark):
    m = manifest(spark, {"/aa": ("x", None), "/bb": ("x", DAY + timedelta(1)), "/cc": ("x", DAY), "/d/long": ("x", DAY - timedelta(9)), "/ee": ("y", DAY), "/ff": ("y", DAY)})
    h = duplicates.hashed(m)
    assert {r.keep_path for r in duplicates.keep_recommendation(h).collect()} == {"/cc", "/ee"}
    assert rows(duplicates.delete_candidates(h), "path") == [("/aa",), ("/bb",), ("/d/long",), ("/ff",)]


def plain_similar(files, threshold, everything=False):
    sizes = defaultdict(int)
    for c in files.values():
        sizes[len(c)] += 1
    sets = defaultdict(set)
    for path, c in files.items():
        if everything or sizes[len(c)] > 1:
            sets[path.rpartition("/")[0]].add(c)
    out = []
    for a, b in combinations(sorted(sets), 2):
        s = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) * 100
        if s >= threshold:
            out.append((a, b, s))
    return out


@pytest.mark.parametrize("threshold", [-1, 0, 0.5, 25, 33, 50, 70, 100])
def test_similar_folders(spark, threshold):
    rng = random.Random(3)
    files = {f"/f{i % 14}/{i}": rng.choice("abcdefghijklmnop" if i % 3 else "a") * rng.choice([1, 2, 2, 2, 3]) for i in range(90)}
    files |= {"/x/1": "only", "/a/1": "kk", "/a/2": "ll", "/b/1": "kk", "/b/2": "ll"}
    h = duplicates.hashed_candidates(manifest(spark, files))
    got = sorted((r.folder_a, r.folder_b, r.similarity) for r in similarity.similar_folders(h, threshold).collect())
    want = plain_similar(files, threshold)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    full = similarity.similar_folders(duplicates.hashed(manifest(spark, files)), threshold, crowd=3)
    assert sorted((r.folder_a, r.folder_b) for r in full.collect()) == [w[:2] for w in plain_similar(files, threshold, True)]


def test_nothing_there(spark):
    m = manifest(spark, {}).where("false")
    h = duplicates.hashed_candidates(m)
    assert rows(duplicates.summary(h), "total_duplicates", "total_wasted") == [(0, 0)]
    r = reports.duplicate_report(h).first()
    assert r.unique_duplicates == 0 and r.total_duplicate_files is None and r.wasted_space is None
    assert rows(folders.overall_statistics(h), "total_folders", "total_files", "total_size", "unique_files") == [(0, 0, 0, 0)]
    assert rows(reports.strategy_choice(m), "strategy") == [("full",)]
    s = reports.analysis_summary(h).first()
    assert s.n_groups == 0 and s.most_wasted_hash is None
    assert similarity.similar_folders(h, 0).count() == 0 and folders.folder_stats(h).count() == 0


def test_bands_ranges_and_sizes(spark):
    sizes = [0, 1023, 1024, 1048575, 1048576, 10485760, 104857600, 1073741824]
    df = spark.createDataFrame([(f"/{s}", s) for s in sizes], "path string, size long")
    assert [tuple(r) for r in reports.size_distribution(df).collect()] == [("< 1KB", 2, 1023), ("1KB - 1MB", 2, 1024 + 1048575), ("1MB - 10MB", 1, 1048576), ("10MB - 100MB", 1, 10485760), ("100MB - 1GB", 1, 104857600), ("> 1GB", 1, 1073741824)]
    assert [r.size for r in filters.size_range(df, 1023, 1048576).collect()] == [1023, 1024, 1048575, 1048576]
    values = [0, 1, 1023, 1024, 39040, 1536, 10**6, 2**20 - 1, 2**30, 2**40 + 1, 2**50, 2**60, 2**52 + 12345]

    def plain(n):
        x = float(n)
        for u in ("B", "KB", "MB", "GB", "TB"):
            if x < 1024:
                return f"{x:.2f} {u}"
            x /= 1024
        return f"{x:.2f} PB"

    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert {r.n: r.t for r in df.select("n", format_size(F.col("n")).alias("t")).collect()} == {v: plain(v) for v in values}
    many = spark.createDataFrame([(200 << 20, "/a"), (1, "/b")], "size long, path string")
    assert reports.strategy_choice(many).first()[0] == "partial"
    assert reports.strategy_choice(many.where("size = 1")).first()[0] == "full"
    assert reports.strategy_choice(many.withColumn("size", F.lit(50 << 10))).first()[0] == "quick"


def test_names(spark):
    names = ["A.TMP", "x.tmp", "x.cache", "Thumbs.db", "thumbs.db", "~x", "a~", ".DS_Store", ".hidden", "x.tmp\n", "a[1].c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    globs = EngineConfig().ignore_globs
    assert {r.n for r in df.where(ignored(F.col("n"), globs)).collect()} == {"x.tmp", "x.cache", "Thumbs.db", "~x", ".DS_Store"}
    assert {r.n for r in df.where(ignored(F.col("n"), ("a[[]1].?",), True)).collect()} == {".DS_Store", ".hidden", "a[1].c"}
    m = spark.createDataFrame([("/~old/keep.txt",), ("/a/x.tmp",), ("/a/b/keep",), ("/a.tmp/b/c",), ("/r.tmp/ok",)], "path string")
    assert rows(filters.not_ignored(m), "path") == [("/a/b/keep",)]
    assert rows(filters.not_ignored(m, root="/r.tmp").where("path like '/r.tmp%'"), "path") == [("/r.tmp/ok",)]
    one = spark.createDataFrame([("/a/b/c",)], "p string").select(ancestors(F.col("p")).alias("a"), parent(F.col("p")).alias("q"), parent(F.lit("/a")).alias("r")).first()
    assert (one.a, one.q, one.r) == (["/a", "/a/b", "/a/b/c"], "/a/b", "/")


def test_state_between_runs(spark):
    f = spark.createDataFrame([("/a", 1, DAY), ("/b", 2, DAY), ("/c", 3, None)], "path string, size long, last_modified timestamp")
    cache = spark.createDataFrame([("/a", 1, DAY, "sha256", "full", "ha"), ("/b", 9, DAY, "sha256", "full", "hb"), ("/c", 3, None, "sha256", "full", "hc"), ("/a", 1, DAY, "md5", "full", "m")], "path string, size long, last_modified timestamp, algorithm string, kind string, hash string")
    assert rows(incremental.cache_misses(f, cache), "path") == [("/b",)]
    assert rows(incremental.cache_statistics(f, cache), "lookups", "hits") == [(3, 2)]
    new = incremental.updated_cache(cache, f.withColumn("hash", F.lit("new")).where("path = '/b'"))
    assert rows(new, "path", "algorithm", "hash") == [("/a", "md5", "m"), ("/a", "sha256", "ha"), ("/b", "sha256", "new"), ("/c", "sha256", "hc")]
    assert rows(incremental.cache_without(cache, f.where("path = '/a'")), "path") == [("/b",), ("/c",)]
    assert rows(incremental.upsert(f.select("path", "size"), spark.createDataFrame([("/a", 5), ("/a", 7), ("/z", 1)], "path string, size long")), "path", "size") == [("/a", 7), ("/b", 2), ("/c", 3), ("/z", 1)]
    later = spark.createDataFrame([("/a", 1, DAY), ("/b", 4, DAY), ("/d", 3, None)], "path string, size long, last_modified timestamp")
    assert rows(incremental.manifest_diff(f, later), "path", "change") == [("/b", "changed"), ("/c", "removed"), ("/d", "added")]
    got = incremental.run_all(spark, ["SELECT 1 AS x", "SELECT 2 AS x"])
    assert [g.first().x for g in got] == [1, 2]
    with pytest.raises(Exception, match="(?i)nope"):
        incremental.run_all(spark, ["SELECT * FROM nope"])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_spread(spark, how):
    left = spark.createDataFrame([(f"/{i}", "hot" if i % 3 else f"k{i % 12}") for i in range(300)] + [("/n", None)], "path string, key string")
    right = left.where("key <> 'k3' AND key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n_files"))
    got = spread_join(left, right, ["key"], how, hot=50, salts=4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, "key", how).select(got.columns).collect()))


def test_jobs_can_be_cancelled_and_counted(spark):
    with control.job_group(spark, "scan", "a test"):
        observed, metrics = control.observed(spark.range(10).select(F.col("id").alias("size")), "sizes")
        observed.write.format("noop").mode("overwrite").save()
    assert metrics.get == {"n": 10, "bytes": 45}
    assert control.profile("network")["spark.sql.files.maxPartitionBytes"]
    with pytest.raises(ValueError):
        control.profile("tape")
    control.cancel(spark, "scan")


@pytest.fixture
def tree(tmp_path):
    for path, text in {"file1.txt": "Content 1", "file2.txt": "Content 2", "subdir1/file3.txt": "Content 3", "subdir1/nested/file4.txt": "Content 4", "subdir2/file5.txt": "Content 5"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_walks(spark, tree):
    w = walker.walk(spark, [str(tree)])
    assert walker.files(w).count() == 5 and walker.folders(w).count() == walker.count_folders(w) == 4 and walker.errors(w).count() == 0
    top = {r.path: r for r in walker.folders(w).collect()}[str(tree)]
    assert (top.num_files, top.total_size, top.parent_path) == (2, 18, str(tree.parent))
    flat = walker.walk(spark, [str(tree)], recursive=False)
    assert walker.files(flat).count() == 2 and walker.folders(flat).count() == 1
    for depth, n in ((0, 2), (1, 4), (2, 5)):
        assert walker.files(walker.walk(spark, [str(tree)], EngineConfig(max_depth=depth))).count() == n
    for name in ("file.tmp", "~backup", ".hidden", "Thumbs.db", "_keep"):
        (tree / name).write_text("x")
    (tree / "empty").mkdir()
    (tree / "empty.txt").write_text("")
    (tree / "x.tmp").mkdir()
    (tree / "x.tmp" / "inside").write_text("x")
    w = walker.walk(spark, [str(tree)])
    assert {Path(r.path).name for r in walker.files(w).collect()} == {f"file{i}.txt" for i in range(1, 6)} | {".hidden", "_keep", "empty.txt"}
    assert str(tree / "empty") in {r.path for r in walker.folders(w).collect()}
    assert ".hidden" not in {r.name for r in walker.files(walker.walk(spark, [str(tree)], EngineConfig(ignore_hidden=True))).collect()}


def test_walks_of_several_roots_and_links(spark, tree):
    w = walker.walk(spark, [str(tree), str(tree / "subdir1"), str(tree / "subdir2" / "file5.txt"), str(tree / "nowhere")])
    assert walker.files(w).count() == 5 and walker.folders(w).count() == 4
    assert rows(walker.errors(w), "path") == [(str(tree / "nowhere"),)]
    os.link(tree / "file1.txt", tree / "subdir2" / "again.txt")
    os.symlink(tree, tree / "subdir2" / "loop")
    os.symlink(tree / "file2.txt", tree / "link.txt")
    os.symlink(tree / "gone", tree / "broken")
    w = walker.walk(spark, [str(tree)])
    linked = walker.hardlinks(walker.files(w)).where("hardlink_to IS NOT NULL")
    assert rows(linked, "path", "hardlink_to") == [(str(tree / "subdir2" / "again.txt"), str(tree / "file1.txt"))]
    follow = walker.walk(spark, [str(tree)], EngineConfig(follow_symlinks=True))
    names = [r.name for r in walker.files(follow).collect()]
    assert "link.txt" in names and len(names) < 40


def test_analysis_of_paths(spark, tree):
    (tree / "subdir2" / "copy.txt").write_text("Content 1")
    (tree / "big1").write_bytes(b"s" * 5000 + b"1")
    (tree / "big2").write_bytes(b"s" * 5000 + b"2")
    (tree / "big3").write_bytes(b"s" * 5000 + b"1")
    for quick in (True, False):
        r = analysis.analyze_paths(spark, [str(tree)], quick=quick)
        assert rows(r.groups, "n_files", "wasted") == [(2, 9), (2, 5001)]
        assert r.summary.first().total_wasted == 5010
    hashed = walker.with_hash(r.files.drop("hash"), "sampled", sample=100).where("name = 'big1'").first()
    raw = (tree / "big1").read_bytes()
    assert hashed.hash == hashlib.sha256(b"".join(raw[a : a + n] for a, n in H.sample_positions(len(raw), 100))).hexdigest()
    assert walker.verify(r.files.where("hash IS NOT NULL")).where("NOT ok").count() == 0
    assert walker.verify(r.files.withColumn("hash", F.lit("wronghash"))).where("ok").count() == 0
    lost = r.files.drop("hash").withColumn("path", F.concat("path", F.lit("-gone")))
    assert walker.with_hash(lost).where("hash IS NOT NULL").count() == 0
    table = manifest(spark, {"/a/1": "aa", "/a/2.tmp": "aa", "/b/3": "aa", "/b/4": "long one"})
    out = analysis.analyze_manifest(table, EngineConfig(min_size=2))
    assert rows(out.groups, "n_files") == [(2,)] and out.statistics.first().total_files == 3


def test_second_run_reads_only_what_changed(spark, tree, tmp_path_factory):
    state = str(tmp_path_factory.mktemp("state"))
    (tree / "subdir2" / "copy.txt").write_text("Content 1")
    for i in range(3):
        (tree / f"big{i}").write_bytes(b"s" * 5000 + bytes([48 + i // 2]))
        (tree / f"huge{i}").write_bytes(b"h" * 40_000 + bytes([48 + i // 2]))
    config = EngineConfig(state_dir=state, sampled_from=20_000, sample_size=1000)
    first = analysis.analyze_paths(spark, [str(tree)], config)
    assert rows(first.groups, "n_files", "wasted") == [(2, 9), (2, 5001), (2, 40001)]
    kinds = defaultdict(int)
    for r in first.read.collect():
        kinds[r.kind] += 1
    assert kinds == {"quick": 3, "sampled": 3, "full": 6 + 3 + 2}  # of the samples of huge files the last byte is one
    again = analysis.analyze_paths(spark, [str(tree)], config)
    assert again.read.count() == 0 and rows(again.files, "path", "hash") == rows(first.files, "path", "hash")
    (tree / "file2.txt").write_text("Content 1")
    os.utime(tree / "file2.txt", (1, 1))
    third = analysis.analyze_paths(spark, [str(tree)], config)
    assert rows(third.read, "path", "kind") == [(str(tree / "file2.txt"), "full")]
    assert rows(third.groups, "n_files", "wasted") == [(2, 5001), (2, 40001), (3, 18)]
    assert incremental.cache_statistics(third.files.drop("hash"), incremental.read_cache(spark, state)).first().hits == 11


def test_deep_trees_are_shared_out(spark, tmp_path, monkeypatch):
    deep = tmp_path / "a" / "b" / "c"
    for i in range(40):
        (deep / f"d{i}" / "e").mkdir(parents=True)
        (deep / f"d{i}" / "e" / "f.txt").write_text("x")
    reader = walker.WalkReader({"roots": json.dumps([str(tmp_path)])})
    assert [len(p.places) for p in reader.partitions()] == [32, 32, 20]  # small: all folders are known, and listed in batches
    monkeypatch.setattr(walker, "SUBTREES", 16)
    assert sum(p.places[0].what == "tree" for p in reader.partitions()) == 40
    w = walker.walk(spark, [str(tmp_path)])
    assert walker.files(w).count() == 40 and walker.folders(w).count() == 84
    reader = walker.WalkReader({"roots": json.dumps([str(tmp_path)]), "config": json.dumps({"max_depth": 3})})
    found = [x[1] for p in reader.partitions() for x in reader.read(p) if x[0] == "folder"]
    assert len(found) == len(set(found)) == 4


@pytest.mark.parametrize("name", ["delete_candidates", "folder_stats_full", "similar_folders_candidates", "similar_folders_all", "cache_update", "dup_members", "keep_recommendation", "two_stage_groups"])
def test_content_is_read_once(spark, small, name):
    scans = spark.sparkContext.accumulator(0)
    d = spark.read.parquet(f"{small}/documents.parquet")
    seen = F.udf(lambda text: scans.add(1) or text, "string")
    old = Q.tables.documents

    def counted(s, sf):
        from mirrorfold.sources import tables

        rows = d.withColumn("text", seen("text"))
        return tables.from_columns(rows, F.concat(F.lit("/"), "source", F.lit("/"), "lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.encode("text", "UTF-8"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")))

    Q.tables.documents = counted
    try:
        Q.queries()[name](spark, small).collect()
    finally:
        Q.tables.documents = old
    assert scans.value == d.count()


def test_files_without_hash_or_inode(spark):
    f = manifest(spark, {"/a/1": "aa", "/a/2": "aa", "/b/3": "bb"}).withColumn("hash", F.when(F.col("name") != "3", F.sha2("content", 256))).withColumn("inode", F.when(F.col("name") != "3", F.lit("1:1")))
    assert rows(folders.marked(f), "path", "is_duplicate") == [("/a/1", True), ("/a/2", True), ("/b/3", False)]
    assert rows(walker.hardlinks(f), "path", "hardlink_to") == [("/a/1", None), ("/a/2", "/a/1"), ("/b/3", None)]


def test_tiers_are_confirmed(spark):
    head, body = "h" * 1500, "x" * 9000
    f = manifest(spark, {"/s1": "same", "/s2": "same", "/q1": head + "1", "/q2": head + "2", "/q3": head + "1", "/l1": body + "1" + body + body, "/l2": body + "2" + body + body, "/l3": body + "1" + body + body, "/n": None})
    for limit in (1 << 20, 0):
        got = duplicates.hash_tiers(f, 100, 5000, sample=64, broadcast_bytes=limit)
        assert rows(got, "tier", "size", "n_files") == [("full", 4, 2), ("quick", 1501, 2), ("sampled", 27001, 2)]


def test_storage(spark, tmp_path):
    from mirrorfold import storage

    path = str(tmp_path / "table")
    storage.replaced(spark.range(5), path)
    storage.replaced(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["table"]
    incremental.compact(spark, path, str(tmp_path / "small"))
    assert len(list((tmp_path / "small").glob("*.parquet"))) == 1
    with storage.Scratch(spark) as scratch:
        kept = storage.materialized(spark.range(3), "kept")
        gone = storage.materialized(spark.range(3), "gone", scratch)
        assert gone.count() == 3
    assert kept.count() == 3 and not storage.exists(spark, gone.inputFiles()[0])
    storage.clean(spark)
    assert not storage.exists(spark, kept.inputFiles()[0])
    spark.sql("CREATE TABLE analyzed USING parquet AS SELECT id FROM range(7)")
    incremental.analyze(spark, "analyzed")
    assert "7 rows" in str(spark.sql("DESCRIBE EXTENDED analyzed").where("col_name = 'Statistics'").collect())


def test_command_line(spark, tree, tmp_path, tmp_path_factory, capsys):
    state = str(tmp_path_factory.mktemp("state"))
    (tree / "subdir2" / "copy | one.txt").write_text("Content 1")
    out = tmp_path / "report.json"
    assert cli.main([str(tree), "--export", str(out), "--all", "--find-similar", "1", "--stats", "--db", state]) == 0
    assert "waste 9 bytes" in capsys.readouterr().out
    report = json.loads(out.read_text())
    assert report["total_wasted_space"] == 9 and report["duplicate_groups"][0]["count"] == 2 and report["folder_stats"][str(tree / "subdir2")] == 50.0
    assert spark.read.parquet(f"{state}/files").count() >= 6
    out.unlink()
    again = [str(tree), "--find-similar", "1", "--stats", "--db", state, "--storage", "ssd", "--workers", "2", "--no-progress", "--batch-size", "5"]
    capsys.readouterr()
    assert cli.main(again) == 0 and "\n0 reads" in capsys.readouterr().out
    (tree / "new.txt").write_text("Content 1")
    assert cli.main(again) == 0
    out_ = capsys.readouterr().out
    assert "1 added since the last run" in out_ and "\n1 reads" in out_
    assert cli.master(cli.parser().parse_args(["x", "--workers", "3"])) == "local[3]" and cli.master(cli.parser().parse_args(["x"])) == "local[*]"
    assert cli.main([str(tree), "--export", str(tmp_path / "csv"), "--export-format", "csv", "--min-size", "5"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Hash", "Size", "Count", "Files"]
    assert cli.main([str(tree / "nowhere")]) == 1


def test_settings(monkeypatch):
    assert EngineConfig.from_dict({"algorithm": "md5", "unknown": 1}).algorithm == "md5"
    monkeypatch.setenv("MIRRORFOLD_HASH_ALGORITHM", "sha1")
    monkeypatch.setenv("MIRRORFOLD_VERBOSE", "Yes")
    c = EngineConfig.from_env()
    assert c.algorithm == "sha1" and c.verbose and c.quick_from == 3072


def test_arrivals(spark, tmp_path):
    m = manifest(spark, {"/a": "one", "/b": "two", "/c": "one"})
    m.write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), m.schema)
    for name, df, n in (("first", arrivals.first_seen(stream), 2), ("copies", arrivals.copies_per_window(stream), None)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if n else "complete").start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name)
        assert got.count() == (n or 1)
    assert spark.table("copies").first().wasted == 3


@pytest.fixture(scope="module")
def small():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.mark.parametrize("name", list(Q.queries()))
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    df = Q.queries()[name](spark, small)
    sql = Q.oracle_sql().get(name)
    assert all(not isinstance(f.dataType, T.NullType) for f in df.schema)
    if sql is None:
        assert df.count() >= 0
        return
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, want.select(*columns).fetchall()))


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from mirrorfold.operators.duplicates import hash_tiers
from mirrorfold.plans.analysis import analyze_paths
found = analyze_paths(spark, [{tree!r}]).groups.count()
f = spark.range(2).select(F.concat(F.lit("/"), "id").alias("path"), F.encode(F.lit("x" * 500), "UTF-8").alias("content"), F.lit(500).cast("long").alias("size"))
print("found", found, hash_tiers(f, 10, 20, sample=64).count())
"""


def test_workers_get_the_code_from_the_job(spark, tmp_path):
    import subprocess
    import sys

    tree = tmp_path / "tree"
    tree.mkdir()
    for name in "ab":
        (tree / name).write_bytes(b"q" * 5000)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_GATEWAY"))}
    script = ELSEWHERE.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tree=str(tree))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1 1" in done.stdout, done.stderr[-2000:]
