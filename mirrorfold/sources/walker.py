"""Scans of file trees as a Python data source.

``spark.read.format("mirrorfold_walk")`` gives a row per folder, file and error. The driver lists folders breadth
first until there are enough subtrees to share out, however deep these lie; tasks list the folders above them in
batches and walk the subtrees, so all executors must see the same file system. Ignored names are left out before
anything else, and an ignored folder takes all below it along. Folders are reported even when empty. Errors become
rows and the scan goes on.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import EngineConfig
from ..functions.arrow import map_arrow, ship
from ..functions.hashing import sample_positions
from ..operators.joins import spread_join
from ..schemas import WALK

BUFFER = 8 << 20
#: Subtrees that make a scan wide enough, folders that the driver lists at most, and folders listed by one task.
SUBTREES, LISTED, BATCH = 256, 2048, 32


@dataclass
class Place:
    """A directory to walk from a depth on or to list alone, or a single file or missing path to report.

    ``above`` identifies the folders that lead to it, so that a link back up is known.
    """

    path: str
    depth: int
    what: str
    above: tuple = ()


@dataclass
class Places(InputPartition):
    places: list[Place]


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.config = EngineConfig.from_dict(json.loads(options.get("config", "{}")))
        self.recursive = options.get("recursive", "true") == "true"

    def _ignored(self, name: str) -> bool:
        c = self.config
        return c.ignore_hidden and name.startswith(".") or any(fnmatch.fnmatchcase(name, g) for g in c.ignore_globs)

    def _below(self, path: str) -> tuple[list[os.DirEntry], list[os.DirEntry], str | None]:
        """Folders and files of a directory, and why it can't be listed."""
        follow = self.config.follow_symlinks
        folders, files = [], []
        try:
            with os.scandir(path) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    if self._ignored(e.name):
                        continue
                    if e.is_dir(follow_symlinks=follow):
                        folders.append(e)
                    elif e.is_file(follow_symlinks=follow):
                        files.append(e)
        except OSError as error:
            return folders, files, str(error)
        return folders, files, None

    def partitions(self) -> list[Places]:
        waiting: deque[Place] = deque()
        alone, trees = [], []
        most = self.config.max_depth
        for root in map(os.path.abspath, self.roots):
            if os.path.isdir(root):
                waiting.append(Place(root, 0, "tree"))
            else:
                alone.append(Place(root, 0, "file" if os.path.isfile(root) else "missing"))
        listed = 0
        while waiting and listed < LISTED and len(waiting) + len(trees) < SUBTREES:
            place = waiting.popleft()
            if not self.recursive or most is not None and place.depth >= most:
                alone.append(Place(place.path, place.depth, "top", place.above))
                continue
            if self._inode(place.path) in place.above:
                continue
            below = self._below(place.path)[0]
            listed += 1
            above = self._chain(place)
            alone.append(Place(place.path, place.depth, "top", place.above))
            waiting += [Place(os.path.join(place.path, e.name), place.depth + 1, "tree", above) for e in below]
        trees = [Places([p]) for p in waiting]
        return [*trees, *(Places(alone[i : i + BATCH]) for i in range(0, len(alone), BATCH))]

    def _inode(self, path: str) -> tuple | None:
        """What a folder is known by; only followed links can lead back to one."""
        if not self.config.follow_symlinks:
            return None
        try:
            s = os.stat(path)
        except OSError:
            return None
        return (s.st_dev, s.st_ino) if stat.S_ISDIR(s.st_mode) else None

    def _chain(self, place: Place) -> tuple:
        here = self._inode(place.path)
        return place.above if here is None else (*place.above, here)

    @staticmethod
    def _file(path: str) -> tuple:
        try:
            s = os.stat(path)
        except OSError as error:
            return ("error", path, None, None, None, None, None, str(error))
        when = datetime.fromtimestamp(s.st_mtime, timezone.utc)
        return ("file", path, os.path.basename(path), os.path.dirname(path), s.st_size, when, f"{s.st_dev}:{s.st_ino}", None)

    @staticmethod
    def _folder(path: str) -> tuple:
        return ("folder", path, os.path.basename(path), os.path.dirname(path), None, None, None, None)

    def read(self, part: Places) -> Iterator[tuple]:
        for place in part.places:
            if place.what == "missing":
                yield ("error", place.path, None, None, None, None, None, "does not exist")
            elif place.what == "file":
                yield self._folder(os.path.dirname(place.path))
                yield self._file(place.path)
            else:
                yield from self._walk(place)

    def _walk(self, place: Place) -> Iterator[tuple]:
        most = self.config.max_depth
        waiting = [place]
        while waiting:
            now = waiting.pop()
            if (here := self._inode(now.path)) is not None and here in now.above:  # a link back up
                continue
            folders, files, error = self._below(now.path)
            yield self._folder(now.path)
            if error is not None:
                yield ("error", now.path, None, None, None, None, None, error)
            for e in files:
                yield self._file(os.path.join(now.path, e.name))
            if self.recursive and place.what == "tree" and (most is None or now.depth < most):
                above = now.above if here is None else (*now.above, here)
                waiting += [Place(os.path.join(now.path, e.name), now.depth + 1, "tree", above) for e in reversed(folders)]


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirrorfold_walk"

    def schema(self):
        return WALK

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)


def walk(spark: SparkSession, roots: list[str], config: EngineConfig | None = None, recursive: bool = True) -> DataFrame:
    """Rows of WALK for all roots: directories, single files (their folder holds them alone) or missing paths."""
    config = config or EngineConfig()
    ship(spark)
    spark.dataSource.register(WalkSource)
    plain = {k: getattr(config, k) for k in ("max_depth", "follow_symlinks", "ignore_hidden", "ignore_globs")}
    return spark.read.format("mirrorfold_walk").option("roots", json.dumps(list(roots))).option("config", json.dumps(plain)).option("recursive", str(recursive).lower()).load()


def files(walked: DataFrame) -> DataFrame:
    """Each file once, however many roots reach it."""
    rows = walked.where("kind = 'file'").select("path", "name", F.col("parent").alias("folder"), "size", "last_modified", "inode")
    return rows.dropDuplicates(["path"])


def folders(walked: DataFrame) -> DataFrame:
    """Each folder once, with the number and size of its direct files."""
    own = files(walked).groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("num_files"), F.sum("size").alias("total_size"))
    rows = walked.where("kind = 'folder'").select("path", "name", F.col("parent").alias("parent_path")).dropDuplicates(["path"])
    return rows.join(own, "path", "left").withColumns({"num_files": F.coalesce("num_files", F.lit(0)), "total_size": F.coalesce("total_size", F.lit(0))})


def errors(walked: DataFrame) -> DataFrame:
    return walked.where("kind = 'error'").select("path", "message")


def count_folders(walked: DataFrame) -> int:
    """Number of different folders, those with ignored names left out."""
    return walked.where("kind = 'folder'").select("path").distinct().count()


def verify(manifest: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``manifest`` with ok: whether the file still has its hash; false where it can't be read."""
    return with_hash(manifest, "full", algorithm, "_now").withColumn("ok", F.coalesce(F.col("_now") == F.col("hash"), F.lit(False))).drop("_now")


def hardlinks(manifest: DataFrame) -> DataFrame:
    """``manifest`` with hardlink_to: the first path of the same inode, null for that one itself."""
    linked = manifest.where("inode IS NOT NULL").groupBy("inode").agg(F.count("*").alias("n_files"), F.min("path").alias("_first")).where("n_files > 1")
    has = spread_join(manifest.where("inode IS NOT NULL"), linked, ["inode"], "left")
    has = has.withColumn("hardlink_to", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("n_files", "_first")
    return has.unionByName(manifest.where("inode IS NULL").withColumn("hardlink_to", F.lit(None).cast("string")))


def read_hash(path: str, algorithm: str, kind: str, size: int = 1024, sample: int = 1 << 20) -> str:
    """Digest of a file, read in pieces: all of it, its head, head-middle-tail, or samples."""
    h = hashlib.blake2b(digest_size=32) if algorithm == "blake2b" else hashlib.new(algorithm)
    with open(path, "rb") as f:
        n = os.fstat(f.fileno()).st_size
        spans = {
            "quick": [(0, size)],
            "partial": [(0, size), (n // 2, size), (n - size, size)] if n > 3 * size else [(0, n)],
            "sampled": sample_positions(n, sample) if n > 3 * sample else [(0, n)],
            "full": [(0, n)],
        }[kind]
        for at, left in spans:
            f.seek(at)
            while left > 0 and (piece := f.read(min(left, BUFFER))):
                h.update(piece)
                left -= len(piece)
    return h.hexdigest()


def with_hash(manifest: DataFrame, kind: str = "full", algorithm: str = "sha256", column: str = "hash", size: int = 1024, sample: int = 1 << 20) -> DataFrame:
    """``manifest`` with the digest of each path's bytes; null where the file can't be read."""
    schema = manifest.select("*", F.lit(None).cast("string").alias(column)).schema

    def one(path: str) -> str | None:
        try:
            return read_hash(path, algorithm, kind, size, sample)
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(p.as_py()) for p in batch.column("path")], pa.string())], names=schema.names)

    return map_arrow(manifest, run, schema)
