"""Tables on the storage that all executors share: lineage is cut there, and content is read once for many results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders given out and not yet deleted.
_live: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the storage that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its place on
    one machine, and a folder in the warehouse on a cluster, for executors share no local folder.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_mirrorfold"
    if not base:
        base = tempfile.mkdtemp(prefix="mirrorfold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _live.append(path)
    return path


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.exists(target)


def size_of(spark: SparkSession, path: str) -> int:
    target, system = _at(spark, path)
    return system.getContentSummary(target).getLength()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    if path in _live:
        _live.remove(path)
    target, system = _at(spark, path)
    system.delete(target, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators have stored and left, as results still read from them. Those results end with it."""
    while _live:
        removed(spark, _live[-1])


class Scratch:
    """Tables that only serve until the ``with`` block ends; what is read after it must be stored without one, until ``clean``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths.clear()


def materialized(df: DataFrame, purpose: str, scratch: Scratch | None = None) -> DataFrame:
    """The rows written to shared storage and read back: lineage is cut, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, purpose)
    if scratch is not None:
        scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, path: str) -> None:
    """Write a table in the place of a former one, which ``df`` may read from; the former one goes when all is written."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    target, system = _at(spark, path)
    if system.exists(target):
        system.rename(target, _at(spark, old)[0])
    system.rename(_at(spark, new)[0], target)
    removed(spark, old)


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
