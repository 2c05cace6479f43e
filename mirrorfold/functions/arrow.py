"""Arrow batch functions whose code reaches the executors with the job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of a batch on its way to a worker, by ``bound_batches``; a row that is larger makes a batch of its own.
BATCH_BYTES = 2 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches end at ``BATCH_BYTES``, unless it has a bound of its own.

    By rows alone, a batch of texts takes as much as a task reads: in the buffers of the executor, which keeps them
    for later tasks, and in each worker. Batches of any size give the same results.
    """
    if _BOUND not in spark.conf.getAll:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the running application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # else it came in a zip itself
        folder = os.path.realpath(tempfile.mkdtemp(prefix="mirrorfold-code-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
