"""Joins to a table with one row per key where one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is spread over SALTS tasks. There are at most rows / HOT such keys.
HOT, SALTS = 1_000_000, 64
#: A side of at most this size is broadcast, as by Spark's own default.
BROADCAST_BYTES = 10 << 20


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, count: str = "n_files", spread: str = "path", hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and in ``count`` the number of its rows in ``left``.

    Rows of a hot key are dealt by a hash of ``spread``, and that key's row is sent to each of its tasks. The
    list of hot keys is broadcast; its length is bounded by the definition of hot. All other keys join as usual.
    """
    keys = right.where(F.col(count) > hot).select(*on, F.lit(True).alias("_hot"))
    dealt = left.join(F.broadcast(keys), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col(count) > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(every)), [*on, "_salt"], how).drop("_salt")
