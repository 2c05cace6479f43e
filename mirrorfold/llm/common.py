"""What the operators of this package share: tables, shared storage, joins that survive skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch as Scratch
from ..storage import clean as clean
from ..storage import materialized as materialized
from ..storage import shared_dir as shared_dir

#: A side of at most this size is broadcast, as by Spark's own default; beyond it the join is shuffled.
BROADCAST_BYTES = 10 << 20
#: Labelled documents that are sent to look up their texts.
BROADCAST_ROWS = 20_000
#: Keys that are dealt over several tasks, at most.
MOST_HOT = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bytes(df: DataFrame) -> int:
    """Upper estimate of a row's size in a hash relation, for columns of fixed size and for digests."""
    widths = {"boolean": 8, "int": 8, "bigint": 8, "double": 8, "string": 80, "binary": 48}
    return 72 + sum(widths.get(t, 160) for _, t in df.dtypes)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted rows are small, else shuffled with skew splitting.

    ``right`` has one row per key, so adaptive execution can split a hot key of ``left``.
    """
    if right.count() * row_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return shuffled_join(left, right, on, how)


def shuffled_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a stored ``right`` that grows with the corpus, one row per key: never broadcast, hot keys are split."""
    return left.join(right.hint("merge"), on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, count: str, spread: str, salts: int = 64) -> DataFrame:
    """Join with a stored ``right``, one row per key, that has in ``count`` the number of the key's rows in ``left``.

    Keys with more than a ``MOST_HOT``-th part of all those rows are hot; so there are at most ``MOST_HOT`` of them,
    and their list is broadcast. Their rows are dealt over ``salts`` tasks by a hash of ``spread``. ``count`` is
    among the columns of an inner join.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(1000, total // MOST_HOT)
    keys = right.where(hot).select(*on, F.lit(True).alias("_hot"))
    dealt = left.join(F.broadcast(keys), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return shuffled_join(dealt, every, [*on, "_salt"], how).drop("_salt")


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; a null is an empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.encode(column, "UTF-8"), F.lit(b""))


def document_key() -> list[Column]:
    """Columns that name a document even where ids are null or repeat: rows that agree in both are the same text."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")]
