"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping with a partial minimum and a join that adaptive execution can split, and its result
goes to shared storage, so neither a hot node nor a lost executor matters and the plan stays short. The number
of steps grows with the logarithm of the number of nodes in a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialized, sized_join


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, most_steps: int = 60) -> DataFrame:
    """For edges (u, v) of one orderable type: (node, root) with the smallest node of its component, stored in ``scratch``.

    Only nodes with an edge to another node appear. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    former = Scratch(spark)
    e = materialized(e, "edges", former)
    before = _digest(e)
    for _ in range(most_steps):
        kept = Scratch(spark)
        with Scratch(spark) as step:
            # Large star: every larger neighbour of a node is joined to the smallest in the node's neighbourhood.
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", step)
            large = sized_join(both.where("v > u"), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # Small star: a node and its smaller neighbours are joined to the smallest of them.
            large = materialized(large, "large-star", step)
            least = materialized(large.groupBy("u").agg(F.min("v").alias("m")), "least", step)
            small = sized_join(large, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            e = materialized(small, "small-star", kept)
        former.__exit__()
        former = kept
        after = _digest(e)
        if after == before:
            scratch.paths += kept.paths
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
