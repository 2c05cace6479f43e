"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks, and each block takes a slot. In the ideal flow all sources that
have blocks left are served at the same time, in proportion to their weights. Block i of a source (from 0) is
released at the slot in which that flow begins it and due at the slot by which the flow has ended it; slots go to
the released block of the earliest deadline. So in every prefix of slots a source has had what the flow gives it to
within less than one block: until some source runs out that is its target weight times the slots, and after that
the others share the slots by their weights. The windows follow from whole-number weights by whole-number
arithmetic; nothing is rounded, however long the run is.

One unit of the flow serves each source as many blocks as its weight says. At the ends of units no block is half
done, so units are scheduled each on its own, by different tasks: their cost is linear in the blocks. Weights that
are decimals are taken as exactly these decimals. Weights without a small common denominator make one unit of the
whole run, which one task then schedules as a stream.

Every row comes out once: the schedule orders documents, it does not repeat or drop any. Ranks within a source
come from buckets of a hash, whose sizes are summed first, so that a source that holds most rows is spread over
many tasks.

Results for unusual rows: a null source is a source of its own; a source without a target weight, or with one
that is not positive, gets the smallest weight of the others; ids that are null or repeat are ranked
arbitrarily among themselves, those of one id by one task; texts of any length are carried along
unread; an empty table gives an empty result. Columns of the input that are named like a result (``RESULT``) are
replaced by it in ``scheduled``; ``interleaved`` keeps columns of any names as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import map_arrow
from .common import BROADCAST_BYTES, Scratch, materialized, row_bytes, sized_join

#: Documents in a block, and rows ranked in one bucket.
BLOCK, BUCKET = 64, 400
#: Buckets over all sources: with more rows, buckets grow instead.
BUCKETS = 20_000
#: Columns that ``scheduled`` adds.
RESULT = ["_source", "_rank", "_block", "_slot", "_place"]
BATCH = 1 << 16


def whole_weights(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The smallest whole numbers in the same proportions; a float counts as the decimal that it is written as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


class Flow:
    """The ideal service of sources with numbers of blocks and whole weights, and the schedule that follows it."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.blocks, self.weights = blocks, weights
        # Sources in the order in which they run out, what those before have had, and the weight of the others.
        ends = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
        self.end_blocks, self.end_weights = [blocks[s] for s in ends], [weights[s] for s in ends]
        self.had, self.active = [0], [sum(weights)]
        for n, w in zip(self.end_blocks, self.end_weights, strict=True):
            self.had.append(self.had[-1] + n)
            self.active.append(self.active[-1] - w)
        self.units = max((-(-n // w) for n, w in zip(blocks, weights, strict=True)), default=0)

    def ended(self, i: int, weight: int, lo: int, hi: int) -> int:
        """Sources that have run out when a source of ``weight`` has had ``i`` blocks: a number from lo to hi."""
        while lo < hi:
            mid = (lo + hi) // 2
            if self.end_blocks[mid] * weight <= i * self.end_weights[mid]:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def schedule(self, unit: int) -> Iterator[tuple[int, int, int]]:
        """(slot, source, block) of one unit, in the order of slots."""
        every = len(self.blocks)
        lo, hi = self.ended(unit, 1, 0, every), self.ended(unit + 1, 1, 0, every)
        t = self.had[lo] + self.active[lo] * unit
        waiting: list[tuple] = []
        ready: list[tuple] = []

        def window(release: int, s: int, i: int, p: int) -> tuple[int, int, int, int, int, int]:
            """Release, deadline, source, block, sources run out at its end, release of the next block."""
            w = self.weights[s]
            p = self.ended(i + 1, w, p, hi)
            whole, part = divmod(self.had[p] * w + self.active[p] * (i + 1), w)
            return release, whole + (part > 0), s, i, p, whole

        for s, (n, w) in enumerate(zip(self.blocks, self.weights, strict=True)):
            if w * unit < n:
                waiting.append(window(t, s, w * unit, lo))
        heapq.heapify(waiting)
        while waiting or ready:
            while waiting and waiting[0][0] <= t:
                _, due, s, i, p, after = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, i, p, after))
            due, s, i, p, after = heapq.heappop(ready)
            if due <= t:
                raise AssertionError("a deadline was missed")
            yield t, s, i
            if i + 1 < min(self.blocks[s], self.weights[s] * (unit + 1)):
                heapq.heappush(waiting, window(after, s, i + 1, p))
            t += 1


@dataclass(frozen=True)
class Plan:
    """What the driver knows of a schedule: numbers of documents and blocks by source, and the flow of the blocks."""

    block: int
    counts: dict[str, int]
    flow: Flow

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    @property
    def blocks(self) -> int:
        return self.flow.had[-1]


def plan(docs: DataFrame, weights: Mapping[str, float] | None, source: str, block: int) -> Plan:
    counts = {r["s"]: r["n"] for r in docs.groupBy(_source_name(source).alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()}
    if weights is None:
        whole = {s: max(1, isqrt(n)) for s, n in counts.items()}
    else:
        given = {s: weights[s[1:]] for s in counts if s and s[1:] in weights and weights[s[1:]] > 0}
        least = min(given.values(), default=1)
        whole = whole_weights({s: given.get(s, least) for s in counts})
    return Plan(block, counts, Flow([-(-n // block) for n in counts.values()], list(whole.values())))


def block_slots(docs: DataFrame, p: Plan) -> DataFrame:
    """(_source, _block, _slot) of all blocks, made by tasks that schedule some units each."""
    spark = docs.sparkSession
    names, flow = list(p.counts), p.flow
    tasks = max(1, min(flow.units, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-p.blocks // BATCH)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            t, s, i = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x in s], pa.string()), pa.array(i, pa.int64()), pa.array(t, pa.int64())], names=["_source", "_block", "_slot"])

        rows = []
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                for row in flow.schedule(unit):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield packed(rows)
                        rows = []
        yield packed(rows)

    return map_arrow(spark.range(0, flow.units, 1, tasks), run, "_source string, _block long, _slot long")


def _source_name(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _order(docs: DataFrame) -> F.Column:
    """Place of a row within its source: 60 bits of a hash of its id."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in docs.columns else F.lit("")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _bucketed(rows: DataFrame, p: Plan) -> DataFrame:
    """``rows`` with _bucket: buckets are ranges of the order, so ranks rise from bucket to bucket."""
    per_bucket = max(BUCKET, -(-p.total // BUCKETS))
    # From an Arrow table, for a list of rows would start Python workers of another kind on each executor.
    known = rows.sparkSession.createDataFrame(pa.table({"_source": pa.array(list(p.counts), pa.string()), "_buckets": pa.array([-(-n // per_bucket) for n in p.counts.values()], pa.int64())}))
    if len(p.counts) * row_bytes(known) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    # The upper 31 of 60 bits, scaled to the number of buckets.
    return rows.join(known, "_source").withColumn("_bucket", F.shiftright(F.shiftright("_order", 29) * F.col("_buckets"), 31)).drop("_buckets")


def _placed(rows: DataFrame, p: Plan, scratch: Scratch) -> DataFrame:
    """``rows`` (_source, _bucket, _order and others) with _rank, _block and _slot."""
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # At most BUCKETS rows and one per source.
    offsets = materialized(sizes.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")), "offsets", scratch)
    within = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order")))
    ranked = sized_join(within, offsets, ["_source", "_bucket"], "inner").withColumn("_rank", F.col("_before") + F.col("_rank") - 1).drop("_before")
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / F.lit(p.block)).cast("long"))
    return sized_join(ranked, materialized(block_slots(rows, p), "slots", scratch), ["_source", "_block"], "inner")


def scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with _source, _rank (within it, from 0), _block (from 0), _slot and _place (_slot * block + place in the block).

    Without weights, sources get the whole part of the square root of their number of documents. One row per source
    goes to the driver.
    """
    p = plan(docs, weights, source, block)
    row = F.struct(*(c for c in docs.columns if c not in RESULT)).alias("_row")
    rows = _bucketed(docs.select(row, _source_name(source).alias("_source"), _order(docs).alias("_order")), p)
    out = _placed(rows, p, Scratch(docs.sparkSession))  # the result still reads what it stores
    return out.withColumn("_place", F.col("_slot") * block + F.col("_rank") % block).select("_row.*", *RESULT)


def interleaved(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """The same rows and columns, in the order of the schedule: partitions in order, and rows in order within each.

    The schedule is made on ids and sources alone. It says which range of each bucket belongs to which partition,
    and with that table whole rows are shuffled once, straight to their partition; the slots of a partition's
    blocks travel with them.
    """
    spark = docs.sparkSession
    p = plan(docs, weights, source, block)
    if not p.total:
        return docs
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), p.blocks))
    key = [_source_name(source).alias("_source"), _order(docs).alias("_order")]
    with Scratch(spark) as scratch:
        slim = _placed(_bucketed(docs.select(*key), p), p, scratch)
        part = F.floor(F.col("_slot") * parts / F.lit(p.blocks)).cast("int")
        # Rows of one order can't be told apart here: they stay together.
        slim = slim.withColumn("_part", F.max(part).over(Window.partitionBy("_source", "_bucket", "_order")))
        slim = materialized(slim, "places", scratch)
        ranges = slim.groupBy("_source", "_bucket", "_part").agg(F.min("_order").alias("_lo"))
        until = F.lead("_lo").over(Window.partitionBy("_source", "_bucket").orderBy("_lo"))
        ranges = materialized(ranges.withColumn("_hi", F.coalesce(until, F.lit((1 << 63) - 1))), "ranges")
        marks = slim.groupBy("_source", "_part", "_block").agg(F.min("_slot").alias("_slot"), F.min("_rank").alias("_rank"))
        marks = materialized(marks, "marks")
    rows = _bucketed(docs.select(F.struct(*docs.columns).alias("_row"), *key), p)
    inside = (F.col("_order") >= F.col("_lo")) & ((F.col("_order") < F.col("_hi")) | (F.col("_hi") == (1 << 63) - 1))
    rows = sized_join(rows, ranges, ["_source", "_bucket"], "inner").where(inside)
    none = F.lit(None).cast("long")
    rows = rows.select("_row", "_source", "_part", F.lit(1).alias("_kind"), "_order", none.alias("_rank"), none.alias("_block"), none.alias("_slot"))
    heads = marks.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_source", "_part", F.lit(0).alias("_kind"), none.alias("_order"), "_rank", "_block", "_slot")
    dealt = rows.unionByName(heads).repartitionById(parts, F.col("_part"))
    first = F.min("_rank").over(Window.partitionBy("_part", "_source"))
    within = F.row_number().over(Window.partitionBy("_part", "_source", "_kind").orderBy("_order"))
    ranked = dealt.withColumn("_rank", F.when(F.col("_kind") == 1, first + within - 1).otherwise(F.col("_rank")))
    ranked = ranked.withColumn("_block", F.coalesce("_block", F.floor(F.col("_rank") / F.lit(block)).cast("long")))
    slot = F.last("_slot", ignorenulls=True).over(Window.partitionBy("_part", "_source").orderBy("_block", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranked.withColumn("_slot", slot).where("_kind = 1")
    return placed.sortWithinPartitions("_slot", "_rank").select("_row.*")
