"""Exact top-k against all scores, and the bounds of the mixing schedule."""

import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfold.llm import ball_tree, pfair


def whole(rows):
    out = {}
    vectors = [(i, [math.floor(1024 * float(np.float32(v))) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    for q, y in vectors:
        if q % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, x in vectors if i != q and len(x) == len(y)]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    return out


@pytest.mark.parametrize("shard", [37, 10_000])
def test_top_k_is_exact(spark, shard):
    rng = np.random.default_rng(shard)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(1000, 1300)]  # ties
    rows += [(2000, None), (2010, []), (2020, [1.0, None] * 4), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, [1.0] * 8), (2050, [1.0, 2.0]), (2060, [0.5, -3.0]), (2070, [1.0] * 3), (2081, rows[3][1]), (2081, rows[3][1])]
    df = spark.createDataFrame([(i, x, 7, "clash") for i, x in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = defaultdict(list)
    for r in ball_tree.top_k(ball_tree.integer_vectors(df), F.col("vec_id") % 10 == 0, 10, shard).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = {q: x for q, x in whole(rows).items() if x}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert ball_tree.top_k(ball_tree.integer_vectors(df.where("false")), F.col("vec_id") % 10 == 0).count() == 0


def test_shards_below_the_kth_score_are_skipped(spark):
    rng = np.random.default_rng(4)
    axes = np.eye(16) * 4
    rows = [(i, (axes[i % 16] + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    stats = {}
    got = defaultdict(list)
    for r in ball_tree.top_k(ball_tree.integer_vectors(df), F.col("vec_id") % 10 == 0, 10, 100, stats).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == whole(rows)
    assert stats["queries"] == 320 and len(stats["visits"]) == 3 and sum(stats["visits"]) < 0.4 * stats["queries"] * stats["shards"]


def test_scores_beyond_double_precision():
    big = np.array([[2**40, 3], [2**40, 4], [-(2**40), 5]], dtype=np.int64)
    tree = ball_tree.BallTree(np.array([1, 2, 3]), big)
    assert tree.search(9, np.array([2**20, 1]), 2, -np.inf) == ([2, 1], [2**60 + 4, 2**60 + 3])


def prefixes(blocks, weights, most=None):
    """Checks the bound in all prefixes against a plain simulation of the flow, and returns the order."""
    flow = pfair.Flow(blocks, weights)
    had, ideal, order = [0] * len(blocks), [Fraction(0)] * len(blocks), []
    done = 0
    for unit in range(flow.units):
        for t, s, i in flow.schedule(unit):
            assert t == done and i == had[s]
            done += 1
            had[s] += 1
            order.append(s)
            left = Fraction(1)  # the flow serves one slot, and sources run out within it
            while left:
                live = [x for x in range(len(blocks)) if ideal[x] < blocks[x]]
                rate = sum(weights[x] for x in live)
                step = min(left, *((blocks[x] - ideal[x]) * rate / weights[x] for x in live))
                for x in live:
                    ideal[x] += step * weights[x] / rate
                left -= step
            assert all(abs(h - x) < 1 for h, x in zip(had, ideal, strict=True))
            if done == most:
                return order
    assert had == blocks
    return order


@pytest.mark.parametrize("seed", range(12))
def test_schedule_keeps_within_a_block(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    blocks = [rng.randint(1, 90) for _ in range(n)]
    largest = rng.choice([1, 3, 12, 10**6])
    prefixes(blocks, [rng.randint(1, largest) for _ in range(n)])


@pytest.mark.parametrize("weights", [[1, 2, 4], [99_995, 5], [n**0.5 for n in (3, 50, 977, 12_345, 400_000)], [1, 10**-4, 10**-7]])
def test_long_runs_keep_to_the_target_weights(weights):
    target = [Fraction(str(w)) for w in weights]
    whole = list(pfair.whole_weights(dict(enumerate(weights))).values())
    total = sum(whole)
    flow = pfair.Flow([10**9] * len(weights), whole)
    assert [Fraction(w, total) for w in whole] == [w / sum(target) for w in target]
    had, done = [0] * len(weights), 0
    for t, s, i in itertools.chain.from_iterable(map(flow.schedule, itertools.count())):
        assert t == done and i == had[s]
        had[s] += 1
        done += 1
        assert all(abs(h * total - w * done) < total for h, w in zip(had, whole, strict=True))
        if done == 200_000:
            break


def test_weights_become_whole_numbers():
    assert pfair.whole_weights({"a": 0.1, "b": 0.25, "c": 2}) == {"a": 2, "b": 5, "c": 40}
    with pytest.raises(ValueError):
        pfair.whole_weights({"a": 0})


def test_twenty_thousand_sources(spark):
    import time

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000)).alias("source"))
    began = time.time()
    rows = pfair.scheduled(docs, block=4).collect()
    assert time.time() - began < 90
    assert len(rows) == 60_000 and len({r._place for r in rows}) == 60_000
    slots = {r._slot: (r._source, r._block) for r in rows}
    assert sorted(slots) == list(range(len(set(slots.values()))))
    out = pfair.interleaved(docs, block=4)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 60_000


def test_all_rows_come_out_once_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice(["big"] * 12 + ["x", "y", None]), None if i % 7 else "text", "clash") for i in range(3000)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _slot string").withColumns({"_part": F.lit("clash"), "_row": F.lit(1)})
    got = pfair.scheduled(docs, {"big": 1, "x": 1, "y": 2}, block=10).collect()
    assert {(r._part, r._row) for r in got} == {("clash", 1)}
    assert sorted(map(repr, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(repr, (r[:3] for r in rows)))
    assert len({r._place for r in got}) == len(rows)
    size = Counter(r[1] for r in rows)
    for s, n in size.items():
        assert sorted(r._rank for r in got if r.source == s) == list(range(n))
    order = [r.source for r in sorted(got, key=lambda r: r._place)]
    active = min(size["x"], size["y"] // 2, size["big"], size[None])  # until then every source has blocks
    seen = Counter()
    for n, s in enumerate(order[: 4 * active], 1):
        seen[s] += 1
        assert abs(seen["y"] - n * 0.4) < 2 * 10
    out = pfair.interleaved(docs, {"big": 1, "x": 1, "y": 2}, block=10)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mixed"))
    import pyarrow.parquet as pq

    back = [v for p in sorted((tmp_path / "mixed").glob("part-*")) for v in pq.read_table(p, columns=["source"]).column(0).to_pylist()]
    assert back == order
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    many = docs.unionByName(spark.createDataFrame([(7, "big", "same", "row", "clash", 1)] * 400, docs.schema))  # rows that can't be told apart
    assert sorted(map(repr, pfair.interleaved(many, block=3).collect())) == sorted(map(repr, many.collect()))
    assert pfair.scheduled(docs.where("false")).count() == 0
    assert pfair.interleaved(docs.where("false")).count() == 0


def test_query_ids_that_repeat(spark):
    rows = [(100 * q, [sign * (q + 1), i]) for q in range(20) for i, sign in enumerate((1, -1, 1))] + [(1, [1, 0]), (2, [-1, 0])]
    for order in (rows, rows[::-1]):
        vectors = spark.createDataFrame(order, "vec_id long, x array<long>").coalesce(1)
        got = ball_tree.top_k(vectors, F.col("vec_id") % 100 == 0, k=50).where("vec_id in (1, 2)").collect()
        assert {(r.query_id, r.vec_id, r.score) for r in got} == {(100 * q, v, (q + 1) * (-1 if v == 1 else 1)) for q in range(20) for v in (1, 2)}
