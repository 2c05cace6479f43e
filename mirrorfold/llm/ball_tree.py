"""Exact top-k inner products by branch and bound over a ball tree per shard.

Vectors are dealt to clusters by the nearest of some centres, which come from a bounded sample, and a cluster of
more than ``SHARD`` vectors to shards by a hash of the id, so that no cluster of equal vectors makes a shard large.
Of each cluster the driver knows the centre, the radius and the size. A task builds the ball tree of its shard and
then reads the queries one batch at a time: nothing but a shard and a batch is held. For each query, nodes are
opened in the order of their upper bound <q, centre> + |q| * radius, and the search ends once the bound of the
best open node is below the current k-th score.

The k-th score is shared in rounds: a query first visits a shard of the cluster whose centre fits it best; with the
k-th score found there it goes to the next best clusters, and with the k-th score of both to all others that are
left. A cluster whose bound is below the k-th score is never visited, and the query isn't sent to it. On vectors
without clusters bounds are wide and few shards are skipped; then each query meets each shard, as exactness asks.

Scores are inner products of integers and exact: in double precision where all sums stay below 2^53, else in
Python integers, held to the range of a long. Bounds get a margin for rounding, and only nodes strictly below
the k-th score are left out, so ties by id come out right.

Results for unusual rows: a vector that is null or empty, or holds a null or non-finite component, takes no
part, nor does one whose id is null; vectors meet only vectors of their own length; all rows with the query's id
count as the query's own, and repeated rows of other ids are candidates each; where a query's id repeats with
different vectors, the smallest in order of its components is searched; a query without candidates has no
rows; an empty table gives an empty result; other columns than the two that are named are not read, so they may
have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrow import map_arrow
from .common import Scratch, materialized

SCALE = 1024
#: Vectors in a shard, and in a leaf of its tree.
SHARD, LEAF = 16_384, 128
#: Clusters at most, vectors in the sample that gives their centres, and clusters that a query visits in the second round.
CLUSTERS, SAMPLE, SECOND = 256, 2048, 2
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class BallTree:
    """Balls over the rows of an integer matrix, halved along the direction between two far points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        order = np.arange(len(ids))
        x = rows.astype(np.float64)

        def build(lo: int, hi: int) -> int:
            part = order[lo:hi]
            p = x[part]
            centre = p.mean(0)
            away = np.sqrt(((p - centre) ** 2).sum(1))
            node = len(self.radii)
            self.centres.append(centre)
            self.radii.append(float(away.max()))
            self.spans.append((lo, hi))
            self.children.append(None)
            if hi - lo > leaf:
                a = p[int(away.argmax())]
                b = p[int(((p - a) ** 2).sum(1).argmax())]
                order[lo:hi] = part[np.argsort(p @ (b - a), kind="stable")]
                mid = (lo + hi) // 2
                self.children[node] = (build(lo, mid), build(mid, hi))
            return node

        build(0, len(ids))
        self.ids = ids[order]
        self.rows = x[order]
        self.ints = rows[order]
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)
        self.largest = float(np.abs(self.rows).max(initial=0))

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> tuple[list[int], list[int]]:
        """Ids and scores of the best k rows other than the query's own that score at least ``floor``."""
        q = query.astype(np.float64)
        exact = self.largest * float(np.abs(q).sum()) < EXACT
        bound = self.centre @ q + np.sqrt((q * q).sum()) * self.radius
        bound += 1e-6 + np.abs(bound) * 1e-9 + 1e-9 * np.sqrt((q * q).sum()) * (np.sqrt((self.centre**2).sum(1)) + self.radius)
        open_ = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # score, -id: the smallest is the k-th
        while open_:
            upper, node = heapq.heappop(open_)
            if -upper < floor:
                break
            if (pair := self.children[node]) is not None:
                for c in pair:
                    if bound[c] >= floor:
                        heapq.heappush(open_, (-bound[c], c))
                continue
            lo, hi = self.spans[node]
            if exact:
                score = self.rows[lo:hi] @ q
                take = np.flatnonzero((score >= floor) & (self.ids[lo:hi] != own))
                if len(take) > k:  # beyond the k-th of this leaf only ties matter
                    kth = np.partition(score[take], -k)[-k]
                    take = take[score[take] >= kth]
                found = [(int(s), -int(i)) for s, i in zip(score[take].tolist(), self.ids[lo:hi][take].tolist(), strict=True)]
            else:
                found = []
                for i, r in zip(self.ids[lo:hi].tolist(), self.ints[lo:hi].tolist(), strict=True):
                    s = max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(r, query.tolist(), strict=True))))
                    if i != own:
                        found.append((int(s), -int(i)))
            for x in found:
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
            if len(best) == k:
                floor = max(floor, best[0][0])
        best.sort(reverse=True)
        return [-i for _, i in best], [s for s, _ in best]


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): ids and integer components floor(1024 * x) of the vectors that take part.

    Components are held to the range of a long.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ok).select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE)).cast("array<long>").alias("x"))


def centres(vectors: DataFrame, clusters: int, sample: int = SAMPLE, steps: int = 5) -> dict[int, np.ndarray]:
    """Centres by the length of vectors: means of the nearest of a sample, chosen by a hash of the ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "x").limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.x), []).append(r.x)
    out = {}
    for d, found in by_length.items():
        x = np.array(found, np.float64)
        c = np.unique(x, axis=0)
        c = c[np.random.default_rng(1).permutation(len(c))[: max(1, clusters * len(x) // len(rows))]]
        for _ in range(steps):
            near = nearest(x, c)[0]
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        out[d] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of c, and the distance to it."""
    near, away = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        near[i : i + 1024] = ((c * c).sum(1)[None] - 2 * (part @ c.T)).argmin(1)
        away[i : i + 1024] = np.sqrt(((part - c[near[i : i + 1024]]) ** 2).sum(1))
    return near, away


def by_lengths(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and rows as a matrix, of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        m = np.flatnonzero(lengths == d)
        yield d, m, column.take(pa.array(m)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def clustered(vectors: DataFrame, of: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with cluster (number of the centre among all, or minus the length where the sample has none of it) and away."""
    first = dict(zip(of, np.cumsum([0, *(len(c) for c in of.values())])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d, m, rows in by_lengths(batch.column("x")):
                x = rows.astype(np.float64)
                near, away[m] = nearest(x, of.get(d, np.zeros((1, d))))
                cluster[m] = near + first[d] if d in of else -d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(away)], names=["vec_id", "x", "cluster", "away"])

    return map_arrow(vectors.select("vec_id", "x"), run, "vec_id long, x array<long>, cluster long, away double")


class Routes:
    """Which shards a query visits in which round."""

    def __init__(self, of: dict[int, np.ndarray], sizes: dict[int, tuple[int, float]], shard_rows: int):
        self.centre, self.radius, self.shards = {}, {}, {}
        at = 0
        for d, c in of.items():
            known = [j for j in range(len(c)) if at + j in sizes]
            self.centre[d] = (np.array([at + j for j in known], np.int64), c[known])
            at += len(c)
        for cluster in sizes:
            if cluster < 0:
                self.centre[-cluster] = (np.array([cluster]), np.zeros((1, -cluster)))
        for cluster, (n, radius) in sizes.items():
            self.radius[cluster], self.shards[cluster] = radius, -(-n // shard_rows)

    def visits(self, own: int, q: np.ndarray, floors: list[float]) -> list[tuple[int, int]]:
        """(cluster, shard in it) of the round that follows those which gave ``floors``."""
        if len(q) not in self.centre:
            return []
        names, c = self.centre[len(q)]
        q = q.astype(np.float64)
        fit, norm = c @ q, np.sqrt((q * q).sum())
        radius = np.array([self.radius[x] for x in names.tolist()])
        bound = fit + norm * radius
        bound += 1e-6 + np.abs(bound) * 1e-9 + 1e-9 * norm * (np.sqrt((c * c).sum(1)) + radius)
        order = np.argsort(-fit, kind="stable")
        home = int(names[order[0]])
        first = (home, own % self.shards[home])
        if not floors:
            return [first]
        second = self._all(names[order[: SECOND + 1]][bound[order[: SECOND + 1]] >= floors[0]], first)
        if len(floors) == 1:
            return second
        done = {first, *second}
        return [x for x in self._all(names[bound >= floors[1]], first) if x not in done]

    def _all(self, clusters: np.ndarray, but: tuple[int, int]) -> list[tuple[int, int]]:
        return [x for c in clusters.tolist() for x in ((c, s) for s in range(self.shards[c])) if x != but]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD, stats: dict | None = None) -> DataFrame:
    """For integer vectors (vec_id, x) and the rows among them that are queries: (query_id, rank, vec_id, score).

    ``stats`` gets, if given, the number of shards, of queries, and of visits in each round.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        v = materialized(vectors, "vectors", scratch)
        of = centres(v, min(CLUSTERS, max(1, -(-v.count() // shard_rows))))
        dealt = materialized(clustered(v, of), "clusters", scratch)
        sizes = {r.cluster: (r.n, r.radius) for r in dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        routes = Routes(of, sizes, shard_rows)
        known = F.broadcast(spark.createDataFrame(list(routes.shards.items()), "cluster long, shards int"))  # at most CLUSTERS, and a row per other length
        candidates = dealt.join(known, "cluster").select("cluster", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "x", F.lit(None).cast("double").alias("floor"))
        queries = materialized(v.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")), "queries", scratch)
        if stats is not None:
            stats |= {"shards": sum(routes.shards.values()), "queries": queries.count(), "visits": []}
        found, floors = None, []
        for turn in range(1 if sum(routes.shards.values()) == 1 else 2 if len(sizes) <= SECOND + 1 else 3):
            sent = _sent(queries, routes, [f"f{i}" for i in range(turn)])
            if stats is not None:
                stats["visits"].append(sent.count())
            new = _search(candidates, sent, k)
            found = materialized(new if found is None else _best(found.unionByName(new), k).drop("rank"), "found")
            # Fewer than k so far: no score is too low yet.
            kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias(f"f{turn}")).withColumnRenamed("query_id", "vec_id")
            queries = materialized(queries.join(kth, "vec_id", "left").fillna(float("-inf"), [f"f{turn}"]), "queries", scratch)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _sent(queries: DataFrame, routes: Routes, floors: list[str]) -> DataFrame:
    """The queries of a round with the shards that they visit."""
    schema = "cluster long, shard int, kind int, vec_id long, x array<long>, floor double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own, known = part.column("vec_id").to_pylist(), [part.column(f).to_pylist() for f in floors]
                rows = [(c, s, j) for j, x in enumerate(part.column("x")) for c, s in routes.visits(own[j], np.array(x.as_py()), [f[j] for f in known])]
                c, s, j = (np.array(y, np.int64) for y in (zip(*rows, strict=True) if rows else ((), (), ())))
                last = np.array(known[-1], np.float64)[j] if floors else np.full(len(j), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s.astype(np.int32)), pa.array(np.ones(len(j), np.int32)), part.column("vec_id").take(pa.array(j)), part.column("x").take(pa.array(j)), pa.array(last)], names=["cluster", "shard", "kind", "vec_id", "x", "floor"])

    return map_arrow(queries.select("vec_id", "x", *floors), run, schema)


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of every shard for the queries sent to it. A shard's vectors come before its queries."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.unionByName(queries).repartition(n, "cluster", "shard").sortWithinPartitions("cluster", "shard", "kind")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trees = None, {}, {}

        def built(length: int) -> BallTree | None:
            if length not in trees:
                parts = held.pop(length, None)
                trees[length] = None if parts is None else BallTree(np.concatenate([i for i, _ in parts]), np.vstack([r for _, r in parts]))
            return trees[length]

        for batch in batches:
            cluster, shard, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "shard", "kind"))
            cut = np.flatnonzero((cluster[1:] != cluster[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            q_out, i_out, s_out = [], [], []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if (at := (cluster[lo], shard[lo])) != now:
                    now, held, trees = at, {}, {}
                part = batch.slice(lo, hi - lo)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                floors = part.column("floor").to_pylist()
                for d, m, rows in by_lengths(part.column("x")):
                    if kind[lo] == 0:
                        held.setdefault(d, []).append((ids[m], rows))
                        continue
                    if (tree := built(d)) is None:
                        continue
                    for j, row in zip(m.tolist(), rows, strict=True):
                        floor = -np.inf if floors[j] is None else floors[j]
                        found, score = tree.search(int(ids[j]), row, k, floor)
                        q_out += [int(ids[j])] * len(found)
                        i_out += found
                        s_out += score
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_out, i_out, s_out)], names=["query_id", "vec_id", "score"])

    return map_arrow(dealt, run, schema)
