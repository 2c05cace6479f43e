"""Quality scores learned from preferences: a Bradley-Terry model on differences of features.

Labels say which documents are good (1) and which are not (0); a good one is preferred to a bad one. The
model gives each document a strength w.x, and the chance that one document is preferred to another is the
logistic function of the difference of their strengths. Fitting minimises the logistic loss on the feature
differences of all pairs of a good and a bad document among all that are labelled. The threshold is a quantile of
the strengths of all labelled documents: that of the share of bad ones among them, moved into the widest gap near
it. A score in 0..1 is the logistic function of the distance to it, so that ``cut`` is the score at the quantile.

The pairs are never made. A pair counts by the difference of two strengths, through a function that polynomials
of degree ``NODES`` - 1 on cells of width ``SPAN`` give to some ten digits; so each document is dealt to the nodes
of its cell, with its features and their products, and the sums at the nodes give loss, gradient and Hessian of
all pairs. Each Newton step is one pass over the stored features; tasks send sums, whose size depends on the range
of the strengths only. The threshold comes from ranks counted over ranges of the strengths. Results are rounded,
so that the order of sums does not show in them.

Results for unusual rows: null and empty texts are scored as texts without words; a very long text is held whole
by one task, with its words; a document whose id is null is not held out; repeated rows get repeated scores, and
of rows that repeat a labelled id one is learned from; a column of the input that is named like the score is
replaced by it, and others may have any names; an empty table gives an empty result. Without two kinds of labels,
every score is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrow import map_arrow
from .common import BROADCAST_ROWS, Scratch, materialized, shuffled_join
from .text_features import NAMES, features

#: Score at which a document counts as good.
CUT = 0.3
#: At most so many labelled documents are in a sample, which the ranker itself doesn't use.
MAX_LABELLED = 12_000
RIDGE = 1e-3
#: Chebyshev nodes of a cell, and its width in units of strength.
NODES, SPAN = 20, 4.0
#: Tasks of a pass over the labelled documents: so many sums meet in the driver.
TASKS = 16
#: Values of standardised features are cut there.
FAR = 8
_COSINES = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: Turns Chebyshev polynomials at a place into the weights of the nodes there.
_WEIGHTS = np.polynomial.chebyshev.chebvander(_COSINES, NODES - 1).T * np.r_[1.0, np.full(NODES - 1, 2.0)][:, None] / NODES


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features, the strength at the threshold, and the width of the logistic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float
    cut: float = CUT

    def strength(self, x: np.ndarray) -> np.ndarray:
        # Each row by itself, so that its strength does not depend on the batch.
        return (np.clip((x - self.mean) / self.scale, -FAR, FAR) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.threshold) / self.width + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def nothing_learned() -> Ranker:
    zero = np.zeros(len(NAMES))
    return Ranker(zero, zero + 1, zero, -1e6, 1.0)


def differences(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, ...]:
    """Mean and scale of the features, both kinds standardised, and the feature differences of random pairs."""
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    rng = np.random.default_rng(seed)
    g, b = ((np.clip((x - mean) / scale, -FAR, FAR)) for x in (good, bad))
    return mean, scale, g, b, g[rng.integers(0, len(g), pairs)] - b[rng.integers(0, len(b), pairs)]


def least(measured: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], n: int, most_steps: int = 50) -> np.ndarray:
    """Weights of the least loss by Newton steps, for a function that gives loss, gradient and Hessian."""
    w = np.zeros(n)
    loss, gradient, hessian = measured(w)
    for _ in range(most_steps):
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        before, (loss, gradient, hessian) = loss, measured(w)
        while loss > before + 1e-9 and np.abs(step).max() > 1e-9:  # too far
            step = step / 2
            w = w + step
            loss, gradient, hessian = measured(w)
        if np.abs(step).max() < 1e-6:
            return w
    raise RuntimeError("the fit did not settle")


def node_sums(z: np.ndarray, goal: np.ndarray, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """By kind and cell of the strength: at each node the sums of 1, the features and their products."""
    s = (z * weights).sum(1) / SPAN
    cell = np.floor(s)
    share = np.polynomial.chebyshev.chebvander(2 * (s - cell) - 1, NODES - 1) @ _WEIGHTS
    a, b = np.triu_indices(z.shape[1])
    values = np.hstack([np.ones((len(z), 1)), z, z[:, a] * z[:, b]])
    out = {}
    for key in set(zip(goal.tolist(), cell.astype(int).tolist(), strict=True)):
        rows = (goal == key[0]) & (cell == key[1])
        out[key] = share[rows].T @ values[rows]
    return out


def all_pairs(sums: dict[tuple[int, int], np.ndarray], w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good and a bad document, with its gradient and Hessian, from sums at nodes."""
    d = len(w)
    a, b = np.triu_indices(d)
    at, n, x, xx = {}, {}, {}, {}
    for goal in (0, 1):
        cells = sorted(k[1] for k in sums if k[0] == goal)
        at[goal] = np.concatenate([(c + (_COSINES + 1) / 2) * SPAN for c in cells])
        m = np.vstack([sums[goal, c] for c in cells])
        n[goal], x[goal], xx[goal] = m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :]
    pairs = n[0].sum() * n[1].sum()
    gap = at[0][:, None] - at[1][None, :]  # how much stronger the bad one is
    p = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
    q = p * (1 - p)
    loss = n[0] @ np.logaddexp(0, gap) @ n[1] / pairs + ridge / 2 * float(w @ w)
    gradient = ((p @ n[1]) @ x[0] - (n[0] @ p) @ x[1]) / pairs + ridge * w
    hessian = np.zeros((d, d))
    hessian[a, b] = (q @ n[1]) @ xx[0] + (n[0] @ q) @ xx[1]
    hessian[b, a] = hessian[a, b]
    cross = x[0].T @ q @ x[1]
    return float(loss), gradient, (hessian - cross - cross.T) / pairs + ridge * np.eye(d)


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int | None = None, ridge: float = RIDGE, seed: int = 7) -> Ranker:
    """Fit to features in memory, on all (good, bad) pairs, or on so many random ``pairs`` where a caller asks for them."""
    if not len(good) or not len(bad):
        return nothing_learned()
    mean, scale, g, b, d = differences(good, bad, pairs or 0, seed)

    def of_pairs(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = d @ w
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        return float(np.logaddexp(0, -z).mean() + ridge / 2 * w @ w), -(d * p[:, None]).mean(0) + ridge * w, (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))

    both, goal = np.vstack([g, b]), np.repeat([1, 0], [len(g), len(b)])
    w = least(of_pairs if pairs else lambda w: all_pairs(node_sums(both, goal, w), w, ridge), d.shape[1])
    s = (both * w).sum(1)
    order = np.sort(s)
    window = order[slice(*near_quantile(len(bad), len(s)))]
    k = int(np.argmax(np.diff(window))) if len(window) > 1 else 0
    threshold = float((window[k] + window[min(k + 1, len(window) - 1)]) / 2)
    return Ranker(mean, scale, w, threshold, float(max(s.std() / 4, 1e-6)))


def near_quantile(bad: int, n: int) -> tuple[int, int]:
    """Ranks within two hundredths of the share of bad documents; the threshold is in the widest gap among them."""
    share = bad / n
    return max(0, int((share - 0.02) * n) - 1), max(2, int((share + 0.02) * n) + 1)


def held_out(folds: int = 5) -> F.Column:
    """Rows whose crc32 of the id, as text, leaves no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` documents that are not held out, chosen by a hash of their ids."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("goal")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    assert limit <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "goal", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("goal"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "goal", "x"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("goal", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    one = map_arrow(rows, run, schema).groupBy("doc_id").agg(F.min(F.struct("x", "goal")).alias("r"))  # at most ``limit`` rows
    got = one.select("r.goal", "r.x").toPandas()
    if got.empty:
        return np.zeros((0, len(NAMES))), np.zeros(0, int)
    # The order in which rows arrive must not matter.
    x, y = np.array(got["x"].tolist()), got["goal"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))
    return x[order], y[order]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row: the features of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return map_arrow(docs.select("doc_id", "text"), run, T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def labelled_features(found: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(goal, x) of every labelled document that is not held out, from rows (doc_id, x)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("goal"))
    return shuffled_join(found, known, ["doc_id"], "inner").groupBy("doc_id").agg(F.min(F.struct("x", "goal")).alias("r")).select("r.goal", "r.x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))


def widest_gap(strengths: DataFrame, first: int, last: int, scratch: Scratch) -> float:
    """The middle of the widest gap between neighbours of the sorted column s, among ranks ``first`` to before ``last``."""
    n = int(strengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = strengths.groupBy("s").agg(F.count("*").alias("c")).repartitionByRange(n, "s").withColumn("part", F.spark_partition_id())
    values = materialized(values, "strength-values", scratch)
    parts = values.groupBy("part").agg(F.sum("c").alias("c"), F.min("s").alias("s")).orderBy("part").collect()  # one row for a range
    ranks = np.cumsum([0, *(r.c for r in parts)]).tolist()
    # Only the ranges that hold such ranks are looked into.
    held = [(r.part, before, after.s if after else None) for r, before, end, after in zip(parts, ranks[:-1], ranks[1:], [*parts[1:], None], strict=True) if before < last and end > first]
    offset = F.create_map(*(F.lit(x) for part, before, _ in held for x in (part, before)))
    following = F.create_map(*(x for part, _, after in held for x in (F.lit(part), F.lit(after).cast("double"))))
    inside = Window.partitionBy("part").orderBy("s")
    ranked = values.where(F.col("part").isin([h[0] for h in held])).select(
        "s",
        (offset[F.col("part")] + F.sum("c").over(inside) - 1).alias("rank"),
        F.coalesce(F.lead("s").over(inside), following[F.col("part")]).alias("next"),
    )
    apart = F.when(F.col("rank") + 1 < last, F.col("next") - F.col("s"))  # null where all ranks that follow are equal or outside
    row = ranked.where(F.col("rank") >= first).orderBy(F.coalesce(apart, F.lit(0.0)).desc(), "s").select("s", F.when(apart.isNotNull(), F.col("next")).otherwise(F.col("s")).alias("next")).first()
    return (row.s + row.next) / 2


def fit_features(found: DataFrame, labels: DataFrame, label: str = "quality", ridge: float = RIDGE) -> Ranker:
    """Fit on all labelled documents that are not held out, and all their pairs, from rows (doc_id, x)."""
    with Scratch(found.sparkSession) as scratch:
        learned = materialized(labelled_features(found, labels, label), "learned", scratch)
        d = len(NAMES)
        x = [F.col("x")[i] for i in range(d)]
        row = learned.agg(F.count("*"), F.count(F.when(F.col("goal") == 0, 1)), *map(F.avg, x), *map(F.stddev_pop, x)).first()
        n, bad = row[:2]
        if not bad or bad == n:
            return nothing_learned()
        mean, scale = np.round(row[2 : 2 + d], 10), np.maximum(np.round(row[2 + d :], 10), 1e-6)
        few = learned.coalesce(TASKS)

        def measured(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    z = np.clip((_matrix(batch) - mean) / scale, -FAR, FAR)
                    for key, value in node_sums(z, batch.column("goal").to_numpy(), w).items():
                        sums[key] = sums[key] + value if key in sums else value
                columns = [pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["goal", "cell", "sums"])

            total: dict[tuple[int, int], np.ndarray] = {}
            for r in map_arrow(few, run, "goal int, cell int, sums binary").collect():
                value = np.frombuffer(r.sums).reshape(NODES, -1)
                total[r.goal, r.cell] = total[r.goal, r.cell] + value if (r.goal, r.cell) in total else value
            return all_pairs(total, w, ridge)

        w = np.round(least(measured, d), 6)
        ranker = Ranker(mean, scale, w, 0.0, 1.0)

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(ranker.strength(_matrix(batch)))], names=["s"])

        s = materialized(map_arrow(learned, strengths, "s double"), "strengths", scratch)
        threshold = round(widest_gap(s, *near_quantile(bad, n), scratch), 9)
        width = round(s.agg(F.stddev_pop("s")).first()[0] / 4, 9)
    return Ranker(mean, scale, w, threshold, max(width, 1e-6))


def fit_ranker(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    """Fit on all labelled documents. Features are taken of all rows, so that no text is shuffled."""
    with Scratch(docs.sparkSession) as scratch:
        return fit_features(materialized(with_features(docs), "features", scratch), labels, label)


def score_features(found: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of rows (doc_id, x)."""
    schema = T.StructType([found.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(_matrix(batch)))], names=["doc_id", "score"])

    return map_arrow(found, run, schema)


def score_documents(docs: DataFrame, ranker: Ranker, column: str = "score") -> DataFrame:
    """``docs`` with a score per row, in the place of a column of that name, in one pass without a shuffle."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.score(x))], names=[*batch.schema.names, column])

    return map_arrow(docs, run, schema)
