"""Quality rules as a learned decision list, applied as ordered Spark conditional expressions.

Sequential covering: a rule is a conjunction of thresholds that says "bad". It grows on two thirds of the
labelled rows by FOIL's information gain, is pruned on the remaining third by dropping final conditions, and
is accepted if it is right for most rows that it covers there; then the rows that it covers are removed and
the next rule is learned. A row that no rule covers is good. The list becomes a chain of F.when, in order, so
each verdict names the rule that gave it.

Results for unusual rows: a null text counts as one without words, which the base rules reject; a very long text
is held whole by one task, with its words; of conditions with equal gain the first in order of the features is
taken; without both kinds of labels the list is empty and only the base rules reject; repeated rows get repeated
results; an empty table gives an empty result; only ``keep`` and the text are read, so other columns may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from .quality_ranker import MAX_LABELLED, labelled_sample
from .text_features import NAMES, base_counts, features

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.value if self.above else v <= self.value

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.name)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


def _covered(x: np.ndarray, rule: list[Condition], names: list[str]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in rule:
        m &= c.holds(x, names)
    return m


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition with the largest gain: bad rows kept, times the rise in the log share of bad ones."""
    p0, n0 = bad.sum(), len(bad)
    start = np.log2(p0 / n0)
    best: tuple[float, Condition | None] = (1e-9, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, y = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(y)[cut], cut + 1
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / n) - start), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0] * (1 + 1e-9):
                best = (float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def learn(x: np.ndarray, good: np.ndarray, names: list[str], most_rules: int = 12, most_conditions: int = 4, least_right: float = 0.8, seed: int = 11) -> list[list[Condition]]:
    """Rules that say "bad", in order."""
    bad = good == 0
    if not bad.any() or bad.all():
        return []
    rng = np.random.default_rng(seed)
    grows = rng.permutation(len(x)) % 3 > 0
    left = np.ones(len(x), bool)
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        g, t = left & grows, left & ~grows
        if bad[g].sum() < 3 or bad[t].sum() < 1:
            break
        rule: list[Condition] = []
        inside = g.copy()
        while len(rule) < most_conditions and not bad[inside].all():
            _, c = _best(x[inside], bad[inside], names)
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(x, names)

        def worth(r: list[Condition]) -> float:
            m = t & _covered(x, r, names)
            p, n = bad[m].sum(), (~bad[m]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = left & _covered(x, rule, names)
        if not rule or not m.any() or bad[m].mean() < least_right or worth(rule) < 2 * least_right - 1:
            break
        rules.append(rule)
        left &= ~m
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> list[list[Condition]]:
    """Rules from the statistics of at most ``limit`` labelled documents."""
    x, y = labelled_sample(docs, labels, label, limit)
    return learn(x, y, NAMES)


def conditional(rules: list[list[Condition]], prefix: str = "") -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(prefix)
        for c in rule[1:]:
            holds &= c.column(prefix)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep``, the counts of BASE and the features of NAMES, with ``prefix``, per row; no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep])
    for k in BASE:
        schema = schema.add(prefix + k, T.LongType())
    for k in NAMES:
        schema = schema.add(prefix + k, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(BASE))
            more = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
            columns = [pa.array(np.ascontiguousarray(a[:, j])) for a in (base, more) for j in range(a.shape[1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=schema.names)

    return map_arrow(docs.select(*keep, "text"), run, schema)


def judged(docs: DataFrame, rules: list[list[Condition]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base verdict, the rule that rejected, and the verdict per row."""
    stats = with_statistics(docs, keep)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(F.col("base_failed"), F.lit(None).cast("int")).otherwise(conditional(rules)))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("rule", F.lit(0)) == 0))
        .select(*keep, *BASE, "base_failed", "kept", "rule")
    )
