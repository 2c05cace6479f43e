"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's bits are majorities over the hashes of word shingles. Equal fingerprints are merged first, so
copies cost nothing further. Two fingerprints within ``limit`` differing bits are found through the pigeonring
principle: lay the 64 bits on a ring of m = limit + 1 segments; then some segment starts a chain of which the
first l segments together differ in at most l * limit / m bits, for every l. A chain therefore starts with an
equal segment and one bit at most in the first two, which makes two exact keys (the equal segment, and one equal
half of the next). Within a key the longer chain conditions prune what is left before the full comparison.

Results for unusual rows: null and empty texts have fingerprint zero and link like any other; a bit that is set in
exactly half the hashes is 0; a very long text is held whole by one task, with its words; repeated rows share their
component; the smallest id of a component ignores null ids (null if there is no other); an empty table gives an
empty result; only ``keep``, the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from .common import Scratch, materialized, sized_join
from .components import components

SEED, BITS = 42, 64
SHINGLE, LIMIT = 3, 3
#: Fingerprints of a key that are compared at once, and that go to one task.
BLOCK, HOT = 2048, 8192


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles; fewer words than ``width`` make one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = len(words)
    if k <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, k) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: k - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    n = len(hashes)
    total = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, n, 1 << 15):
        part = values[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, width: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint, as a signed long with the same 64 bits, per row."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    columns = dict.fromkeys([*keep, "text"])
    return map_arrow(docs.select(*columns), run, schema)


def segments(limit: int) -> list[tuple[int, int]]:
    """Start and width of each of the limit + 1 segments of the ring."""
    m = limit + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]


def _field(column, start: int, width: int):
    return F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else column


def ring_keys(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (key, start, fp): equal keys hold whatever may start a chain at segment ``start``."""
    parts = segments(limit)
    m = len(parts)
    fp = F.col("fp")
    keys = []
    for i, (at, width) in enumerate(parts):
        if m == 1:
            keys.append(F.struct(F.xxhash64(fp).alias("key"), F.lit(i).alias("start")))
            continue
        nxt, wide = parts[(i + 1) % m]
        half = wide // 2
        # One bit in the first two segments leaves a half of the second equal, if the budget of two is below 2.
        halves = [(nxt, half), (nxt + half, wide - half)] if 2 * limit // m < 2 and wide > 1 else [(0, 0)]
        for h, (a, w) in enumerate(halves):
            extra = _field(fp, a, w) if w else F.lit(0)
            keys.append(F.struct(F.xxhash64(F.lit(i), F.lit(h), _field(fp, at, width), extra).alias("key"), F.lit(i).alias("start")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.start", "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_links(fps: np.ndarray, start: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``limit`` bits among the fingerprints of one key, by blocks, through the chain test."""
    parts = segments(limit)
    m = len(parts)
    masks, mask = [], 0
    for length in range(m):
        at, width = parts[(start + length) % m]
        mask |= ((1 << width) - 1) << at
        masks.append((np.uint64(mask), (length + 1) * limit // m))
    a_all, b_all = [], []
    n = len(fps)
    for i in range(0, n, BLOCK):
        left = fps[i : i + BLOCK]
        for j in range(i, n, BLOCK):
            right = fps[j : j + BLOCK]
            a, b = np.triu_indices(len(left), 1) if i == j else map(np.ravel, np.indices((len(left), len(right))))
            x = left[a] ^ right[b]
            for mask, budget in masks:
                ok = _popcount(x & mask) <= budget
                if not ok.all():
                    a, b, x = a[ok], b[ok], x[ok]
            a_all.append(a + i)
            b_all.append(b + j)
    return np.concatenate(a_all), np.concatenate(b_all)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the index pairs."""
    parent = list(range(n))
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = i, j
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def spread_hot(keyed: DataFrame, hot: int) -> DataFrame:
    """``keyed`` with each key of more than ``hot`` fingerprints split: its fingerprints are dealt to parts, and every
    two parts meet under a key of their own, so the comparisons of one key are shared among tasks.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    sizes = materialized(sizes, "hot-keys")
    if sizes.isEmpty():
        return keyed
    rows = sized_join(keyed, sizes, ["key"])
    parts = F.ceil(F.col("m") * 2 / F.lit(hot)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.when(F.col("m").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts - 1)))
    met = rows.select("key", "start", "fp", mine.alias("mine"), other.alias("other"))
    split = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return met.select(F.when(F.col("other") < 0, F.col("key")).otherwise(split).alias("key"), "start", "fp")


def links(fps: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(u, v): enough links between distinct fingerprints to connect all that are within ``limit`` bits.

    Rows of a key come together by one shuffle on it and are read in order, a key at a time.
    """
    keyed = spread_hot(ring_keys(fps, limit), hot)
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "start", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def of(key, start, fp, final):
            """Links of all keys that are complete; the last one may go on in the next batch."""
            if not len(key):
                return [], [np.zeros(0, np.int64)] * 3
            cut = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1
            edges = np.r_[0, cut, len(key)]
            if not final:
                edges = edges[:-1]
            out = []
            size = np.diff(edges)
            for g in np.flatnonzero(size > 1):
                lo, hi = edges[g], edges[g + 1]
                f = fp[lo:hi].view(np.uint64)
                a, b = chain_links(f, int(start[lo]), limit)
                if len(a):
                    out += [(int(fp[lo + i]), int(fp[lo + j])) for i, j in spanning(hi - lo, a, b)]
            k = edges[-1]
            return out, [key[k:], start[k:], fp[k:]]

        def batch_of(pairs):
            u, v = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "start", "fp")]
            pairs, rest = of(*(np.concatenate([r, x]) for r, x in zip(rest, new, strict=True)), False)
            yield batch_of(pairs)
        pairs, _ = of(*rest, True)
        yield batch_of(pairs)

    return map_arrow(dealt, run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fp and component_id per row: the smallest doc_id that links of at most ``limit`` bits reach."""
    marked = materialized(with_fingerprints(docs, width, tuple(dict.fromkeys(["doc_id", *keep]))), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        fps = materialized(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints", scratch)
        roots = components(links(fps.select("fp"), limit), scratch).withColumnRenamed("node", "fp")
        members = sized_join(fps, roots, ["fp"]).withColumn("root", F.coalesce("root", "fp"))
        of_root = materialized(members.groupBy("root").agg(F.min("least").alias("component_id")), "roots", scratch)
        named = materialized(sized_join(members, of_root, ["root"], "inner").select("fp", "component_id"), "components")
    return sized_join(marked, named, ["fp"]).select(*keep, "fp", "component_id")


def hexadecimal(column) -> F.Column:
    """16 lower-case digits of the 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
