"""Repeated passages by suffix arrays: bytes covered by a string of ``LENGTH`` bytes that starts elsewhere too.

1. Candidates. Each window of LENGTH bytes names as its anchor the least hash among the byte runs of length
   ``GRAM`` in it. Equal windows name the same run at the same place, so windows only need to be compared with
   windows of an equal anchor. The windows of one anchor are consecutive; the bytes that they cover are its
   context. On ordinary text a context has some 260 bytes and covers some 60 windows.
2. Contexts that are equal altogether are counted, with partial sums before the shuffle: all their windows
   repeat. So a group of copies, however large, goes no further.
3. The distinct contexts of an anchor go to shards. A shard's suffix array is built by Larsson and Sadakane's
   refinement, its common prefixes follow by Kasai's rule, and runs of common prefixes of LENGTH or more are
   the windows that repeat. Where a task's rows fill more than one shard, the windows of an anchor that was cut
   in two are merged by binary search in the sorted windows of the earlier shard.
4. An anchor with more than ``HOT`` distinct contexts is split, not sent to one task: of its windows, those with
   the anchor in the right half share more bytes to the left of it, the others more to the right of it, so the
   contexts are grouped anew by those bytes, and so on until groups are small. What is equal in all windows of a
   group is counted there and goes on once. A common line thus falls apart into its neighbourhoods in eight
   steps at most, for in a group of one window all are equal.

Every decision is on the input, whole texts, at any size; nothing is dropped or capped. Runs of equal contexts in a
periodic text make one row, and spans are merged before those of a text come together.

Results for unusual rows: a null text counts as empty; texts shorter than LENGTH lose nothing; rows that repeat
are each elsewhere for the other, also with equal or null ids; a very long text is held whole by one task and read
in portions; an empty table gives an empty result; of the input's columns only ``keep``, the id and the text are
read, so others may have any names, and ``keep`` travels in a struct.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrow import map_arrow
from .common import Scratch, materialized, salted_join, sized_join

LENGTH, GRAM = 200, 64
#: Distinct contexts of an anchor that go to one task at most.
HOT = 256
#: Bytes in one suffix array, bytes of a text that are hashed at once, and contexts that are cut out at once.
SHARD, CHUNK, STEP = 1 << 20, 1 << 20, 20_000
NO_ID = -(1 << 63)

_MIX = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    s = 1
    while s * 2 <= width:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes (a power of two), by doubling."""
    h = _MIX[raw]
    s, p = 1, _ODD
    while s < gram:
        h = h[:-s] * np.uint64(p) + h[s:]
        p = p * p % (1 << 64)
        s *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(raw, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """First window, number of windows, place of the anchor after the first window's start, hash, and repetitions, per anchor, in portions.

    Where a text is periodic, consecutive anchors with equal hashes and equal contexts make one row: it stands for
    ``repetitions`` of them, each as many windows after the one before as each of them has. So a long run of one
    byte is a few rows. A portion holds what ``chunk`` windows name; the last anchor goes on into the next.
    """
    width = length - gram + 1
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - length + 1  # windows
    low = np.uint64(0xFFFFFFFF)
    held: tuple[int, int, int] | None = None  # first window, place and hash of the anchor that may go on
    for at in range(0, n, chunk):
        end = min(n, at + chunk)
        part = data[at : end + length - 1]
        h = gram_hashes(part, gram)
        # High bits decide; of equal ones the rightmost place.
        keys = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        pos = (low - (_sliding(keys, width) & low)).astype(np.int64)
        lo = np.r_[0, np.flatnonzero(pos[1:] != pos[:-1]) + 1]
        place, key = pos[lo] + at, h[pos[lo]].view(np.int64)
        lo = lo + at
        if held is not None:
            if place[0] == held[1]:
                lo[0] = held[0]
            else:
                lo, place, key = np.r_[held[0], lo], np.r_[held[1], place], np.r_[held[2], key]
        if end < n:
            held = int(lo[-1]), int(place[-1]), int(key[-1])
            wins = np.diff(lo)
            lo, place, key = lo[:-1], place[:-1], key[:-1]
        else:
            wins = np.diff(np.r_[lo, n])
        if len(lo):
            yield _run_lengths(data, lo, wins, place - lo, key, length)


def _run_lengths(data: np.ndarray, lo: np.ndarray, wins: np.ndarray, off: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The rows with runs of equal ones, as ``anchors`` describes, put into one each."""
    same = np.r_[False, (key[1:] == key[:-1]) & (wins[1:] == wins[:-1]) & (off[1:] == off[:-1])]
    for w in np.unique(wins[same]).tolist():
        # A context equals the one before if the text has period w from the start of that to its own end.
        rows = np.flatnonzero(same & (wins == w))
        first, last = int(lo[rows[0]]) - w, int(lo[rows[-1]]) + w - 1 + length
        odd = np.r_[0, np.cumsum(data[first + w : last] != data[first : last - w])]
        at = lo[rows] - w - first
        same[rows] = odd[at + w - 1 + length] == odd[at]
    head = np.flatnonzero(~same)
    return lo[head], wins[head], off[head], key[head], np.diff(np.r_[head, len(lo)])


def suffix_array(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over all contexts, in which a context's end is less than any byte and differs from all other
    ends; common prefixes of neighbours in it (of the entry and the one before); and the contexts' starts.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), starts
    text = np.frombuffer(b"".join(contexts) + bytes(16), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    # The first seven symbols, nine bits each.
    keys = np.zeros(n, np.int64)
    for j in range(7):
        keys = (keys << 9) | np.where(left > j, text[j : n + j].astype(np.int64) + 1, 0)
    sa = np.argsort(keys)
    keys = keys[sa]
    head = np.r_[True, keys[1:] != keys[:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
    h, wide = 7, n + len(contexts) + 1
    slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(slots):
        sub = sa[slots]
        group = rank[sub]
        second = np.where(left[sub] > h, rank[np.minimum(sub + h, n - 1)], -owner[sub] - 1) + len(contexts)
        key = group * wide + second
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[slots] = sub
        head = np.r_[True, key[1:] != key[:-1]]
        rank[sub] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.r_[head[1:], True])]
        h *= 2
    # Kasai: from one suffix to the next of its context the common prefix shrinks by one at most. All contexts
    # take this step at the same time.
    packed = np.lib.stride_tricks.sliding_window_view(text, 8)[: n + 8]
    packed = np.ascontiguousarray(packed).view("<u8").ravel()
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    common = np.zeros(n, np.int64)
    h = np.zeros(len(contexts), np.int64)
    for t in range(int(sizes.max())):
        live = np.flatnonzero(sizes > t)
        i = starts[live] + t
        j = before[i]
        ok = j >= 0
        got = np.zeros(len(live), np.int64)
        a, b = i[ok], j[ok]
        most = np.minimum(left[a], left[b])
        have = np.minimum(np.maximum(h[live[ok]] - 1, 0), most)
        go = np.flatnonzero(have < most)
        while len(go):
            x = packed[a[go] + have[go]] ^ packed[b[go] + have[go]]
            step = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            have[go] = np.minimum(have[go] + step, most[go])
            go = go[(step == 8) & (have[go] < most[go])]
        got[ok] = have
        h[live] = got
        common[i] = got
    return sa, common[sa], starts


def repeated(contexts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of the first ``windows`` window starts of each context, in order: whether an equal one is among the others;
    and for each the number of its class.
    """
    sa, common, starts = suffix_array(contexts)
    first = np.r_[0, np.cumsum(windows)[:-1]]
    total = int(windows.sum())
    inside = np.full(len(sa), -1)
    inside[np.repeat(starts - first, windows) + np.arange(total)] = np.arange(total)
    classes = np.cumsum(common < length)
    which = inside[sa]
    held = which >= 0
    of = np.zeros(total, np.int64)
    of[which[held]] = classes[held]
    return np.bincount(of)[of] > 1, of


def _spans(dup: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes that the marked windows cover, from the first window on."""
    edge = np.flatnonzero(np.diff(np.r_[0, dup.astype(np.int8), 0]))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


class _Shards:
    """Contexts of a task, one shard at a time. Rows of a group follow one another."""

    def __init__(self, length: int, size: int):
        self.length, self.size = length, size
        self.rows: list[tuple] = []
        self.held = 0
        self.cut_group = None
        self.cut: list[tuple[bytes, tuple]] = []  # windows of the cut group in order, with whose they are

    def add(self, row: tuple) -> list[tuple]:
        """row: group, context, windows, copies, kd, kt, lo."""
        self.rows.append(row)
        self.held += len(row[1])
        return self.flush() if self.held >= self.size else []

    def flush(self, final: bool = False) -> list[tuple]:
        rows, self.rows, self.held = self.rows, [], 0
        out: list[tuple] = []
        if not rows:
            return out
        windows = np.fromiter((r[2] for r in rows), np.int64, len(rows))
        dup, of = repeated([r[1] for r in rows], windows, self.length)
        first = np.r_[0, np.cumsum(windows)]
        n = self.length
        if self.cut and rows[0][0] == self.cut_group:
            # Merge with the earlier shard: search each class once in its sorted windows.
            told: dict[int, bool] = {}
            for k, r in enumerate(rows):
                if r[0] != self.cut_group:
                    break
                for w in range(r[2]):
                    c = int(of[first[k] + w])
                    if c not in told:
                        x = r[1][w : w + n]
                        at = bisect_left(self.cut, x, key=lambda e: e[0])
                        told[c] = at < len(self.cut) and self.cut[at][0] == x
                        while at < len(self.cut) and self.cut[at][0] == x:
                            kd, kt, s = self.cut[at][1]
                            out.append((kd, kt, s, s + n))
                            at += 1
                    dup[first[k] + w] |= told[c]
        for k, r in enumerate(rows):
            if r[3] == 1:
                out += [(r[4], r[5], r[6] + a, r[6] + b) for a, b in _spans(dup[first[k] : first[k + 1]], n)]
        last = rows[-1][0]
        keep = self.cut if last == self.cut_group and rows[0][0] == last else []
        if final:
            self.cut = []
        else:
            keep = keep + [(r[1][w : w + n], (r[4], r[5], r[6] + w)) for r in rows if r[0] == last for w in range(r[2])]
            self.cut, self.cut_group = sorted(keep), last
        return out


def _key() -> list[F.Column]:
    """Rows that agree in kd and kt are the same text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kd"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(7)).alias("kt")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _bytes(text: pa.StringScalar) -> memoryview:
    """UTF-8 bytes of a text, not copied."""
    return memoryview(text.as_buffer())


def _found_anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(kd, kt, lo, wins, off, a, reps, c) per anchor; c is the hash of its context."""
    names = ["kd", "kt", "lo", "wins", "off", "a", "reps", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            kd, kt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kd", "kt"))
            parts: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for row, text in enumerate(batch.column("text")):
                raw = _bytes(text)
                for lo, wins, off, a, reps in anchors(raw, length, gram):
                    c = np.fromiter((digest(raw[s:e]) for s, e in zip(lo.tolist(), (lo + wins - 1 + length).tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)
                    for p, x in zip(parts, (np.full(len(lo), kd[row]), np.full(len(lo), kt[row]), lo, wins, off, a, reps, c), strict=True):
                        p.append(x)
                    held += len(lo)
                    if held > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)
                        parts, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)

    return map_arrow(keyed, run, ", ".join(f"{c} long" for c in names))


def _contexts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted contexts: (a, many, n, kd, kt, lo, wins, off, ctx)."""
    per_text = wanted.groupBy("kd", "kt").agg(F.collect_list(F.struct("a", "many", "n", "lo", "wins", "off")).alias("want"))
    rows = keyed.join(per_text, ["kd", "kt"])
    names = ["a", "many", "n", "kd", "kt", "lo", "wins", "off", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kd, kt, text, want in zip(*(batch.column(c) for c in ("kd", "kt", "text", "want")), strict=True):
                raw = _bytes(text)
                for at in range(0, len(want.values), STEP):
                    some = want.values.slice(at, STEP)
                    fields = {c: some.field(c) for c in ("a", "many", "n", "lo", "wins", "off")}
                    lo, wins = (fields[c].to_numpy(zero_copy_only=False) for c in ("lo", "wins"))
                    ctx = pa.array([bytes(raw[s:e]) for s, e in zip(lo.tolist(), (lo + wins - 1 + length).tolist(), strict=True)], pa.binary())
                    fields |= {"kd": pa.repeat(kd, len(lo)), "kt": pa.repeat(kt, len(lo)), "ctx": ctx}
                    yield pa.RecordBatch.from_arrays([fields[c] for c in names], names=names)

    return map_arrow(rows, run, "a long, many boolean, n long, kd long, kt long, lo long, wins long, off long, ctx binary")


def _split_hot(hot: DataFrame, length: int, gram: int, limit: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Small groups (g, ctx, wins, n, kd, kt, lo) and repeated windows (kd, kt, s, e) of the hot anchors.

    A group holds windows with the anchor ``oa`` to ``ob`` bytes after their start, which share the bytes from
    oa before the anchor to length - ob after its start. Contexts whose windows in a group are the same
    altogether repeat, and one of them goes on for all, so what many share goes no further down.
    """
    small, whole = [], []
    row = ["ctx", "wins", "n", "kd", "kt", "lo", "off", "oa", "ob", "fa", "fb"]
    level = hot.withColumns({"oa": F.lit(0), "ob": F.lit(length - gram)})
    while True:
        shared = F.substring("ctx", F.col("off") - F.col("oa") + 1, F.lit(length) - F.col("ob") + F.col("oa"))
        first, last = F.greatest(F.col("off") - F.col("ob"), F.lit(0)), F.least(F.col("off") - F.col("oa"), F.col("wins") - 1)
        own = F.substring("ctx", F.col("fa") + 1, F.col("fb") - F.col("fa") + length)
        level = level.withColumns({"fa": first, "fb": last}).withColumns({"g": F.concat_ws(":", F.md5(shared), "oa", "ob"), "own": F.concat_ws(":", F.md5(own), F.col("off") - F.col("fa"))})
        level = materialized(level.select("g", "own", *row), "hot-contexts", scratch)
        same = level.groupBy("g", "own").agg(F.count("*").alias("k"), F.first(F.struct(*row)).alias("r"))
        same = materialized(same.select("g", "own", "k", *(f"r.{c}" for c in row)).withColumn("n", F.when(F.col("k") > 1, F.lit(2)).otherwise(F.col("n"))), "hot-classes", scratch)
        again = level.where("n = 1").join(same.where("k > 1").select("g", "own"), ["g", "own"], "left_semi")
        whole.append(again.select("kd", "kt", (F.col("lo") + F.col("fa")).alias("s"), (F.col("lo") + F.col("fb") + length).alias("e")))
        sizes = same.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
        sized = materialized(sized_join(same, materialized(sizes, "hot-sizes", scratch), ["g"], "inner").drop("own", "k"), "hot-groups", scratch)
        fits = sized.where(F.col("m") <= limit)
        small.append(fits.select("g", own.alias("ctx"), (F.col("fb") - F.col("fa") + 1).alias("wins"), "n", "kd", "kt", (F.col("lo") + F.col("fa")).alias("lo")))
        rest = sized.where(F.col("m") > limit).drop("g", "m", "fa", "fb")
        if rest.isEmpty():
            return small, whole
        mid = F.floor((F.col("oa") + F.col("ob")) / 2).cast("int")
        left = rest.withColumn("oa", mid + 1).where(F.col("off") >= F.col("oa"))
        right = rest.withColumn("ob", mid).where(F.col("off") - F.col("wins") + 1 <= F.col("ob"))
        level = left.unionByName(right)


def _by_suffix_arrays(groups: DataFrame, length: int, shard: int) -> DataFrame:
    """(kd, kt, s, e): bytes of repeated windows, from rows (g, ctx, wins, n, kd, kt, lo)."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, "g").sortWithinPartitions("g")
    columns = ["g", "ctx", "wins", "n", "kd", "kt", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(length, shard)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 4)], names=["kd", "kt", "s", "e"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                out += shards.add(row)
            yield packed(out)
        yield packed(shards.flush(final=True))

    return map_arrow(dealt.select(*columns), run, "kd long, kt long, s long, e long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(kd, kt, spans): for each text with repeated windows, the maximal runs of bytes that they cover, in order."""
    keyed = _keyed(docs)
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as early:
            found = materialized(_found_anchors(keyed, length, gram), "anchors", early)
            twice = materialized(found.groupBy("a").agg(F.sum("reps").alias("k")).where("k > 1"), "repeated-grams", early)
            shared = materialized(salted_join(found, twice, ["a"], "left_semi", "k", "lo"), "shared-anchors", scratch)
        place = F.min(F.struct("kd", "kt", "lo", "wins", "off")).alias("p")
        contexts = materialized(shared.groupBy("a", "c").agg(F.sum("reps").alias("n"), place), "contexts", scratch)
        several = materialized(contexts.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several-contexts", scratch)
        compared = salted_join(contexts, several, ["a"], "inner", "m", "c").select("a", (F.col("m") > hot).alias("many"), "n", "p.*")
        bytes_ = materialized(_contexts(keyed, compared, length), "context-bytes", scratch)
        small, whole = [bytes_.where("NOT many").select(F.col("a").cast("string").alias("g"), "ctx", "wins", "n", "kd", "kt", "lo")], []
        many = bytes_.where("many")
        if not many.isEmpty():
            more, whole = _split_hot(many.drop("a", "many"), length, gram, hot, scratch)
            small += more
        groups = small[0]
        for x in small[1:]:
            groups = groups.unionByName(x)
        again = materialized(contexts.where("n > 1").select("a", "c", "n"), "equal-contexts", scratch)
        equal = salted_join(shared, again, ["a", "c"], "left_semi", "n", "lo")
        out = equal.select("kd", "kt", F.col("lo").alias("s"), (F.col("lo") + F.col("reps") * F.col("wins") - 1 + length).alias("e"))
        for x in [_by_suffix_arrays(groups, length, shard), *whole]:
            out = out.unionByName(x)
        return materialized(merged(out).groupBy("kd", "kt").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")


def merged(spans: DataFrame) -> DataFrame:
    """(kd, kt, s, e): the maximal runs that the spans (kd, kt, s, e) of a text cover; spans that touch make one."""
    by_start = Window.partitionBy("kd", "kt").orderBy("s")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.when(F.col("s") <= before, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("kd", "kt", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def kept_parts(raw, starts: list[int], ends: list[int]) -> bytes:
    """The bytes outside the disjoint spans, which come in order."""
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, **options) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, kept_sha256 per row, and the remaining bytes if asked for."""
    spans = repeated_spans(docs, length, **options)
    packed = docs.select(F.struct(*keep).alias("_row"), *_key(), F.coalesce("text", F.lit("")).alias("_t"))
    joined = packed.join(spans, ["kd", "kt"], "left").select("_row.*", "_t", "spans")
    schema = T.StructType([docs.schema[c] for c in keep])
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("kept_sha256", T.StringType())
    if with_text:
        schema = schema.add("kept", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, digests, kept = [], [], [], [], []
            for text, found in zip(batch.column("_t"), batch.column("spans"), strict=True):
                raw = _bytes(text)
                starts, ends = (found.values.field(c).to_pylist() if found.is_valid else [] for c in ("s", "e"))
                out = kept_parts(raw, starts, ends)
                n.append(len(raw))
                removed.append(len(raw) - len(out))
                runs.append(len(starts))
                digests.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out)
            columns = [*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], names=schema.names)

    return map_arrow(joined, run, schema)

