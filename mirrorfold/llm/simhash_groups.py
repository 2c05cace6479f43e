"""Groups of near-duplicate documents at a given shingle similarity, by operator 8, pigeonhole keys and exact checks.

Operator 8 comes first, with its own fingerprints, ring of segments, chains within proportional budgets, and
components (``ring_members``): each of its components is a key here, and all pairs inside are open to the exact
check, whatever their other fingerprints. Within ``limit`` bits of 64, that finds copies that differ in a few words
only; a Jaccard similarity of 0.8 on five-word shingles may cost 17 bits. So for what is farther apart, segments
are laid over the shingles beside the fingerprint's bits: a hash deals the shingles of a text to m segments, and
two sets that differ in at most t < m shingles agree altogether in some segment. Single segments that agree are
further keys; no chain is tested there, for a pair with t differences has but one valid start among all m segments.
t follows from the similarity and the size, m = t + 1, some four shingles in a segment. The first ``SEGMENTS`` segments serve as keys: of two texts at exactly the threshold a segment agrees
with a chance of e^-1 or more, so all keys of a pair fail with a chance of about 1e-4, and with less above it.

Texts with a key in common are compared by 128-bit SimHash fingerprints; of the pairs that may be similar enough,
first those with the first member of the key and between neighbours are checked by exact Jaccard similarity. Then
the members of a key that still have such a pair between different components meet with their shingle sets, and
each pair that lies in two components when its turn comes is checked; only edges that join components leave the
task. The components of what holds are the groups. A group of close texts of any size costs a few edges for each
of them; a family of texts just below the threshold costs a check for each pair that the bits allow, but no row.
A key with many members, or heavy ones, is dealt to tasks by parts, so that no task grows with a key.

Results for unusual rows: null and empty texts form one group; texts of fewer than five words are one shingle;
texts that agree in their lower-cased words are one node; rows that repeat are copies, of which one stays; a null
id comes after all others; a very long text is held whole by one task, with its shingles' hashes (some 30 bytes a
word); an empty table gives an empty result; columns of the input may have any names, for they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from . import simhash
from .common import Scratch, materialized, shuffled_join, sized_join
from .components import components

WIDTH, SIMILARITY = 5, 0.8
SEGMENTS = 20
#: Bits of 128 in which a pair at the threshold may differ: the mean of 19.4 and 4 deviations.
BITS = 36
#: Members of a key that are compared at once: so many with so many.
STEP, BLOCK = 256, 8192
#: Members of a key that go to one task.
HOT = 8192
#: Bytes of shingle sets that meet in a task.
BLOCK_BYTES = 16 << 20
#: Sets of up to so many shingles also meet by what is left of them without a few shingles.
SMALL = 14
EMPTY = bytes(16)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def shingle_digests(text: str | None, width: int = WIDTH) -> tuple[bytes, np.ndarray]:
    """Digest of the lower-cased words, and 128-bit digests of all word shingles as pairs of 64 bits."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return EMPTY, np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    k = len(words)
    digest = xxhash.xxh3_128_digest
    if k <= width:
        raw = [digest(joined)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, k) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        raw = [digest(joined[a:b]) for a, b in zip(starts[: k - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return digest(joined, 1), np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_digests(text, width)[1][:, 0])


def rest_keys(spread: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of all subsets that a similar set may have in common with this one; odd, while those of segments are even.

    A set with c of these n shingles in common can be similar only if n - c is at most n (1 - similarity).
    """
    n = len(spread)
    x = _mixed(spread)
    out = []
    for gone in range(int(n * (1 - similarity) + 1e-9) + 1):
        without = np.array(list(combinations(range(n), gone)), np.int64)
        out.append(_mixed(x.sum() - x[without].sum(1, dtype=np.uint64) + np.uint64(n - gone) * np.ones(1, np.uint64) * _ODD))
    return np.concatenate(out) | np.uint64(1)


def ring_keys(shingles: np.ndarray, similarity: float = SIMILARITY, segments: int = SEGMENTS) -> np.ndarray:
    """Keys of the first segments of the rings for the set's size class and the next: similar sets share a ring.

    A small set has few segments, and an empty one gives no key: up to ``SMALL``, ``rest_keys`` are added.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    step = np.log(1 / similarity)
    k = int(np.floor(np.log(n) / step + 1e-9))
    spread = _mixed(shingles)
    out = [rest_keys(spread, similarity)] if n <= SMALL else []
    for ring in (k, k + 1):
        largest = np.exp(step * (ring + 1))
        m = int(2 * largest * (1 - similarity) / (1 + similarity)) + 1
        segment = (spread >> np.uint64(20)) % np.uint64(m)
        inside = segment < segments
        s, x = segment[inside].astype(np.int64), spread[inside]
        if not len(s):
            continue
        order = np.argsort(s, kind="stable")
        s, x = s[order], x[order]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total = np.add.reduceat(_mixed(x), head)
        out.append(_mixed(total + s[head].astype(np.uint64) * _ODD + np.uint64(ring * int(_MIX) % (1 << 64))) & ~np.uint64(1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketch(text: str | None, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[bytes, int, int, np.ndarray]:
    """Node, the two halves of the 128-bit fingerprint, and keys of the shingles."""
    node, d = shingle_digests(text, width)
    if not len(d):
        return node, 0, 0, np.zeros(0, np.int64)
    # Distinct shingles, as the similarity counts them: repeats have no weight.
    d = d[np.unique(d[:, 0], return_index=True)[1]]
    total = np.zeros(128, np.int64)
    for i in range(0, len(d), 1 << 14):
        total += np.unpackbits(d[i : i + (1 << 14)].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = np.packbits(total * 2 > len(d), bitorder="little").view(np.int64)
    return node, int(fp[0]), int(fp[1]), ring_keys(d[:, 0], similarity)


def sketches(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kt, node, fa, fb, keys, fp) per row; kt is the text's hash, fp operator 8's fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("kt"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py(), width, similarity) for t in batch.column("text")]
            fp = np.array([simhash.fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("kt"), pa.array([x[0] for x in found], pa.binary()), *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2)), pa.array([x[3] for x in found], pa.list_(pa.int64())), pa.array(fp)],
                names=["doc_id", "kt", "node", "fa", "fb", "keys", "fp"],
            )

    return map_arrow(rows, run, "doc_id long, kt long, node binary, fa long, fb long, keys array<long>, fp long")


def node_words(column: pa.Array) -> np.ndarray:
    """The 128 bits of nodes as two numbers each, in the order of the bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2)


def edge_batch(nodes: pa.Array, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(u, v) with the smaller node first; pairs of one node with itself are left out."""
    a, b = words[i], words[j]
    less = (a[:, 0] < b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1])
    apart = (a != b).any(1)
    u, v = np.where(less, i, j)[apart], np.where(less, j, i)[apart]
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(u)), nodes.take(pa.array(v))], names=["u", "v"])


def distance(fa: np.ndarray, fb: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fa ^ ga).astype(np.int16) + np.bitwise_count(fb ^ gb)


def shared_keys(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, m, node, fa, fb), stored: a row for each key of a node that m > 1 nodes have. Most keys are one node's own."""
    sizes = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "fa", "fb")
    return materialized(shuffled_join(keyed, materialized(sizes, "key-sizes", scratch), ["key"], "inner").select("key", "m", "node", "fa", "fb"), "shared-keys", scratch)


def ring_members(nodes: DataFrame, scratch: Scratch, limit: int = simhash.LIMIT) -> DataFrame:
    """(key, m, node, fa, fb), stored: a row for each node in a component of operator 8 that m > 1 nodes have.

    Its links come from chains on the ring of the fingerprint's segments. The keys are odd, so that no other
    fingerprint keeps a pair of a component from the exact check.
    """
    solid = nodes.where(F.col("node") != F.lit(EMPTY)).select("node", "fa", "fb", "fp")
    fps = materialized(solid.select("fp").distinct(), "ring-fingerprints", scratch)
    roots = components(simhash.links(fps, limit), scratch).withColumnRenamed("node", "fp")
    named = sized_join(solid, roots, ["fp"]).withColumn("key", F.xxhash64(F.lit("ring"), F.coalesce("root", "fp")).bitwiseOR(F.lit(1)))
    named = materialized(named.select("key", "node", "fa", "fb"), "ring-named", scratch)
    sizes = materialized(named.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "ring-sizes", scratch)
    return materialized(sized_join(named, sizes, ["key"], "inner").select("key", "m", "node", "fa", "fb"), "ring-members", scratch)


def first_edges(shared: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(u, v): in each key, edges from a member to the first and to the one before it in order of the fingerprints, within ``bits``.

    Their number is linear in that of members. A key of more than ``hot`` members is dealt to several tasks, each
    with a first of its own; what that leaves apart, the rounds join.
    """
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / hot)).cast("int")
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.select("key", salt.alias("salt"), "fa", "fb", "node").repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "fa", "fb", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the first and the last row of the group that may go on
        for batch in batches:
            new = pa.Table.from_batches([batch])
            t = (new if held is None else pa.concat_tables([held, new])).combine_chunks()
            old = 0 if held is None else held.num_rows
            if not new.num_rows:
                continue
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            fa, fb = (t.column(c).to_numpy().view(np.uint64) for c in ("fa", "fb"))
            k = np.arange(len(key))
            head = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            first = np.maximum.accumulate(np.where(head, k, 0))
            i = k[(k >= old) & ~head]
            limit = np.where(key[i] & 1, 128, bits)  # fingerprints of small sets differ more
            star = i[distance(fa[i], fb[i], fa[first[i]], fb[first[i]]) <= limit]
            near = i[(distance(fa[i], fb[i], fa[i - 1], fb[i - 1]) <= limit) & (first[i] != i - 1)]
            nodes = t.column("node").combine_chunks()
            nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
            yield edge_batch(nodes, node_words(nodes), np.r_[star, near], np.r_[first[star], near - 1])
            held = t.take(pa.array([first[-1], len(key) - 1]))

    return map_arrow(dealt, run, "u binary, v binary").distinct()


def open_members(fa: np.ndarray, fb: np.ndarray, root: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
    """Whether each member has another within ``bits`` and of another ``root``; where there are two parts, in the other part.

    Members of the commonest root meet the others only, so a key that is almost one group costs little more than
    its members.
    """
    out = np.zeros(len(root), bool)
    names, of = np.unique(root, return_inverse=True)
    if len(names) < 2:
        return out
    rest = np.flatnonzero(of != np.bincount(of).argmax())
    split = part.min() != part.max()
    fa, fb = fa.view(np.uint64), fb.view(np.uint64)
    for at in range(0, len(rest), STEP):
        rows = rest[at : at + STEP]
        for to in range(0, len(root), BLOCK):
            columns = slice(to, to + BLOCK)
            ok = (distance(fa[rows, None], fb[rows, None], fa[None, columns], fb[None, columns]) <= bits) & (of[rows, None] != of[None, columns])
            if split:
                ok &= part[rows, None] != part[None, columns]
            out[rows] |= ok.any(1)
            out[columns] |= ok.any(0)
    return out


def joining_edges(sets: list[np.ndarray], fa: np.ndarray, fb: np.ndarray, root: np.ndarray, part: np.ndarray, bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all members of different ``root`` that are within ``bits`` and similar, none of which joins what others have joined.

    Members of one root count as joined. Every pair that lies in two components when its turn comes is checked, but
    for those that can't be similar: of two similar sets, the rarest n - ceil(similarity * n) + 1 shingles of each
    have one in common, so what all members share by a common passage makes no pair.
    """
    names, of = np.unique(root, return_inverse=True)
    first, second = [], []
    if len(names) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = _Sets(sets)
    rest = np.flatnonzero(of != np.bincount(of).argmax())
    split = part.min() != part.max()
    fa, fb = fa.view(np.uint64), fb.view(np.uint64)
    # The prefixes of all sets, and by shingle the sets that have it there.
    times = np.bincount(block.ids)
    rarity = np.empty(len(times), np.int64)
    rarity[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(len(sets)), block.sizes)
    order = np.lexsort((rarity[block.ids], owner))
    length = block.sizes - np.ceil(similarity * block.sizes - 1e-9).astype(np.int64) + 1
    inside = np.arange(len(owner)) - block.starts[owner] < length[owner]
    shingle, holder = block.ids[order][inside], owner[inside]
    begin = np.cumsum(length) - length
    by_shingle = np.argsort(shingle, kind="stable")
    holders = holder[by_shingle]
    at = np.searchsorted(shingle[by_shingle], np.arange(len(times) + 1))
    for i in rest.tolist():
        mine = shingle[begin[i] : begin[i] + length[i]]
        n = at[mine + 1] - at[mine]
        to = np.cumsum(n) - n
        js = np.unique(holders[np.repeat(at[mine] - to, n) + np.arange(int(n.sum()))])
        js = js[of[js] != of[i]]
        if split:
            js = js[part[js] != part[i]]
        js = js[distance(fa[i], fb[i], fa[js], fb[js]) <= bits]
        if len(js):
            for j in js[block.similar(i, js, similarity)].tolist():
                if of[j] != of[i]:
                    of[of == of[j]] = of[i]
                    first.append(i)
                    second.append(j)
    return np.array(first, np.int64), np.array(second, np.int64)


def grouped(dealt: DataFrame, keys: list[str], each: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` of every run of rows that agree in ``keys``; such rows follow one another in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of one group that may go on

        def ended() -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in rest) > 1 and (found := each(pa.Table.from_batches(rest).combine_chunks())) is not None:
                yield found
            rest.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            if last is not None and tuple(c[0] for c in columns) != last:
                yield from ended()
            edges = [0, *cut.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo:
                    yield from ended()
                if hi - lo == 1 and lo and hi < batch.num_rows:
                    continue  # a group of one
                rest.append(batch.slice(lo, hi - lo))
            last = tuple(c[-1] for c in columns)
        yield from ended()

    return map_arrow(dealt, run, schema)


def _met(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` with p, q and part: the members of a key are dealt to so many parts, and every two parts meet."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("parts", "other")


def open_keys(shared: DataFrame, roots: DataFrame, scratch: Scratch, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(key, node, root, fa, fb), stored: members of a key that have another within ``bits`` in another component.

    Only keys with members of different components are read. A key of more than ``hot`` members is dealt to
    parts of which every two meet in a task. What is made has a row for a member, never for a pair. Of keys with
    the same such members one stays: similar texts share several keys, and checking them under one is enough.
    """
    # Only the hash of a root is compared: roots of one hash would pass as one component.
    rooted = materialized(sized_join(shared, roots, ["node"]).withColumn("root", F.xxhash64(F.coalesce("root", "node"))), "rooted", scratch)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rows = sized_join(rooted, materialized(mixed, "mixed-keys", scratch), ["key"], "inner")
    met = _met(rows, F.when(F.col("m") > hot, F.ceil(F.col("m") * 2 / hot)).otherwise(1))
    names = ["key", "node", "root", "fa", "fb"]
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("p", "q", "part", *names).repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def each(t: pa.Table) -> pa.RecordBatch | None:
        key, part, root, fa, fb = (t.column(c).to_numpy() for c in ("key", "part", "root", "fa", "fb"))
        some = t.select(names).filter(pa.array(open_members(fa, fb, root, part, 128 if key[0] & 1 else bits)))
        if not some.num_rows:
            return None
        some = some.combine_chunks().to_batches()[0]
        whole = part.min() == part.max()  # what is dealt to parts is told apart by its key
        same = xxhash.xxh3_128_digest(b"".join(sorted(some.column("node").to_pylist())), int(key[0] & 1)) if whole else b""
        return some.append_column("same", pa.array([same] * some.num_rows, pa.binary()))

    found = grouped(dealt, ["key", "p", "q"], each, "key long, node binary, root long, fa long, fb long, same binary")
    found = materialized(found.dropDuplicates(["key", "node"]), "found-members", scratch)
    one = materialized(found.groupBy("same", F.when(F.octet_length("same") == 0, F.col("key")).alias("own")).agg(F.min("key").alias("key")).select("key"), "one-key", scratch)
    return materialized(shuffled_join(found, one, ["key"], "left_semi").drop("same"), "open-members", scratch)


def open_edges(members: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch, bits: int = BITS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v): edges that join the components of all similar ``members`` of a key, checked on their whole shingle sets.

    The sets of a key's members come together in a task. Keys with more than ``most_bytes`` of them are dealt to
    parts of which every two meet.
    """
    sized = sets.select("node", "bytes")
    heavy = members.join(sized, "node").groupBy("key").agg(F.sum("bytes").alias("b")).where(F.col("b") > most_bytes)
    rows = sized_join(members, materialized(heavy, "heavy-keys", scratch), ["key"])
    met = _met(rows, F.when(F.col("b").isNotNull(), F.ceil(F.col("b") * 2 / most_bytes)).otherwise(1)).join(sets.select("node", "shingles"), "node")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("key", "p", "q", "part", "node", "root", "fa", "fb", "shingles").repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def each(t: pa.Table) -> pa.RecordBatch | None:
        key, part, root, fa, fb = (t.column(c).to_numpy() for c in ("key", "part", "root", "fa", "fb"))
        raw = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
        i, j = joining_edges(raw, fa, fb, root, part, 128 if key[0] & 1 else bits, similarity)
        nodes = t.column("node").combine_chunks()
        nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
        return edge_batch(nodes, node_words(nodes), i, j) if len(i) else None

    return grouped(dealt, ["key", "p", "q"], each, "u binary, v binary").distinct()


def whole_components(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root) of the components of all pairs that share a key, are within the bits and pass the exact check.

    Keys are operator 8's components, without limit of bits, and segments of shingles that agree. The first edges join what is close. Then every pair of a key that still lies in two components is checked
    where the sets of the key's members meet; only edges that join components leave the task.
    """
    shared = ring_members(nodes, scratch).unionByName(shared_keys(nodes, scratch))
    sets = shingle_sets(docs, nodes, shared.select("node").distinct(), width, scratch)
    first = materialized(first_edges(shared), "first-edges", scratch)
    held = materialized(similar_edges(first, sets, similarity), "similar-edges", scratch)
    roots = components(held, scratch)
    members = open_keys(shared, roots, scratch)
    if members.isEmpty():
        return roots
    more = materialized(open_edges(members, sets, similarity, scratch), "more-edges", scratch)
    return roots if more.isEmpty() else components(held.unionByName(more), scratch)


def shingle_sets(docs: DataFrame, nodes: DataFrame, involved: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, bytes, shingles), stored: the sorted shingle hashes of the involved nodes, from a text of each."""
    none = F.lit(-(1 << 63))
    wanted = nodes.join(involved, "node", "left_semi").select("node", F.coalesce("at.doc_id", none).alias("kd"), F.col("at.kt").alias("kt"))
    wanted = materialized(wanted, "wanted", scratch)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("kd"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("kt"), "text")
    rows = sized_join(rows, wanted, ["kd", "kt"], "inner").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")], pa.binary())], names=["node", "shingles"])

    out = map_arrow(rows, sets, "node binary, shingles binary")
    return materialized(out.select("node", F.octet_length("shingles").cast("long").alias("bytes"), "shingles"), "shingle-sets", scratch)


class _Sets:
    """Sets of shingles as numbers from 0, of which one is compared with many at a time."""

    def __init__(self, raw: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.ids = np.unique(np.concatenate(raw), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def similar(self, i: int, js: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the Jaccard similarity of set i with each of the sets js is reached."""
        own = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = True
        out = np.zeros(len(js), bool)
        for at in range(0, len(js), STEP):  # so much is held at once
            some = js[at : at + STEP]
            sizes = self.sizes[some]
            first = np.cumsum(sizes) - sizes
            hits = self.mark[self.ids[np.repeat(self.starts[some] - first, sizes) + np.arange(int(sizes.sum()))]]
            both = np.add.reduceat(hits, first, dtype=np.int64)
            out[at : at + STEP] = both >= similarity * (self.sizes[i] + sizes - both) - 1e-9
        self.mark[own] = False
        return out


class _Block:
    """The shingle sets of the nodes of a block of edges."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.raw: list[np.ndarray] = []
        self.sets: _Sets | None = None

    def add(self, node: bytes, shingles: bytes) -> None:
        if node not in self.at:  # rows that repeat give the same set
            self.at[node] = len(self.raw)
            self.raw.append(np.frombuffer(shingles, np.uint64))

    def similar(self, u: list[bytes], v: list[bytes], similarity: float) -> np.ndarray:
        """Whether the Jaccard similarity of each pair is reached."""
        if self.sets is None:
            self.sets, self.raw = _Sets(self.raw), []
        a, b = (np.fromiter((self.at[x] for x in side), np.int64, len(side)) for side in (u, v))
        out = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            out[group] = self.sets.similar(int(a[group[0]]), b[group], similarity)
        return out


def similar_edges(edges: DataFrame, sets: DataFrame, similarity: float, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored ``edges`` whose nodes have the similarity, computed on their whole shingle sets.

    Nodes are dealt to parts, and the edges between two parts form a block; a set is sent once to each block that
    has an edge of its node, however many edges that are. Parts are small enough for two of them to fit a task.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sets.agg(F.sum("bytes")).first()[0] or 0
    parts = max(-(-total // most_bytes), int((2 * n) ** 0.5))
    part = {c: F.pmod(F.xxhash64(c), F.lit(parts)) for c in ("u", "v")}
    a, b = F.least(part["u"], part["v"]).alias("a"), F.greatest(part["u"], part["v"]).alias("b")
    e = edges.select(a, b, F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("binary").alias("shingles"))
    sent = e.select("a", "b", F.explode(F.array("u", "v")).alias("node")).distinct().join(sets.select("node", "shingles"), "node")
    rows = sent.select("a", "b", F.lit(0).alias("kind"), F.col("node").alias("u"), F.lit(None).cast("binary").alias("v"), "shingles").unionByName(e)
    dealt = rows.repartition(n, "a", "b").sortWithinPartitions("a", "b", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block()
        for batch in batches:
            a, b, kind = (batch.column(c).to_numpy() for c in ("a", "b", "kind"))
            cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if (at := (a[lo], b[lo])) != now:
                    now, block = at, _Block()
                some = batch.slice(lo, hi - lo)
                u = some.column("u").to_pylist()
                if kind[lo] == 0:
                    for node, shingles in zip(u, some.column("shingles"), strict=True):
                        block.add(node, shingles.as_py())
                else:
                    ok = block.similar(u, some.column("v").to_pylist(), similarity)
                    yield some.select(["u", "v"]).filter(pa.array(ok))

    return map_arrow(dealt, run, "u binary, v binary")


def marked(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kt, node, root, stays) per row of ``docs``, stored: rows with one root are one group.

    ``stays`` holds for the rows of a group that have its smallest id; more than one only where rows repeat.
    """
    with Scratch(docs.sparkSession) as scratch:
        s = materialized(sketches(docs, width, similarity), "sketches", scratch)
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kt")
        nodes = s.groupBy("node").agg(F.min(place).alias("at"), F.first("fa").alias("fa"), F.first("fb").alias("fb"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
        nodes = materialized(nodes, "nodes", scratch)
        roots = whole_components(docs, nodes, width, similarity, scratch)
        members = materialized(sized_join(nodes.select("node", "at"), roots, ["node"]).withColumn("root", F.coalesce("root", "node")), "members", scratch)
        first = materialized(members.groupBy("root").agg(F.min("at").alias("first")), "first", scratch)
        named = materialized(sized_join(members, first, ["root"], "inner").select("node", "root", "first"), "groups", scratch)
        out = sized_join(s.select("doc_id", "kt", "node"), named, ["node"])
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("kt") == F.col("first.kt"))
        return materialized(out.select("doc_id", "kt", "node", "root", stays.alias("stays")), "marked")


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that with the smallest id."""
    m = marked(docs, width, similarity)
    columns = docs.columns
    none = F.lit(-(1 << 63))
    packed = docs.select(F.struct(*columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("_kd"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_kt"))
    gone = m.where(~F.col("stays")).select(F.coalesce("doc_id", none).alias("_kd"), F.col("kt").alias("_kt")).distinct()
    kept = sized_join(packed, materialized(gone, "gone"), ["_kd", "_kt"], "left_anti")
    if not m.where("stays").groupBy("root").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_kd", "_kt"])
    return kept.select("_row.*")
