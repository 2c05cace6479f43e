"""Suffix arrays against sorting, and removal against a dictionary of all windows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from mirrorfold.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(8))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    contexts = [bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
    contexts += contexts[:2]
    sa, common, starts = sd.suffix_array(contexts)
    suffixes = {int(starts[k]) + i: (c[i:], k) for k, c in enumerate(contexts) for i in range(len(c))}
    assert sorted(sa.tolist()) == sorted(suffixes)
    listed = [suffixes[i] for i in sa.tolist()]
    assert [s for s, _ in listed] == sorted(s for s, _ in listed)
    for r in range(1, len(listed)):
        assert common[r] == len(os.path.commonprefix([listed[r - 1][0], listed[r][0]]))


def every_anchor(raw, **options):
    """(first window, windows, place, hash), runs written out."""
    return [(l + k * n, n, o, h) for p in sd.anchors(raw, **options) for l, n, o, h, r in zip(*(x.tolist() for x in p), strict=True) for k in range(r)]


def test_anchors_depend_on_windows_alone():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, 900, dtype=np.uint8).tobytes()
    seen = []
    for before in (0, 13, 500):
        raw = rng.integers(0, 256, before, dtype=np.uint8).tobytes() + same + b"tail" * 50
        found = every_anchor(raw)
        assert found[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(found, found[1:], strict=False)) and sum(found[-1][:2]) == len(raw) - 199
        of = {s: (h, l + o - before) for l, n, o, h in found for s in range(l - before, l - before + n)}
        seen.append([of[s] for s in range(len(same) - 199)])
        for chunk in (64, 137, 1000):
            assert every_anchor(raw, chunk=chunk) == found
    assert seen[0] == seen[1] == seen[2]
    assert list(sd.anchors(b"x" * 199)) == list(sd.anchors(b"")) == []


def test_periodic_texts_have_few_rows():
    rng = np.random.default_rng(2)
    for period in (1, 2, 7, 64, 130):
        raw = b"head " * 3 + rng.integers(0, 256, period, dtype=np.uint8).tobytes() * (300_000 // period) + b"tail" + b"q" * 5000
        rows = [x for p in sd.anchors(raw, chunk=1 << 16) for x in zip(*(c.tolist() for c in p), strict=True)]
        assert len(rows) < 600
        for l, n, o, h, r in rows:  # what a row says of its repetitions
            assert r == 1 or raw[l : l + (r - 1) * n + n - 1 + 200] == (raw[l : l + n] * (r + 199 // n + 1))[: r * n + 199]
        assert every_anchor(raw) == every_anchor(raw, chunk=1 << 14)


def plain(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, line = prose(60), prose(14)
    base = prose(400)
    near = []
    for _ in range(12):
        w = base.split()
        for _ in range(9):
            w[rng.randrange(len(w))] = rng.choice(words)
        near.append(" ".join(w))
    common = [prose(rng.randint(0, 40)) + " " + passage + " " + prose(rng.randint(0, 40)) for _ in range(40)]
    edges = [passage[k : k + 199] + prose(30) for k in (0, 3)] + [passage[2:202] + "|", "|" + passage[5:205]]
    lines = ["\n".join([prose(20), line, prose(20)]) for _ in range(30)]
    return [None, "", "a", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, base, base, *near, *common, *edges, *lines, prose(30) + passage[:150], base + base[:150], "q" * 5000, prose(3000)]


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"hot": 1}, {"shard": 600}, {"hot": 7, "shard": 3000}])
def test_removal_is_exact(spark, options):
    rows = texts()
    ids = [None if i % 9 == 0 else i for i in range(len(rows))]
    rows, ids = [*rows, rows[9], rows[9], rows[20]], [*ids, ids[9], ids[9], ids[20]]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, a string, n_bytes int, kd int")
    got = sd.without_repeats(docs, **options).collect()
    want = Counter((i, *x) for i, x in zip(ids, plain(rows), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_nothing_there(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.without_repeats(docs).count() == 0
    one = spark.createDataFrame([(1, "abc " * 10)], "doc_id long, text string")
    r = sd.without_repeats(one, with_text=True).first()
    assert (r.n_removed, r.n_spans, bytes(r.kept)) == (0, 0, b"abc " * 10)


def test_long_texts_of_one_byte(spark):
    n = 8_000_000
    long = "a" * n
    rows = [long, long[: n // 2], "b" + "ab" * 1_000_000, "xyz" * 70, "c" * 201, "d" * 200]
    got = {r.doc_id: r for r in sd.without_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)).collect()}
    for i, t in enumerate(rows):
        gone = 0 if i == 5 else len(t)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(t), gone, int(gone > 0))
