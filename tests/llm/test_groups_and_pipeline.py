"""Near-duplicate groups against all pairs, and the pipeline on a small corpus with planted cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mirrorfold.llm import secrets, simhash_groups


def plain_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_groups(texts, similarity=0.8):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (a or b) and both >= similarity * (len(a) + len(b) - both) - 1e-9 or not a and not b:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    texts = [None, "", " \n", "one two", "One  TWO", "x" * 2000]
    for n in (8, 40, 150, 700, 3000):
        for edits in (0, 1, 2, n // 60, n // 40, n // 25):
            base = prose(n)
            texts.append(" ".join(base))
            for _ in range(3):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(w))
    line = " ".join(prose(12))
    texts += [line + " " + " ".join(prose(60)) for _ in range(40)]
    base = prose(200)
    for k in range(120):  # a chain of copies, each an edit further
        base[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(base) + f" {k}")
    return texts


def test_groups_equal_those_of_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, _kd int")
    want = plain_groups(texts)
    got = {r.doc_id: r.root for r in simhash_groups.marked(docs).collect()}
    first = {}
    mine = [first.setdefault(bytes(got[i]), i) for i in range(len(texts))]
    assert mine == want
    kept = simhash_groups.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_the_chains_of_operator_8_find_links(spark, monkeypatch):
    from mirrorfold.llm import simhash

    texts = corpus()
    rng = random.Random(5)
    for _ in range(40):  # copies with a word more or less at the end
        w = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "end"])]
    fps = [simhash.fingerprint(t) for t in texts]
    sets = [plain_set(t) for t in texts]
    near, want = list(range(len(texts))), list(range(len(texts)))

    def join(root, i, j):
        a, b = root[i], root[j]
        root[:] = [min(a, b) if x in (a, b) else x for x in root]

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and sets[i] and sets[j] and near[i] != near[j]:
                join(near, i, j)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if near[i] == near[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and want[i] != want[j]:
                join(want, i, j)
    assert len(set(want)) < len(texts) - 100 and want != near
    keys = simhash_groups.shared_keys
    monkeypatch.setattr(simhash_groups, "shared_keys", lambda *a: keys(*a).where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash_groups.marked(docs).collect()}
    first = {}
    blank = next(i for i, x in enumerate(sets) if not x)
    mine = [first.setdefault(bytes(got[i]), i) for i in range(len(texts))]
    assert mine == [want[i] if sets[i] else blank for i in range(len(texts))]


def test_repeats_of_a_line_are_near_copies(spark):
    rng = random.Random(31)
    texts = []
    for times in (8, 15, 30, 100):
        for _ in range(5):
            words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
            line = [f"l{rng.randrange(10**6)}" for _ in range(12)]
            texts += [" ".join(words + line * 2), " ".join(words + line * times)]
    want = plain_groups(texts)
    assert want == [i // 2 * 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_groups.one_of_each(docs).collect()) == sorted(set(want))


def test_pairs_inside_a_family_just_below_the_threshold(spark):
    rng = random.Random(17)

    def prose(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    base, texts = prose(200), []
    for _ in range(150):  # similarity 0.84 inside a pair, 0.77 to all others
        tail = prose(10)
        texts += [" ".join(base + tail + prose(20)) for _ in range(2)]
    want = plain_groups(texts)
    assert want == [i // 2 * 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_groups.one_of_each(docs).collect()) == sorted(set(want))


def test_no_open_pair_is_left_out():
    rng = np.random.default_rng(3)
    n = simhash_groups.STEP + 100
    fa, fb = (rng.integers(0, 4, n, dtype=np.int64) for _ in range(2))
    sets = [np.unique(rng.integers(0, 12, 9).astype(np.uint64)) for _ in range(n)]
    for parts in (1, 2):
        root, part = np.maximum(rng.integers(-600, 40, n), 0), rng.integers(0, parts, n)
        open_ = {(i, j) for i in range(n) for j in range(i + 1, n) if root[i] != root[j] and (parts == 1 or part[i] != part[j]) and int(fa[i] ^ fa[j]).bit_count() + int(fb[i] ^ fb[j]).bit_count() <= 1}
        assert set(np.flatnonzero(simhash_groups.open_members(fa, fb, root, part, 1)).tolist()) == {x for p in open_ for x in p}
        want = list(root)
        for i, j in open_:
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.6 * (len(sets[i]) + len(sets[j]) - both):
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
        i, j = simhash_groups.joining_edges(sets, fa, fb, root, part, 1, 0.6)
        got = list(root)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            assert (min(x, y), max(x, y)) in open_
            got = [min(got[x], got[y]) if z in (got[x], got[y]) else z for z in got]
        assert got == want and 0 < len(i) < len(set(root.tolist()))


@pytest.mark.parametrize("hot", [3, 40])
def test_hot_keys_are_dealt_by_parts(spark, monkeypatch, hot):
    texts = corpus()
    first, keys, edges, check = simhash_groups.first_edges, simhash_groups.open_keys, simhash_groups.open_edges, simhash_groups.similar_edges
    monkeypatch.setattr(simhash_groups, "first_edges", lambda shared: first(shared, hot=hot))
    monkeypatch.setattr(simhash_groups, "open_keys", lambda *a: keys(*a, hot=hot))
    monkeypatch.setattr(simhash_groups, "open_edges", lambda *a: edges(*a, most_bytes=20_000))
    monkeypatch.setattr(simhash_groups, "similar_edges", lambda *a: check(*a, most_bytes=20_000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_groups.one_of_each(docs).collect()) == sorted(set(plain_groups(texts)))


def test_rows_that_repeat_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "g h"), (None, "g h"), (3, "other words stand here now"), (3, "quite different ones are there")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash_groups.one_of_each(docs).collect())
    assert got == Counter({(5, "a b c d e f"): 1, (None, "g h"): 1, (3, "other words stand here now"): 1, (3, "quite different ones are there"): 1})
    assert simhash_groups.one_of_each(docs.where("false")).count() == 0


def test_ring_keys_meet():
    rng = np.random.default_rng(0)
    missed = 0
    for n in (3, 10, 50, 400, 5000):
        for _ in range(60):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            gone = int(n * 0.2 / 1.8)
            b = np.r_[a[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]
            missed += not set(simhash_groups.ring_keys(np.unique(a))) & set(simhash_groups.ring_keys(np.unique(b)))
    assert missed <= 3  # a set of few shingles may have an empty segment as its only equal one


def test_short_texts_always_meet(spark):
    rng = np.random.default_rng(5)
    texts, want = [], []
    for common, p, q in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (12, 2, 1)):
        for _ in range(150):
            d = rng.integers(0, 2**63, common + p + q, dtype=np.uint64)
            a, b = d[: common + p], np.r_[d[:common], d[common + p :]]
            assert set(simhash_groups.ring_keys(np.unique(a))) & set(simhash_groups.ring_keys(np.unique(b)))
    for k in range(300):  # 4 of 5 shingles
        words = [f"w{rng.integers(10**9)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
        want += [2 * k, 2 * k]
    assert plain_groups(texts) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_groups.one_of_each(docs).collect()) == sorted(set(want))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        bad = i % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        elif i % 31 == 1:
            w[5] = 'token = "' + hashlib.sha1(str(i).encode()).hexdigest() + '"'
        rows.append((i, " ".join(w), "en", f"src{i % 3 if i % 2 else 0}", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000 + i, rows[i][1] + (" end" if i % 2 else ""), "en", "src9", 0) for i in range(20)]
    rows += [(2000, None, None, None, None), (None, "some words without an id stand here for all to see and read", "en", "src1", 4)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    import corpus_pipeline as cp
    import sentencepiece

    from mirrorfold.llm.common import materialized, table

    path, rows = folder
    docs = table(spark, path, "documents")
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = materialized(out, "test")
        seen.append(docs)
    text = {r[0]: r[1] for r in rows}
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    junk = {i for i in range(600) if i % 7 == 0}
    assert junk & ids[1] == set() and len((ids[0] - junk - {i for i in ids[0] if i and i >= 1000 and (i - 1000) % 7 == 0}) - ids[1]) <= 3
    left = sorted(ids[1], key=lambda i: (i is None, i or 0))
    groups = plain_groups([text[i] for i in left])
    assert ids[2] == {left[g] for g in set(groups)}
    for r in seen[3].collect():
        t = text[r.doc_id]
        if t and "token =" in t:
            assert secrets.MARK in r.text and "token" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == t
    assert sorted(map(repr, seen[4].collect())) == sorted(map(repr, seen[3].collect()))
    lib = sentencepiece.SentencePieceProcessor(model_file=cp.piece_model_path())
    last = {r.doc_id: r.text for r in seen[4].collect()}
    got = cp.run(spark, path).collect()
    assert {r.doc_id for r in got} == ids[4]
    for r in got:
        enc = lib.encode(last[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(enc) and r.decoded_sha256 == hashlib.sha256((last[r.doc_id] or "").encode()).hexdigest()


def test_stages_on_empty_tables_and_nulls(spark, folder):
    import corpus_pipeline as cp

    path, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score string, spans int"
    none = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None,) * 7, (None,) * 7, (1, "", None, None, None, "clash", 1), (1, "", None, None, None, "clash", 1), (2, "word " * 60_000, "en", "s", 1, None, None)], schema)
    for name, stage in cp.STAGES:
        assert stage(spark, none, path).count() == 0, name
        out = stage(spark, nulls, path)
        n = out.count()
        assert n == len(nulls.collect()) if name in ("secrets", "mix", "tokens") else n <= 5, name
        if name != "tokens":
            assert out.columns == nulls.columns, name
    assert cp.near_duplicates(spark, nulls, path).count() == 2


def test_texts_go_to_workers_once_and_in_bounded_batches(spark, folder, monkeypatch):
    import corpus_pipeline as cp
    import pyarrow as pa

    from mirrorfold.functions.arrow import BATCH_BYTES
    from mirrorfold.llm import quality_ranker

    path, _ = folder
    sent = []

    def measured(df, function, schema):
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

        sent.append(df.mapInArrow(sizes, "n long, bytes long"))
        return real(df, function, schema)

    real = quality_ranker.map_arrow
    monkeypatch.setattr(quality_ranker, "map_arrow", measured)
    long = "some words to read " * 1000
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", f"'{long}' AS text", "id AS _score")
    out = cp.quality(spark, docs, path)
    assert out.columns == docs.columns
    batches = sent[-1].collect()  # what the scores are taken of
    assert sum(r.n for r in batches) == 1000
    assert sum(r.bytes for r in batches) < 1.1 * 1000 * len(long)
    assert max(r.bytes for r in batches) < BATCH_BYTES + 2 * len(long)


def test_the_mix_makes_no_rows_in_python(spark, folder, monkeypatch):
    import corpus_pipeline as cp

    def refused(*_):
        raise AssertionError("rows from Python start further workers on each executor")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert cp.mix(spark, docs, path).count() == len(rows)
