"""SentencePiece, fingerprints, licence scan, rules and ranker against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mirrorfold.llm import decision_list, license_scan, quality_ranker, sentencepiece_bpe, simhash
from mirrorfold.llm.queries import piece_model_path
from mirrorfold.llm.text_features import NAMES, base_counts, features

ODD = [None, "", " ", "  \t\n", "a", "one two", "A b\x0bc\x0cd e", "é ß 日本 🙂", "x" * 3000, "same words here " * 400]
SCHEMA = "doc_id long, text string, lang string, score double, key string, n_words string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, "k", "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def test_pieces_equal_the_library(library):
    m = sentencepiece_bpe.model(piece_model_path())
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("aab e  étxyzABC\n▁\x00<s>12,ß日🙂") for _ in range(rng.randint(0, 40)))
        want = library.encode(t, add_bos=True, add_eos=True)
        assert m.encode(t) == want
        assert m.decode(want) == library.decode(want)
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(6)]
        assert m.decode(ids) == library.decode(ids)
    for t in ("a" * 20_000, " " * 5001, "thethethe" * 999):
        assert m.encode(t) == library.encode(t, add_bos=True, add_eos=True)


def test_piece_query_on_odd_rows(spark, library):
    texts = [*ODD, "Hello  world", "Hello  world"]
    got = sentencepiece_bpe.round_trip(frame(spark, texts), piece_model_path()).collect()
    assert len(got) == len(texts)
    for row, t in zip(sorted(got), texts, strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    both = sentencepiece_bpe.decode_documents(sentencepiece_bpe.encode_documents(frame(spark, ODD), piece_model_path()), piece_model_path())
    assert [(r.decoded) for r in both.orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert sentencepiece_bpe.round_trip(frame(spark, []), piece_model_path()).count() == 0


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(fps, limit):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in [*ODD, "The quick BROWN fox jumps", "a b", "w " * 70_000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize(("limit", "hot"), [(0, 8), (1, 8), (2, 9000), (3, 9000), (3, 3), (5, 9000)])
def test_links_connect_all_that_are_near(spark, limit, hot):
    rng = random.Random(limit)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            fps.add(x)
            for _ in range(rng.randint(0, limit + 1)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps | {0, 1, 2**63, 2**64 - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit, hot).collect()
    place = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        i, j = place[r.u], place[r.v]
        assert (fps[i] ^ fps[j]).bit_count() <= limit
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert [root(i) for i in range(len(fps))] == plain_components(fps, limit)


def test_near_duplicates_on_odd_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(900))
    texts = [*ODD, base, base, base + " end", "Start " + base, base.upper(), " ".join(rng.choice(words) for _ in range(50))]
    ids = [None if i == 3 else i + 7 for i in range(len(texts))]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps, 3)
    least = defaultdict(lambda: None)
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = ids[i] if least[r] is None else min(least[r], ids[i])
    want = Counter((ids[i], fps[i], least[roots[i]]) for i in range(len(texts)))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def plain_places(text):
    words, word = [], b""
    for b in (text or "").encode() + b" ":
        b = b + 32 if 65 <= b <= 90 else b
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word.decode())
            word = b""
    places = [(i, p) for i in range(len(words)) for p in license_scan.PHRASES if words[i : i + len(p.split())] == p.split()]
    return words, places


def test_license_places(spark):
    rng = random.Random(2)
    bits = ["MIT", "License", "license,", "cc", "BY", "by-nc", "GNU", "General", "Public", "public-license", "apache", "x", "é", "\n", "2.0", "mit_license"]
    texts = [*ODD, *(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)), "mit license mit license"]
    got = {r.doc_id: r for r in license_scan.scan_documents(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words, places = plain_places(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({license_scan.PHRASES[p] for _, p in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert license_scan.scan_documents(frame(spark, [])).count() == 0


def test_license_expressions():
    def labels(x):
        return license_scan.evaluate(license_scan.parse_expression(x)[0])[0]

    assert labels("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == {"mit", "apache", "gpl"}
    assert labels("MIT and then some prose") == {"mit"}
    assert license_scan.parse_expression("MIT OR")[1] is False
    assert license_scan.parse_expression("(MIT")[1] is False
    assert license_scan.parse_expression("MIT) OR GPL-3.0") == (["MIT"], True)
    assert license_scan.evaluate(license_scan.parse_expression("MIT AND (BSD-2-Clause OR ISC AND BSD-3-Clause)")[0]) == ({"mit", "bsd", "isc"}, {"mit", "bsd"})
    for tag in ("SPDX License Identifier: ", "spdx-license-identifier:", "<SPDX_License.Identifier ", "SPDX\nlicense\nidentifier  : "):
        assert license_scan.scan("é " * 9 + tag + "MIT OR GPL-2.0-only WITH GCC-exception-3.1\nISC")["labels"] == "gpl,mit"
    assert license_scan.scan("SPDX-License-Identifier: MIT\n x SPDX-License-Identifier: ISC")["labels"] == "isc,mit"
    assert license_scan.scan("SPDX-License-Identifier:")["score"] == 0.5 * 0.8
    assert license_scan.parse_expression("")[0] == [] and license_scan.parse_expression("OR ()")[0] == []
    assert license_scan.scan("// SPDX-License-Identifier: LGPL-2.1+\n")["labels"] == "lgpl"


def test_license_expression_on_a_long_line():
    names = [f"LicenseRef-{i}" for i in range(600)]
    got = license_scan.scan("# SPDX-License-Identifier: (" + " AND ".join(names) + ") AND MIT\nnext line")
    assert got["labels"] == ",".join(sorted(["mit", *map(str.lower, names)]))
    assert got["score"] > 0.999


def test_license_labels_of_many_alternatives():
    names = [f"LicenseRef-{i}" for i in range(3000)]
    choices = " AND ".join(f"({a} OR {b})" for a, b in zip(names[:14:2], names[1:14:2], strict=True))
    for line, want in ((choices, names[:14]), (" OR ".join(names), names)):
        assert license_scan.scan("SPDX-License-Identifier: " + line)["labels"] == ",".join(sorted(map(str.lower, want)))
    assert len(license_scan.evaluate(license_scan.parse_expression(choices)[0])[0]) == 14


def test_base_counts_by_hand():
    text = "a b c d e\nx\na b c d e\n\n \n# <tag> * é\na b c d e"
    words = text.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    assert base_counts(text) == (len(words), sum(map(len, words)), 4, 2, len(inside))
    assert base_counts(None) == base_counts("") == base_counts(" \n") == (0, 0, 0, 0, 0)
    assert base_counts("a\xa0b\x85c\x1cd") == (1, 7, 0, 0, 0)


def corpus(n=900):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts, quality = [], []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        kind = rng.randrange(6)
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        texts.append(" ".join(w))
        quality.append(int(kind > 1))
    return texts, quality


def test_ranker_and_rules_on_held_out_rows(spark):
    texts, quality = corpus()
    docs = frame(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, q, None) for i, q in enumerate(quality)] + [(0, quality[0], 1), (None, 1, 1), (5000, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    ranker = quality_ranker.fit_ranker(docs, labels)
    got = quality_ranker.score_documents(docs, ranker).withColumn("held", quality_ranker.held_out()).collect()
    assert len(got) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < len(texts)]
    assert len(held) > 100
    assert np.mean([(r.score >= quality_ranker.CUT) == quality[r.doc_id] for r in held]) > 0.97
    rules = decision_list.fit_rules(docs, labels)
    assert rules
    out = {r.doc_id: r for r in decision_list.judged(docs, rules).collect()}
    assert len(out) == len(got)
    ok = [out[r.doc_id].kept == (bool(quality[r.doc_id]) and not out[r.doc_id].base_failed) for r in held]
    assert np.mean(ok) > 0.95
    for i, t in enumerate(ODD):
        r = out[len(texts) + i]
        assert tuple(r[k] for k in decision_list.BASE) == base_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_the_fit_is_the_least_loss():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0.4, 1, (300, len(NAMES))), rng.normal(0, 1.3, (90, len(NAMES)))
    ranker = quality_ranker.fit_pairs(good, bad, 4000, 1e-3, 7)
    d = quality_ranker.differences(good, bad, 4000, 7)[4]

    def loss(w):
        return np.mean([np.log1p(np.exp(-sum(a * b for a, b in zip(row, w, strict=True)))) for row in d.tolist()]) + 0.5e-3 * float(w @ w)

    least = loss(ranker.weights)
    for j in range(len(NAMES)):  # the loss is convex: where no small step lowers it, it is least
        for step in (-1e-3, 1e-3):
            moved = ranker.weights.copy()
            moved[j] += step
            assert loss(moved) > least
    plain = np.zeros(len(NAMES))
    for _ in range(3000):
        p = 1 / (1 + np.exp(d @ plain))
        plain += 0.3 * ((d * p[:, None]).mean(0) - 1e-3 * plain)
    assert np.abs(plain - ranker.weights).max() < 1e-3


def test_the_fit_is_on_all_labels_and_all_pairs(spark):
    texts, quality = corpus(700)
    quality = [1 - q if i % 9 == 0 else q for i, q in enumerate(quality)]  # labels that no weights can meet
    docs = frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    ranker = quality_ranker.fit_ranker(docs.repartition(5), labels)
    again = quality_ranker.fit_ranker(docs.unionByName(docs).repartition(2), labels)
    assert all(np.array_equal(getattr(ranker, k), getattr(again, k)) for k in ("mean", "scale", "weights", "threshold", "width"))
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([features(texts[i]) for i in known]), np.array([quality[i] for i in known])
    assert np.allclose(ranker.mean, x.mean(0), atol=1e-9) and np.allclose(ranker.scale, np.maximum(x.std(0), 1e-6), atol=1e-9)
    z = np.clip((x - ranker.mean) / ranker.scale, -8, 8)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, len(NAMES))  # every pair
    p = 1 / (1 + np.exp(d @ ranker.weights))
    assert np.abs(-(d * p[:, None]).mean(0) + 1e-3 * ranker.weights).max() < 1e-5  # no slope is left
    s = np.sort(z @ ranker.weights)
    share = (y == 0).mean()
    window = s[max(0, int((share - 0.02) * len(s)) - 1) : max(2, int((share + 0.02) * len(s)) + 1)]
    k = int(np.argmax(np.diff(window)))
    assert abs(ranker.threshold - (window[k] + window[k + 1]) / 2) < 1e-6 and abs(ranker.width - s.std() / 4) < 1e-6
    plain = quality_ranker.fit_pairs(x[y == 1], x[y == 0])
    assert np.abs(plain.weights - ranker.weights).max() < 2e-6 and abs(plain.threshold - ranker.threshold) < 1e-5


def test_no_label_is_left_out(spark):
    n = 2 * quality_ranker.MAX_LABELLED
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = quality_ranker.labelled_features(quality_ranker.with_features(rows), labels, "quality").groupBy("goal").count().collect()
    assert {r.goal: r["count"] for r in got} == Counter(i % 2 for i in range(n) if zlib.crc32(str(i).encode()) % 5)


def test_the_widest_gap_is_that_of_the_sorted_values(spark):
    from mirrorfold.llm.common import Scratch

    rng = np.random.default_rng(2)
    for values in (rng.normal(size=500), np.repeat(rng.normal(size=40), 9), np.zeros(30), np.array([1.0, 2.0]), np.r_[np.zeros(50), 1.0]):
        s = np.sort(values)
        df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(3)
        for first, last in ((0, 2), (len(s) // 3, len(s) // 2 + 2), (len(s) - 2, len(s) + 1)):
            window = s[first:last]
            k = int(np.argmax(np.diff(window)))
            with Scratch(spark) as scratch:
                assert quality_ranker.widest_gap(df, first, last, scratch) == (window[k] + window[k + 1]) / 2


def test_labels_of_ids_that_repeat(spark):
    texts, quality = corpus(200)
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    x, y = quality_ranker.labelled_sample(docs, labels, "quality", 12_000)
    twice = quality_ranker.labelled_sample(docs.unionByName(docs), labels, "quality", 12_000)
    assert np.array_equal(x, twice[0]) and np.array_equal(y, twice[1])
    some = [quality_ranker.labelled_sample(docs.repartition(n), labels, "quality", 50) for n in (1, 5)]
    assert len(some[0][1]) == 50 and np.array_equal(some[0][0], some[1][0])


def test_the_chain_gives_the_first_rule_that_holds(spark):
    rng = np.random.default_rng(8)
    x = rng.random((400, len(NAMES)))
    rules = [[decision_list.Condition(NAMES[int(rng.integers(len(NAMES)))], bool(rng.integers(2)), float(rng.random())) for _ in range(int(rng.integers(1, 4)))] for _ in range(6)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], ", ".join(["doc_id long", *(f"{n} double" for n in NAMES)]))
    got = {r.doc_id: r.rule for r in df.select("doc_id", decision_list.conditional(rules).alias("rule")).collect()}
    for i, row in enumerate(x.tolist()):
        values = dict(zip(NAMES, row, strict=True))
        want = next((k for k, rule in enumerate(rules, 1) if all(values[c.name] > c.value if c.above else values[c.name] <= c.value for c in rule)), 0)
        assert got[i] == want
    texts, _ = corpus(120)
    rules = [[decision_list.Condition("symbol_share", True, 0.1)], [decision_list.Condition("upper_share", True, 0.3), decision_list.Condition("log_words", False, 5.0)]]
    for r in decision_list.judged(frame(spark, [*texts, *ODD]), rules).collect():
        v = dict(zip(NAMES, features([*texts, *ODD][r.doc_id]), strict=True))
        want = 1 if v["symbol_share"] > 0.1 else 2 if v["upper_share"] > 0.3 and v["log_words"] <= 5.0 else 0
        assert r.base_failed or (r.rule, r.kept) == (want, want == 0)


def test_very_long_texts(spark, library):
    from mirrorfold.llm import secrets

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(1_300_000)) + " MIT License token=abcdefghijklmnop"
    assert len(text) > 6_000_000
    docs = frame(spark, [text, "x" * 7_000_000])
    scanned = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    assert (scanned[0].n_words, scanned[0].first_word, scanned[0].labels) == (1_300_004, 1_300_000, "mit") and scanned[1].n_words == 1
    assert {r.doc_id: (r.n_assign, r.spans) for r in secrets.digests(docs).collect()} == {0: (1, f"assign:{len(text) - 22}:{len(text)}"), 1: (0, "")}
    assert {r.doc_id: r.fp % 2**64 for r in simhash.with_fingerprints(docs).collect()} == {0: plain_fingerprint(text), 1: plain_fingerprint("x" * 7_000_000)}
    assert {r.doc_id: r.n_words for r in decision_list.judged(docs, []).collect()} == {0: 1_300_003, 1: 1}
    ids = library.encode(text, add_bos=True, add_eos=True)
    got = {r.doc_id: r for r in sentencepiece_bpe.round_trip(docs, piece_model_path()).collect()}
    assert got[0].n_tokens == len(ids) and got[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(b"x" * 7_000_000).hexdigest()


def test_nothing_to_learn_from(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranker = quality_ranker.fit_ranker(docs, none)
    assert {r.score for r in quality_ranker.score_documents(docs, ranker).collect()} == {1.0}
    assert decision_list.fit_rules(docs, none) == []
    assert decision_list.judged(docs, []).count() == len(ODD)
    assert decision_list.judged(frame(spark, []), []).count() == 0


def test_a_list_is_the_chain_of_its_rules():
    c = decision_list.Condition
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(NAMES)))
    good = ~((x[:, 2] > 0.8) & (x[:, 5] <= 0.5) | (x[:, 9] > 0.9))
    rules = decision_list.learn(x, good.astype(int), NAMES)
    bad = np.zeros(len(x), bool)
    for r in rules:
        bad |= decision_list._covered(x, r, NAMES)
    assert (bad == ~good).mean() > 0.98
    assert str(c("upper_share", True, 0.5)) == "upper_share > 0.5"
