"""Archives: revisits, assembly, payloads that look like records, and torn or foreign files."""

import gzip
import hashlib
from collections import Counter

from mirrorfold.llm import warc
from mirrorfold.llm.common import materialized

LONG = "<p>é日🙂</p>" * 30
NASTY = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "\n"
ROWS = [
    (5, "http://a.example/x y", LONG), (2, "https://b.example/?q=1", LONG), (9, None, LONG), (1, "http://c/", "short"), (3, "http://c/", "short"), (4, "", None), (6, "u", ""),
    (7, "http://d/", NASTY), (8, "http://d/", NASTY), (10, "http://e/", "y" * 100), (11, "http://e/", "y" * 100), (12, "http://e/", "z" * 99), (13, "http://e/", "z" * 99),
    (20, "http://same/", LONG + "2"), (20, "http://same/", LONG + "2"), (None, "http://n/", LONG), (None, "http://n/", "n" * 200), (30, "http://big/", "ab" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string, digest string, bytes int"


def run(spark, rows):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    path = warc.write_archives(pages)
    return path, warc.with_origins(spark, materialized(warc.assembled(materialized(warc.read_records(spark, path), "records")), "captures"))


def test_round_trip(spark):
    path, captures = run(spark, ROWS)
    got = captures.collect()
    assert len(got) == len(ROWS)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == raw and j is not None]
        revisit = len(raw) >= 100 and same and i != min(same)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    seen = [(r.metadata.page_id, r.response.payload_bytes, r.response.digest, r.response.kind, r.origin_page) for r in got]
    assert Counter(seen) == Counter(want)
    for r in got:
        assert r.request.http_head.startswith("GET ") and r.request.url == r.response.url and not set(" \r\n") & set(r.request.url)
        if r.response.kind == "response":
            assert hashlib.sha256(r.response.payload).hexdigest() == r.response.digest
        else:
            assert r.response.payload is None and r.response.http_head.startswith("HTTP/1.1 200")
    ids = Counter(r.record_id for r in got)
    assert sum(n > 1 for n in ids.values()) == 1  # the repeated row
    assert run(spark, [])[1].count() == 0


def test_files_are_plain_archives(spark, tmp_path):
    path, _ = run(spark, ROWS[:5])
    from pathlib import Path

    raw = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path).rglob("*.gz"))
    found = list(warc.records(raw))
    assert Counter(h["warc-type"] for h, _ in found) == {"request": 5, "metadata": 5, "response": 3, "revisit": 2}
    by_id = {h["warc-record-id"] for h, _ in found}
    assert len(by_id) == 15 and all(h["warc-concurrent-to"] in by_id for h, _ in found if "warc-concurrent-to" in h)
    # members that follow one another, plain text, and an archive that breaks off
    members = b"".join(gzip.compress(raw[a:b]) for a, b in ((0, 700), (700, 705), (705, len(raw))))
    assert list(warc.records(members)) == found
    assert list(warc.records(raw[:-20])) == found[:-1]
    assert list(warc.records(b"")) == []


def test_lost_records_leave_nulls(spark, tmp_path):
    path, _ = run(spark, ROWS[:3])
    found = warc.read_records(spark, path, with_payload=False)
    assert all(r.request is None and r.metadata is not None for r in warc.assembled(found.where("kind <> 'request'")).collect())
    assert all(r.metadata is None for r in warc.assembled(found.where("kind <> 'metadata'")).collect())


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "LARGE", 9_000)
    rows = [(i, "http://a/", f"{i} " * (200 if i % 10 else 6000)) for i in range(100, 200)]
    path, captures = run(spark, rows)
    assert captures.count() == 100
    files = [f.read_bytes() for f in Path(path).rglob("*.gz")]
    assert len(files) >= 14 and max(len(gzip.decompress(f)) for f in files) < 60_000
