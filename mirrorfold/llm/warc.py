"""WARC archives: writing captures, and assembling them again from their records.

A capture is three records of a WARC/1.1 file: the request, the response (or a revisit of an earlier one with
the same payload) and metadata. Request and metadata name the response in WARC-Concurrent-To. Archives are
written by Spark's text writer: a record is one line whose line end is the two line breaks that close a WARC
record, so files go wherever Spark can write, with its commit protocol, gzipped as a whole. Files are read as
binary rows and parsed as a stream by content length, never by searching for separators, so a payload may hold
anything. Assembly joins the three kinds of record on the response's identifier and gives one nested row per
capture.

Of the captures with equal payloads of ``least`` bytes or more, those with the smallest page_id are responses
and the others revisit it.

Results for unusual rows: a null html has an empty payload; a null url becomes ``about:blank``; a null page_id
never is the one that others revisit, so a row with it is a response only where no other row has its payload;
rows that repeat page_id and payload are written each, with the same identifiers, and come back each; a very long
page is one record in a file of its own, held whole by one task; other columns of the input are not read, so they
may have any names; an empty table gives an empty result. A response whose request or metadata is lost comes back with nulls in their place.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from .common import Scratch, materialized, shared_dir, sized_join, text_bytes

LEAST = 100
#: Captures in one archive file at most, bytes of payload that a file is meant to hold, and bytes from which a page counts as large.
PER_FILE, FILE_BYTES, LARGE = 4000, 64 << 20, 1 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _urn(kind: str, *parts: Column) -> Column:
    """Identifier that follows from the capture alone."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, rid: Column, url: Column, content: str, body: Column, *more: tuple[str, Column]) -> Column:
    """One record without its closing line breaks."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"Content-Type: {content}"),
        *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in more),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def slim(pages: DataFrame) -> DataFrame:
    """(page_id, bytes, digest) per page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(text_bytes("html"), 256).alias("digest"))


def with_revisits(pages: DataFrame, known: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, bytes, digest, first_id): first_id is the page that the row revisits, else null.

    Copies are found among ``known``, the ``slim`` rows. A page is joined to them where it is read, and shuffled only
    where there are more copies than can be broadcast.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(text_bytes("html"), 256))
    groups = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count("*").alias("n")).where("n > 1 AND least_id IS NOT NULL").select("digest", "least_id")
    marked = sized_join(p, materialized(groups, "copies", scratch), ["digest"])
    return marked.select("page_id", "url", "html", "bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id")).alias("first_id"))


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Write the captures of ``pages`` (page_id, url, html) below ``path`` and return it.

    An archive is read back as one cell, so files are kept near ``FILE_BYTES``: as many captures as that holds at
    the mean size, and large pages, if there are any, in files of their own by their largest size.
    """
    path = path or shared_dir(pages.sparkSession, "warc")
    with Scratch(pages.sparkSession) as scratch:
        known = materialized(slim(pages), "digests", scratch)
        lines = _lines(with_revisits(pages, known, scratch, least))
        large = F.col("bytes") >= LARGE
        size = known.agg(F.avg(F.when(~large, F.col("bytes"))).alias("mean"), F.max(F.when(large, F.col("bytes"))).alias("most")).first()
        for which, where, each in (("small", ~large, size["mean"]), ("large", large, size["most"])):
            if each is not None or which == "small":
                per_file = max(1, min(PER_FILE, int(FILE_BYTES // max(each or 1, 1))))
                lines.where(where).select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/{which}")
    return path


def _lines(c: DataFrame) -> DataFrame:
    """(value, bytes): the three records of each capture."""
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\s\x00]+", "%20")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rid = _urn("response", F.col("page_id"), F.col("digest"))
    revisit = F.col("first_id").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    request = _record(F.lit("request"), _urn("request", F.col("page_id"), F.col("digest")), url, "application/http; msgtype=request", F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)), ("WARC-Concurrent-To", rid))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), rid, url, "application/http; msgtype=response", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("first_id"), F.col("digest")))),
    )
    fields = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("fetcher: mirrorfold\r\n"))
    metadata = _record(F.lit("metadata"), _urn("metadata", F.col("page_id"), F.col("digest")), url, "application/warc-fields", fields, ("WARC-Concurrent-To", rid))
    return c.select(F.concat(request, F.lit(END), response, F.lit(END), metadata).alias("value"), "bytes")


class _Stream:
    """Decompressed bytes of one archive, read on demand; gzip members may follow one another."""

    STEP = 1 << 20

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer, self.start = memoryview(raw), 0, bytearray(), 0
        self.gz = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.start > 1 << 22:
            del self.buffer[: self.start]
            self.start = 0
        while self.at < len(self.raw) or (self.gz is not None and self.gz.unused_data):
            piece = self.raw[self.at : self.at + (1 << 18)]
            self.at += len(piece)
            if self.gz is None:
                self.buffer += piece
                return True
            if self.gz.eof:
                rest = self.gz.unused_data + bytes(piece)
                self.gz = zlib.decompressobj(31)
                out = self.gz.decompress(rest)
            else:
                out = self.gz.decompress(piece)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        look = self.start
        while (k := self.buffer.find(mark, look)) < 0:
            left = len(self.buffer) - self.start
            if not self.more():
                return None
            look = max(self.start, self.start + left - len(mark))
        out = bytes(self.buffer[self.start : k])
        self.start = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n and self.more():
            pass
        out = bytes(self.buffer[self.start : self.start + n])
        self.start += len(out)
        return out


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of every record of an archive; a torn last record is left out."""
    s = _Stream(raw)
    while (head := s.until(END.encode())) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {}
        for x in lines[1:]:
            k, _, v = x.partition(b":")
            headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        n = int(headers.get("content-length", 0))
        block = s.take(n)
        if len(block) < n:
            return
        s.take(4)
        yield headers, block


RECORD = pa.schema(
    [(c, pa.string()) for c in ("kind", "record_id", "concurrent_to", "refers_to", "url", "content_type", "declared_digest", "digest")]
    + [("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("http_head", pa.string()), ("payload", pa.binary())]
)


def parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A record as a row. The digest of a response is computed from its payload; a revisit declares its own."""
    kind = headers.get("warc-type")
    row = dict.fromkeys(RECORD.names)
    row |= {"kind": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "url": headers.get("warc-target-uri"), "content_type": headers.get("content-type")}
    declared = headers.get("warc-payload-digest", "")
    row["declared_digest"] = declared.partition(":")[2] or None
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        row["http_head"] = head.decode("utf-8", "replace")
        if kind == "response":
            row["payload_bytes"], row["digest"] = len(payload), hashlib.sha256(payload).hexdigest()
            if declared.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["declared_digest"] or declared.startswith("sha256:") and row["digest"] != row["declared_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not have its digest")
            if with_payload:
                row["payload"] = payload
        elif kind == "revisit":
            row["digest"] = row["declared_digest"]
            for x in head.split(b"\r\n"):
                k, _, v = x.partition(b":")
                if k.strip().lower() == b"content-length" and v.strip().isdigit():
                    row["payload_bytes"] = int(v)
    elif kind == "metadata":
        for x in block.split(b"\r\n"):
            k, _, v = x.partition(b":")
            if k.strip().lower() == b"page-id" and v.strip().lstrip(b"-").isdigit():
                row["page_id"] = int(v)
    return row


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in records(content.as_py()):
                    rows.append(parsed(headers, block, with_payload))
                    size += len(block)
                    if len(rows) >= 4096 or with_payload and size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    kinds = {"int64": "long", "binary": "binary", "string": "string"}
    schema = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in RECORD)
    return map_arrow(files, run, schema)


def assembled(found: DataFrame) -> DataFrame:
    """Transactions: one nested row per response or revisit, with its request, its metadata and what it revisits.

    ``found`` should be stored, for it is read once per kind of record.
    """
    answers = found.where(F.col("kind").isin("response", "revisit"))
    aside = found.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    # Several of a kind for one response: the one with the smallest identifier.
    request = F.struct("record_id", "url", "http_head")
    meta = F.struct("record_id", "page_id")
    about = aside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(F.col("kind") == "request", request)).alias("request"),
        F.min(F.when(F.col("kind") == "metadata", meta)).alias("metadata"),
    )
    response = F.struct("kind", "url", "content_type", "http_head", "payload_bytes", "digest", "payload", "refers_to")
    joined = answers.select("record_id", response.alias("response")).join(about, "record_id", "left")
    return joined.select("record_id", "request", "response", "metadata")


def with_origins(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """``captures`` with origin_page: the page of the response that a revisit refers to, else null."""
    wanted = captures.select(F.col("response.refers_to").alias("origin_id")).where("origin_id IS NOT NULL").distinct()
    known = captures.select(F.col("record_id").alias("origin_id"), F.col("metadata.page_id").alias("origin_page")).join(wanted, "origin_id", "left_semi").groupBy("origin_id").agg(F.min("origin_page").alias("origin_page"))
    return sized_join(captures.withColumn("origin_id", F.col("response.refers_to")), materialized(known, "origins"), ["origin_id"]).drop("origin_id")
