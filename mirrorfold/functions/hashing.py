"""Content digests. On binary columns all but the two marked ones are built-in expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .arrow import ship

QUICK = 1024


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_hash(content: Column | str, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest of all bytes; null stays null."""
    c = _column(content)
    if algorithm == "md5":
        return F.md5(c)
    if algorithm == "sha1":
        return F.sha1(c)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(c, int(algorithm[3:]))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def quick_hash(content: Column | str, algorithm: str = "sha256", size: int = QUICK) -> Column:
    """Digest of the first ``size`` bytes."""
    return full_hash(F.substring(_column(content), 1, size), algorithm)


def partial_hash(content: Column | str, algorithm: str = "sha256", size: int = QUICK, positions: list[tuple[int, int]] | None = None) -> Column:
    """Digest of the head, the middle and the tail (or of given offset-length pairs); of all bytes if small."""
    c = _column(content)
    n = F.octet_length(c)
    if positions is not None:
        parts = [F.substring(c, at + 1, length) for at, length in positions]
        return full_hash(F.concat(*parts), algorithm)
    middle = F.floor(n / 2).cast("int")
    parts = F.concat(F.substring(c, 1, size), F.substring(c, middle + 1, F.lit(size)), F.substring(c, n - size + 1, F.lit(size)))
    return F.when(n <= 3 * size, full_hash(c, algorithm)).otherwise(full_hash(parts, algorithm))


def verify_hash(content: Column | str, expected: Column | str, algorithm: str = "sha256") -> Column:
    return F.coalesce(full_hash(content, algorithm) == _column(expected), F.lit(False))


def has_hash(h: Column | str = "hash") -> Column:
    return _column(h).isNotNull() & (_column(h) != "")


def tier(size: Column | str, full_below: int = 1 << 20, quick_below: int = 100 << 20) -> Column:
    """How a file of this size is fingerprinted: full, quick then full, or sampled."""
    s = _column(size)
    return F.when(s < full_below, "full").when(s < quick_below, "quick").otherwise("sampled")


def strategy(n: Column, mean: Column, largest: Column) -> Column:
    """One strategy for a set of files, from their number, mean and largest size."""
    return F.when(n == 0, "full").when(mean < 1024, "full").when(largest > 100 << 20, "partial").otherwise("quick")


def blake2b(content: Column | str, digest_size: int = 32) -> Column:
    """BLAKE2b, which Spark lacks: an Arrow batch function."""

    @F.pandas_udf("string")
    def digest(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=digest_size).hexdigest())

    return digest(_column(content))


def sample_positions(size: int, sample: int) -> list[tuple[int, int]]:
    """Offsets and lengths of a sampled hash: head, places spread by the golden ratio, tail."""
    out = [(0, sample)]
    for i in range(1, min(10, size // sample)):
        at = int((size * i * 1.618033988749895) % size)
        out.append((at, min(sample, size - at)))
    return [*out, (size - sample, sample)]


def sampling_hash(content: Column | str, sample: int = 1 << 20, algorithm: str = "sha256") -> Column:
    """Digest of samples of a large content. Lossy: equal values need a full hash to confirm. An Arrow batch function."""
    ship(SparkSession.active())

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        h = hashlib.new(algorithm)
        for at, n in [(0, len(b))] if len(b) <= 3 * sample else sample_positions(len(b), sample):
            h.update(b[at : at + n])
        return h.hexdigest()

    @F.pandas_udf("string")
    def digest(x: pd.Series) -> pd.Series:
        return x.map(one)

    return digest(_column(content))
