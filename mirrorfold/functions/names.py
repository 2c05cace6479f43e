"""Paths, ignore globs and sizes as text."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Folder of a path; ``/`` for what lies directly below the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, without the root."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def glob_pattern(glob: str) -> str:
    """Regular expression of a whole name for a shell glob, case-sensitive."""
    body = fnmatch.translate(glob)
    # Python writes the flags and the end in its own way; Java needs its own.
    body = body.removeprefix("(?s:").removesuffix("\\Z").removesuffix("\\z").removesuffix(")")
    return f"(?s)^(?:{body})$(?!\\n)" if body.endswith("$") else f"(?s)\\A(?:{body})\\z"


def ignored(name: Column, globs: tuple[str, ...], ignore_hidden: bool = False) -> Column:
    """Whether a scan leaves this name out."""
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_pattern(g))
    return out | name.startswith(".") if ignore_hidden else out


def path_ignored(path: Column, globs: tuple[str, ...], ignore_hidden: bool = False, root: str = "/") -> Column:
    """Whether any part of the path below the root is left out: an ignored folder takes its files with it."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return F.exists(F.filter(F.split(below, "/"), lambda x: x != ""), lambda x: ignored(x, globs, ignore_hidden))


def format_size(n: Column) -> Column:
    """Two decimals and the unit in which the value is below 1024; ties round to the even digit."""
    exact = n.cast("decimal(25,0)")
    out = None
    for i, unit in enumerate([*UNITS, "PB"]):
        size = F.lit(1024**i).cast("decimal(20,0)")
        hundredths = F.floor(exact * 100 / size).cast("decimal(28,0)") if i == 0 else _half_even(exact * F.lit(100).cast("decimal(3,0)"), size)
        text = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("decimal(2,0)").cast("string"), 2, "0"), F.lit(f" {unit}"))
        if unit == "PB":
            return out.otherwise(text)
        fits = exact < F.lit(1024 ** (i + 1)).cast("decimal(20,0)")
        out = F.when(fits, text) if out is None else out.when(fits, text)
    raise AssertionError


def _half_even(x: Column, unit: Column) -> Column:
    """x / unit as a whole number, ties to even."""
    left = x % unit
    down = ((x - left) / unit).cast("decimal(28,0)")
    return F.when((left * 2 > unit) | (left * 2 == unit) & (down % 2 == 1), down + 1).otherwise(down).cast("decimal(28,0)")
