"""Licences named in texts: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the and/or/with expression behind a tag.

Phrases are matched on words: A-Z are lower-cased and words are runs of ASCII letters, digits and non-ASCII
characters. A phrase counts wherever its words stand one after the other, and so does an identifier tag, in
whichever way its words are joined. The rest of the tag's line, behind a colon if there is one, is parsed as a
licence expression; a malformed one gives the labels of the part that parses and a lower score.

Results for unusual rows: a null text counts as empty; a text without words or phrases has null first and last
places, empty labels and score 0; phrases that overlap count each; a very long text is held whole by one task,
with its words; repeated rows give repeated results; an empty table gives an empty result; of the input's columns
only ``keep`` and the text are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.arrow import map_arrow

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices whose labels this scan adds.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu gpl": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "bsd",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "python software foundation license": "psf",
    "php license": "php",
    "ruby license": "ruby",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "postgresql license": "postgresql",
    "openssl license": "openssl",
    "university of illinois ncsa open source license": "ncsa",
    "w3c software notice and license": "w3c",
    "do what the fuck you want to public license": "wtfpl",
    "zlib license": "zlib",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier",)
#: Families of identifiers, by prefix.
FAMILIES = {
    "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "cc0": "cc0", "cc-pddc": "public-domain",
    "agpl": "agpl", "lgpl": "lgpl", "gfdl": "gfdl", "gpl": "gpl", "apache": "apache", "mit": "mit", "x11": "mit", "bsd": "bsd", "0bsd": "bsd",
    "mpl": "mpl", "epl": "epl", "cddl": "cddl", "cpl": "cpl", "eupl": "eupl", "osl": "osl", "afl": "afl", "artistic": "artistic", "ms-pl": "ms-pl",
    "ms-rl": "ms-rl", "psf": "psf", "python": "psf", "php": "php", "ruby": "ruby", "ofl": "ofl", "odbl": "odbl", "sspl": "sspl", "busl": "busl",
    "elastic": "elastic", "postgresql": "postgresql", "openssl": "openssl", "ncsa": "ncsa", "w3c": "w3c", "wtfpl": "wtfpl", "isc": "isc",
    "bsl": "boost", "unlicense": "unlicense", "zlib": "zlib", "unicode": "unicode", "blueoak": "blueoak", "curl": "curl", "json": "json",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_REST = re.compile(r"[ \t]*:?([^\r\n]*)")
_TOKEN = re.compile(r"[ \t]*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
_ORDER = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """Family of an identifier by the longest prefix that is known; of others, the identifier itself."""
    x = identifier.lower().rstrip("+")
    return FAMILIES[max(known, key=len)] if (known := [k for k in FAMILIES if x == k or x.startswith(k + "-")]) else x


def is_identifier(word: str) -> bool:
    """A known family, or a word formed like an identifier; prose that follows a tag is neither."""
    return family(word) in FAMILIES.values() or any(c in "-." or c.isdigit() for c in word.rstrip("."))


def parse_expression(text: str) -> tuple[list, bool]:
    """Expression in reverse Polish order, and whether all of it is well formed.

    ``with`` binds tighter than ``and``, that tighter than ``or``. What follows the first token that can't
    continue the expression is left alone, as prose often follows a tag.
    """
    out: list = []
    operators: list[str] = []
    wants, at, whole = True, 0, True
    while (m := _TOKEN.match(text, at)) is not None:
        opened, closed, word = m.groups()
        name = word.lower() if word else ""
        if wants:
            if opened:
                operators.append("(")
            elif word and name not in _ORDER and is_identifier(word):
                out.append(word)
                wants = False
            else:
                whole = False
                break
        elif closed:
            if "(" not in operators:
                break
            while operators[-1] != "(":
                out.append((operators.pop(),))
            operators.pop()
        elif name in _ORDER:
            while operators and operators[-1] != "(" and _ORDER[operators[-1]] >= _ORDER[name]:
                out.append((operators.pop(),))
            operators.append(name)
            wants = True
        else:
            break
        at = m.end()
    if wants and operators and operators[-1] != "(":  # an operator without its right side
        operators.pop()
        whole = False
    if not out:
        return [], False
    while operators:
        if (x := operators.pop()) == "(":
            whole = False
        else:
            out.append((x,))
    return out, whole


def evaluate(expression: list) -> tuple[set[str], set[str]]:
    """All families that an expression names, and those that apply whichever alternative is chosen.

    Sets only grow, the smaller into the larger, so the cost stays near the number of identifiers; an exception
    behind ``with`` names no family.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for x in expression:
        if isinstance(x, str):
            stack.append(({family(x)}, {family(x)}))
        elif len(stack) > 1:
            (b, sure_b), (a, sure_a) = stack.pop(), stack.pop()
            if x[0] == "with":
                stack.append((a, sure_a))
                continue
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
            if x[0] == "or":
                sure_a &= sure_b
            else:
                sure_a, sure_b = (sure_a, sure_b) if len(sure_a) >= len(sure_b) else (sure_b, sure_a)
                sure_a |= sure_b
            stack.append((a, sure_a))
    return stack[-1] if stack else (set(), set())


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in (*PHRASES, *NOTICES, *TAGS):
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_MADE: list[ahocorasick.Automaton] = []


def behind(text: str, words: list[int]) -> Iterator[str]:
    """What follows the words of these numbers (rising) on their lines, without a colon that comes first."""
    if not words:
        return
    wanted = iter(words)
    nxt = next(wanted)
    for k, m in enumerate(_WORD.finditer(text)):
        if k == nxt:
            yield _REST.match(text, m.end())[1]
            if (nxt := next(wanted, None)) is None:
                return


def scan(text: str | None) -> dict:
    """Places and labels in one whole text."""
    if not _MADE:
        _MADE.append(_automaton())
    text = text or ""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base, own, tags = [], set(), []
    at, index = 0, 0
    for end, phrase in _MADE[0].iter(joined):
        if phrase in NOTICES:
            own.add(NOTICES[phrase])
            continue
        start = end - len(phrase) - 1
        if start >= at:
            index += joined.count(" ", at, start)
        else:
            index -= joined.count(" ", start, at)
        at = start
        (base if phrase in PHRASES else tags).append((index, phrase))
    whole = True
    for rest in behind(text, [i + p.count(" ") for i, p in tags]):
        parsed, good = parse_expression(rest)
        whole &= good
        own |= evaluate(parsed)[0]
    labels = {PHRASES[p] for _, p in base}
    # Each place, label and tag halves the doubt.
    doubt = 0.5 ** min(len(base) + len(own) + len(tags), 60)
    places = [i for i, _ in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | own)),
        "score": (1 - doubt) * (1.0 if whole else 0.8),
    }


FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


def scan_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the results of ``scan`` per row, in one pass without a shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep])
    for k, t in FIELDS.items():
        schema = schema.add(k, t)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([x[k] for x in found], kinds[t]) for k, t in FIELDS.items())], names=[*keep, *FIELDS])

    return map_arrow(docs.select(*keep, "text"), run, schema)
