"""Numbers that describe a text, computed on its bytes with numpy; the learned filters share them.

Every number is defined for every text: a null counts as empty, and a ratio over nothing is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: White space of the word pattern ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these.
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

NAMES = [
    "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "bang_share", "punct_share",
    "wide_share", "white_share", "bar_per_word", "stop_per_word", "comma_per_word", "short_words", "long_words",
    "distinct_words", "top_word", "dup_lines", "words_per_line", "title_words", "symbol_words",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>@^~_=+\\{}[]")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True


def features(text: str | None) -> list[float]:
    """The values of NAMES for one text. Only the text counts."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    k = len(words)
    if not k:
        return [0.0] * len(NAMES)
    byte = np.frombuffer(raw, np.uint8)
    counts = np.bincount(byte, minlength=256)
    solid = n - counts[_WHITE].sum()
    lengths = np.fromiter(map(len, words), np.int64, k)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    begin = byte[np.flatnonzero(np.r_[True, _WHITE[byte[:-1]]] & ~_WHITE[byte])]
    last = byte[np.flatnonzero(np.r_[_WHITE[byte[1:]], True] & ~_WHITE[byte])]
    return [
        float(np.log1p(k)),
        float(lengths.mean()),
        float(counts[_UPPER].sum() / solid),
        float(counts[_DIGIT].sum() / solid),
        float(counts[_SYMBOL].sum() / solid),
        float(counts[33] / solid),
        float(counts[_PUNCT].sum() / solid),
        float(counts[128:].sum() / solid),
        float((n - solid) / n),
        min(float(seen[b"|"] / k), 1.0),
        float(counts[46] / k),
        float(counts[44] / k),
        float((lengths <= 3).mean()),
        float((lengths >= 9).mean()),
        float(len(seen) / k),
        float(max(seen.values()) / k),
        float(1 - len(set(lines)) / len(lines)),
        float(np.log1p(k / len(lines))),
        float(_UPPER[begin].mean()),
        float((_SYMBOL[last] | (last == 33)).mean()),
    ]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i : n + i] for i in range(width)), strict=True))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((count[g] > 1 for g in grams), bool, n))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    solid = len(raw.translate(None, WHITE))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - (len(raw) - solid),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )
