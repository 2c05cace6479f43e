"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A tokenisation is what the merges would give exactly when every two adjacent tokens are what the
merges give for their concatenation: merges inside a token do not depend on its surroundings, and the
first merge over a boundary would also be made in the two tokens alone. So the encoder walks from left
to right, takes the longest vocabulary entry (the trie of an Aho-Corasick automaton tells how far entries
reach from a position), checks it against its left neighbour by merging the two again, and goes back to shorter
entries where no continuation fits. A bitfield of failed positions keeps each position from being
explored twice.

Results for unusual rows: a null text counts as empty; an empty text gives the begin and end ids only and
decodes to the empty text; of pieces with equal scores the leftmost merge comes first; a very long text is held
whole by one task, with its ids; repeated rows give repeated results; an empty table gives an empty result; other
columns of the input are kept, but for one that is named like the result, which is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow, ship

SPACE = "▁"
#: Words whose encoding a Python worker remembers, in each of two generations.
MEMO = 150_000
REPLACEMENT = "�".encode()


class PieceModel:
    """Vocabulary of a model file, with its encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("not a merge-type model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text unchanged are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.surface: list[bytes] = []
        self.byte_of: dict[int, int] = {}
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            surface = p.piece.replace(SPACE, " ").encode()
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif p.type == kinds.NORMAL:
                self.rank[p.piece], self.ids[p.piece] = -p.score, i
            elif p.type == kinds.UNKNOWN:
                self.unknown, surface = i, proto.trainer_spec.unk_surface.encode()
            elif p.type == kinds.CONTROL:
                surface = b""
            else:
                raise ValueError(f"piece type {p.type} is not supported")
            self.surface.append(surface)
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.piece = {i: p for p, i in self.ids.items()}
        surfaces = [bytes([self.byte_of[i]]) if i in self.byte_of else x for i, x in enumerate(self.surface)]
        self.sizes = np.fromiter(map(len, surfaces), np.int64, len(surfaces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(surfaces), np.uint8)
        self.cut = _cut_pattern(self.ids)
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.longest = max(map(len, self.ids))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: always the pair of the best score, of equals the leftmost."""
        part: list[str] = list(text)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := self.rank.get(x := part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, b, x))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, x = heapq.heappop(heap)
            if not part[a] or not part[b] or after[a] != b or part[a] + part[b] != x:
                continue
            part[a], part[b] = x, ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in part if x]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2 * MEMO:
                self.fits.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.fits[key] = self.merged(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text; a character outside the vocabulary becomes its bytes (or the unknown id)."""
        n, most, reach, entry = len(text), self.longest, self.automaton.longest_prefix, self.ids.get
        fits, compatible = self.fits.get, self.compatible
        failed = bytearray((n >> 3) + 1)
        ids: list[int] = []
        starts: list[int] = []
        at, length, last = 0, 0, -1  # length 0: as far as the automaton goes
        while at < n:
            if length == 0:
                length = reach(text[at : at + most])
                if length == 0:  # unknown: nothing merges over it
                    last = -ord(text[at]) - 1
                    ids.append(last)
                    starts.append(at)
                    at += 1
                    continue
            while length > 0:
                i = entry(text[at : at + length])
                if i is not None:
                    end = at + length
                    if not (failed[end >> 3] >> (end & 7)) & 1 and (last < 0 or fits(last << 32 | i) or compatible(last, i)):
                        break
                length -= 1
            if length > 0:
                ids.append(i)
                starts.append(at)
                at, length, last = end, 0, i
                continue
            # Nothing continues from here: back to the previous token's shorter entries.
            failed[at >> 3] |= 1 << (at & 7)
            end = at
            ids.pop()
            at = starts.pop()
            length = end - at - 1
            last = ids[-1] if ids else -1
            while length == 0:
                failed[at >> 3] |= 1 << (at & 7)
                end = at
                ids.pop()
                at = starts.pop()
                length = end - at - 1
                last = ids[-1] if ids else -1
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in chr(-i - 1).encode()]
            else:
                out.append(self.unknown)
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a whole text without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if self.cut is None:
            return packed_ids(self.backtrack(marked))
        known, learned = self.memo.get, self._learned
        return b"".join([known(w) or learned(w) for w in self.cut.findall(marked)])

    def _learned(self, word: str) -> bytes:
        """Packed ids of a word that the younger generation of the store lacks."""
        if (x := self.older.get(word)) is None:
            x = packed_ids(self.backtrack(word))
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.older = dict(self.memo)
                self.memo.clear()
            self.memo[word] = x
        return x

    def encode(self, text: str | None) -> list[int]:
        raw = self.packed(text or "")
        return [self.bos, *struct.unpack(f"<{len(raw) // 4}I", raw), self.eos]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: control ids give nothing, the mark of the added prefix goes, malformed bytes become U+FFFD."""
        x = np.asarray(ids, np.int64)
        sizes = self.sizes[x]
        if not sizes[1:-1].all():  # a control id inside ends a run of byte pieces
            return self._decode_leniently(x.tolist())
        total = int(sizes.sum())
        # Where each surface starts in the pool, less where it starts in the text.
        shift = self.starts[x] - (np.cumsum(sizes) - sizes)
        raw = self.pool[np.repeat(shift, sizes) + np.arange(total)].tobytes()
        if self.dummy_prefix and raw[:1] == b" ":
            first = int(x[np.flatnonzero(sizes)[0]])
            if first != self.unknown and first not in self.byte_of:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # malformed runs of byte pieces
            return self._decode_leniently(x.tolist())

    def _decode_leniently(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
            surface = self.surface[i]
            if surface and first:
                first = False
                if self.dummy_prefix and i != self.unknown and surface[:1] == b" ":
                    surface = surface[1:]
            out.append(surface)
        if run:
            out.append(lenient(bytes(run)))
        return b"".join(out).decode()


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _cut_pattern(pieces: Iterable[str]) -> re.Pattern | None:
    """Parts of a marked text between which no piece of the vocabulary reaches, so that no merge does either.

    A part is a run of marks with the letters, or the other characters, that follow it; where pieces mix letters
    with others, with all that follows up to the next mark; None where pieces hold marks further inside.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return None
    odd = {c for p in pieces for c in p if LETTER.match(c) and not c.isalpha()}
    letter = f"[^\\W\\d_{re.escape(''.join(sorted(odd)))}]"
    alpha = re.compile(letter)
    for p in pieces:
        kinds = {bool(alpha.match(c)) for c in p if c != SPACE}
        if len(kinds) > 1:
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    other = f"(?:[^\\w{SPACE}]+|[\\d_{re.escape(''.join(sorted(odd)))}]+)+"
    return re.compile(f"{SPACE}*{letter}+|{SPACE}*{other}|{SPACE}+")


LETTER = re.compile(r"[^\W\d_]")


def lenient(raw: bytes) -> bytes:
    """Valid characters of a run of bytes; each byte that starts none becomes U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            if len(raw[i : i + n]) == n:
                out.append(raw[i : i + n])
                i += n
                break
        else:
            out.append(REPLACEMENT)
            i += 1
    return b"".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(df: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each whole text as an array, begin and end ids included."""

    ship(df.sparkSession)

    @F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
    def encoded(x):
        return model(model_path).encode(x)

    return df.withColumn(ids, encoded(F.col(text)))


def decode_documents(df: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; a null array gives an empty text."""

    ship(df.sparkSession)

    @F.udf(T.StringType(), useArrow=True)
    def decoded(x):
        return model(model_path).decode([int(i) for i in x] if x is not None else [])

    return df.withColumn(text, decoded(F.col(ids)))


def round_trip(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of the ids and of the decoded text per row, in one pass that sends no token back to the JVM.

    Returns ``keep``, n_tokens (begin and end included), ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (UTF-8).
    """
    kept = list(keep)
    digests = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        bos, eos = struct.pack("<I", m.bos), struct.pack("<I", m.eos)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(text):
                raw = b"".join((bos, m.packed(x.as_py() or ""), eos))
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(m.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(v, t) for v, (_, t) in zip((n, a, b), digests, strict=True))],
                names=[*kept, *(k for k, _ in digests)],
            )

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_arrow(df.select(*kept, text), run, schema)
