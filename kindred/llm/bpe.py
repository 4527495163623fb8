"""Byte-level BPE by longest matches and backtracking.

The merges of BPE give each piece one encoding, and an encoding is that one
exactly if each two neighbouring tokens are: if encoding the joined bytes of
the two gives the two back.  So a piece is encoded from the left: take the
longest token that starts here, go on if it fits the token before, else try
the next shorter one, and step back if none fits.  Places where stepping back
has failed are remembered, so no place is tried twice and the time is linear.
The automaton finds all tokens in the piece in one pass; bytes are mapped to
the characters with the same numbers.  Whether two tokens fit is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import vocab

#: Most remembered pieces and token pairs of one worker; memory only, results do not depend on it.
MOST_PIECES, MOST_PAIRS = 300_000, 500_000


class Merges:
    """A rank file made ready: automaton, splits of every token, next shorter prefix tokens."""

    def __init__(self, file: str):
        import ahocorasick
        self.ids = vocab.ranks(file)
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (1 - len(token), rank))
        self.automaton.make_automaton()
        self.parts = [self._parts(r) for r in range(len(self.tokens))]
        self.shorter = [self._shorter(token) for token in self.tokens]
        self.fits = vocab.Memo(self._fits, MOST_PAIRS)
        import regex
        self.split = regex.compile(vocab.pattern()).findall
        self.width = [len(t) for t in self.tokens]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.chunks = vocab.Chunks(self._pack, MOST_PIECES)

    def _parts(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one (None: it is never made by a merge)."""
        parts = [self.ids[bytes([b])] for b in self.tokens[rank]]
        while len(parts) > 2:
            joined = [(self.ids.get(self.tokens[a] + self.tokens[b], rank), i)
                      for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            low, i = min(joined)
            if low >= rank:
                return None
            parts[i:i + 2] = [low]
        return tuple(parts) if len(parts) == 2 else None

    def _shorter(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (rank := self.ids.get(token[:n])) is not None:
                return rank
        return -1

    def _fits(self, key: int) -> bool:
        """Do these two tokens stay apart when their joined bytes are encoded?

        Undo their merges from the latest one.  A merge across the border would
        have come first if its rank is below that of all merges undone so far.
        """
        left, right = key >> 32, key & 0xFFFFFFFF
        limit = len(self.tokens)
        while True:
            span = self.ids.get(self.tokens[left] + self.tokens[right])
            if span is not None and span < limit:
                return False
            made_left, made_right = (r if self.parts[r] else -1 for r in (left, right))
            if made_left == made_right == -1:
                return True
            # merges of one rank run from the left, so of equal tokens the right one was made last
            if made_left > made_right:
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ids.get(piece)) is not None and (self.parts[whole] is not None or len(piece) == 1):
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + back] = rank  # ends rise, so the longest match of a start is its last
        fits, width, shorter, dead = self.fits, self.width, self.shorter, bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + width[token]
            if not dead[end] and (last < 0 or fits[last << 32 | token]):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this place is dead, step back
                dead[at] = 1
                gone = out.pop()
                at -= width[gone]
                token, last = shorter[gone], out[-1] if out else -1

    def _pack(self, texts: list[str]) -> list[bytes]:
        packed, encode, split = self.packed, self.encode_bytes, self.split
        return [b"".join([packed[i] for piece in split(x) for i in encode(piece.encode())]) for x in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        return [np.frombuffer(x, dtype="<i4") for x in self.chunks.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, in order."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        place = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[place].tobytes()


@cache
def merges(file: str) -> Merges:
    return Merges(file)


#: Rows that are held at a time inside a task.
ROWS = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, "<i4")]).astype(np.int32)))


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, file: str | None = None,
           out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of ``text`` as ``array<int>``; the columns ``keep`` (null: all) stay.

    Null text counts as empty and gives an empty array.  A column of the name
    ``out`` is replaced.  Repeated rows and an empty table need no care: one
    row in, one row out, no shuffle.
    """
    file = file or vocab.path(vocab.RANKS)
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("\x00text"))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        own = merges(file)
        for part in _slices(batches):
            ids = _lists(own.encode(part.column(len(kept)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], ids], names=[*kept, out])
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, file: str | None = None,
           out: str = "bytes") -> DataFrame:
    """Adds ``out``: the bytes that ``ids`` stand for (null: none), as ``binary``; the columns ``keep`` (null: all) stay."""
    file = file or vocab.path(vocab.RANKS)
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("\x00ids"))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        own = merges(file)
        for part in _slices(batches):
            lists = part.column(len(kept))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            ends = ends - ends[0]
            made = pa.array([own.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], made], names=[*kept, out])
    return rows.mapInArrow(run, schema)
