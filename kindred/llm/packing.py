"""Pattern packing of token sequences by non-negative least squares.

A histogram of piece lengths has at most ``limit`` rows whatever the corpus,
so the plan is made on the driver: patterns of at most three lengths that fill
a sequence, repeat counts by non-negative least squares, rounded down, and the
rest by best fit on the histogram.  The plan is a list of templates, each with
the number of its sequences; its size depends on ``limit`` only.  Pieces are
numbered inside their length, and the number decides the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import vocab
from kindred.llm.common import numbered
from kindred.runtime import cut_lineage

LIMIT = 2048
#: Most remembered chunks of one worker; memory only.
MOST_CHUNKS = 250_000
#: Rows that are held at a time inside a task.
ROWS = 256


@cache
def _chunks(file: str) -> vocab.Chunks:
    return vocab.Chunks(vocab.json_packer(file, special=True), MOST_CHUNKS)


def pieces(docs: DataFrame, limit: int = LIMIT, file: str | None = None) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids``.

    A document's ids are its text's ids and then id 0; null text counts as
    empty and gives the one id 0.  No special tokens are added, but the string
    of one inside a text stands for its id, as in the file's own library.  More than ``limit`` ids are cut into pieces
    of ``limit``, of which the first may be shorter.  ``ids`` holds
    little-endian unsigned 32-bit numbers.  Other columns are not read.
    """
    file = file or vocab.path(vocab.MODEL)
    ids_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, piece, start, ids = [], [], [], []
                for i, packed in enumerate(chunks.encode(part.column(1).to_pylist())):
                    packed += b"\0\0\0\0"
                    n = len(packed) // 4
                    cuts = [0, *range((n - 1) % limit + 1, n + 1, limit)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        ids.append(packed[4 * a:4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {ids_type}, piece int, start bigint, length bigint, ids binary")


@dataclass
class Template:
    """``count`` sequences that each hold ``parts``: (length, how many of it)."""

    parts: list[tuple[int, int]]
    count: int

    def space(self, limit: int) -> int:
        return limit - sum(n * k for n, k in self.parts)


def patterns(bins: int) -> np.ndarray:
    """All ascending triples of bins that sum to ``bins``; 0 stands for none."""
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a <= b) & (b <= c) & (c < bins)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(cols: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares for columns given by row numbers (row 0 is ignored).

    Active set: let in the columns with the largest gain, no two of a round
    sharing a row, solve for the columns that are in, and walk back to the edge
    of the feasible region while a column would turn negative.
    """
    rows, n = len(h), len(cols)
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)

    def matrix(which: np.ndarray) -> np.ndarray:
        m = np.zeros((rows, len(which)))
        for j in range(cols.shape[1]):
            np.add.at(m, (cols[which, j], np.arange(len(which))), 1.0)
        m[0] = 0
        return m
    target = h.astype(float)
    target[0] = 0
    for _ in range(rounds):
        held = np.flatnonzero(inside)
        rest = target - (matrix(held) @ x[held] if len(held) else 0)
        rest[0] = 0
        gain = rest[cols].sum(axis=1)
        gain[inside] = -np.inf
        used, entered = np.zeros(rows, dtype=bool), 0
        for i in np.argsort(-gain)[:max(64, rows // 8)]:
            mine = cols[i][cols[i] > 0]
            if gain[i] > 1e-6 * max(1.0, target.max()) and not used[mine].any():
                used[mine] = inside[i] = True
                entered += 1
        if not entered:
            break
        while True:
            held = np.flatnonzero(inside)
            m = matrix(held)
            gram = m.T @ m
            gram[np.diag_indices(len(held))] += 1e-9
            z = np.linalg.solve(gram, m.T @ target)
            if (z > 1e-9).all():
                x[:] = 0
                x[held] = z
                break
            low = z <= 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                steps = np.where(low, x[held] / np.maximum(x[held] - z, 1e-12), np.inf)
            step = min(1.0, steps.min())
            x[held] += step * (z - x[held])
            out = held[low & (x[held] <= 1e-9)]
            x[out] = 0
            inside[out] = False
    return x


def plan(counts: np.ndarray, limit: int = LIMIT, bins: int = 256) -> list[Template]:
    """Templates for ``counts[n]`` pieces of length ``n`` (0 to ``limit``)."""
    left = counts.astype(np.int64).copy()
    width = -(-limit // bins)
    templates = []
    if left[limit]:
        templates.append(Template([(limit, 1)], int(left[limit])))
        left[limit] = 0
    bin_of = -(-np.arange(limit + 1) // width)
    cols = patterns(limit // width)
    repeats = np.floor(nnls(cols, np.bincount(bin_of, weights=left, minlength=limit // width + 1)) + 1e-6).astype(np.int64)
    for i in np.flatnonzero(repeats):
        *small, large = sorted(int(b) for b in cols[i] if b)
        want = int(repeats[i])
        while want:
            # longest piece of the larger bins; the last place goes to the piece that fills best
            picks: list[int] = []
            for b in [large, *small[:0:-1]]:
                picks += _longest(left, min(b * width, limit - sum(picks)), width, picks)
            room = limit - sum(picks)
            picks += _longest(left, room, 3 * width, picks)
            if len(picks) <= len(small) or sum(picks) < limit - 1:
                break  # best fit finds better company for these
            parts = [(n, picks.count(n)) for n in dict.fromkeys(picks)]
            take = int(min(want, *(left[n] // k for n, k in parts)))
            for n, k in parts:
                left[n] -= k * take
            templates.append(Template(parts, take))
            want -= take
    return best_fit(left, templates, limit)


def _longest(left: np.ndarray, most: int, reach: int, taken: list[int]) -> list[int]:
    """The longest length of at most ``most`` and above ``most - reach`` that is left beside ``taken``, as a list; empty if none is."""
    for n in range(most, max(most - reach, 0), -1):
        if left[n] > taken.count(n):
            return [n]
    return []


def best_fit(left: np.ndarray, templates: list[Template], limit: int) -> list[Template]:
    """Puts the remaining pieces, longest first, where the least space stays; opens new sequences where none fits."""
    spaces: dict[int, list[Template]] = {}
    done = []
    for t in templates:
        spaces.setdefault(t.space(limit), []).append(t)
    for n in range(limit, 0, -1):
        c = int(left[n])
        while c:
            fits = [s for s in spaces if s >= n]
            if not fits:
                each = limit // n
                for size, count in ((each, c // each), (c % each, 1)):
                    if size and count:
                        t = Template([(n, size)], count)
                        spaces.setdefault(t.space(limit), []).append(t)
                break
            s = min(fits)
            t = spaces[s].pop()
            if not spaces[s]:
                del spaces[s]
            each = s // n
            full = c // each
            use = min(t.count, full) if full else 1
            put = each if full else c
            if t.count > use:
                spaces.setdefault(s, []).append(Template(t.parts, t.count - use))
            new = Template([*t.parts, (n, put)], use)
            spaces.setdefault(new.space(limit), []).append(new)
            c -= use * put
    for s in sorted(spaces):
        done += spaces[s]
    return done


def segments(templates: list[Template]) -> np.ndarray:
    """Rows ``length, first number, sequence, repeats, offset`` sorted by length and first number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for t in templates:
        at = 0
        for n, k in t.parts:
            first = used.get(n, 0)
            rows.append((n, first, sequence, k, at))
            used[n] = first + k * t.count
            at += n * k
        sequence += t.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(found: DataFrame, order: list[str], limit: int = LIMIT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``limit``.

    ``order`` names columns that tell pieces apart.  ``found`` is written to
    the shared folder once.  Equal pieces get places of their own; an empty
    table gives no rows.
    """
    found = cut_lineage(found, "pieces")
    counts = np.zeros(limit + 1, dtype=np.int64)
    for n, c in found.groupBy("length").count().collect():  # at most ``limit`` rows
        counts[n] = c
    rows = segments(plan(counts, limit))
    lengths, firsts = rows[:, 0], rows[:, 1]
    fields = found.schema.fieldNames()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths << 40 | firsts
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, n << 40 | number, side="right") - 1
            k = number - firsts[at]
            seq, off = rows[at, 2] + k // rows[at, 3], rows[at, 4] + k % rows[at, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(seq), pa.array(off)],
                                             names=[*fields, "sequence_id", "offset"])
    buckets = max(32, int(counts.sum() // 200_000))
    return numbered(found, ["length"], order, "_number", buckets).select(*fields, "_number").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, limit: int = LIMIT, file: str | None = None) -> DataFrame:
    """Pieces of all documents and their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece with id 0.  A null ``doc_id`` stays
    null.  Repeated rows are packed each.  The ids themselves are dropped
    before the table is written; ``pieces`` gives them.
    """
    found = pieces(docs, limit, file).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(found, ["doc_id", "piece", "start", "ids_crc32"], limit)
