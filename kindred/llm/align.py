"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cover the same bytes, a space and the text, so their tokens are
two ascending lists of byte ends.  A common end near the middle of an interval
is located by bisecting one list for an end of the other, in turns, to the
right and, if nothing is there, to the left.  Both halves are intervals of
their own; an interval without a common end inside is a group.  All intervals
of a level, over many documents, are searched at the same time.

Tokens that share a group are linked.  How many documents hold a linked id pair
is counted over the corpus.  The most frequent pairs, a bounded number, go to
all tasks; every other pair is looked up by a join.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import vocab
from kindred.llm.common import whole_rows
from kindred.runtime import cut_lineage, release

PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at a time inside a task, remembered chunks of a worker; memory only.
BYTES, MOST_CHUNKS = 1 << 20, 300_000
#: Most pairs that every task gets (17 bytes each), and most products of one group that are held at a time.
FREQUENT, PRODUCTS = 1 << 18, 1 << 20


class Tokens:
    """Bytes of a vocabulary's tokens, as arrays."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.size)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        shift = self.start[ids] - (np.cumsum(size) - size)
        return self.bytes[np.arange(size.sum()) + np.repeat(shift, size)].tobytes()


class Tokenizers:
    """Both tokenizers of a worker; ``encode`` gives ids of a list of texts, each with a space before the text.

    Texts are cut at single spaces and line ends, and the chunks are
    remembered.  For A that is safe by its pattern; for B because none of its
    pieces has a space after another character, or a line end.
    """

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        ids, special, _ = vocab.byte_level(a_file)
        a = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            a[i] = token
        self.a = Tokens(a)
        self.a_chunks = vocab.Chunks(vocab.json_packer(a_file, special=False), MOST_CHUNKS)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.b = Tokens([self._bytes(i, p) for i, p in enumerate(pieces)])
        safe = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.b_chunks = vocab.Chunks(self._pack, MOST_CHUNKS, marks="") if safe else None

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _pack(self, texts: list[str]) -> list[bytes]:
        # the space that the model adds comes before the line end, and both are pieces of their own
        found = self.model.encode(["\n" + t for t in texts], num_threads=1)
        return [array("I", ids[2:]).tobytes() for ids in found]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        # a letter before the space is a piece of its own; with it no text starts with white space, which chunks cannot
        led = ["a " + t for t in texts]
        a = [np.frombuffer(x, dtype="<u4", offset=4).astype(np.int64) for x in self.a_chunks.encode(led)]
        if self.b_chunks is None:
            return a, [np.array(x, dtype=np.int64) for x in self.model.encode(texts, num_threads=1)]
        return a, [np.frombuffer(x, dtype="<u4", offset=4).astype(np.int64) for x in self.b_chunks.encode(led)]


@cache
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def _to_the_right(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first common end from ``a[i]`` on, as places in both lists; the last end of an interval is common."""
    i, j = i.copy(), np.searchsorted(b, a[i])
    todo = np.flatnonzero(b[j] != a[i])
    while len(todo):
        i[todo] = np.searchsorted(a, b[j[todo]])
        todo = todo[a[i[todo]] != b[j[todo]]]
        j[todo] = np.searchsorted(b, a[i[todo]])
        todo = todo[a[i[todo]] != b[j[todo]]]
    return i, j


def _to_the_left(a: np.ndarray, b: np.ndarray, i: np.ndarray, a_low: np.ndarray, b_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last common end up to ``a[i]``; a place below ``a_low`` if there is none."""
    i = i.copy()
    j = np.searchsorted(b, a[i], side="right") - 1
    todo = np.arange(len(i))
    while True:
        todo = todo[(i[todo] >= a_low[todo]) & (j[todo] >= b_low[todo])]
        todo = todo[a[i[todo]] != b[j[todo]]]
        if not len(todo):
            break
        i[todo] = np.searchsorted(a, b[j[todo]], side="right") - 1
        todo = todo[i[todo] >= a_low[todo]]
        j[todo] = np.searchsorted(b, a[i[todo]], side="right") - 1
    i[j < b_low] = -1
    return i, j


def groups(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places in ``a`` and ``b`` of each group, in order.

    ``a`` and ``b`` are ascending ends; ``a_cuts`` and ``b_cuts`` are the
    borders of the intervals to start from (documents), from 0 to the lengths.
    """
    a_low, a_high, b_low, b_high = a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a_low):
        whole = (a_high - a_low < 2) | (b_high - b_low < 2)
        done.append((a_low[whole], b_low[whole]))
        a_low, a_high, b_low, b_high = (x[~whole] for x in (a_low, a_high, b_low, b_high))
        if not len(a_low):
            break
        middle = (a_low + a_high - 2) // 2
        i, j = _to_the_right(a, b, middle)
        none = np.flatnonzero(i == a_high - 1)
        cut = np.ones(len(i), dtype=bool)
        leaf = np.zeros(len(i), dtype=bool)  # right halves known to have no cut
        if len(none):
            i[none], j[none] = _to_the_left(a, b, middle[none], a_low[none], b_low[none])
            cut[none] = i[none] >= a_low[none]
            leaf[none] = True
        done.append((a_low[~cut], b_low[~cut]))
        done.append((i[cut & leaf] + 1, j[cut & leaf] + 1))
        both = cut & ~leaf
        a_low, a_high, b_low, b_high = (np.concatenate(x) for x in (
            (a_low[cut], i[both] + 1), (i[cut] + 1, a_high[both]), (b_low[cut], j[both] + 1), (j[cut] + 1, b_high[both])))
        order = np.argsort(a_low, kind="stable")  # neighbours are bisected one after the other
        a_low, a_high, b_low, b_high = a_low[order], a_high[order], b_low[order], b_high[order]
    a_first, b_first = (np.concatenate([d[k] for d in done] or [np.empty(0, np.int64)]) for k in (0, 1))
    order = np.argsort(a_first, kind="stable")
    return a_first[order], b_first[order]


def _tally(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its numbers."""
    order = np.argsort(keys, kind="stable")
    keys, many = keys[order], many[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(many, first) if len(first) else many


def _links(ids_a: np.ndarray, ids_b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, row: np.ndarray,
           b_size: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``row * span + a * b_size + b`` of all links and how many there are of each."""
    a_n = np.diff(np.append(a_first, len(ids_a)))
    b_n = np.diff(np.append(b_first, len(ids_b)))
    found = []
    small = np.flatnonzero(a_n * b_n <= 64)
    for at in range(0, len(small), PRODUCTS // 64):
        g = small[at:at + PRODUCTS // 64]
        n = a_n[g] * b_n[g]
        of = np.repeat(np.arange(len(g)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        key = (row[g][of] * span + ids_a[a_first[g][of] + k // b_n[g][of]] * b_size + ids_b[b_first[g][of] + k % b_n[g][of]])
        found.append(_tally(key, np.ones(len(key), dtype=np.int64)))
    for g in np.flatnonzero(a_n * b_n > 64):  # distinct ids first, so a long run of one token costs little
        a, a_many = np.unique(ids_a[a_first[g]:a_first[g] + a_n[g]], return_counts=True)
        b, b_many = np.unique(ids_b[b_first[g]:b_first[g] + b_n[g]], return_counts=True)
        step = max(1, PRODUCTS // len(b))
        for at in range(0, len(a), step):
            key = row[g] * span + (a[at:at + step, None] * b_size + b).ravel()
            found.append((key, (a_many[at:at + step, None] * b_many).ravel()))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _tally(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


class Part:
    """The aligned tokens of some texts."""

    def __init__(self, own: Tokenizers, texts: list[str]):
        self.rows, self.own = len(texts), own
        ids_a, ids_b = own.encode(texts)
        for i, t in enumerate(texts):
            want = (" " + t).encode()
            sizes = own.a.size[ids_a[i]].sum(), own.b.size[ids_b[i]].sum()
            if not t or sizes != (len(want), len(want)) or own.a.joined(ids_a[i]) != want or own.b.joined(ids_b[i]) != want:
                ids_a[i] = ids_b[i] = np.empty(0, np.int64)
        self.a_cuts, self.b_cuts = (np.cumsum([0, *map(len, x)]) for x in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (ids_a, ids_b))
        held = np.flatnonzero(np.diff(self.a_cuts))  # rows with tokens
        starts = [np.append(c[held], c[-1]) for c in (self.a_cuts, self.b_cuts)]
        self.a_first, self.b_first = groups(np.cumsum(own.a.size[self.a]), np.cumsum(own.b.size[self.b]), *starts)
        self.row = np.searchsorted(self.a_cuts, self.a_first, side="right") - 1
        self.n_groups = np.bincount(self.row, minlength=self.rows)
        sizes = np.diff(np.append(self.a_first, len(self.a))) * np.diff(np.append(self.b_first, len(self.b)))
        self.n_links = np.zeros(self.rows, dtype=np.int64)
        np.add.at(self.n_links, self.row, sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Borders of the rows, distinct id pairs ``a * size of B + b`` of each row, and how often each is linked."""
        b_size = len(self.own.b)
        span = len(self.own.a) * b_size
        keys, many = _links(self.a, self.b, self.a_first, self.b_first, self.row, b_size, span)
        return np.searchsorted(keys, np.arange(self.rows + 1) * span), keys % span, many

    def texts(self) -> list[str]:
        """The groups of each row as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.own.a), len(self.own.b)
        names = _names(n_a, n_b)
        group_a = np.repeat(np.arange(len(self.a_first)), np.diff(np.append(self.a_first, len(self.a))))
        group_b = np.repeat(np.arange(len(self.b_first)), np.diff(np.append(self.b_first, len(self.b))))
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[:len(self.a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[:len(self.b)]
        code[np.arange(len(self.a)) + self.b_first[group_a]] = self.a + n_a * last_a
        code[np.arange(len(self.b)) + np.append(self.a_first, len(self.a))[group_b + 1]] = 2 * n_a + self.b + n_b * last_b
        ends = self.a_cuts + self.b_cuts
        return ["".join(map(names.__getitem__, code[x:y].tolist()))[:-1] for x, y in zip(ends, ends[1:], strict=False)]


@cache
def _names(n_a: int, n_b: int) -> list[str]:
    return [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]


def _lists(borders: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.astype(kind)))


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of at most ``BYTES`` characters, or of one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, keep: list[str] | None = None, text: str = "text", a_file: str | None = None, b_file: str | None = None,
          with_groups: bool = False) -> DataFrame:
    """Aligns every whole ``text``: ``doc`` (the columns ``keep``, null: all), ``n_a, n_b, n_groups, n_links, groups_sha256, pairs, many``.

    ``pairs`` are the distinct linked id pairs of the row as ``a * size of B +
    b``, ascending; ``many`` says how many links each has.  ``with_groups``
    adds the groups themselves, as a string.  A text that is null or empty, or
    whose tokens do not give back its bytes (a literal U+2581), has no tokens:
    zeros, empty lists and ''.  One row in, one row out; repeated rows, null
    ids and an empty table need no care, and ``doc`` keeps other columns
    apart.  A long text is one interval to start from; memory follows the
    longest text of a task.
    """
    a_file, b_file = a_file or vocab.path(vocab.MODEL), b_file or vocab.path(PIECES)
    held = F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])
    rows = whole_rows(docs).select(held.alias("doc"), F.coalesce(F.col(f"doc.`{text}`"), F.lit("")).alias("text"))
    kind = "bigint" if _pair_space(a_file, b_file) > 1 << 31 else "int"
    schema = (f"doc {rows.schema['doc'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              f"groups_sha256 string, pairs array<{kind}>, many array<int>" + (", `groups` string" if with_groups else ""))
    names = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "many", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a_file, b_file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, y in _parts(texts):
                part = Part(own, texts[x:y])
                borders, pairs, many = part.pairs()
                shown = part.texts()
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in shown]
                columns = [batch.column("doc").slice(x, y - x), pa.array(np.diff(part.a_cuts)), pa.array(np.diff(part.b_cuts)),
                           pa.array(part.n_groups.astype(np.int64)), pa.array(part.n_links), pa.array(digests, pa.string()),
                           _lists(borders, pairs, np.int64 if kind == "bigint" else np.int32), _lists(borders, many, np.int32)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(shown, pa.string())] if with_groups else []), names=names)
    return rows.mapInArrow(run, schema)


@cache
def _b_size(b_file: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=b_file).vocab_size()


def _pair_space(a_file: str, b_file: str) -> int:
    ids, special, _ = vocab.byte_level(a_file)
    return (max([*ids.values(), *special.values()]) + 1) * _b_size(b_file)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """How many rows hold each linked id pair: ``pair, n, best``; ``best``: no pair with its A id has more.

    Counts are combined before the shuffle, so a frequent pair costs one row a
    task.  The highest counts are one row for each A id at most.  The result is
    a table in the shared folder.
    """
    counts = cut_lineage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    a_id = F.floor(F.col("pair") / b_size)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("high"))
    out = cut_lineage(counts.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("high")).alias("best")), "pair_marks")
    release(counts)
    return out


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts and best marks of the most frequent pairs, ascending by pair; at most ``most``.

    A histogram over logarithms of the counts gives the lowest level that still fits.
    """
    level = F.floor(16 * F.log2("n"))
    sizes = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    low, held = None, 0
    for at, k in sizes:
        if held + k > most:
            break
        low, held = at, held + k
    if low is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    rows = counts.where(level >= low).toPandas().sort_values("pair")
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def count_links(aligned: DataFrame, b_file: str | None = None, most: int = FREQUENT) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the rows of ``align`` and drops ``pairs`` and ``many``.

    The input is written to the shared folder once and gets a row number
    there.  Links with a frequent pair are summed where the row is; the pairs
    that are left become rows, meet their counts in a join, and are summed by
    row number.  No pair is left out.
    """
    spark = aligned.sparkSession
    held = cut_lineage(aligned.withColumn("\x00row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(held, _b_size(b_file or vocab.path(PIECES)))
    known = spark.sparkContext.broadcast(frequent(counts, most))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value

        def made(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "pair", "m", "n_best", "count_sum"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists, row = part.column("pairs"), part.column("row").to_numpy(zero_copy_only=False)
                pairs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                many = part.column("many").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(row)), np.diff(np.asarray(lists.offsets)))
                place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
                sums = np.zeros((2, len(row)), dtype=np.int64)
                np.add.at(sums[0], of[hit], many[hit] * best[place[hit]])
                np.add.at(sums[1], of[hit], many[hit] * n[place[hit]])
                yield made(row, -1 - row, np.zeros_like(row), *sums)  # no pair has such a key: it spreads and meets nothing
                rest = pairs[~hit]
                yield made(row[of[~hit]], rest, many[~hit], np.zeros_like(rest), np.zeros_like(rest))
    found = held.select(F.col("\x00row").alias("row"), "pairs", "many").mapInArrow(
        look_up, "row bigint, pair bigint, m bigint, n_best bigint, count_sum bigint")
    rare = counts.select(F.col("pair").cast("bigint").alias("pair"), "n", "best")
    sums = found.join(rare, "pair", "left").groupBy(F.col("row").alias("\x00row")).agg(
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("m") * F.col("n"), F.lit(0))).alias("count_sum"))
    return held.drop("pairs", "many").join(sums, "\x00row").drop("\x00row")
