"""Groups of near-equal documents by the Jaccard similarity of their word shingles, exactly.

A document is the set of its distinct five-word shingles, as 64-bit hashes.
Documents with equal sets form one class and are compared once.  Two sets of
similarity t or more share one of the first ``n - ceil(t n) + 1`` elements of
each in any common order, so classes that share such a key are candidates.  The
order goes from rare to frequent: a fixed table of counters is filled by one
pass over all texts, and a shingle's place is its counter, then its hash.
Candidates meet in
tiles: a key and a band of sizes, and sets whose sizes lie more than one band
apart are too different to link.  A pair is first judged by hashed bitmaps: a
bit set in one and not in the other is a shingle that is not shared, which
bounds the overlap from above.  What passes is compared by exact intersection
of sorted arrays.

Large groups need no large number of pairs, since only components count:

* A few keys per class link it to the best-known class with the same key; what
  is linked then needs no further comparison inside its group.
* Pairs are made between different groups only.
* A key that many groups share makes no pairs.  Passages and notices come last
  in the order, so few classes have one; these are compared again under the
  order of their shingles' exact frequency among themselves.  There, rounds of
  stars come first: every class is compared with one class of each of its keys,
  another one each round, which joins large groups without their pairs.  Then
  the tiles make their pairs in parts, the first of about as many as rows, each
  four times the share of the one before: a class outside a large group is
  compared with a few of its members, and with more only while none links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import whole_rows
from kindred.runtime import cut_lineage, release

#: Words of a shingle; similarity in hundredths.
WORDS, PERCENT = 5, 80
#: A key shared by more groups than this is compared under the second order.
COMMON = 100
#: Keys per class and rounds of the first linking; most rounds of stars, and the share of pairs that must link for one more.
LINK_KEYS, LINK_ROUNDS = 6, 2
STAR_ROUNDS, STAR_SHARE = 6, 0.02
#: Growth of the parts of the last tiles, and numbers that deal pairs to them (a power of it).
PART, NUMBERS = 4, 1 << 40
#: Rows held at a time in a task; more ids than this, of two numbers each, are not broadcast (4 MB).
ROWS, BROADCAST_ROWS = 256, 250_000
#: Counters of the order, four bytes each, whatever the corpus; a power of two.
COUNTERS = 1 << 18
#: Words with more bytes are hashed one by one: a polynomial over 64-bit numbers cannot tell some of these apart.
LONG_WORD = 256
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
          np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]

_GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUES = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 256, dtype=np.uint64)
_VALUES[ord("A"):ord("Z") + 1] = _VALUES[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_grown = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""
    while len(_grown[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = _grown[i]
            _grown[i] = np.concatenate((x, x * np.uint64(pow(base, len(x), 1 << 64))))
    return _grown


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word of UTF-8 bytes; A-Z count as a-z, words end at ASCII white space.

    A word is a polynomial of random byte values over the ring of 64-bit numbers.  With
    running sums of ``value * base ** position`` a word is the difference of two sums, times
    the inverse power of its start, so no step loops over words.
    """
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, dtype=bool)
    gap[1:-1] = _GAPS[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[b] * up[:len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        import xxhash
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]].lower())
    h ^= h >> np.uint64(32)
    h *= _SEEDS[0]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed 64-bit numbers.

    A shorter text is one shingle; its hash also depends on the number of words.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return np.empty(0, dtype=np.int64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = (out ^ h[j:len(h) - n + 1 + j]) * _SEEDS[j % len(_SEEDS)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def shingle_counts(docs: DataFrame, words: int = WORDS, counters: int = COUNTERS) -> np.ndarray:
    """How many rows have a shingle of each counter (the low bits of its hash); a task sends ``counters`` rows at most."""
    def run(batches):
        total = np.zeros(counters, dtype=np.int64)
        for part in _slices(batches):
            found = [shingles(x, words) for x in part.column(0).to_pylist()]
            total += np.bincount(np.concatenate([*found, np.empty(0, np.int64)]) & (counters - 1), minlength=counters)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["c", "n"])
    rows = docs.select("text").mapInArrow(run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(counters, dtype=np.int64)
    out[rows["c"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def rare_first(hashes: np.ndarray, counts: np.ndarray, few: int) -> np.ndarray:
    """The ``few`` first of sorted hashes in the order of their counters, then of the hashes."""
    place = counts[hashes & (len(counts) - 1)]
    return hashes[np.argsort(place, kind="stable")[:few]]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of the first elements, in any order of all shingles, must hold one that a similar set has."""
    return n - -(-n * percent // 100) + 1 if n else 0


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Signature of a set: about four bits an element, a power of two; bit ``h mod size`` is set."""
    size = 64 << max(0, math.ceil(math.log2(max(1, len(hashes)) / 16)))
    bits = np.zeros(size, dtype=np.uint8)
    bits[hashes.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little")


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """Largest possible intersection of two sets with these bitmaps; the longer one is folded to the shorter."""
    def fold(x: np.ndarray, size: int) -> np.ndarray:
        while len(x) > size:
            x = x[:len(x) // 2] | x[len(x) // 2:]
        return x
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _class_id(hashes: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n, cid, keys`` of every row: ``cid`` names the set (null: empty), ``keys`` are its first shingles from rare to frequent."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))

    def run(batches):
        for part in _slices(batches):
            sets = [shingles(x, words) for x in part.column(1).to_pylist()]
            first = [rare_first(s, counts.value, prefix_size(len(s), percent)) for s in sets]
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.empty(0, np.int64)])))],
                names=["doc_id", "n", "cid", "keys"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, cid bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, give: str, repeats: bool) -> DataFrame:
    """Sets of the classes in ``wanted`` (``cid, doc_id``), made again from the text of one document each.

    ``give`` chooses the columns: ``cid, n, bits``; ``cid, hashes``; or ``cid, n, key`` with a row per shingle.
    Sets take more room than texts, so they are not kept.  ``repeats``: rows may agree in both id and text, of which one counts.
    """
    few = wanted.count() <= BROADCAST_ROWS
    w = wanted.select("cid", F.col("doc_id").alias("_doc"))
    rows = docs.select("doc_id", "text").join(F.broadcast(w) if few else w, F.col("doc_id").eqNullSafe(F.col("_doc")))

    def run(batches):
        for part in _slices(batches):
            found = [(cid, s) for cid, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                     if len(s := shingles(x, words)) and _class_id(s) == cid]
            cid, n = np.array([c for c, _ in found], np.int64), np.array([len(s) for _, s in found], np.int64)
            if give == "bits":
                out = {"cid": cid, "n": n, "bits": pa.array([bitmap(s).tobytes() for _, s in found], pa.binary())}
            elif give == "hashes":
                out = {"cid": cid, "hashes": pa.array([s.tobytes() for _, s in found], pa.binary())}
            else:
                out = {"cid": np.repeat(cid, n), "n": np.repeat(n, n), "key": np.concatenate([*[s for _, s in found], np.empty(0, np.int64)])}
            yield pa.RecordBatch.from_pydict(out)
    schema = {"bits": "cid bigint, n bigint, bits binary", "hashes": "cid bigint, hashes binary", "key": "cid bigint, n bigint, key bigint"}
    out = rows.select("cid", "text").mapInArrow(run, schema[give])
    return out.dropDuplicates(["cid", "key"] if give == "key" else ["cid"]) if repeats else out


def _linked(pairs: DataFrame, bits: DataFrame, made: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``: class ids) whose sets are similar: size, bitmaps (``cid, n, bits``), then exact
    intersection of the sets that ``made`` gives (``cid, hashes``) for classes (``cid``).

    These sets are written while they are compared, so that no task runs two Python steps in a row.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("cid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "cid"])

    def enough(x: int, n_a: int, n_b: int) -> bool:
        return 100 * x >= percent * (n_a + n_b - x)

    def bounded(batches):
        for part in _slices(batches):
            r = part.to_pydict()
            ok = [enough(overlap_bound(np.frombuffer(p, np.uint8), n, np.frombuffer(q, np.uint8), m), n, m)
                  for n, m, p, q in zip(r["n_a"], r["n_b"], r["bits_a"], r["bits_b"], strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def exact(batches):
        for part in _slices(batches):
            ok = []
            for p, q in zip(part.column("hashes_a"), part.column("hashes_b"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), np.int64)
                both = np.sort(np.concatenate((p, q)), kind="stable")
                ok.append(enough(int((both[1:] == both[:-1]).sum()), len(p), len(q)))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    near = (pairs.join(side(bits, "a"), "a").join(side(bits, "b"), "b")
            .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
            .mapInArrow(bounded, "a bigint, b bigint"))
    near = cut_lineage(near, "near")
    ids = near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct()
    sets = cut_lineage(made(ids), "sets")
    met = near.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    out = cut_lineage(met.select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, "a bigint, b bigint"), "links")
    release(sets)
    release(near)
    return out


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """``cid, comp`` after adding ``links`` (``a, b``) to the groups in ``comp``; a group is named by its smallest class.

    Rounds of contraction: every group points at the smallest of itself and
    its neighbours (a combining aggregate), pointers are followed once, edges
    are rewritten to the groups pointed at and the rest goes on.
    """
    ends = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).distinct()
    state = ends.withColumn("comp", F.col("cid"))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if comp is not None:
        state = comp.unionByName(state.join(comp, "cid", "left_anti"))
        edges = _renamed(edges, comp.select(F.col("cid").alias("old"), F.col("comp").alias("new")))
    state, edges = cut_lineage(state, "groups"), cut_lineage(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "low")
        twice = low.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jump = cut_lineage(low.join(twice, "v", "left").select(F.col("u").alias("old"), F.coalesce("w", "v").alias("new")), "jump")
        used = state, edges, low
        state = cut_lineage(state.join(jump, F.col("comp") == F.col("old"), "left").select("cid", F.coalesce("new", "comp").alias("comp")), "groups")
        edges = cut_lineage(_renamed(edges, jump).where(F.col("u") != F.col("v")).distinct(), "edges")
        for x in (*used, jump):
            release(x)
    return state


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends looked up in ``names`` (``old, new``); smaller end first."""
    u = names.select(F.col("old").alias("u"), F.col("new").alias("nu"))
    v = names.select(F.col("old").alias("v"), F.col("new").alias("nv"))
    e = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("nu", "u").alias("u"), F.coalesce("nv", "v").alias("v"))
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _with_groups(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Adds ``comp``; a class without a link is a group of its own."""
    return rows.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _tiles(rows: DataFrame, percent: int, part: int = 1, seen: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of different groups that meet in a tile: same key, same or next band of sizes.

    Only pairs whose numbers have a sum divisible by ``part`` meet, without those of ``seen``, a multiple of it.

    ``pos`` is the key's place in the order of the set.  If this is the first
    key that two sets share, what they share lies at and behind it; a similar
    pair has enough left there, and its first shared key says so.
    """
    step = math.log(100 / percent)
    band = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    number = F.pmod(F.xxhash64("cid"), F.lit(NUMBERS))
    left = rows.select("key", band.alias("band"), F.pmod(number, F.lit(part)).alias("part"), number.alias("_i"), F.col("cid").alias("x"), F.col("comp").alias("comp_x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"))
    right = rows.select("key", F.explode(F.array(band - 1, band)).alias("band"), F.pmod(-number, F.lit(part)).alias("part"), number.alias("_j"),
                        band.alias("_own"), F.col("cid").alias("y"),
                        F.col("comp").alias("comp_y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y"))
    left_over = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    new = F.lit(True) if seen is None else (F.col("_i") + F.col("_j")) % seen != 0
    met = left.join(right, ["key", "band", "part"] if part > 1 else ["key", "band"]).where(
        new & (F.col("comp_x") != F.col("comp_y")) & ((F.col("_own") > F.col("band")) | (F.col("x") < F.col("y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & ((100 + percent) * left_over >= percent * (F.col("n_x") + F.col("n_y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _stars(rows: DataFrame, comp: DataFrame, linked: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Groups (``cid, comp``) after rounds in which the classes of a key (``rows``: ``key, cid, n``) meet one class of it that is in another group.

    A round makes at most one pair a row.  Rounds go on while pairs link; what
    they miss is left to the tiles.
    """
    for turn in range(STAR_ROUNDS):
        now = _with_groups(rows, comp)
        star = now.groupBy("key").agg(F.max_by(F.struct("cid", "comp", "n"), F.xxhash64("cid", "key", F.lit(turn))).alias("s"))
        near = 100 * F.least("n", F.col("s.n")) >= percent * F.greatest("n", F.col("s.n"))
        pairs = now.join(star, "key").where((F.col("comp") != F.col("s.comp")) & near).select(
            F.least("cid", "s.cid").alias("a"), F.greatest("cid", "s.cid").alias("b")).distinct()
        pairs = cut_lineage(pairs, "stars")
        found = linked(pairs)
        tried, met = pairs.count(), found.count()
        release(pairs)
        if met:
            comp = _merged(comp, found)
        if met <= STAR_SHARE * tried:
            break
    return comp


def _joined(rows: DataFrame, comp: DataFrame, linked: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Groups (``cid, comp``) after all pairs of the tiles of ``rows`` (``key, cid, n, pos``), in parts.

    Every pair has one part.  Pairs whose groups an earlier part has joined are not made, nor rows of keys with one group left.
    """
    sizes = _with_groups(rows, comp).groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
    most = sizes.groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0
    # a pair may meet at each of its keys: as many as a class has, on average
    n, classes = rows.count(), rows.select("cid").distinct().count()
    part, seen = 1, None
    while most * classes > n * n * part and part < NUMBERS:
        part *= PART
    while True:
        now = _with_groups(rows, comp)
        apart = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        now = cut_lineage(now.join(apart.select("key"), "key"), "apart")
        pairs = cut_lineage(_tiles(now, percent, part, seen), "pairs")
        if pairs.limit(1).count():
            links = linked(pairs)
            comp = _merged(comp, links)
            release(links)
        more = part > 1 and now.limit(1).count()
        release(pairs)
        release(now)
        if not more:
            return comp
        part, seen = part // PART, part


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, cid`` of every row, and ``cid, doc_id, comp`` of every class (its smallest id, its group)."""
    docs = docs.select("doc_id", "text")
    keyed = cut_lineage(_signed(docs, words, percent), "keyed")
    signed = cut_lineage(keyed.select("doc_id", "n", "cid"), "signed")
    classes = signed.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    classes = cut_lineage(classes, "classes")
    repeats = bool(signed.where(F.col("cid").isNotNull()).groupBy("cid", "doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).limit(1).count())
    keys = keyed.select("cid", F.posexplode("keys").alias("pos", "key"))
    # keys that two rows or more have; equal documents count as several here and meet as one class below
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    rows = cut_lineage(keys.join(shared, "key").groupBy("cid", "key").agg(F.first("df").alias("df"), F.min("pos").alias("pos")), "shared")
    release(keyed)
    bits = cut_lineage(_sets(docs, rows.select("cid").distinct().join(classes, "cid"), words, "bits", repeats), "bits")
    sized = cut_lineage(rows.join(bits.select("cid", "n"), "cid"), "sized")
    release(rows)

    def made(ids: DataFrame) -> DataFrame:
        return _sets(docs, ids.join(classes, "cid"), words, "hashes", repeats)

    def linked(pairs: DataFrame) -> DataFrame:
        return _linked(pairs, bits, made, percent)

    links = []
    comp = None
    for turn in range(LINK_ROUNDS):  # the best-known class of a key is the one whose keys are shared most
        mine = sized.groupBy("cid").agg(F.avg("df").alias("fame"), *[
            F.min(F.xxhash64("key", F.lit(turn), F.lit(i))).alias(f"k{i}") for i in range(LINK_KEYS)])
        offers = mine.select("cid", "fame", F.explode(F.array(*[f"k{i}" for i in range(LINK_KEYS)])).alias("k"))
        best = offers.groupBy("k").agg(F.max(F.struct("fame", "cid")).alias("m"), F.count(F.lit(1)).alias("c")).where(
            F.col("c") > 1).select("k", F.col("m.cid").alias("center"))
        pairs = offers.join(best, "k").where(F.col("cid") != F.col("center")).select(
            F.least("cid", "center").alias("a"), F.greatest("cid", "center").alias("b")).distinct()
        if comp is not None:
            of = comp.select(F.col("cid").alias("a"), F.col("comp").alias("comp_a"))
            to = comp.select(F.col("cid").alias("b"), F.col("comp").alias("comp_b"))
            pairs = pairs.join(of, "a", "left").join(to, "b", "left").where(
                F.coalesce(F.col("comp_a") != F.col("comp_b"), F.lit(True))).select("a", "b")
        links.append(linked(pairs))
        comp = _merged(comp, links[-1])

    grouped = cut_lineage(_with_groups(sized, comp).select("key", "cid", "comp", "n", "pos"), "grouped")
    release(sized)
    spread = grouped.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("groups"))
    spread = cut_lineage(spread.where(F.col("groups") > 1), "spread")
    light = grouped.join(spread.where(F.col("groups") <= COMMON), "key").select("key", "cid", "comp", "n", "pos")
    links.append(linked(cut_lineage(_tiles(light, percent), "pairs")))

    hard = grouped.join(spread.where(F.col("groups") > COMMON), "key").select("cid").distinct()
    hard = cut_lineage(hard, "hard")
    release(grouped)
    comp = _merged(comp, links[-1])
    if hard.limit(1).count():
        rare = _rare_first(_sets(docs, hard.join(classes, "cid"), words, "key", repeats), percent)
        comp = _joined(rare, _stars(rare, comp, linked, percent), linked, percent)

    return signed, classes.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Two documents link when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest ``doc_id`` that links reach.  Null or
    empty text: no shingle, linked with nothing, its own component.  Equal sets
    are one class, however many rows have them.  A null ``doc_id`` stays null
    and its component is named by the other rows (null if there are none).  An
    empty table gives no rows.

    Sets and classes are told apart by 64-bit hashes.
    """
    signed, named = _grouped(docs, words, percent)
    low = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = named.join(low, "comp").select("cid", "component_id")
    return signed.join(names, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest ``doc_id`` stays.

    Texts without words are linked with nothing and stay.  If a group has no
    ``doc_id`` at all, any one row stays; of rows that agree in ``doc_id`` and
    shingles one stays.  Columns are those of ``docs``.
    """
    signed, named = _grouped(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")
    first = named.groupBy("comp").agg(F.min(order).alias("m")).select(F.col("m.cid").alias("cid"), F.struct(F.col("m.doc_id")).alias("keep"))
    counted = signed.where(F.col("cid").isNotNull()).groupBy("cid", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    leads = F.col("keep").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    judged = cut_lineage(counted.join(first, "cid", "left").select("cid", "doc_id", "c", leads.alias("stays")), "judged")
    whole = whole_rows(docs)
    schema = T.StructType([whole.schema["doc"], T.StructField("cid", T.LongType())])

    def run(batches):
        for part in _slices(batches):
            sets = [shingles(x, words) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64())],
                                             names=["doc", "cid"])
    rows = whole.select("doc", F.col("doc.text").alias("text")).mapInArrow(run, schema)

    def against(df: DataFrame, which: DataFrame, how: str) -> DataFrame:
        other = which.select(F.col("cid").alias("_cid"), F.col("doc_id").alias("_id"))
        other = F.broadcast(other) if which.count() <= BROADCAST_ROWS else other
        return df.join(other, (F.col("cid") == F.col("_cid")) & F.col("doc.doc_id").eqNullSafe(F.col("_id")), how)
    left = against(rows, judged.where(~F.col("stays")), "left_anti")
    twice = judged.where(F.col("stays") & (F.col("c") > 1))
    if not twice.limit(1).count():
        return left.select("doc.*")
    return against(left, twice, "left_anti").unionByName(against(left, twice, "left_semi").dropDuplicates(["cid"])).select("doc.*")


def _rare_first(own: DataFrame, percent: int) -> DataFrame:
    """``key, cid, n, pos``: the first shingles of the hard classes (``own``: ``cid, n, key``) in the order of their frequency among these."""
    df = own.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    many = own.join(df.where(F.col("df") > 1), "key")
    # shingles of one class only come first in the order and match nothing: they only use up places
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cid"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("df", "key")) + alone
    size = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    first = many.withColumn("_at", place).where(F.col("_at") <= size)
    return cut_lineage(first.select("key", "cid", "n", (F.col("_at") - 1).alias("pos")), "rare")
