"""Importance resampling with hashed n-gram models.

Two bag-of-n-grams models over hashed single words and word pairs are counted:
one of target texts, one of all texts.  A text's log weight is the sum of the
log ratios of its n-grams, that is the log of the ratio of what the two models
give the text.  Gumbel noise on the log weights and the k largest sums are a
sample without replacement in proportion to the weights.  Ratios of long texts
are far apart; ``effective`` scales each to so many n-grams (off by default).

Texts do not move: models of all texts need no key, and for the target ones
each text's buckets, two bytes an n-gram, meet the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import whole_rows
from kindred.runtime import cut_lineage

#: Hash buckets of the models (at most 65,536), rows held at a time.
BUCKETS, ROWS = 10_000, 256


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the single words and word pairs of a text, lower case."""
    import xxhash
    words = text.lower().encode("utf-8", "surrogatepass").split()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    both = np.concatenate((h, (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(3))))
    return (both >> np.uint64(20)) % np.uint64(buckets)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _totals(rows: DataFrame, counted, buckets: int) -> np.ndarray:
    """Sums of the bucket counts that ``counted(batch)`` yields; each task sends ``buckets`` rows at most."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for part in _slices(batches):
            for g in counted(part):
                total += np.bincount(g, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])
    out = np.zeros(buckets, dtype=np.int64)
    for b, n in rows.mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gram_counts(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of every bucket over all texts and over those whose ``doc_id`` is in ``target`` (once each), 2 rows.

    Target ids grow with the corpus and are never broadcast.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches):
        for part in _slices(batches):
            found = [grams(x, buckets).astype("<u2").tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc_id", "grams"])
    raw = _totals(texts.select("text"), lambda part: (grams(x, buckets).astype(np.int64) for x in part.column(0).to_pylist()), buckets)
    held = texts.where(F.col("doc_id").isNotNull()).mapInArrow(packed, f"doc_id {kind}, grams binary").join(target.hint("merge"), "doc_id", "left_semi")
    hit = _totals(held.select("grams"), lambda part: (np.frombuffer(x, "<u2") for x in part.column(0).to_pylist()), buckets)
    return np.stack((raw, hit))


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log ratio of the target model to the raw model, with one added to every count."""
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def weigh(docs: DataFrame, ratio: np.ndarray, keep: list[str] | None = None, effective: float | None = None, **beside: Column) -> DataFrame:
    """``doc`` (the columns ``keep``, null: all), ``log_weight``, and ``beside`` (columns made from ``doc``).

    Texts without words (null, empty) get null.
    """
    held = F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])
    rows = whole_rows(docs).select(held.alias("doc"), F.coalesce(F.col("doc.text"), F.lit("")).alias("text"), *[c.alias(n) for n, c in beside.items()])
    names = ["doc", "log_weight", *beside]

    def run(batches):
        for part in _slices(batches):
            w = []
            for x in part.column(1).to_pylist():
                r = ratio[grams(x, len(ratio)).astype(np.int64)]
                w.append(round(float(r.sum() if effective is None else r.mean() * effective), 6) if len(r) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w, pa.float64()), *part.columns[2:]], names=names)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("log_weight", T.DoubleType()), *[rows.schema[n] for n in beside]]))


def gumbel(seed: int, *key: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the key only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top(df: DataFrame, score: str, k: int, bins: int = 1024) -> DataFrame:
    """Adds ``selected``: is the row among the ``k`` largest scores (ties at the end: all in)?

    The k-th score is found by counting rows in equal intervals and refining
    the one it lies in; no row is moved and the driver sees ``bins`` counts.
    """
    low, high, n = df.agg(F.min(score), F.max(score), F.count(score)).first()
    if not n or k <= 0:
        return df.withColumn("selected", F.lit(False))
    if k >= n:
        return df.withColumn("selected", F.col(score).isNotNull())
    above = 0
    while high > low:
        step = (high - low) / bins
        if low + step == low or high - step == high:
            break
        i = F.least(F.floor((F.col(score) - low) / step), F.lit(bins - 1))
        counts = dict(df.where(F.col(score).between(low, high)).groupBy(i.alias("i")).count().collect())
        at, seen = bins - 1, above
        while seen + counts.get(at, 0) < k:
            seen += counts.get(at, 0)
            at -= 1
        inside = df.where(F.col(score).between(low, high) & (i == at)).agg(F.min(score), F.max(score)).first()
        above, (low, high) = seen, inside
        if counts[at] == 1:
            break
    return df.withColumn("selected", F.coalesce(F.col(score) >= low, F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, keep: list[str] | None = None,
             effective: float | None = None) -> DataFrame:
    """``doc``, ``log_weight``, ``score`` (with noise) and ``selected`` for every document.

    Target texts are those that ``labels`` (``doc_id``, ``quality``) marks with
    quality 1; a document with several labels needs one.  ``share`` of the
    texts with words is selected; null takes the share of quality 1 among the
    labelled ones.  Without labels all weights are 0 and all texts with words
    are selected.  Null and empty texts have no weight and are not selected.
    Repeated rows have equal scores and are selected together.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = marks.agg(F.count(F.lit(1)), F.sum((F.col("quality") == 1).cast("int"))).first()
    share = share if share is not None else (good or 0) / n if n else 1.0
    counts = gram_counts(docs, marks.where("quality = 1").select("doc_id"))
    ratio = log_ratio(counts) if counts[1].any() else np.zeros(BUCKETS)
    weighed = weigh(docs, ratio, keep, effective, noise=gumbel(seed, F.col("doc.doc_id")))
    scored = cut_lineage(weighed.select("doc", "log_weight", (F.col("log_weight") + F.col("noise")).alias("score")), "scores")
    texts = scored.where(F.col("log_weight").isNotNull()).count()
    return top(scored, "score", round(share * texts))
