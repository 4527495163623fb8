"""Language by nearest centroid of TF-IDF n-gram vectors.

A text is a vector of hashed letter pairs and triples, weighted by square root
of the count times inverse document frequency, of length 1.  Document
frequencies are counted over all training rows.  Each language has several
centroids, found by spherical k-means on a bounded sample of its rows, since
short texts, names and tables of one language lie apart.  A text gets the
language of the centroid with the largest cosine; it is rejected if even that
is too far away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import whole_rows

DIM = 2048
#: Rows of the sample that centroids are fitted on, over all languages; centroids of a language.
SAMPLE_ROWS, CENTROIDS = 6_000, 4
#: A text is rejected if its cosine is below this share of the lowest one percent of its language's sample.
REACH = 0.5
ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, every run of anything else as one 0."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    far = c >= 0x250
    letter = ((c >= 97) & (c <= 122)) | np.isin(c, (0xAA, 0xB5, 0xBA)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~far)
    if far.any():  # beyond Latin: ask for each distinct character
        seen, at = np.unique(c[far], return_inverse=True)
        letter = letter.copy()
        letter[far] = np.array([chr(x).isalpha() for x in seen], dtype=bool)[at]
    c = np.where(letter, c, 0)
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """How many letter pairs and triples fall into each of ``dim`` buckets."""
    c = _letters(text)
    pair = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = pair[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
    both = np.concatenate((pair, triple))
    both ^= both >> np.uint64(31)
    both *= np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((both >> np.uint64(40)).astype(np.int64) % dim, minlength=dim)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """One row a text: weighted counts of length 1 (no letter: all 0)."""
    out = np.zeros((len(texts), len(idf)), dtype=np.float32)
    for i, x in enumerate(texts):
        if x and _LETTER.search(x):
            v = np.sqrt(counts(x, len(idf))) * idf
            out[i] = v / max(np.linalg.norm(v), 1e-12)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centers: np.ndarray      # one row a centroid
    languages: list[str]     # of each centroid
    floors: np.ndarray       # cosine below which a text is rejected, of each centroid


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def document_frequencies(texts: DataFrame, dim: int = DIM) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are; each task sends ``dim`` numbers at most."""
    def run(batches):
        df = np.zeros(dim + 1, dtype=np.int64)
        for part in _slices(batches):
            for x in part.column(0).to_pylist():
                df[:dim] += counts(x, dim) > 0
                df[dim] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])
    total = np.zeros(dim + 1, dtype=np.int64)
    for b, n in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        total[b] = n
    return total[:dim], int(total[dim])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean and then each time the row farthest from all centers."""
    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    centers = [unit(x.mean(axis=0))]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.argmin((x @ np.array(centers).T).max(axis=1))])
    c = np.array(centers)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([unit(x[near == i].mean(axis=0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def fit(rows: DataFrame, dim: int = DIM, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> Model:
    """Model of ``rows`` (``text``, ``lang``, ``key``: anything that tells rows apart).

    Rows without text, letter or label are left out.  The driver gets document
    frequencies, the row count of each label and about ``sample_rows`` vectors:
    those with the smallest hashes, as many for each label.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.ones(dim), np.zeros((0, dim), dtype=np.float32), [], np.zeros(0))
    df, n = document_frequencies(rows.select("text"), dim)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    each = max(1, sample_rows // len(sizes))
    share = F.lit(1.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / size))).otherwise(share)
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(chance < share).select("lang", "text")

    def run(batches):
        for part in _slices(batches):
            v = vectors(part.column(1).to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "v"])
    by: dict[str, list[bytes]] = {}
    for lang, v in sample.mapInArrow(run, "lang string, v binary").collect():
        by.setdefault(lang, []).append(bytes(v))
    centers, languages, floors = [], [], []
    for lang in sorted(by):
        x = np.frombuffer(b"".join(sorted(by[lang])), dtype=np.float32).reshape(-1, dim)
        c = _kmeans(x, k)
        floor = REACH * float(np.quantile((x @ c.T).max(axis=1), 0.01))
        centers.append(c)
        languages += [lang] * len(c)
        floors += [floor] * len(c)
    return Model(idf, np.concatenate(centers).astype(np.float32), languages, np.array(floors))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds to ``doc`` (the columns ``keep``, null: all): ``lang_pred``, ``score``, ``accepted``.

    Null text or text without a letter: ``und``, score 0, not accepted.
    ``score`` is the cosine of the nearest centroid, ``accepted`` is false if
    that is too small.  Without any learned language all is ``und``.
    """
    rows = whole_rows(docs).select((F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])).alias("doc"),
                                   F.col("doc.text").alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("accepted", T.BooleanType())])
    idf, centers, languages, floors = model.idf, model.centers, [*model.languages, "und"], model.floors

    def run(batches):
        for part in _slices(batches):
            v = vectors(part.column(1).to_pylist(), idf)
            empty = ~v.any(axis=1)
            if len(centers):
                cos = v @ centers.T
                best = cos.argmax(axis=1)
                score = np.clip(np.round(cos.max(axis=1).astype(float), 5), 0.0, 1.0)
                ok = ~empty & (score >= floors[best])
            else:
                best, score, ok = np.zeros(len(v), dtype=int), np.zeros(len(v)), np.zeros(len(v), dtype=bool)
                empty[:] = True
            names = [languages[-1] if e else languages[b] for b, e in zip(best, empty, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(empty, 0.0, score)),
                                              pa.array(ok)], names=["doc", "lang_pred", "score", "accepted"])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from; a null ``doc_id`` has no remainder and is left out."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "text", "lang", F.col("doc_id").cast("string").alias("key"))
