"""Exact and approximate cosine top-k between two vector tables.

The exact search never builds the pair table.  Vectors are packed into blocks
of a bounded number of rows; one task row holds one left and one right block,
multiplies them and keeps only the k best per left vector.  Vectors that are
equal are searched once and expanded afterwards, so a large group of copies
costs one row in the grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIM_DIGITS = 8  # similarities are rounded here, so rank order does not depend on summation order


def _copies(df: DataFrame, id: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors under their smallest id, and the (id, rep) membership.

    Records without a vector, or with a component that is null, NaN or infinite, have no neighbours.
    """
    df = df.select(F.col(id).alias("id"), F.col(vec).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = df.where(F.col("v").isNotNull() & F.forall("v", finite))
    reps = df.groupBy("v").agg(F.min("id").alias("rep"))
    members = df.join(reps, "v").select("id", "rep")
    return reps, members


def _id_type(df: DataFrame, id: str) -> str:
    return df.schema[id].dataType.simpleString()


def _pack(df: DataFrame, keys: list[str], id_type: str) -> DataFrame:
    """One row per block: ids in order and the vectors as bytes, in the width of their column."""
    width = _width(df)
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        m = np.array(pdf["v"].tolist(), dtype=width).reshape(len(pdf), -1)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "ids": [pdf["rep"].tolist()], "m": [m.tobytes()]})

    return (df.select(*keys, "rep", "v").groupBy(*keys)
            .applyInPandas(pack, f"{key_ddl}, ids array<{id_type}>, m binary"))


def _width(df: DataFrame) -> str:
    """Number type of the vectors ``v``: doubles stay doubles."""
    return "<f4" if df.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"


def _unit(raw: bytes, n: int, width: str) -> np.ndarray:
    m = np.frombuffer(raw, dtype=width).reshape(n, -1).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best_in_cell(cells: DataFrame, k: int, l_type: str, r_type: str, l_width: str, r_width: str) -> DataFrame:
    """Multiply the two blocks of each row and keep k candidates per left vector."""

    def run(batches):
        for pdf in batches:
            for lids, lm, rids, rm in zip(pdf["lids"], pdf["lm"], pdf["rids"], pdf["rm"]):
                lids, rids = np.asarray(lids), np.asarray(rids)
                left, right = _unit(lm, len(lids), l_width), _unit(rm, len(rids), r_width).T
                for start in range(0, len(lids), 1024):
                    sims = np.round(left[start:start + 1024] @ right, SIM_DIGITS)
                    if sims.shape[1] > k:
                        cut = sims.shape[1] - k
                        kth = np.partition(sims, cut, axis=1)[:, cut]
                        rows, cols = np.nonzero(sims >= kth[:, None])
                    else:
                        rows, cols = np.nonzero(np.ones_like(sims, dtype=bool))
                    vals = sims[rows, cols]
                    order = np.lexsort((cols, -vals, rows))  # right ids are packed in order
                    rows, cols, vals = rows[order], cols[order], vals[order]
                    first = np.searchsorted(rows, rows, side="left")
                    keep = np.arange(len(rows)) - first < k
                    yield pd.DataFrame({"l_rep": lids[start + rows[keep]], "r_rep": rids[cols[keep]],
                                        "sim": vals[keep]})

    return cells.select("lids", "lm", "rids", "rm").mapInPandas(run, f"l_rep {l_type}, r_rep {r_type}, sim double")


def _top(df: DataFrame, left: str, right: str, k: int) -> DataFrame:
    w = Window.partitionBy(left).orderBy(F.desc("sim"), F.col(right))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _expand(best: DataFrame, l_members: DataFrame, r_members: DataFrame, k: int) -> DataFrame:
    """Representatives -> records.  A right copy group can contribute at most its k smallest ids."""
    w = Window.partitionBy("rep").orderBy("id")
    few = r_members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    by_rep = best.join(few.select(F.col("rep").alias("r_rep"), F.col("id").alias("r_id")), "r_rep")
    top = _top(by_rep, "l_rep", "r_id", k).select("l_rep", "r_id", "sim", "rank")
    return (top.join(l_members.select(F.col("rep").alias("l_rep"), F.col("id").alias("l_id")), "l_rep")
            .select("l_id", "r_id", "sim", "rank"))


def _swap(ed: DataFrame) -> DataFrame:
    return ed.select(F.col("r_id").alias("l_id"), F.col("l_id").alias("r_id"), "sim", "rank")


def knn(left: DataFrame, right: DataFrame, k: int, query_side: str = "left", block_rows: int = 8192,
        id: str = "id", vec: str = "embedding") -> DataFrame:
    """Edges ``(l_id, r_id, sim, rank)``: the k most similar records per query record.

    Ties go to the smaller id.  ``query_side='right'`` searches the left table
    for each right record.
    """
    if query_side == "right":
        return _swap(knn(right, left, k, "left", block_rows, id, vec))
    l_type, r_type = _id_type(left, id), _id_type(right, id)
    l_reps, l_members = _copies(left, id, vec)
    r_reps, r_members = _copies(right, id, vec)
    n_l = max(1, math.ceil(left.count() / block_rows))
    n_r = max(1, math.ceil(right.count() / block_rows))
    lb = _pack(l_reps.withColumn("lb", F.pmod(F.xxhash64("rep"), F.lit(n_l)).cast("int")), ["lb"], l_type)
    rb = _pack(r_reps.withColumn("rb", F.pmod(F.xxhash64("rep"), F.lit(n_r)).cast("int")), ["rb"], r_type)
    # Every grid cell (lb, rb) is one join key: the cells spread evenly over all tasks.
    lc = lb.select("lb", F.col("ids").alias("lids"), F.col("m").alias("lm"),
                   F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("rb"))
    rc = rb.select("rb", F.col("ids").alias("rids"), F.col("m").alias("rm"),
                   F.explode(F.sequence(F.lit(0), F.lit(n_l - 1))).alias("lb"))
    cells = lc.join(rc, ["lb", "rb"])
    best = _top(_best_in_cell(cells, k, l_type, r_type, _width(l_reps), _width(r_reps)), "l_rep", "r_rep", k).drop("rank")
    return _expand(best, l_members, r_members, k)


def _hyperplanes(bands: int, bits: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bands, bits, dim))


def _signatures(reps: DataFrame, id_type: str, bands: int, bits: int, seed: int) -> DataFrame:
    """One row per (vector, band): the sign bits of random projections as a number."""

    def run(batches):
        planes = None
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            if planes is None:
                planes = _hyperplanes(bands, bits, m.shape[1], seed)
            weights = 1 << np.arange(bits, dtype=np.int64)
            for b in range(bands):
                code = ((m @ planes[b].T) > 0).astype(np.int64) @ weights
                yield pd.DataFrame({"rep": pdf["rep"], "v": pdf["v"], "band": b, "code": code})

    return reps.select("rep", "v").mapInPandas(run, f"rep {id_type}, v {reps.schema['v'].dataType.simpleString()}, band int, code bigint")


def knn_approx(left: DataFrame, right: DataFrame, k: int, bands: int = 8, bits: int = 6, block_rows: int = 4096,
               seed: int = 42, id: str = "id", vec: str = "embedding") -> DataFrame:
    """Approximate top-k: sign-bit bands, then exact cosine on vectors that share a band code.

    A bucket is split into blocks of at most about ``block_rows`` rows before
    anything is compared, so a bucket with a third of all rows becomes many
    even cells, and only k rows per left vector and cell leave a task.
    """
    l_type, r_type = _id_type(left, id), _id_type(right, id)
    l_reps, l_members = _copies(left, id, vec)
    r_reps, r_members = _copies(right, id, vec)
    l_sig = _signatures(l_reps, l_type, bands, bits, seed)
    r_sig = _signatures(r_reps, r_type, bands, bits, seed)

    def split(sig, name):
        sizes = sig.groupBy("band", "code").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
        return sizes

    ls, rs = split(l_sig, "n_l"), split(r_sig, "n_r")
    both = ls.join(rs, ["band", "code"])  # one row per bucket present on both sides

    def blocks(sig, own, name):
        sig = sig.join(both, ["band", "code"]).withColumn(name, F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        return sig

    lb = _pack(blocks(l_sig, "n_l", "lb"), ["band", "code", "lb", "n_r"], l_type)
    rb = _pack(blocks(r_sig, "n_r", "rb"), ["band", "code", "rb", "n_l"], r_type)
    lc = lb.select("band", "code", "lb", F.col("ids").alias("lids"), F.col("m").alias("lm"),
                   F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)).alias("rb"))
    rc = rb.select("band", "code", "rb", F.col("ids").alias("rids"), F.col("m").alias("rm"),
                   F.explode(F.sequence(F.lit(0), F.col("n_l") - 1)).alias("lb"))
    cells = lc.join(rc, ["band", "code", "lb", "rb"])
    found = _best_in_cell(cells, k, l_type, r_type, _width(l_reps), _width(r_reps)).groupBy("l_rep", "r_rep").agg(F.max("sim").alias("sim"))
    best = _top(found, "l_rep", "r_rep", k).drop("rank")
    return _expand(best, l_members, r_members, k)


def recall_against(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact edges that the approximate search also found."""
    a = approx.select("l_id", "r_id", F.lit(1).alias("a"), F.lit(0).alias("e"))
    e = exact.select("l_id", "r_id", F.lit(0).alias("a"), F.lit(1).alias("e"))
    both = a.unionByName(e).groupBy("l_id", "r_id").agg(F.max("a").alias("a"), F.max("e").alias("e"))
    return both.agg(F.sum("e").alias("exact_edges"), F.sum(F.col("a") * F.col("e")).alias("found"),
                    F.try_divide(F.sum(F.col("a") * F.col("e")).cast("double"), F.sum("e")).alias("recall"))


def graph(ed: DataFrame) -> DataFrame:
    """Similarity graph view of candidate edges."""
    return ed.select("l_id", "r_id", "sim")
