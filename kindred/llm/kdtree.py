"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards by id; each shard splits its vectors at medians
and keeps a tight box and the smallest id of every node.  A query walks a tree
best box first: the largest inner product that any point of a box can have is
known from its corners.  The walk ends at the first box that cannot beat the
query's k-th score.  That score is first found in one shard and then goes with
the query to all of them, so most boxes of the others are never opened.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import cut_lineage

#: Vectors of a shard, queries that meet a shard in one task, queries bounded at a time, points of a leaf.
SHARD_ROWS, LANE_ROWS, BLOCK_ROWS, LEAF = 100_000, 32_768, 256, 128


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: components as floor(1024 * x), x as double.

    Rows with a null id, a null vector or a null or non-finite component are
    left out.  Of rows that repeat an id, the least vector counts.
    """
    x = F.col(embedding).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 1024)).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


@dataclass
class Tree:
    points: np.ndarray   # vectors, those of a leaf together
    ids: np.ndarray
    low: np.ndarray      # corners of each node's box
    high: np.ndarray
    span: np.ndarray     # first and last point of each node
    child: np.ndarray    # its two children, or -1
    least: np.ndarray    # its smallest id


def build(ids: np.ndarray, points: np.ndarray, k: int) -> Tree:
    """Tree of one shard.  Of equal vectors only the ``k + 1`` smallest ids can be among a query's best."""
    order = np.lexsort((ids, *points.T))
    ids, points = ids[order], points[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (points[1:] != points[:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    few = np.arange(len(ids)) - first <= k
    ids, points = ids[few], points[few]
    order = np.arange(len(ids))
    low, high, span, child = [], [], [], []

    def node(a: int, b: int) -> int:
        box = points[order[a:b]]
        low.append(box.min(axis=0))
        high.append(box.max(axis=0))
        span.append((a, b))
        child.append((-1, -1))
        return len(span) - 1
    todo = [node(0, len(ids))] if len(ids) else []
    while todo:
        i = todo.pop()
        a, b = span[i]
        if b - a <= LEAF or not points.shape[1]:
            continue
        width = high[i].astype(float) - low[i]
        axis, mid = int(width.argmax()), (a + b) // 2
        if not width[axis]:
            continue
        part = order[a:b]
        order[a:b] = part[np.argpartition(points[part, axis], mid - a)]
        child[i] = node(a, mid), node(mid, b)
        todo += child[i]
    ids, points = ids[order], points[order]
    least = np.array([ids[a:b].min() for a, b in span], dtype=np.int64)
    return Tree(points, ids, np.array(low), np.array(high), np.array(span, dtype=np.int64), np.array(child, dtype=np.int64), least)


def search(tree: Tree, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best ``k`` of a shard for each query, as far as they can reach its score ``kth`` (NaN: none known yet)."""
    out: list[tuple[int, int, int]] = []
    if not len(tree.ids):
        return out
    reach = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(tree.points.astype(float)).max(initial=0))
    exact = reach * max(1, queries.shape[1]) < 2.0 ** 52  # doubles hold all scores
    slack = 0.0 if exact else reach * max(1, queries.shape[1]) * 1e-12
    points = tree.points.astype(float) if exact else tree.points
    low, high = tree.low.astype(float), tree.high.astype(float)
    for at in range(0, len(qids), BLOCK_ROWS):
        block = queries[at:at + BLOCK_ROWS]
        q = block.astype(float)
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + slack
        for i, row in enumerate(bounds):
            own, floor = int(qids[at + i]), kth[at + i]
            best: list[tuple[int, int]] = []  # (score, -id): the worst of the best first
            heap = [(-row[0], 0)]
            vector = q[i] if exact else block[i]
            while heap:
                bound, j = heapq.heappop(heap)
                bound = -bound
                if bound < floor:
                    break
                if len(best) == k and bound <= best[0][0]:
                    if bound < best[0][0]:
                        break
                    if tree.least[j] > -best[0][1]:
                        continue
                a, b = tree.child[j]
                if a >= 0:
                    heapq.heappush(heap, (-row[a], a))
                    heapq.heappush(heap, (-row[b], b))
                    continue
                a, b = tree.span[j]
                scores = points[a:b] @ vector
                least = max(floor, best[0][0]) if len(best) == k else floor
                for p in np.flatnonzero(~(scores < least)):
                    vec = int(tree.ids[a + p])
                    if vec != own:
                        entry = (int(scores[p]), -vec)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
            out += [(own, -v, s) for s, v in best]
    return out


def _cells(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches every (shard, lane) cell: ``vectors`` and ``queries`` carry those two columns."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            lengths = right["v"].map(len)
            mine = left["v"].map(len)
            for d in lengths.unique():  # vectors of another length are not comparable
                own, q = left[mine == d], right[lengths == d]
                if len(own):
                    def matrix(rows, d=d):
                        return np.array([np.asarray(v, dtype=np.int64) for v in rows["v"]], dtype=np.int64).reshape(len(rows), d)
                    tree = build(own["vec_id"].to_numpy(np.int64), matrix(own), k)
                    found += search(tree, q["vec_id"].to_numpy(np.int64), matrix(q), q["kth"].to_numpy(float, na_value=np.nan), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
    return vectors.groupBy("shard", "lane").cogroup(queries.groupBy("shard", "lane")).applyInPandas(
        run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all other vectors for every query.

    Both tables are ``vec_id, v`` (``array<bigint>``, ids unique); scores must
    fit into a long.  Ties go to the smaller ``vec_id``.  A query with fewer
    partners of its length gets what there is; without any it has no row.
    """
    vectors, queries = cut_lineage(vectors, "vectors"), cut_lineage(queries, "queries")
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD_ROWS), min(cores, n // (8 * LEAF)))
    lanes = max(1, -(-m // LANE_ROWS))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    lane = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lanes)).cast("int")
    dealt = vectors.withColumn("shard", home).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked = queries.withColumn("lane", lane)
    first = _cells(dealt, asked.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)).cast("int"))
                   .withColumn("kth", F.lit(None).cast("double")), k)
    seeds = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    known = asked.join(seeds, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return _best(_cells(dealt, known, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
