import random

import numpy as np
import pytest

from kindred.operators import blocking as blk
from kindred.operators import knn as nn


def vectors(n, dim, seed, copies=0):
    m = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    if copies:
        m[:copies] = m[0]
    return m


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")


def brute(l, r, k):
    u = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(u(l) @ u(r).T, nn.SIM_DIGITS)
    out = set()
    for i, row in enumerate(s):
        for rank, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]):
            out.add((i, j, rank + 1))
    return out


def rows(df):
    return {(r["l_id"], r["r_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block", [8192, 7])
def test_exact_search(spark, block):
    l, r = vectors(40, 8, 1), vectors(30, 8, 2)
    assert rows(nn.knn(frame(spark, l), frame(spark, r), 5, block_rows=block)) == brute(l, r, 5)


def test_copies_and_k_larger_than_the_index(spark):
    l, r = vectors(20, 6, 3, copies=9), vectors(12, 6, 4, copies=8)
    assert rows(nn.knn(frame(spark, l), frame(spark, r), 4, block_rows=5)) == brute(l, r, 4)
    assert rows(nn.knn(frame(spark, l), frame(spark, r), 50)) == brute(l, r, 50)


def test_vectors_that_are_not_finite_take_no_part(spark):
    l, r = vectors(12, 6, 3), vectors(9, 6, 4)
    bad = [(100, [float("nan")] * 6), (101, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (102, None), (103, [None] * 6)]
    add = lambda m: frame(spark, m).unionByName(spark.createDataFrame(bad, "id long, embedding array<float>"))
    assert rows(nn.knn(add(l), add(r), 2)) == brute(l, r, 2)
    got = nn.knn_approx(add(l), add(r), 2, bands=8, bits=1).collect()
    assert got and not [e for e in got if e["l_id"] >= 100 or e["r_id"] >= 100]


def test_doubles_are_not_cut(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(4)
    m = np.array([base + np.array([0, 0, 0, 1e-4]) * i for i in range(30)])  # too close for single precision
    wide = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    assert rows(nn.knn(wide, wide, 3)) == brute(m, m, 3)


def test_query_side(spark):
    l, r = vectors(15, 6, 5), vectors(10, 6, 6)
    got = rows(nn.knn(frame(spark, l), frame(spark, r), 3, "right"))
    assert {(b, a, k) for a, b, k in got} == brute(r, l, 3)


def test_empty_side(spark):
    l = frame(spark, vectors(5, 4, 7))
    assert nn.knn(l, l.limit(0), 3).count() == 0


def test_approximate_search_recall_and_hot_bucket(spark):
    l, r = vectors(120, 8, 8), vectors(120, 8, 9)
    l[:60] = l[0] + vectors(60, 8, 10) * 0.01  # half of the rows fall into one bucket
    r[:60] = l[0] + vectors(60, 8, 11) * 0.01
    fl, fr = frame(spark, l), frame(spark, r)
    approx = nn.knn_approx(fl, fr, 5, bands=12, bits=3, block_rows=10)
    assert nn.recall_against(approx, nn.knn(fl, fr, 5)).first()["recall"] >= 0.8


def texts(n, seed, hot=True):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    out = []
    for i in range(n):
        t = rng.choices(words, k=rng.randrange(0, 8))
        if hot and rng.random() < 0.5:
            t += ["the", "of"]
        out.append((i, " ".join(t), rng.choice(["a", "b", None])))
    out += [(n + i, "the of w1 w2 w3", "a") for i in range(5)]  # copies
    return out


def naive(l, r, n, equal=False):
    out = {}
    for i, a, x in l:
        for j, b, y in r:
            c = len(set(a.split()) & set(b.split()))
            if c >= n and (not equal or (x is not None and x == y)):
                out[i, j] = c
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("heavy", [None, 3, 500])
def test_overlap_equals_naive_join(spark, n, heavy):
    l, r = texts(40, 1), texts(35, 2)
    a, b = (spark.createDataFrame(x, "id long, text string, key string") for x in (l, r))
    got = blk.overlap_block(a, b, "text", n, heavy=heavy)
    assert {(x["l_id"], x["r_id"]): x["overlap"] for x in got.collect()} == naive(l, r, n)
    assert got.count() == len(naive(l, r, n))


def test_overlap_within_equal_keys_and_filter(spark):
    l, r = texts(40, 3), texts(35, 4)
    a, b = (spark.createDataFrame(x, "id long, text string, key string") for x in (l, r))
    got = blk.overlap_block(a, b, "text", 2, equal_on=["key"], heavy=3)
    want = naive(l, r, 2, equal=True)
    assert {(x["l_id"], x["r_id"]): x["overlap"] for x in got.collect()} == want
    chained = blk.overlap_filter(blk.equal_block(a, b, "key"), a, b, "text", 2)
    assert {(x["l_id"], x["r_id"]): x["overlap"] for x in chained.collect()} == want


def test_missing_values_pair_with_everything(spark):
    a = spark.createDataFrame([(1, "x y"), (2, None)], "id long, text string")
    b = spark.createDataFrame([(5, "x y"), (6, "z"), (7, None)], "id long, text string")
    got = {(x["l_id"], x["r_id"]) for x in blk.overlap_block(a, b, "text", 2, allow_missing=True).collect()}
    assert got == {(1, 5), (1, 7), (2, 5), (2, 6), (2, 7)}


def test_all_pairs_over_several_cells(spark):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(23)], "id long, name string")
    out = blk.cross_block(a, a, block_rows=5)
    assert out.count() == 23 * 23 == out.select("_id").distinct().count()


def test_blocking_quality(spark):
    e = spark.createDataFrame([(i,) for i in range(10)], "id long")
    cand = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "l_id long, r_id long")
    gt = spark.createDataFrame([(0, 0), (1, 1), (4, 4), (5, 5)], "l_id long, r_id long")
    q = blk.block_quality(cand, e, e, gt).first()
    assert (q["candidates"], q["known"], q["missed"], q["recall"]) == (3, 4, 2, 0.5)
    assert abs(q["reduction_ratio"] - 0.97) < 1e-12


def test_knn_leaves_out_missing_vectors(spark):
    from kindred.operators.knn import knn
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, None]), ("d", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {(r.l_id, r.r_id) for r in knn(df, df, 2).collect()}
    assert got == {("a", "a"), ("a", "d"), ("d", "a"), ("d", "d")}
