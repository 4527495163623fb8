"""Groups of equal records: candidates, features and fits count for all the pairs that they stand for."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking as blk
from kindred.operators import em
from kindred.operators import features as ft

COLS = ["name_jac", "name_lev", "size_anm"]
TYPES = {"name": "str_bt_1w_5w", "size": "numeric"}


def side(spark, start, n, seed, extra=()):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "old", "bolt"])
    rows = [(start + 2 * i, rng.choice([f"{word()} {word()} x", None]), rng.choice(["1", "2", None])) for i in range(n)]
    frame = spark.createDataFrame([*rows, *extra], "id long, name string, size string")
    return frame.withColumn("text", F.concat_ws(" ", "name", "size"))


def key(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("extra", [[], [(0, "red bolt x", "1"), (0, "old gear x", "2")], [(None, "red bolt x", "1")]])
def test_expanded_groups_equal_records(spark, extra):
    """Also where values are missing, where an id comes again and where an id is missing."""
    l, r = side(spark, 0, 40, 1, extra), side(spark, 1, 40, 2)
    plan = ft.feature_plan(TYPES)
    plain = ft.pair_features(blk.overlap_block(l, r, "text", 2).drop("overlap"), l, r, plan)
    table, lm, rm = ft.block_and_compare(l, r, "text", 2, plan)
    assert key(blk.expand_pairs(table, lm, rm).select(plain.columns)) == key(plain)
    stands_for = blk.group_sizes(table, lm, rm, "pairs").agg(F.sum("pairs")).first()[0]
    assert extra and extra[0][0] == 0 or stands_for == plain.count()
    if not extra:
        assert table.count() < plain.count() / 2


def test_rounded_features_and_values_of_few_pairs(spark):
    l, r = side(spark, 0, 60, 3), side(spark, 1, 60, 4)
    cand = l.select(F.col("id").alias("l_id")).crossJoin(r.select(F.col("id").alias("r_id")))
    plan = ft.feature_plan(TYPES)
    assert ft._few_values(l, r, ["name", "size"], 20) == {"size"}
    plain = ft.pair_features(cand, l, r, plan, distinct_values=[])
    ready = ft.pair_features(cand, l, r, plan, digits=3)
    names = [p[0] for p in plan]
    assert key(ready) == key(plain.select("l_id", "r_id", *[F.round(c, 3).alias(c) for c in names]))


def counted(spark, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(np.clip(rng.normal(np.where(np.arange(120) < 40, 0.8, 0.25)[:, None], 0.1, (120, 3)), 0, 1), 1)
    n = rng.integers(1, 6, 120)
    rows = [(i, i, *map(float, x[i]), int(n[i])) for i in range(120)]
    X = spark.createDataFrame(rows, "l_id long, r_id long, name_jac double, name_lev double, size_anm double, pairs long")
    copies = X.withColumn("r_id", F.explode(F.sequence(F.lit(1), F.col("pairs")))).drop("pairs")
    return X, copies


def test_a_fit_over_groups_equals_the_fit_over_their_pairs(spark):
    X, copies = counted(spark)
    a, scored = em.em_fit(X, COLS, max_iter=4, weight="pairs")
    b, each = em.em_fit(copies, COLS, max_iter=4)
    for name in ("pi", "mu_m", "mu_u", "cov_m", "cov_u", "corr", "history"):
        assert np.allclose(getattr(a, name), getattr(b, name), rtol=1e-9, atol=1e-12), name
    p = {r["l_id"]: r["p"] for r in scored.collect()}
    assert all(abs(r["p"] - p[r["l_id"]]) < 1e-9 for r in each.collect())
    with pytest.raises(ValueError):
        em.em_fit(X, COLS, constraint="dup_free", weight="pairs")


def test_moments_and_fallback_over_groups(spark):
    X, copies = counted(spark)
    mine = em.class_moments(em.initial_labels(X, COLS), COLS, weight="pairs").orderBy("start").collect()
    theirs = em.class_moments(em.initial_labels(copies, COLS), COLS).orderBy("start").collect()
    assert np.allclose([list(r) for r in mine], [list(r) for r in theirs])
    mine = em.weighted_moments(em.initial_labels(X, COLS), COLS, "start_score", "pairs").first()
    assert np.allclose(list(mine), list(em.weighted_moments(em.initial_labels(copies, COLS), COLS, "start_score").first()))
    low = lambda df: df.select(*[c for c in df.columns if c not in COLS], F.col("name_jac"), (1 - F.col("name_jac")).alias("name_lev"), F.lit(0.1).alias("size_anm"))
    a, b = em.em_init(low(X), COLS, "pairs"), em.em_init(low(copies), COLS)
    assert a.fallback and b.fallback and np.allclose(a.mu_m, b.mu_m) and a.pi == b.pi


def test_a_round_with_overrides_equals_numpy(spark):
    _, X = counted(spark)
    fit = em._Fit(X, COLS, 0.1)
    rows = X.collect()
    x, ids = np.array([[r[c] for c in COLS] for r in rows]), [(r["l_id"], r["r_id"]) for r in rows]
    p_before = None
    for held in ({ids[0]: 0.0, ids[7]: 0.0}, {ids[0]: 0.0, ids[3]: 0.25}):
        q, prev = fit.q, fit.q_prev
        p, lm, lu = em._posterior(x, q)
        p = np.array([held.get(i, v) for i, v in zip(ids, p)])
        fit.advance(spark.createDataFrame([(*i, v) for i, v in held.items()], "l_id long, r_id long, p_new double"))
        assert abs(fit.q.pi - p.mean()) < 1e-12 and np.allclose(fit.q.mu_m, (p[:, None] * x).sum(0) / p.sum())
        energy = p * (lm - np.log(p + em.TINY)) + (1 - p) * (lu - np.log(1 - p + em.TINY)) + p * np.log(fit.q.pi) + (1 - p) * np.log(1 - fit.q.pi)
        if prev is not None:
            _, lm0, lu0 = em._posterior(x, prev)
            assert np.isclose(fit.changes[-1], np.sqrt(((energy - em._free_energy(p_before, lm0, lu0, q.pi)) ** 2).sum()))
        p_before = p


def test_split_ranks_only_pairs_at_a_border(spark):
    """Sizes and members are those of a sort by the whole hash within the ranges; ranges within one split are not sorted."""
    import hashlib
    from kindred.operators.export import split_pairs
    pairs = spark.range(900).select(F.col("id").alias("l_id"), (F.col("id") * 7 % 31).alias("r_id"))
    split = split_pairs(pairs, seed=3, buckets=16)
    got = {(r["l_id"], r["r_id"]): r["split"] for r in split.collect()}
    h = lambda p: int(hashlib.md5(f"3:{p[0]}:{p[1]}".encode()).hexdigest()[:15], 16)
    order = sorted(got, key=lambda p: ((h(p) >> 40) % 16, h(p), p))
    assert [got[p] for p in order] == ["train"] * 540 + ["test"] * 180 + ["valid"] * 180
    union = split._jdf.queryExecution().analyzed().toString()
    assert "Union" in union and union.count("Window") >= 1
    part = pairs.where("l_id < 0")
    assert split_pairs(part).count() == 0
