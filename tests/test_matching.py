import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions.text import qgrams
from kindred.operators import em
from kindred.operators import features as ft


def test_known_string_scores(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), ("a", ""), (None, "a")], "a string, b string")
    got = df.select(sim.jaro(F.col("a"), F.col("b")).alias("j"), sim.jaro_winkler(F.col("a"), F.col("b")).alias("w"),
                    sim.levenshtein_similarity(F.col("a"), F.col("b")).alias("l")).collect()
    assert [round(x, 4) if x == x and x is not None else None for x in (r["j"] for r in got)][:4] == [0.9444, 0.7667, 1.0, 0.0]
    assert [round(r["w"], 4) for r in got[:2]] == [0.9611, 0.8133]
    assert got[4]["l"] is None and got[2]["l"] == 1.0


def test_set_measures_on_edges(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], []), (None, ["a"])], "a array<string>, b array<string>")
    cols = {n: sim.similarity(n)(F.col("a"), F.col("b")) for n in ("jaccard", "cosine", "dice", "overlap_coeff")}
    got = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert [round(x, 4) for x in got[0]] == [0.3333, 0.5, 0.5, 0.5]
    assert list(got[1]) == [1.0] * 4 and list(got[2]) == [0.0] * 4 and list(got[3]) == [None] * 4


def test_number_similarity_and_qgrams(spark):
    df = spark.createDataFrame([("10", "8"), ("0", "0"), ("x", "1"), ("-5", "5")], "a string, b string")
    assert [r[0] for r in df.select(sim.absolute_norm(F.col("a"), F.col("b"))).collect()] == [0.8, 1.0, None, 0.0]
    one = spark.createDataFrame([("ab",), ("",), (None,)], "a string")
    assert [r[0] for r in one.select(qgrams(F.col("a"), 3)).collect()] == [["##a", "#ab", "ab$", "b$$"], ["##$", "#$$"], None]
    assert [r[0] for r in one.select(qgrams(F.col("a"), 3, padding=False)).collect()] == [[], [], None]


def test_scaled_features_are_told_by_kind_not_by_substring():
    names = ["name_name_lev_dist", "name_name_lev_sim", "affiliation_affiliation_jac_qgm_3_qgm_3", "answer_answer_sw", "a_b_a_b_rdf"]
    assert ft.scaled_only(names) == ["name_name_lev_sim", "affiliation_affiliation_jac_qgm_3_qgm_3"]


def test_feature_table_with_and_without_value_pairs(spark):
    rng = random.Random(1)
    people = [(i, rng.choice(["ann lee", "bob ray", "ann ray", None]), str(rng.randrange(5))) for i in range(30)]
    e = spark.createDataFrame(people, "id long, name string, size string")
    cand = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)], "l_id long, r_id long")
    plan = ft.feature_plan({"id": "numeric", "name": "str_bt_1w_5w", "size": "numeric"})
    assert not [p for p in plan if p[1] == "id"]
    a = ft.pair_features(cand, e, e, plan)
    b = ft.pair_features(cand, e, e, plan, distinct_values=["name", "size"], rows_per_task=10)
    key = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert key(a) == key(b) and a.count() == cand.count()
    assert ft.constant_features(a.withColumn("same", F.lit(1.0)), ["same", plan[0][0]]) == ["same"]


def mixture(spark, n=400, seed=5, share=0.25):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for i in range(n):
        match = i < n * share
        base = 0.85 if match else 0.25
        x = np.clip(rng.normal(base, 0.08, 3), 0, 1)
        rows.append((i, i, *map(float, x)))
        truth[i] = int(match)
    return spark.createDataFrame(rows, "l_id long, r_id long, name_jac double, name_lev double, size_anm double"), truth


COLS = ["name_jac", "name_lev", "size_anm"]


def test_matcher_separates_two_groups(spark):
    X, truth = mixture(spark)
    params, scored = em.em_fit(X, COLS, max_iter=15)
    got = {r["l_id"]: r for r in em.decide(scored).collect()}
    assert all(0 <= r["p"] <= 1 for r in got.values())
    assert np.mean([got[i]["pred"] == t for i, t in truth.items()]) > 0.98
    assert abs(params.pi - 0.25) < 0.03 and not params.fallback
    assert params.cov_m[0, 2] == 0 and params.cov_m[0, 1] != 0  # block diagonal by attribute
    hard = em.em_score(X, params)
    assert {r["l_id"]: r["pred"] for r in hard.collect()} == {i: r["pred"] for i, r in got.items()}


def test_one_round_equals_numpy(spark):
    X, _ = mixture(spark, 80)
    q = em.em_init(X, COLS)
    x = np.array([[r[c] for c in COLS] for r in X.orderBy("l_id").collect()])
    p, _, _ = em._posterior(x, q)
    got = [r["p"] for r in em.em_expect(X, q).orderBy("l_id").collect()]
    assert np.allclose(got, p)
    nxt = em.maximise(em._unpack(em._sums(X.select(*COLS), COLS, lambda pdf: em._pack_moments(
        pdf[COLS].to_numpy(float), em._posterior(pdf[COLS].to_numpy(float), q)[0], [0.0])), 3), q, 0.1)
    assert np.allclose(nxt.mu_m, (p[:, None] * x).sum(0) / p.sum()) and abs(nxt.pi - p.mean()) < 1e-12
    assert np.allclose(q.corr, np.corrcoef(x.T))


def test_constant_table_falls_back(spark):
    X = spark.createDataFrame([(i, i, 0.5 + 0.0 * i, i / 50, 0.1) for i in range(50)],
                              "l_id long, r_id long, name_jac double, name_lev double, size_anm double")
    params, scored = em.em_fit(X, COLS, max_iter=3)
    assert all(0 <= r["p"] <= 1 for r in scored.collect()) and params.corr.shape == (3, 3)


def pairwise_giveup(rows, pi):
    """Compare the predicted pairs of each record two by two and zero the cheaper one."""
    lse = lambda p, lm, lu: p * (np.log(pi) + lm - np.log(p + 1e-300)) + (1 - p) * (np.log(1 - pi) + lu - np.log(1 - p + 1e-300))
    cost = {(a, b): lse(0.0, lm, lu) - lse(p, lm, lu) for a, b, p, lm, lu in rows}
    p = {(a, b): q for a, b, q, _, _ in rows}
    hot = [k for k in p if p[k] > 0.5]
    for side in (0, 1):
        order = sorted(hot, key=lambda k: (k[side], k[1 - side]))
        for x, y in itertools.combinations(order, 2):
            if x[side] == y[side] and p[x] * p[y] > 0:
                p[x if cost[x] >= cost[y] else y] = 0.0
    return {k for k in hot if p[k] == 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_transitivity_equals_pairwise_comparison(spark, seed):
    rng = random.Random(seed)
    pi, rows = 0.3, []
    for a, b in sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(40)}):
        lm, lu = rng.uniform(-3, 6), rng.uniform(-3, 3)
        rows.append((a, b, pi / (pi + (1 - pi) * np.exp(lu - lm)), lm, lu))
    rows = [tuple(float(x) if i > 1 else x for i, x in enumerate(r)) for r in rows]
    df = spark.createDataFrame(rows, "l_id long, r_id long, p double, log_m double, log_u double")
    lost = {(r["l_id"], r["r_id"]) for r in em.transitivity_dup_free(df, pi).collect()}
    assert lost == pairwise_giveup(rows, pi)
    after = df.join(em.transitivity_dup_free(df, pi), ["l_id", "r_id"], "left").withColumn("p", F.coalesce("p_new", "p"))
    assert em.violations(after).first()[0] == 0


def test_constrained_fit_has_no_violations(spark):
    X, _ = mixture(spark, 200)
    X = X.withColumn("l_id", F.floor(F.col("l_id") / 2))
    _, scored = em.em_fit(X, COLS, max_iter=4, constraint="dup_free")
    assert em.violations(scored).first()[0] == 0
    _, single = em.em_fit(X.withColumn("r_id", F.col("r_id") + 1000), COLS, max_iter=3, constraint="single")
    assert all(0 <= r["p"] <= 1 for r in single.collect())
