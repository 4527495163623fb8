import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import analytics as an
from kindred.operators import prepare as prep
from kindred.operators import significance as sg

# Published paired scores over ten datasets.
DEFAULT = [47.44, 85.85, 57.35, 97.56, 57.74, 30.39, 35.68, 35.82, 92.04, 53.63]
SAMPLED = [78.43, 85.85, 58.97, 98.56, 78.92, 60.42, 67.76, 49.53, 94.92, 56.11]


def test_profile_ratios(spark):
    rows = [("D", i, s, f"v{i % 3}", None if i % 2 else "x y", "") for i, s in enumerate("llllrrrr")]
    e = spark.createDataFrame(rows, "dataset string, id long, side string, a string, b string, c string")
    p = prep.profile(e, ["dataset"]).first()
    assert (p["InputEntityProfiles"], p["NumberOfNameValuePairs"], p["NumberOfAttributes"], p["MaxValuesPerEntity"]) == (8, 12, 2, 2)
    assert p["NumberOfDistinctValues"] == 4 and p["AverageNVPairsPerEntity"] == 1.5
    assert p["NumberOfMissingNVpairs"] == 8 * 2 - 12


def test_missing_pairs_formula_holds_on_published_profiles():
    # entities, pairs, largest profile, published missing pairs
    for f1, f4, f9, missing in [(2595, 8649, 5, 4326), (2152, 4876, 3, 1580), (10000, 106108, 12, 13892), (50000, 530854, 12, 69146)]:
        assert f1 * f9 - f4 == missing


def test_minmax_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "dataset string, x double, y double")
    assert [tuple(r) for r in prep.minmax(df, ["x", "y"]).orderBy("dataset").collect()] == [("a", 0.0, None), ("b", 1.0, None)]


def test_exact_quantiles(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(50, 20), 2) for _ in range(999)] + [50.0] * 400  # one very frequent value
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["q"]: r["value"] for r in an.quantiles(df, "v", shares, cells=16).collect()}
    assert all(math.isclose(got[q], np.quantile(values, q), abs_tol=1e-9) for q in shares)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_segments_do_not_depend_on_buckets(spark, width):
    rng = random.Random(2)
    rows = [(g, i, rng.choice("ab")) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, s string")
    got = an.segments(df, ["g"], ["i"], ["s"], F.floor(F.col("i") / width), boundary=F.col("i") % 10 == 9)
    have = {(r["g"], r["i"]): r["segment"] for r in got.collect()}
    for g in range(3):
        seg, prev = 1, None
        for _, i, s in [r for r in rows if r[0] == g]:
            if prev is not None and (prev != s or (i - 1) % 10 == 9):
                seg += 1
            assert have[g, i] == seg
            prev = s


def test_pivot_in_natural_order(spark):
    rows = [(f"D{d}", b, d / 9 + b) for d in (10, 2, 1) for b in (0, 1)]
    out = an.pivot_ratio(spark.createDataFrame(rows, "dataset string, budget int, r double"), "dataset", "budget", "r", [0, 1], "b").collect()
    assert [r["dataset"] for r in out] == ["D1", "D2", "D10"] and [r["above_one"] for r in out] == [1, 1, 2]


def test_auc_of_a_flat_curve(spark):
    curve = spark.createDataFrame([("t", b, 100.0) for b in range(5, 105, 5)], "method string, budget int, f1 double")
    assert an.curve_auc(curve, ["method"]).first()["auc"] == pytest.approx(0.95)


def test_dedupe_keeps_the_first_trial(spark):
    df = spark.createDataFrame([(2, "a", 1.0), (1, "a", 5.0), (3, "b", 2.0)], "trial int, lm string, f1 double")
    assert sorted(tuple(r) for r in an.dedupe(df, ["lm"], ["trial"]).collect()) == [(1, "a", 5.0), (3, "b", 2.0)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    take = lambda d: [r["id"] for r in an.ordered_sample(d, ["id"], 7, 3).collect()]
    assert take(df.repartition(7)) == take(df.coalesce(1)) and len(set(take(df))) == 7


def test_paired_tests_on_published_scores(spark):
    wide = spark.createDataFrame(list(zip(DEFAULT, SAMPLED)), "a double, b double")
    d = np.array(DEFAULT) - np.array(SAMPLED)
    t = sg.paired_t(wide, [("a", "b")]).first()
    assert t["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(10)))
    assert 0.005 < t["p_value"] < 0.02
    w = sg.wilcoxon(wide, [("a", "b")]).first()
    assert (w["n"], w["w_plus"], w["w_minus"], w["statistic"]) == (9, 0.0, 45.0, 0.0)
    r = sg.rank_biserial(wide, [("a", "b")]).first()
    assert r["n"] == 10 and r["r_reported"] == 1.0 and r["r_standard"] == 1.0


def test_tail_probabilities():
    assert sg._upper_gamma(0.5, 3.841458821 / 2) == pytest.approx(0.05, abs=1e-8)
    assert sg._upper_gamma(1.5, 7.814727903 / 2) == pytest.approx(0.05, abs=1e-8)
    assert sg._t_tail(2.262157163, 9) == pytest.approx(0.05, abs=1e-8)
    assert sg._t_tail(0.0, 9) == pytest.approx(1.0)


def test_friedman_with_ties(spark):
    wide = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 1.0, 2.0), (3.0, 2.0, 1.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    # rank sums 1+1.5+3+1, 2+1.5+2+2, 3+3+1+3
    raw = 12 / (4 * 3 * 4) * (6.5 ** 2 + 7.5 ** 2 + 10 ** 2) - 3 * 4 * 4
    assert sg.friedman(wide, ["a", "b", "c"]).first()["statistic"] == pytest.approx(raw / (1 - 6 / (4 * 3 * 8)))


def test_p_value_correction(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p_value double")
    bh = {r["t"]: round(r["p_adjusted"], 6) for r in sg.adjust_p(df, "bh").collect()}
    assert bh == {"a": 0.04, "b": round(0.16 / 3, 6), "c": round(0.16 / 3, 6), "d": 0.5}
    bonf = {r["t"]: round(r["p_adjusted"], 6) for r in sg.adjust_p(df, "bonferroni").collect()}
    assert bonf == {"a": 0.04, "b": 0.16, "c": 0.12, "d": 1.0}


def test_positions_do_not_depend_on_buckets(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(50)], "g int, i int")
    for width in (3, 100):
        out = sg.number_blocks(df, ["g"], ["i"], F.floor(F.col("i") / width)).collect()
        assert all(r["pair_no"] == r["i"] // 2 + 1 for r in out)
