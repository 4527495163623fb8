"""Analytics over the trials log and result sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.data import (
    FEATURES, SQL_IMPORTANCE, SQL_RESULTS, SQL_TRIALS, importances, results, rounded, table, trials,
)
from kindred.operators import analytics as an

_T = f"WITH {SQL_TRIALS} "
_COLS = "trial, dataset, clustering, lm, k, threshold, sampler, seed, f1, runtime"
_PICK = ["trial", "dataset", "clustering", "lm", "k", "threshold", "sampler", "seed", "f1", "runtime"]
_CURVE = SQL_TRIALS + """,
curve AS (SELECT sampler, dataset, budget, avg(f1) AS f1 FROM
  (SELECT sampler, dataset, budget, seed, max(f1) AS f1 FROM trials WHERE sampler <> 'gridsearch' GROUP BY ALL) GROUP BY ALL),
top AS (SELECT dataset, max(f1) AS f1_max FROM trials WHERE sampler = 'gridsearch' GROUP BY dataset),
ratio AS (SELECT c.*, c.f1 / f1_max AS f1_ratio FROM curve c JOIN top USING (dataset))"""


def sampled(spark, sf):
    return an.by_source(trials(spark, sf), "optuna")


def grid_only(spark, sf):
    return an.by_source(trials(spark, sf), "gridsearch")


def curve(spark, sf):
    return an.budget_curve(sampled(spark, sf), ["sampler", "dataset"])


def ratio(spark, sf):
    return an.grid_ratio(curve(spark, sf), an.max_f1(grid_only(spark, sf), ["dataset"]), ["dataset"])


@query("t1_by_source", _T + f"SELECT {_COLS} FROM trials WHERE sampler <> 'gridsearch'")
def _(spark, sf):
    return sampled(spark, sf).select(*_PICK)


@query("t2_nonzero", _T + f"SELECT {_COLS} FROM trials WHERE f1 <> 0")
def _(spark, sf):
    return an.nonzero(trials(spark, sf)).select(*_PICK)


@query("t3_dedupe_rows", _T + "SELECT DISTINCT dataset, clustering, lm, k, threshold FROM trials")
def _(spark, sf):
    return an.dedupe(trials(spark, sf).select("dataset", "clustering", "lm", "k", "threshold"))


@query("t3_dedupe_by_config", _T + """SELECT dataset, clustering, lm, k, threshold, trial, f1 FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset, clustering, lm, k, threshold ORDER BY trial, f1) AS n FROM trials) WHERE n = 1""")
def _(spark, sf):
    t = trials(spark, sf).select("dataset", "clustering", "lm", "k", "threshold", "trial", "f1")
    return an.dedupe(t, ["dataset", "clustering", "lm", "k", "threshold"], ["trial"])


@query("t4_max_f1", _T + "SELECT dataset, max(f1) AS f1_max FROM trials WHERE sampler = 'gridsearch' GROUP BY dataset")
def _(spark, sf):
    return an.max_f1(grid_only(spark, sf), ["dataset"])


@query("t5_best_row", _T + f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY dataset, sampler
  ORDER BY f1 DESC, trial, lm, k, clustering, threshold) AS n FROM trials) WHERE n = 1""")
def _(spark, sf):
    return an.best_row(trials(spark, sf), ["dataset", "sampler"]).select(*_PICK)


@query("t6_tied_best", _T + f"""SELECT {_COLS} FROM (SELECT *, max(f1) OVER (PARTITION BY dataset, k) AS m FROM trials) WHERE f1 = m""")
def _(spark, sf):
    return an.tied_best(trials(spark, sf), ["dataset", "k"]).select(*_PICK)


@query("t7_runtime_hours", _T + "SELECT dataset, CAST(floor(round(sum(runtime), 4) / 3600) AS BIGINT) AS hours FROM trials GROUP BY dataset")
def _(spark, sf):
    return an.runtime_hours(trials(spark, sf), ["dataset"])


@query("t8_trial_counts", _T + "SELECT sampler, count(*) AS trials FROM trials GROUP BY sampler")
def _(spark, sf):
    return an.counts(trials(spark, sf), ["sampler"])


@query("t9_segments", """
WITH e AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT event_id, user_id, event_type, CAST(1 + sum(CASE WHEN p IS NULL OR p = event_type THEN 0 ELSE 1 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM e)
SELECT event_id, user_id, event_type, segment FROM s""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    out = an.segments(e, ["user_id"], ["ts", "event_id"], ["event_type"], F.date_trunc("day", F.col("ts")))
    return out.select("event_id", "user_id", "event_type", "segment")


@query("t9_budget_segments", _T + """,
o AS (SELECT *, lag(sampler) OVER w AS ps, lag(seed) OVER w AS pseed, lag(trial) OVER w AS pt FROM trials
  WINDOW w AS (PARTITION BY dataset ORDER BY trial, part, supp))
SELECT dataset, trial, part, supp, CAST(1 + sum(CASE WHEN pt IS NULL THEN 0 WHEN ps <> sampler OR pseed <> seed OR pt % 50 = 4 THEN 1 ELSE 0 END)
  OVER (PARTITION BY dataset ORDER BY trial, part, supp) AS BIGINT) AS segment FROM o""")
def _(spark, sf):
    tr = trials(spark, sf).select("dataset", "sampler", "seed", "trial", "part", "supp")
    out = an.segments(tr, ["dataset"], ["trial", "part", "supp"], ["sampler", "seed"], F.floor(F.col("trial") / 4096),
                      boundary=F.col("trial") % 50 == 4)
    return out.select("dataset", "trial", "part", "supp", "segment")


@query("t10_budget_curve", f"WITH {_CURVE} SELECT sampler, dataset, budget, round(f1, 6) AS f1 FROM curve")
def _(spark, sf):
    return rounded(curve(spark, sf))


@query("t11_grid_ratio", f"WITH {_CURVE} SELECT sampler, dataset, budget, round(f1, 6) AS f1, round(f1_ratio, 6) AS f1_ratio FROM ratio")
def _(spark, sf):
    return rounded(ratio(spark, sf))


@query("t12_budget_runtime", f"""WITH {SQL_TRIALS},
r AS (SELECT sampler, dataset, budget, avg(rt) AS avg_runtime FROM (SELECT sampler, dataset, budget, seed, sum(runtime) AS rt FROM trials
  WHERE sampler <> 'gridsearch' GROUP BY ALL) GROUP BY ALL),
g AS (SELECT dataset, sum(runtime) AS total FROM trials WHERE sampler = 'gridsearch' GROUP BY dataset)
SELECT sampler, dataset, budget, round(avg_runtime, 4) AS avg_runtime, round(avg_runtime / total, 6) AS runtime_ratio FROM r JOIN g USING (dataset)""")
def _(spark, sf):
    total = grid_only(spark, sf).groupBy("dataset").agg(F.sum("runtime").alias("total"))
    rt = an.budget_runtime(sampled(spark, sf), ["sampler", "dataset"])
    out = an.grid_ratio(rt, total, ["dataset"], "avg_runtime", "runtime_ratio")
    return out.withColumn("avg_runtime", F.round("avg_runtime", 4)).withColumn("runtime_ratio", F.round("runtime_ratio", 6))


@query("t13_curve_auc", f"""WITH {_CURVE},
a AS (SELECT sampler, dataset, budget, (budget - lag(budget) OVER w) * (f1 + lag(f1) OVER w) / 2 AS s FROM curve
  WINDOW w AS (PARTITION BY sampler, dataset ORDER BY budget))
SELECT sampler, dataset, round(coalesce(sum(s), 0), 7) AS area, round(coalesce(sum(s), 0) / (max(budget) * 100.0::DOUBLE), 11) AS auc FROM a GROUP BY ALL""")
def _(spark, sf):
    out = an.curve_auc(curve(spark, sf), ["sampler", "dataset"])
    return out.withColumn("area", F.round("area", 7)).withColumn("auc", F.round("auc", 11))


@query("t14_mean_curve", f"WITH {_CURVE} SELECT sampler, budget, round(avg(f1), 5) AS avg_f1, round(avg(f1_ratio), 5) AS avg_f1_ratio FROM ratio GROUP BY ALL")
def _(spark, sf):
    return rounded(an.mean_curve(ratio(spark, sf), ["sampler", "budget"], ["f1", "f1_ratio"]), 5)


_BUDGETS = list(range(5, 105, 5))


@query("t15_pivot_ratio", f"WITH {_CURVE} SELECT sampler || ' ' || dataset AS study, " + ", ".join(
    f"round(max(f1_ratio) FILTER (budget = {b}), 5) AS b{b}" for b in _BUDGETS) +
    ", CAST(count(*) FILTER (f1_ratio > 1.0) AS INT) AS above_one FROM ratio GROUP BY sampler, dataset")
def _(spark, sf):
    every = ratio(spark, sf).withColumn("study", F.concat_ws(" ", "sampler", "dataset"))
    return rounded(an.pivot_ratio(every, "study", "budget", "f1_ratio", _BUDGETS, "b"), 5)


@query("t17_fixed_configuration", _T + f"""SELECT {_COLS} FROM trials WHERE lm = 'R' AND k = 10 AND clustering = 'F'
  AND CAST(threshold AS DECIMAL(4,2)) = 0.05""")
def _(spark, sf):
    return an.fixed_config(trials(spark, sf), "R", 10, "F", "0.05").select(*_PICK)


@query("t18_min_max_f1", _T + 'SELECT dataset, min(f1) AS "min", max(f1) AS "max" FROM trials GROUP BY dataset')
def _(spark, sf):
    return an.min_max_f1(trials(spark, sf), ["dataset"])


@query("t19_histogram", _T + """, b AS (SELECT dataset, min(f1) AS lo, max(f1) AS hi FROM trials GROUP BY dataset)
SELECT dataset, CAST(least(floor((f1 - lo) * 10 / (hi - lo)), 9) AS INT) AS bin, count(*) AS n FROM trials JOIN b USING (dataset) GROUP BY ALL""")
def _(spark, sf):
    return an.histogram(trials(spark, sf), ["dataset"], "f1")


@query("t20_summary", _T + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", CAST(sum(({c} IS NULL)::INT) AS BIGINT) AS nulls, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max" FROM trials"""
    for c in ("k", "threshold", "precision", "recall", "f1", "runtime")))
def _(spark, sf):
    out = an.summary(trials(spark, sf), ["k", "threshold", "precision", "recall", "f1", "runtime"])
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("t20_quantiles", _T + """SELECT q, round(v, 6) AS "value" FROM (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q,
  unnest(quantile_cont(f1, [0.25, 0.5, 0.75])) AS v FROM trials)""")
def _(spark, sf):
    return rounded(an.quantiles(trials(spark, sf), "f1", [0.25, 0.5, 0.75]))


_KEYED = """, one AS (SELECT dataset AS "TEST_SET", clustering AS "CLUSTERING", lm AS "LM", k AS "K", CAST(round(threshold, 4) AS DECIMAL(6,4)) AS t,
  min((trial, runtime)) AS b FROM trials GROUP BY ALL)"""


@query("t21_attach_runtime", f"""WITH {SQL_RESULTS}{_KEYED},
j AS (SELECT r.*, one.b[2] AS rt FROM results r LEFT JOIN one ON one."TEST_SET" = r."TEST_SET" AND one."CLUSTERING" = r."CLUSTERING" AND one."LM" = r."LM"
  AND one."K" = r."K" AND one.t = CAST(round(r."THRESHOLD", 4) AS DECIMAL(6,4)))
SELECT "TEST_SET", "DATASET", "REGRESSOR", count(*) AS "rows", count(rt) AS matched, round(sum(rt), 2) AS runtime FROM j GROUP BY ALL""")
def _(spark, sf):
    out = an.attach_runtime(results(spark, sf), trials(spark, sf))
    return out.groupBy("TEST_SET", "DATASET", "REGRESSOR").agg(
        F.count(F.lit(1)).alias("rows"), F.count("PIPELINE_RUNTIME").alias("matched"), F.round(F.sum("PIPELINE_RUNTIME"), 2).alias("runtime"))


@query("t21_unmatched", f"""WITH {SQL_RESULTS}{_KEYED}
SELECT "TEST_SET", "CLUSTERING", "LM", "K", round("THRESHOLD", 6) AS "THRESHOLD", round("PREDICTED_F1", 6) AS "PREDICTED_F1" FROM results r
WHERE NOT EXISTS (SELECT 1 FROM one WHERE one."TEST_SET" = r."TEST_SET" AND one."CLUSTERING" = r."CLUSTERING" AND one."LM" = r."LM"
  AND one."K" = r."K" AND one.t = CAST(round(r."THRESHOLD", 4) AS DECIMAL(6,4)))""")
def _(spark, sf):
    out = an.without_runtime(results(spark, sf), trials(spark, sf))
    return rounded(out.select("TEST_SET", "CLUSTERING", "LM", "K", "THRESHOLD", "PREDICTED_F1"))


@query("t22_ordered_sample", _T + f"SELECT {_COLS} FROM trials ORDER BY md5('42:' || trial || ':' || k), trial, k LIMIT 5")
def _(spark, sf):
    return an.ordered_sample(trials(spark, sf).select(*_PICK), ["trial", "k"], 5, 42)


_GAIN = SQL_RESULTS + """,
gain AS (SELECT "TEST_SET", "DATASET", "REGRESSOR", max("PREDICTED_F1") FILTER ("WITH_DATA_FEATURES" = 1) AS f1_with,
  max("PREDICTED_F1") FILTER ("WITH_DATA_FEATURES" = 0) AS f1_without FROM results GROUP BY ALL HAVING f1_with IS NOT NULL)"""


@query("t24_feature_gain", f"WITH {_GAIN} SELECT * FROM gain")
def _(spark, sf):
    return an.feature_gain(results(spark, sf), ["TEST_SET", "DATASET", "REGRESSOR"])


@query("t24_feature_wins", f"""WITH {_GAIN} SELECT CAST(sum((f1_with >= f1_without)::INT) AS BIGINT) AS wins, count(*) AS "rows",
  round(sum((f1_with >= f1_without)::INT) / count(*), 6) AS share FROM gain""")
def _(spark, sf):
    return rounded(an.wins(an.feature_gain(results(spark, sf), ["TEST_SET", "DATASET", "REGRESSOR"])))


@query("t25_presentation", f"""WITH {SQL_RESULTS},
b AS (SELECT *, row_number() OVER (PARTITION BY "TEST_SET" ORDER BY "PREDICTED_F1" DESC, "DATASET", "REGRESSOR", "LM", "K", "CLUSTERING", "THRESHOLD") AS n FROM results)
SELECT "TEST_SET", "DATASET", "REGRESSOR", round("PREDICTED_F1", 2) AS "F1", round("GLOBAL_BEST_F1", 2) AS "GB_F1", round("PERFORMANCE", 2) AS "F1_RATIO",
  CAST(round("OPTIMIZATION_TIME" / 3600, 0) AS INT) AS "HOURS", "LM", "K", "CLUSTERING", round("THRESHOLD", 6) AS "THRESHOLD" FROM b WHERE n = 1""")
def _(spark, sf):
    return rounded(an.presentation(results(spark, sf)))


_TIMES = SQL_RESULTS + """,
times AS (SELECT "TEST_SET", "DATASET", "REGRESSOR", avg("OPTIMIZATION_TIME") AS optimization_time, avg("BEST_REGRESSOR_FIT_TIME") AS fit_time,
  avg("BEST_REGRESSOR_PREDICTION_TIME") AS prediction_time FROM results GROUP BY ALL)"""


@query("t26_phase_times", f"""WITH {_TIMES} SELECT "TEST_SET", "DATASET", "REGRESSOR", round(optimization_time, 3) AS optimization_time,
  round(fit_time, 5) AS fit_time, round(prediction_time, 5) AS prediction_time FROM times""")
def _(spark, sf):
    t = an.phase_times(results(spark, sf))
    return t.select("TEST_SET", "DATASET", "REGRESSOR", F.round("optimization_time", 3).alias("optimization_time"),
                    F.round("fit_time", 5).alias("fit_time"), F.round("prediction_time", 5).alias("prediction_time"))


@query("t26_max_phase_times", f"""WITH {_TIMES} SELECT "REGRESSOR", round(max(optimization_time), 3) AS optimization_time,
  round(max(fit_time), 5) AS fit_time, round(max(prediction_time), 5) AS prediction_time FROM times GROUP BY "REGRESSOR\"""")
def _(spark, sf):
    t = an.max_phase_times(an.phase_times(results(spark, sf)))
    return t.select("REGRESSOR", F.round("optimization_time", 3).alias("optimization_time"),
                    F.round("fit_time", 5).alias("fit_time"), F.round("prediction_time", 5).alias("prediction_time"))


_FOLD = "regexp_replace(regexp_replace(\"FEATURE\", '^lm_.*', 'lm'), '^clustering_.*', 'clustering')"


@query("t27_importance_ranking", f"""WITH {SQL_IMPORTANCE},
m AS (SELECT "FEATURE", avg("IMPORTANCE") AS v FROM importance GROUP BY "FEATURE")
SELECT {_FOLD} AS "FEATURE", round(sum(v), 6) AS "IMPORTANCE" FROM m GROUP BY 1""")
def _(spark, sf):
    return rounded(an.importance_ranking(importances(spark, sf)))


@query("t28_importance_matrix", f"""WITH {SQL_IMPORTANCE} SELECT "TEST_SET", """ + ", ".join(
    f"""round(sum("IMPORTANCE") FILTER ("FEATURE" = '{f}'), 4) AS "{s}\"""" for f, s in an.FEATURE_SHORT.items()) +
    """ FROM importance GROUP BY "TEST_SET\"""")
def _(spark, sf):
    return rounded(an.importance_matrix(importances(spark, sf)), 4)
