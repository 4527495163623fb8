"""Learning to predict F1, and recommending configurations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.cluster import sql_scores
from catalog.data import SQL_PROFILE, SQL_TRIALS, profiles, rounded, sql_greedy, sql_knn, trials, vector_truth, vectors
from kindred.operators import learn as ml
from kindred.operators import recommend as rec
from kindred.operators.analytics import max_f1
from kindred.operators.prepare import PROFILE_COLUMNS
from kindred.plans import pipeline
from kindred.runtime import cut_lineage, shared_dir
from kindred.sources.trials import read_log

DATASETS = [f"D{i}" for i in range(1, 11)]
DOMAINS = {"lm": ["A", "N", "R"], "clustering": ["F", "O"]}
CONFIG = ["lm", "k", "clustering", "threshold"]
FEATURES = ["k", "threshold", *ml.one_hot_names(DOMAINS), *PROFILE_COLUMNS]

_TRAIN = f"""{SQL_TRIALS}, {SQL_PROFILE},
train AS MATERIALIZED (SELECT DISTINCT dataset, lm, k, clustering, threshold, profiles.* EXCLUDE (dataset), f1 FROM trials JOIN profiles USING (dataset)
  WHERE f1 <> 0 AND sampler = 'gridsearch')"""
_LONG = {"AverageNVPairsPerEntity", "AverageNVpairsPerAttribute", "AverageDistinctValuesPerEntity",
         "AverageDistinctValuesPerAttribute", "AverageValueTokens", "AverageValueLength"}
_PROF = ", ".join(f'round("{c}", 6) AS "{c}"' if c in _LONG else f'"{c}"' for c in PROFILE_COLUMNS)


def training(spark, sf, with_features=True):
    return ml.training_table(trials(spark, sf), profiles(spark, sf), "gridsearch", with_features)


@query("l1_training_table", f"WITH {_TRAIN} SELECT dataset, lm, k, clustering, threshold, {_PROF}, f1 FROM train")
def _(spark, sf):
    return rounded(training(spark, sf))


@query("l1_training_table_without_profile", f"WITH {_TRAIN} SELECT DISTINCT dataset, lm, k, clustering, threshold, f1 FROM train")
def _(spark, sf):
    return training(spark, sf, False)


@query("l2_leave_one_out_folds", f"""WITH {_TRAIN}, fl AS (SELECT unnest({DATASETS}) AS fold)
SELECT fold, CAST((fold = dataset)::INT AS INT) AS is_test, count(*) AS n, round(sum(f1), 4) AS f1 FROM train, fl GROUP BY ALL""")
def _(spark, sf):
    return ml.folds(training(spark, sf, False), DATASETS).groupBy("fold", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("f1"), 4).alias("f1"))


@query("l2_fixed_split", f"""WITH {_TRAIN} SELECT dataset, lm, k, clustering, threshold, f1,
  CASE WHEN dataset IN ('D1','D2','D3','D4','D5') THEN 'train' ELSE 'test' END AS part FROM train""")
def _(spark, sf):
    a, b = ml.fixed_split(training(spark, sf, False), DATASETS[:5], DATASETS[5:])
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query("l3_one_hot", f"""WITH {_TRAIN} SELECT DISTINCT lm, clustering, (lm = 'N')::INT::DOUBLE AS "lm_N", (lm = 'R')::INT::DOUBLE AS "lm_R",
  (clustering = 'O')::INT::DOUBLE AS "clustering_O" FROM train""")
def _(spark, sf):
    return ml.one_hot(training(spark, sf, False), DOMAINS).select("lm", "clustering", "lm_N", "lm_R", "clustering_O").distinct()


@query("l4_standard_scaling", f"""WITH {_TRAIN}, s AS (SELECT avg(k) AS mk, stddev_pop(k) AS sk, avg(threshold) AS mt, stddev_pop(threshold) AS st FROM train
  WHERE dataset <> 'D1')
SELECT lm, clustering, f1, round((k - mk) / sk, 6) AS k, round((threshold - mt) / st, 6) AS threshold FROM train, s WHERE dataset = 'D1'""")
def _(spark, sf):
    t = training(spark, sf, False).withColumn("k", F.col("k").cast("double"))
    out = ml.standardise(t.where("dataset <> 'D1'"), t.where("dataset = 'D1'"), ["k", "threshold"])
    return rounded(out.select("lm", "clustering", "f1", "k", "threshold"))


@query("l5_validation_split", f"WITH {_TRAIN} SELECT dataset, CAST(ceil(count(*) * 0.1) AS BIGINT) AS valid, count(*) AS n FROM train GROUP BY dataset")
def _(spark, sf):
    v = ml.validation_split(training(spark, sf, False), [*CONFIG, "f1"], 42)
    return v.groupBy("dataset").agg(F.sum("is_valid").alias("valid"), F.count(F.lit(1)).alias("n"))


def split(spark, sf, held_out="D1"):
    t = ml.one_hot(training(spark, sf), DOMAINS).withColumn("k", F.col("k").cast("double"))
    v = ml.validation_split(t.where(F.col("dataset") != held_out), [*CONFIG, "f1"], 42)
    keep = ["dataset", "lm", "clustering", *FEATURES, "f1"]
    return v.where("is_valid = 0").select(*keep), v.where("is_valid = 1").select(*keep), t.where(F.col("dataset") == held_out).select(*keep)


def _fit_and_score(spark, sf, name, **params):
    train, valid, test = split(spark, sf)
    model = ml.regressor(name, FEATURES, **params).fit(train.unionByName(valid))
    return ml.error_scores(model.transform(test), "f1", "predicted", ["dataset"]).withColumn("regressor", F.lit(name))


def _folds(spark, sf, regressors):
    t = ml.one_hot(training(spark, sf), DOMAINS).withColumn("k", F.col("k").cast("double"))
    return cut_lineage(ml.leave_one_out(t.select("dataset", "lm", "clustering", *FEATURES, "f1"), FEATURES, regressors), "predicted")


@query("l6_linear_lasso_ridge")
def _(spark, sf):
    """Errors of three linear models on each of ten datasets that they have not seen."""
    out = _folds(spark, sf, {"LINEAR": {}, "LASSO": {"regParam": 0.1}, "RIDGE": {"regParam": 0.1}})
    return rounded(ml.error_scores(out, "f1", "predicted", ["dataset", "regressor"]), 3)


@query("l2_leave_one_dataset_out", f"""WITH {_TRAIN}, m AS (SELECT dataset, max(f1) AS f1_max, count(*) AS n FROM train GROUP BY dataset)
SELECT dataset, regressor, n AS predicted_rows, f1_max, true AS performance_in_range, true AS timed FROM m, (SELECT unnest(['LINEAR', 'RF', 'GBT']) AS regressor)""")
def _(spark, sf):
    """For each of ten datasets: fit on the other nine, take the best predicted configuration, compare its F1 with the best known one."""
    out = _folds(spark, sf, {"LINEAR": {}, "RF": {"numTrees": 10, "maxDepth": 5}, "GBT": {"maxIter": 5, "maxDepth": 3}})
    best = max_f1(out, ["dataset"])
    got = None
    for name in ("LINEAR", "RF", "GBT"):
        mine = out.where(F.col("regressor") == name)
        rows = mine.groupBy("dataset").agg(F.count(F.lit(1)).alias("predicted_rows"), F.min("fit_seconds").alias("fit_seconds"))
        one = ml.performance(mine, best).join(rows, "dataset").select(
            "dataset", F.lit(name).alias("regressor"), "predicted_rows", "f1_max", F.col("performance").between(0.0, 1.0).alias("performance_in_range"),
            (F.col("fit_seconds") > 0).alias("timed"))
        got = one if got is None else got.unionByName(one)
    return got


@query("l7_random_forest")
def _(spark, sf):
    return rounded(_fit_and_score(spark, sf, "RF", numTrees=10, maxDepth=5), 3)


@query("l8_boosted_trees")
def _(spark, sf):
    return rounded(_fit_and_score(spark, sf, "GBT", maxIter=5, maxDepth=3), 3)


_SMALL_RF = {"numTrees": ("int", 5, 10), "maxDepth": ("int", 3, 5), "featureSubsetStrategy": ("choice", ["sqrt", "log2"])}


@query("l9_random_search")
def _(spark, sf):
    train, valid, test = split(spark, sf)
    model, _, mse = ml.tune("RF", FEATURES, train, valid, n=3, ranges=_SMALL_RF)
    return rounded(ml.error_scores(model.transform(test), "f1", "predicted", ["dataset"]).withColumn("validation_mse", F.lit(mse)), 3)


_PRED = f"""{SQL_TRIALS}, p AS (SELECT dataset, lm, k, clustering, threshold, trial, sampler, f1, precision AS a, recall AS b, (precision + recall) / 2 AS c FROM trials)"""


def _predictions(spark, sf):
    return trials(spark, sf).select("dataset", *CONFIG, "trial", "sampler", "f1", F.col("precision").alias("a"),
                                    F.col("recall").alias("b"), ((F.col("precision") + F.col("recall")) / 2).alias("c"))


@query("l11_weighted_ensemble", f"""WITH {_PRED}, e AS (SELECT 1 / avg((a - f1) ** 2) AS wa, 1 / avg((b - f1) ** 2) AS wb, 1 / avg((c - f1) ** 2) AS wc
  FROM p WHERE sampler = 'tpe'), r AS (SELECT *, wa <= least(wb, wc) AS drop_a, wb <= least(wa, wc) AS drop_b, wc <= least(wa, wb) AS drop_c FROM e)
SELECT dataset, trial, lm, k, round((CASE WHEN drop_a THEN 0 ELSE wa * a END + CASE WHEN drop_b THEN 0 ELSE wb * b END + CASE WHEN drop_c THEN 0 ELSE wc * c END)
  / (CASE WHEN drop_a THEN 0 ELSE wa END + CASE WHEN drop_b THEN 0 ELSE wb END + CASE WHEN drop_c THEN 0 ELSE wc END), 6) AS predicted FROM p, r WHERE sampler <> 'tpe'""")
def _(spark, sf):
    p = _predictions(spark, sf)
    out = ml.ensemble_by_error(p.where("sampler <> 'tpe'"), p.where("sampler = 'tpe'"), ["a", "b", "c"], "f1", best=2)
    return rounded(out.select("dataset", "trial", "lm", "k", "predicted"))


@query("l12_error_scores", f"""WITH {_PRED} SELECT dataset, round(avg((f1 - c) ** 2), 4) AS mse, round(avg(abs(f1 - c)), 4) AS mae,
  round(1 - sum((f1 - c) ** 2) / (count(*) * var_pop(f1)), 4) AS r2 FROM p GROUP BY dataset""")
def _(spark, sf):
    return rounded(ml.error_scores(_predictions(spark, sf), "f1", "c", ["dataset"]), 4)


@query("l13_top_20_predicted", f"""WITH {_PRED} SELECT dataset, lm, k, clustering, threshold, round(c, 6) AS "predicted", f1 AS "true_f1" FROM p
  ORDER BY c DESC, lm, k, clustering, threshold, dataset, trial LIMIT 20""")
def _(spark, sf):
    p = _predictions(spark, sf)
    out = ml.top_by(p, "c", 20, [*CONFIG, "dataset", "trial"])
    return rounded(out.select("dataset", *CONFIG, F.col("c").alias("predicted"), F.col("f1").alias("true_f1")))


@query("l14_performance", f"""WITH {_PRED}, t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, lm, k, clustering, threshold, f1) AS n FROM p),
m AS (SELECT dataset, max(f1) AS f1_max FROM p GROUP BY dataset)
SELECT dataset, lm, k, clustering, threshold, f1 AS predicted_f1, f1_max, round(f1 / f1_max, 4) AS performance FROM t JOIN m USING (dataset) WHERE n = 1""")
def _(spark, sf):
    p = _predictions(spark, sf).withColumnRenamed("c", "predicted")
    return ml.performance(p, max_f1(p, ["dataset"]))


@query("l15_feature_importance")
def _(spark, sf):
    train, valid, _ = split(spark, sf)
    model = ml.regressor("RF", FEATURES, numTrees=10, maxDepth=5).fit(train.unionByName(valid))
    return rounded(ml.importance(model, FEATURES, train), 3)


@query("r1_candidates", f"""WITH {SQL_TRIALS}, {SQL_PROFILE}, c AS (SELECT DISTINCT lm, k, clustering, threshold FROM trials WHERE sampler = 'gridsearch')
SELECT dataset, lm, k, clustering, threshold, {_PROF} FROM c, profiles WHERE dataset IN ('D1', 'D2')""")
def _(spark, sf):
    return rounded(rec.candidates(trials(spark, sf), profiles(spark, sf), ["D1", "D2"]))


@query("r2_recommend")
def _(spark, sf):
    train, valid, _ = split(spark, sf)
    model = ml.regressor("RF", FEATURES, numTrees=10, maxDepth=5).fit(train.unionByName(valid))
    cand = ml.one_hot(rec.candidates(trials(spark, sf), profiles(spark, sf), ["D1"]), DOMAINS).withColumn("k", F.col("k").cast("double"))
    return rounded(rec.recommend(model, cand, 5), 3)


@query("r3_attach_real_f1", f"""WITH {SQL_TRIALS}, q AS (SELECT DISTINCT dataset, lm, k, clustering, threshold FROM trials WHERE sampler = 'tpe'),
g AS (SELECT dataset, lm, k, clustering, threshold, max(f1) AS real_f1 FROM trials WHERE sampler = 'gridsearch' GROUP BY ALL)
SELECT q.*, coalesce(real_f1, -1.0) AS real_f1 FROM q LEFT JOIN g USING (dataset, lm, k, clustering, threshold)""")
def _(spark, sf):
    t = trials(spark, sf)
    asked = t.where("sampler = 'tpe'").select("dataset", *CONFIG).distinct()
    return rec.attach_real(asked, t.where("sampler = 'gridsearch'"))


_R4 = """a1 AS MATERIALIZED (SELECT l_id, r_id, sim FROM knn WHERE rank <= 5 AND sim >= 0.3), """ + sql_greedy("a1", "u1") + """,
a2 AS MATERIALIZED (SELECT l_id, r_id, sim FROM knn WHERE rank <= 10 AND sim >= 0.25), """ + sql_greedy("a2", "u2") + """,
a3 AS MATERIALIZED (SELECT l_id, r_id FROM knn WHERE rank <= 5 AND sim >= 0.35),
nb AS MATERIALIZED (SELECT 'l' || l_id AS u, 'r' || r_id AS v FROM a3 UNION SELECT 'r' || r_id, 'l' || l_id FROM a3),
walk AS (SELECT u, u AS v FROM nb UNION SELECT w.u, nb.v FROM walk w JOIN nb ON nb.u = w.v),
cc AS MATERIALIZED (SELECT u, min(v) AS c FROM walk GROUP BY u),
u3 AS (SELECT substr(a.u, 2)::BIGINT AS l_id, substr(b.u, 2)::BIGINT AS r_id FROM cc a JOIN cc b USING (c) WHERE a.u[1] = 'l' AND b.u[1] = 'r'),
al AS (SELECT 'UniqueMappingClustering' AS clustering, 5 AS k, 0.3::DOUBLE AS threshold, l_id, r_id FROM u1
  UNION ALL SELECT 'KiralyMSMApproximateClustering', 10, 0.25, l_id, r_id FROM u2 UNION ALL SELECT 'ConnectedComponentsClustering', 5, 0.35, l_id, r_id FROM u3),
s AS (SELECT clustering, k, threshold, count(g.l_id) AS tp, count(*) AS predicted, (SELECT count(*) FROM gt) AS known
  FROM al LEFT JOIN gt g ON g.l_id = al.l_id AND g.r_id = al.r_id GROUP BY ALL)"""


@query("r4_run_recommended", f"""WITH RECURSIVE {sql_knn(10)}, {_R4}
SELECT 'stored' AS lm, CAST(k AS INT) AS k, clustering, threshold, {sql_scores('tp', 'predicted', 'known')}, true AS timed, 'ok' AS status FROM s
UNION ALL SELECT 'nobody', 5, 'UniqueMappingClustering', 0.3, NULL, NULL, NULL, true, 'failed'
UNION ALL SELECT 'stored', 5, 'no such clustering', 0.3, NULL, NULL, NULL, true, 'failed'
UNION ALL SELECT 'stored', 5, 'UniqueMappingClustering', 1.01, 0, 0, 0, true, 'ok'""")
def _(spark, sf):
    """Recommended configurations, each measured on its own; what fails is a row."""
    l, r = vectors(spark, sf)
    text = lambda e: e.select("id", F.col("label").cast("string").alias("text"), "embedding")
    rows = [("stored", 5, "UniqueMappingClustering", 0.3), ("stored", 10, "KiralyMSMApproximateClustering", 0.25), ("stored", 5, "ConnectedComponentsClustering", 0.35),
            ("nobody", 5, "UniqueMappingClustering", 0.3), ("stored", 5, "no such clustering", 0.3), ("stored", 5, "UniqueMappingClustering", 1.01)]
    asked = spark.createDataFrame(rows, "lm string, k int, clustering string, threshold double")
    out = pipeline.run_recommended(text(l), text(r), vector_truth(spark, sf), asked)
    return out.withColumns({"timed": F.col("runtime") > 0, "status": F.regexp_extract("status", "^[a-z]+", 0)}).drop("runtime")


@query("s5_search_log", f"""WITH RECURSIVE {sql_knn(10)}, {_R4}, w AS (SELECT *, {sql_scores('tp', 'predicted', 'known')} FROM s WHERE clustering <> 'ConnectedComponentsClustering'),
r AS (SELECT unnest([(16, 'first'), (64, 'second')]) AS x)
SELECT 'grid' AS sampler, 'vectors' AS dataset, CAST(x[1] AS INT) AS seed, 'stored' AS lm, CAST(k AS INT) AS k, clustering, threshold, precision, recall, f1,
  3::BIGINT AS added_first, 0::BIGINT AS added_again FROM w, r
UNION ALL SELECT 'grid', 'vectors', CAST(x[1] AS INT), 'stored', 5, 'UniqueMappingClustering', 1.01, 0, 0, 0, 3, 0 FROM r""")
def _(spark, sf):
    """A search of two seeds, interrupted after one trial, resumed, and run once more: the log holds each trial once."""
    l, r = vectors(spark, sf)
    rows = [(0, "stored", 5, "UniqueMappingClustering", 0.3), (1, "stored", 10, "KiralyMSMApproximateClustering", 0.25), (2, "stored", 5, "UniqueMappingClustering", 1.01)]
    asked = spark.createDataFrame(rows, "trial bigint, lm string, k int, clustering string, threshold double")
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    run = lambda seed, configs: pipeline.search_to_log(l, r, vector_truth(spark, sf), configs, path, "grid", "vectors", seed, at_once=2)
    first = {seed: run(seed, asked.where("trial = 0")) + run(seed, asked) for seed in (16, 64)}
    again = {seed: run(seed, asked) for seed in (16, 64)}
    counts = spark.createDataFrame([(s, first[s], again[s]) for s in first], "seed int, added_first bigint, added_again bigint")
    log = read_log(spark, path).join(counts, "seed")
    return log.select("sampler", "dataset", "seed", *CONFIG, "precision", "recall", "f1", "added_first", "added_again")


@query("r5_compare_real_and_predicted", f"""WITH {SQL_TRIALS},
a AS (SELECT dataset, lm, k, clustering, threshold, max(f1) AS real_f1, max(precision) AS real_precision, max(recall) AS real_recall, max(runtime) AS runtime
  FROM trials WHERE sampler = 'gridsearch' GROUP BY ALL),
b AS (SELECT dataset, lm, k, clustering, threshold, max(f1) AS predicted_f1 FROM trials WHERE sampler = 'qmc' GROUP BY ALL)
SELECT dataset, lm, CAST(k AS DOUBLE) AS k, clustering, threshold, real_f1, real_precision, real_recall, runtime, predicted_f1
FROM a JOIN b USING (dataset, lm, k, clustering, threshold)""")
def _(spark, sf):
    t = trials(spark, sf)
    keys = ["dataset", *CONFIG]
    real = t.where("sampler = 'gridsearch'").groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("f1", "precision", "recall", "runtime")])
    pred = t.where("sampler = 'qmc'").groupBy(*keys).agg(F.max("f1").alias("predicted_f1"))
    pred = pred.withColumn("dataset", F.concat(F.lit(" "), "dataset")).withColumn("lm", F.concat(F.lit(" "), "lm"))
    return rec.compare(real, pred)
