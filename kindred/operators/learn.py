"""Learning to predict F1 from configuration and dataset profile."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.analytics import CONFIG, by_source, nonzero
from kindred.operators.prepare import PROFILE_COLUMNS
from kindred.runtime import broadcast_if_small, cut_lineage


def training_table(tr: DataFrame, profiles: DataFrame, kind: str = "all", with_features: bool = True) -> DataFrame:
    """Distinct (configuration, profile, f1) rows of one trials source, zero scores left out."""
    base = nonzero(by_source(tr, kind)).select("dataset", *CONFIG, "f1")
    if with_features:
        base = base.join(broadcast_if_small(profiles.select("dataset", *PROFILE_COLUMNS)), "dataset")
    return base.distinct()


def folds(df: DataFrame, datasets: list[str]) -> DataFrame:
    """Leave one dataset out: every row once per fold, ``is_test`` where it is held out."""
    return df.withColumn("fold", F.explode(F.array(*[F.lit(d) for d in datasets]))).withColumn(
        "is_test", (F.col("fold") == F.col("dataset")).cast("int"))


def fixed_split(df: DataFrame, train: list[str], test: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("dataset").isin(train)), df.where(F.col("dataset").isin(test))


def one_hot(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """0/1 columns over a fixed domain, first value in order left out as the base.

    The domain comes from the configuration space, so train, test and unseen
    data always get the same columns.
    """
    flags = {f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, vals in domains.items() for v in sorted(vals)[1:]}
    return df.withColumns(flags)


def one_hot_names(domains: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, vals in domains.items() for v in sorted(vals)[1:]]


def standardise(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Scale ``test`` with mean and population deviation of ``train``; a constant column becomes 0."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    wide = test.join(F.broadcast(stats), F.lit(True))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in cols}
    return wide.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in test.columns])


def validation_split(df: DataFrame, keys: list[str], seed: int, share: float = 0.1, by: str = "dataset",
                     buckets: int = 256) -> DataFrame:
    """Flag exactly ceil(share * n) rows per dataset, in seeded hash order.

    Rows are counted per hash range first; only the range that holds the cut is
    ranked row by row, so a large dataset is never sorted in one task.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    order = F.struct(h, *keys)
    placed = df.withColumn("_h", F.pmod(F.shiftrightunsigned(h, 40), F.lit(buckets)).cast("int")).withColumn("_o", order)
    sizes = placed.groupBy(by, "_h").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by).orderBy("_h")  # at most `buckets` rows per dataset
    start = sizes.withColumn("_start", F.sum("_c").over(w) - F.col("_c"))
    goal = sizes.groupBy(by).agg(F.ceil(F.sum("_c") * F.lit(share)).alias("_goal"))
    start = start.join(goal, by)
    wr = Window.partitionBy(by, "_h").orderBy("_o")
    ranked = placed.join(start, [by, "_h"]).withColumn("_rank", F.col("_start") + F.row_number().over(wr))
    return ranked.withColumn("is_valid", (F.col("_rank") <= F.col("_goal")).cast("int")).drop(
        "_h", "_o", "_c", "_start", "_goal", "_rank")


# Search ranges per regressor.
SEARCH = {
    "LINEAR": {},
    "LASSO": {"regParam": ("log", 1e-4, 1e1)},
    "RIDGE": {"regParam": ("log", 1e-4, 1e1)},
    "RF": {"numTrees": ("int", 100, 1000), "maxDepth": ("int", 3, 10), "minInstancesPerNode": ("int", 1, 20),
           "featureSubsetStrategy": ("choice", ["sqrt", "log2"])},
    "GBT": {"maxIter": ("int", 100, 1000), "maxDepth": ("int", 3, 10), "stepSize": ("log", 1e-3, 1e-1),
            "subsamplingRate": ("uniform", 0.5, 1.0)},
}


def regressor(name: str, features: list[str], target: str = "f1", seed: int = 42, **params) -> Pipeline:
    """Assemble, standardise and regress."""
    kinds = {
        "LINEAR": lambda: LinearRegression(**params),
        "LASSO": lambda: LinearRegression(elasticNetParam=1.0, **params),
        "RIDGE": lambda: LinearRegression(elasticNetParam=0.0, **params),
        "RF": lambda: RandomForestRegressor(seed=seed, **params),
        "GBT": lambda: GBTRegressor(seed=seed, **params),
    }
    model = kinds[name]().setLabelCol(target).setFeaturesCol("scaled").setPredictionCol("predicted")
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
        model,
    ])


def draw(name: str, n: int, seed: int, ranges: dict | None = None) -> list[dict]:
    """n seeded parameter draws (a model without parameters has one)."""
    space = SEARCH[name] if ranges is None else ranges
    if not space:
        return [{}]
    rng = random.Random(seed)

    def one(spec):
        kind, *rest = spec
        if kind == "int":
            return rng.randint(*rest)
        if kind == "uniform":
            return rng.uniform(*rest)
        if kind == "log":
            lo, hi = rest
            return lo * (hi / lo) ** rng.random()
        return rng.choice(rest[0])
    return [{p: one(s) for p, s in space.items()} for _ in range(n)]


def tune(name: str, features: list[str], train: DataFrame, valid: DataFrame, n: int = 50, seed: int = 42,
         target: str = "f1", ranges: dict | None = None, parallelism: int = 4):
    """Random search on validation MSE, then a refit on train and validation: (model, parameters, mse)."""
    from multiprocessing.pool import ThreadPool

    train, valid = train.persist(), valid.persist()
    measure = RegressionEvaluator(labelCol=target, predictionCol="predicted", metricName="mse")

    def run(p):
        return measure.evaluate(regressor(name, features, target, seed, **p).fit(train).transform(valid))

    draws = draw(name, n, seed, ranges)
    with ThreadPool(min(parallelism, len(draws))) as pool:  # Spark runs the fits side by side
        errors = pool.map(run, draws)
    best = min(range(len(draws)), key=lambda i: (errors[i], i))
    model = regressor(name, features, target, seed, **draws[best]).fit(train.unionByName(valid))
    train.unpersist(), valid.unpersist()
    return model, draws[best], errors[best]


def leave_one_out(table: DataFrame, features: list[str], regressors: dict[str, dict], target: str = "f1", seed: int = 42,
                  by: str = "dataset", parallelism: int = 4) -> DataFrame:
    """Predictions for every dataset by models that have not seen it: ``table`` with ``predicted``, ``regressor`` and ``fit_seconds``.

    ``regressors`` maps a name to its parameters.  There is one fit for each
    dataset and regressor; fits run side by side on the table, which is written once.
    """
    import time
    from multiprocessing.pool import ThreadPool

    table = cut_lineage(table, "folds")
    held_out = [r[0] for r in table.select(by).distinct().orderBy(by).collect()]  # datasets of an experiment

    def run(task):
        dataset, (name, params) = task
        started = time.perf_counter()
        model = regressor(name.split(" ")[0], features, target, seed, **params).fit(table.where(F.col(by) != dataset))
        out = model.transform(table.where(F.col(by) == dataset)).select(*table.columns, "predicted")
        return out.withColumns({"regressor": F.lit(name), "fit_seconds": F.lit(time.perf_counter() - started)})
    with ThreadPool(parallelism) as pool:
        found = pool.map(run, [(d, r) for d in held_out for r in regressors.items()])
    return reduce(DataFrame.unionByName, found)


def inverse_error_weights(mse: dict[str, float]) -> dict[str, float]:
    total = sum(1 / m for m in mse.values())
    return {k: (1 / m) / total for k, m in mse.items()}


def ensemble(df: DataFrame, weights: dict[str, float], out: str = "predicted") -> DataFrame:
    """Weighted sum of prediction columns."""
    parts = [F.lit(w) * F.col(c) for c, w in weights.items()]
    return df.withColumn(out, reduce(lambda a, b: a + b, parts))


def ensemble_by_error(df: DataFrame, valid: DataFrame, preds: list[str], truth: str, best: int = 5) -> DataFrame:
    """Ensemble of the ``best`` columns with the lowest validation MSE, weighted by inverse MSE."""
    mse = valid.agg(*[F.avg((F.col(p) - F.col(truth)) * (F.col(p) - F.col(truth))).alias(p) for p in preds])
    ranked = F.slice(F.array_sort(F.array(*[F.struct(F.col(p).alias("e"), F.lit(p).alias("n")) for p in preds])), 1, best)
    weights = mse.select(F.transform(ranked, lambda s: F.struct(s["n"].alias("n"), (1 / s["e"]).alias("w"))).alias("_w"))
    wide = df.join(F.broadcast(weights), F.lit(True))
    total = F.aggregate("_w", F.lit(0.0), lambda a, s: a + s["w"])

    def weight(p: str) -> Column:
        return F.aggregate(F.filter("_w", lambda s: s["n"] == p), F.lit(0.0), lambda a, s: a + s["w"])
    mix = reduce(lambda a, b: a + b, [weight(p) * F.col(p) for p in preds]) / total
    return wide.withColumn("predicted", mix).drop("_w")


def error_scores(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """MSE, MAE and R2 in one pass."""
    t, p = F.col(truth), F.col(predicted)
    sse, n = F.sum((t - p) * (t - p)), F.count(F.lit(1))
    return df.groupBy(*(by or [])).agg(
        (sse / n).alias("mse"), F.avg(F.abs(t - p)).alias("mae"),
        (1 - F.try_divide(sse, n * F.var_pop(t))).alias("r2"))


def top_by(df: DataFrame, score: str, n: int, ties: list[str] = CONFIG) -> DataFrame:
    """The n best rows; each task keeps n rows."""
    return df.orderBy(F.desc(score), *ties).limit(n)


def performance(pred: DataFrame, best: DataFrame, by: str = "dataset") -> DataFrame:
    """True F1 of the top predicted configuration divided by the best known F1, per dataset."""
    order = F.struct((-F.col("predicted")).alias("s"), *CONFIG, "f1")
    top = pred.groupBy(by).agg(F.min(order).alias("b"))
    top = top.select(by, *[F.col(f"b.{c}").alias(c) for c in CONFIG], F.col("b.f1").alias("predicted_f1"))
    return top.join(best, by).withColumn("performance", F.round(F.try_divide("predicted_f1", "f1_max"), 4))


def importance(model: PipelineModel, features: list[str], like: DataFrame) -> DataFrame:
    """Feature importances of a fitted tree model as ``(Feature, Importance)``."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return like.sparkSession.createDataFrame(list(zip(features, values)), "Feature string, Importance double")


def coefficients(model: PipelineModel, features: list[str], like: DataFrame) -> DataFrame:
    """Intercept and weights of a fitted linear model."""
    last = model.stages[-1]
    rows = [("Intercept", float(last.intercept)), *zip(features, last.coefficients.toArray().tolist())]
    return like.sparkSession.createDataFrame(rows, "Feature string, Weight double")
