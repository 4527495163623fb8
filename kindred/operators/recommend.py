"""Recommending a configuration for a dataset without known matches."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.analytics import CONFIG
from kindred.runtime import broadcast_if_small


def _exact(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", F.col("threshold").cast("decimal(6,4)"))


def candidates(tr: DataFrame, profiles: DataFrame, unseen: list[str]) -> DataFrame:
    """Distinct grid configurations times the profiles of the unseen datasets.

    The profile side has one row per named dataset, so the product grows only
    with the list the caller wrote down.
    """
    configs = tr.where(F.col("sampler") == "gridsearch").select(*CONFIG).distinct()
    named = configs.withColumn("dataset", F.explode(F.array(*[F.lit(d) for d in unseen])))
    return named.join(broadcast_if_small(profiles), "dataset")


def recommend(model: PipelineModel, cand: DataFrame, k: int) -> DataFrame:
    """Top k configurations per dataset by predicted F1."""
    scored = model.transform(cand)
    w = Window.partitionBy("dataset").orderBy(F.desc("predicted"), *CONFIG)
    return (scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
            .select("dataset", *CONFIG, F.col("predicted").alias("predicted_f1"), "place"))


def attach_real(rec: DataFrame, tr: DataFrame) -> DataFrame:
    """Real F1 of each recommendation if a trial has it, else -1."""
    known = _exact(tr).groupBy("dataset", "lm", "k", "clustering", "_t").agg(F.max("f1").alias("real_f1"))
    out = _exact(rec).join(known, ["dataset", "lm", "k", "clustering", "_t"], "left").drop("_t")
    return out.withColumn("real_f1", F.coalesce("real_f1", F.lit(-1.0)))


def compare(real: DataFrame, pred: DataFrame) -> DataFrame:
    """Join measured with predicted results on trimmed, cast keys."""
    def keyed(df):
        return df.withColumns({**{c: F.trim(F.col(c).cast("string")) for c in ("dataset", "lm", "clustering")},
                               "k": F.col("k").cast("double"), "threshold": F.col("threshold").cast("double")})
    keys = ["dataset", "lm", "k", "clustering", "threshold"]
    r = keyed(real).select(*keys, F.col("f1").alias("real_f1"), F.col("precision").alias("real_precision"),
                           F.col("recall").alias("real_recall"), "runtime")
    return r.join(keyed(pred).drop("real_f1"), keys)
