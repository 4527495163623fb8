"""Precision, recall and F1 of match sets, label columns and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.runtime import with_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def scores(tp: Column, predicted: Column, known: Column, percent: bool = True, digits: int | None = 4) -> dict:
    """Precision, recall and F1 columns; a zero denominator scores 0."""
    scale = 100 if percent else 1
    out = {"precision": _ratio(tp, predicted) * scale, "recall": _ratio(tp, known) * scale,
           "f1": _ratio(2 * tp, predicted + known) * scale}
    return {k: F.round(v, digits) for k, v in out.items()} if digits is not None else out


def _score_columns(df: DataFrame, by: list[str], percent: bool = True, digits: int | None = 4) -> DataFrame:
    s = scores(F.col("tp"), F.col("predicted"), F.col("known"), percent, digits)
    return df.select(*by, "tp", "predicted", "known", *[v.alias(k) for k, v in s.items()])


def evaluate(matches: DataFrame, gt: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pair-level scores in percent, per group of ``by`` or overall."""
    by = by or []
    m = matches.select(*by, "l_id", "r_id").distinct()
    g = gt.select("l_id", "r_id").distinct()
    flagged = m.join(g.withColumn("hit", F.lit(1)), ["l_id", "r_id"], "left")
    counts = flagged.groupBy(*by).agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("predicted"))
    return _score_columns(with_totals(counts, g.agg(F.count(F.lit(1)).alias("known"))), by)


def evaluate_labels(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Scores as fractions from two 0/1 columns."""
    by = by or []
    t, p = F.col(truth), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.coalesce(F.sum(t * p), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(p), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(t), F.lit(0)).alias("known"))
    return _score_columns(counts, by, percent=False, digits=6)


def evaluate_partition(clusters: DataFrame, gt: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of a partition ``(by, side, id, cluster_id)`` without listing its pairs.

    Predicted pairs are counted as left size times right size per cluster; true
    ones by looking up both ends of each known match.
    """
    by = by or []
    sizes = clusters.groupBy(*by, "cluster_id").agg(
        F.sum(F.when(F.col("side") == "l", 1).otherwise(0)).alias("nl"),
        F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("nr"))
    predicted = sizes.groupBy(*by).agg(F.sum(F.col("nl") * F.col("nr")).alias("predicted"))
    g = gt.select(F.col("l_id").cast("string").alias("l_id"), F.col("r_id").cast("string").alias("r_id")).distinct()
    left = clusters.where(F.col("side") == "l").select(*by, F.col("id").alias("l_id"), F.col("cluster_id").alias("lc"))
    right = clusters.where(F.col("side") == "r").select(*by, F.col("id").alias("r_id"), F.col("cluster_id").alias("rc"))
    hit = g.join(left, "l_id").join(right, [*by, "r_id"])
    tp = hit.groupBy(*by).agg(F.sum(F.when(F.col("lc") == F.col("rc"), 1).otherwise(0)).alias("tp"))
    if by:
        counts = predicted.join(tp, by, "left")
    else:
        counts = with_totals(predicted, tp)
    counts = counts.withColumn("tp", F.coalesce("tp", F.lit(0)))
    return _score_columns(with_totals(counts, g.agg(F.count(F.lit(1)).alias("known"))), by)


def cluster_precision(clusters: DataFrame, gt: DataFrame) -> DataFrame:
    """Paper form: share of clusters with two or more records whose pairs are all known matches."""
    sizes = clusters.groupBy("cluster_id").agg(
        F.sum(F.when(F.col("side") == "l", 1).otherwise(0)).alias("nl"),
        F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("nr"))
    g = gt.select(F.col("l_id").cast("string").alias("l_id"), F.col("r_id").cast("string").alias("r_id")).distinct()
    left = clusters.where(F.col("side") == "l").select(F.col("id").alias("l_id"), F.col("cluster_id").alias("lc"))
    right = clusters.where(F.col("side") == "r").select(F.col("id").alias("r_id"), F.col("cluster_id").alias("rc"))
    inside = (g.join(left, "l_id").join(right, "r_id").where(F.col("lc") == F.col("rc"))
              .groupBy(F.col("lc").alias("cluster_id")).agg(F.count(F.lit(1)).alias("hits")))
    multi = sizes.where(F.col("nl") + F.col("nr") > 1).join(inside, "cluster_id", "left")
    ok = F.coalesce("hits", F.lit(0)) == F.col("nl") * F.col("nr")
    good = F.sum(F.when(ok & (F.col("nl") * F.col("nr") > 0), 1).otherwise(0))
    return multi.agg(F.count(F.lit(1)).alias("clusters"), good.alias("correct"),
                     F.round(_ratio(good, F.count(F.lit(1))) * 100, 4).alias("precision"))


def threshold_curve(matched: DataFrame, gt: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Scores of one matching at every threshold, from one pass over its edges.

    ``matched`` must be built in descending similarity (unique mapping, stable
    matching without ties): its matching at threshold t is then its own edges
    with sim >= t.
    """
    by = by or []
    cuts = sorted(thresholds)
    level = sum([F.when(F.col("sim") >= F.lit(float(t)), 1).otherwise(0) for t in cuts], F.lit(0))
    g = gt.select("l_id", "r_id").distinct()
    flagged = matched.select(*by, "l_id", "r_id", level.alias("level")).where(F.col("level") > 0).join(
        g.withColumn("hit", F.lit(1)), ["l_id", "r_id"], "left")
    steps = flagged.groupBy(*by, "level").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("predicted"))
    at = F.array(*[F.lit(float(t)) for t in cuts])
    curve = (steps.select(*by, "tp", "predicted", F.explode(F.slice(at, F.lit(1), F.col("level"))).alias("threshold"))
             .groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted")))
    return _score_columns(with_totals(curve, g.agg(F.count(F.lit(1)).alias("known"))), [*by, "threshold"])


def with_empty(scored: DataFrame, asked: DataFrame, gt: DataFrame) -> DataFrame:
    """Scores of every group of ``asked`` (its columns name it): a group without a match predicts nothing and scores 0."""
    by = asked.columns
    counts = asked.join(scored.select(*by, "tp", "predicted"), by, "left").fillna(0, ["tp", "predicted"])
    known = gt.select("l_id", "r_id").distinct().agg(F.count(F.lit(1)).alias("known"))
    return _score_columns(with_totals(counts, known), by)
