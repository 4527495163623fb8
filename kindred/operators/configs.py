"""Configuration spaces: full grid, seeded random, low-discrepancy, and proposals from past trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators.encode import CONFIGURED_ENCODERS
from kindred.runtime import running_sums

# The configuration space and the search budgets and seeds.
SPACE = {
    "lm": CONFIGURED_ENCODERS,
    "k": (1, 100),
    "clustering": ["UniqueMappingClustering", "KiralyMSMApproximateClustering", "ConnectedComponentsClustering"],
    "threshold": (0.05, 0.95, 0.05),
}
SEEDS = [16, 64, 256, 1024, 4096]
BUDGETS = list(range(5, 105, 5))


def _pick(values: list[str], u: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int")]


def _scaled(space: dict, u: dict[str, Column], continuous: bool) -> list[Column]:
    lo, hi = space["k"]
    t_lo, t_hi, t_step = space["threshold"]
    k = (F.lit(lo) + F.least(F.floor(u["k"] * (hi - lo + 1)), F.lit(hi - lo))).cast("int")
    if continuous:
        t = F.lit(t_lo) + u["threshold"] * (t_hi - t_lo)
    else:
        steps = round((t_hi - t_lo) / t_step)
        t = F.round(F.lit(t_lo) + F.least(F.floor(u["threshold"] * (steps + 1)), F.lit(steps)) * t_step, 2)
    return [_pick(space["lm"], u["lm"]).alias("lm"), k.alias("k"),
            _pick(space["clustering"], u["clustering"]).alias("clustering"), t.cast("double").alias("threshold")]


def grid(spark: SparkSession, space: dict = SPACE) -> DataFrame:
    """Every combination; thresholds are exact decimals.  Rows are generated, not joined."""
    lo, hi = space["k"]
    t_lo, t_hi, t_step = (round(x * 100) for x in space["threshold"])
    n_lm, n_k, n_c = len(space["lm"]), hi - lo + 1, len(space["clustering"])
    n_t = (t_hi - t_lo) // t_step + 1
    i = F.col("id")
    t = F.lit(t_lo) + i % n_t * t_step
    c = F.floor(i / n_t) % n_c
    k = F.lit(lo) + F.floor(i / (n_t * n_c)) % n_k
    m = F.floor(i / (n_t * n_c * n_k))
    return spark.range(n_lm * n_k * n_c * n_t).select(
        F.array(*[F.lit(v) for v in space["lm"]])[m.cast("int")].alias("lm"), k.cast("int").alias("k"),
        F.array(*[F.lit(v) for v in space["clustering"]])[c.cast("int")].alias("clustering"),
        (t / 100).cast("decimal(4,2)").alias("threshold"))


def uniform(seed: int, index: Column, name: str) -> Column:
    """A number in [0, 1) that depends only on seed, index and name, never on partitioning: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), index.cast("string"), F.lit(name)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def random_configs(spark: SparkSession, n: int, seed: int, space: dict = SPACE) -> DataFrame:
    i = F.col("id")
    u = {p: uniform(seed, i, p) for p in ("lm", "k", "clustering", "threshold")}
    return spark.range(n).select(i.alias("trial"), *_scaled(space, u, True))


def radical_inverse(index: Column, base: int, digits: int = 24) -> Column:
    """Digits of ``index`` mirrored at the point."""
    terms = [F.floor(index / F.lit(base ** d)) % base / F.lit(float(base ** (d + 1)))
             for d in range(digits) if base ** (d + 1) < 2 ** 53]
    return reduce(lambda a, b: a + b, terms)


def halton_configs(df: DataFrame, index: str, space: dict = SPACE) -> DataFrame:
    """Low-discrepancy configurations, one per row of ``df`` by its index (from 1); bases 2, 3, 5, 7."""
    i = F.col(index)
    u = {p: radical_inverse(i, b) for p, b in (("lm", 2), ("k", 3), ("clustering", 5), ("threshold", 7))}
    return df.select(i.alias("trial"), *_scaled(space, u, True))


def _levels(df: DataFrame, t_bins: int, k_bins: int) -> DataFrame:
    return df.withColumn("k_bin", F.floor((F.col("k") - 1) * k_bins / 100).cast("int")).withColumn(
        "t_bin", F.floor(F.col("threshold").cast("double") * t_bins).cast("int"))


def density_scores(tr: DataFrame, top: float = 0.25, t_bins: int = 10, k_bins: int = 10) -> DataFrame:
    """Per dataset, parameter and level: smoothed log ratio of good to other trials.

    Good trials are those whose F1 is at least the dataset's (1 - top) quantile
    of distinct scores' positions; ``cut`` is found by counting, not by sorting
    all rows.
    """
    per_score = tr.groupBy("dataset", "f1").agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(per_score, ["dataset"], [F.desc("f1")], {"above": "n"})
    total = per_score.groupBy("dataset").agg(F.sum("n").alias("all"))
    cut = (run.join(total, "dataset").where(F.col("above") >= F.ceil(F.col("all") * F.lit(top)))
           .groupBy("dataset").agg(F.max("f1").alias("cut")))
    marked = _levels(tr, t_bins, k_bins).join(cut, "dataset").withColumn(
        "good", F.when(F.col("f1") >= F.col("cut"), 1).otherwise(0))
    params = F.array(*[F.struct(F.lit(n).alias("param"), F.col(c).cast("string").alias("level"))
                       for n, c in (("lm", "lm"), ("clustering", "clustering"), ("k", "k_bin"), ("threshold", "t_bin"))])
    counts = (marked.select("dataset", "good", F.inline(params)).groupBy("dataset", "param", "level")
              .agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")))
    sums = counts.groupBy("dataset", "param").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"),
                                                  F.count(F.lit(1)).alias("m"))
    ratio = F.log(((F.col("g") + 1) / (F.col("gs") + F.col("m"))) / ((F.col("b") + 1) / (F.col("bs") + F.col("m"))))
    return counts.join(sums, ["dataset", "param"]).select("dataset", "param", "level", ratio.alias("score"))


def propose(tr: DataFrame, candidates: DataFrame, n: int, top: float = 0.25, t_bins: int = 10, k_bins: int = 10) -> DataFrame:
    """The n best candidates per dataset by summed log ratio; unseen levels score 0.

    The score table has at most a few dozen rows per dataset; candidates join it
    once per parameter.
    """
    scores = density_scores(tr, top, t_bins, k_bins)
    out = _levels(candidates, t_bins, k_bins)
    for name, col in (("lm", "lm"), ("clustering", "clustering"), ("k", "k_bin"), ("threshold", "t_bin")):
        s = scores.where(F.col("param") == name).select(F.col("dataset").alias("_ds"), F.col("level").alias("_lv"),
                                                        F.col("score").alias(f"_s_{name}"))
        out = out.join(s, (F.col("dataset") == F.col("_ds")) & (F.col(col).cast("string") == F.col("_lv")), "left").drop("_ds", "_lv")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_s_{p}"), F.lit(0.0)) for p in ("lm", "clustering", "k", "threshold")])
    keys = ["lm", "k", "clustering", "threshold"]
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), *keys)
    return (out.select("dataset", *keys, F.round(total, 8).alias("score"))
            .withColumn("place", F.row_number().over(w)).where(F.col("place") <= n))


def best_trial(tr: DataFrame, by: list[str]) -> DataFrame:
    """Best trial per study; ties go to the smaller trial number, then to the configuration order."""
    order = F.struct((-F.col("f1")).alias("s"), "trial", "lm", "k", "clustering", "threshold", "runtime")
    best = tr.groupBy(*by).agg(F.min(order).alias("b"))
    return best.select(*by, F.col("b.trial").alias("trial"), F.col("b.lm").alias("lm"), F.col("b.k").alias("k"),
                       F.col("b.clustering").alias("clustering"), F.col("b.threshold").alias("threshold"),
                       (-F.col("b.s")).alias("f1"))
