"""Questions over the trials log and over result sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import with_totals

CONFIG = ["lm", "k", "clustering", "threshold"]

# Short names used in result tables.
CLUSTERING_SHORT = {
    "UniqueMappingClustering": "UMC",
    "KiralyMSMApproximateClustering": "KMAC",
    "ConnectedComponentsClustering": "CCC",
}
FEATURE_SHORT = {
    "InputEntityProfiles": "F1",
    "NumberOfAttributes": "F2",
    "NumberOfDistinctValues": "F3",
    "NumberOfNameValuePairs": "F4",
    "AverageNVPairsPerEntity": "F5",
    "AverageNVpairsPerAttribute": "F6",
    "AverageDistinctValuesPerEntity": "F7",
    "AverageDistinctValuesPerAttribute": "F8",
    "MaxValuesPerEntity": "F9",
    "NumberOfMissingNVpairs": "F10",
    "AverageValueTokens": "F11",
    "AverageValueLength": "F12",
}


def lookup(names: dict[str, str], c: Column) -> Column:
    """Map fixed names; an unknown name stays."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def natural_order(c: Column) -> Column:
    """Number behind a letter, so that D2 sorts before D10."""
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def by_source(tr: DataFrame, kind: str) -> DataFrame:
    """``gridsearch`` trials, sampled ones (``optuna``), or ``all``."""
    if kind == "all":
        return tr
    return tr.where(F.col("sampler") == "gridsearch") if kind == "gridsearch" else tr.where(F.col("sampler") != "gridsearch")


def nonzero(tr: DataFrame) -> DataFrame:
    return tr.where(F.col("f1") != 0)


def dedupe(tr: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Whole-row duplicates, or one row per ``keys`` with the smallest ``order``."""
    if keys is None:
        return tr.dropDuplicates()
    rest = [c for c in tr.columns if c not in keys]
    first = F.min(F.struct(*(order or []), *[c for c in rest if c not in (order or [])]))
    kept = tr.groupBy(*keys).agg(first.alias("b"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in tr.columns])


def max_f1(tr: DataFrame, by: list[str], name: str = "f1_max") -> DataFrame:
    return tr.groupBy(*by).agg(F.max("f1").alias(name))


def min_max_f1(tr: DataFrame, by: list[str]) -> DataFrame:
    return tr.groupBy(*by).agg(F.min("f1").alias("min"), F.max("f1").alias("max"))


def best_row(tr: DataFrame, by: list[str], score: str = "f1", ties: list[str] | None = None) -> DataFrame:
    """The whole best row per group; only the best rows of each task are shuffled."""
    ties = ties or ["trial", *CONFIG]
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return tr.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def tied_best(tr: DataFrame, by: list[str]) -> DataFrame:
    """All rows that reach their group's best F1."""
    return tr.join(max_f1(tr, by, "_top"), by).where(F.col("f1") == F.col("_top")).drop("_top")


def runtime_hours(tr: DataFrame, by: list[str]) -> DataFrame:
    return tr.groupBy(*by).agg(F.floor(F.sum("runtime") / 3600).cast("long").alias("hours"))


def counts(tr: DataFrame, by: list[str]) -> DataFrame:
    return tr.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"))


def segments(df: DataFrame, by: list[str], order: list[str], changed: list[str], bucket: Column,
             boundary: Column | None = None) -> DataFrame:
    """Number the runs of an ordered log: a new segment starts when a ``changed`` column changes.

    ``boundary`` (a condition on the previous row's values, as column
    expression over ``df``) starts a new segment after the rows where it holds.
    ``bucket`` must grow with the order.  Runs are counted inside
    (group, bucket) and stitched over bucket edges from one summary row per
    bucket, so a group with a large share of all rows is split over many tasks.
    """
    base = df.withColumn("_bucket", bucket).withColumn("_end", boundary if boundary is not None else F.lit(False))
    state = F.struct(*changed, "_end")
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    marked = base.withColumn("_prev", F.lag(state).over(w))

    def differs(prev):
        parts = [~F.col(c).eqNullSafe(prev[c]) for c in changed] + [prev["_end"]]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    marked = marked.withColumn("_new", F.when(F.col("_prev").isNull(), 0).when(differs(F.col("_prev")), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    edge = marked.groupBy(*by, "_bucket").agg(F.min_by(state, key).alias("head"), F.max_by(state, key).alias("tail"),
                                              F.sum("_new").alias("inside"))
    we = Window.partitionBy(*by).orderBy("_bucket")
    before = F.lag("tail").over(we)
    head = F.col("head")
    edge = edge.withColumn("_before", before)
    jump = [~head[c].eqNullSafe(F.col("_before")[c]) for c in changed] + [F.col("_before")["_end"]]
    cond = jump[0]
    for j in jump[1:]:
        cond = cond | j
    edge = edge.withColumn("_jump", F.when(F.col("_before").isNull(), 0).when(cond, 1).otherwise(0))
    run = F.sum(F.col("inside") + F.col("_jump")).over(we.rowsBetween(Window.unboundedPreceding, 0))
    offset = edge.withColumn("_offset", run - F.col("inside")).select(*by, "_bucket", "_offset")
    out = marked.join(offset, [*by, "_bucket"])
    return out.withColumn("segment", (F.col("_run") + F.col("_offset") + 1).cast("long")).drop(
        "_bucket", "_end", "_prev", "_new", "_run", "_offset")


def budget_curve(tr: DataFrame, by: list[str], budget: str = "budget", seed: str = "seed") -> DataFrame:
    """Best F1 per (budget, seed), then the mean over seeds."""
    top = tr.groupBy(*by, budget, seed).agg(F.max("f1").alias("f1"))
    return top.groupBy(*by, budget).agg(F.avg("f1").alias("f1"))


def grid_ratio(curve: DataFrame, grid_best: DataFrame, on: list[str], value: str = "f1", name: str = "f1_ratio") -> DataFrame:
    """Ratio of a curve to the grid best; ``grid_best`` has one row per dataset."""
    top = [c for c in grid_best.columns if c not in on][0]
    return curve.join(grid_best, on).withColumn(name, F.try_divide(F.col(value), F.col(top))).drop(top)


def budget_runtime(tr: DataFrame, by: list[str], budget: str = "budget", seed: str = "seed") -> DataFrame:
    total = tr.groupBy(*by, budget, seed).agg(F.sum("runtime").alias("runtime"))
    return total.groupBy(*by, budget).agg(F.avg("runtime").alias("avg_runtime"))


def curve_auc(curve: DataFrame, by: list[str], x: str = "budget", y: str = "f1") -> DataFrame:
    """Trapezoid area over the budgets, divided by (largest budget x 100).

    A curve has one row per budget (at most a few dozen), so its window is small.
    """
    w = Window.partitionBy(*by).orderBy(x)
    strip = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return (curve.withColumn("_a", strip).groupBy(*by)
            .agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"),
                 F.try_divide(F.coalesce(F.sum("_a"), F.lit(0.0)), F.max(x) * 100.0).alias("auc")))


def mean_curve(curve: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg(*[F.avg(v).alias(f"avg_{v}") for v in values])


def pivot_ratio(curve: DataFrame, row: str, col: str, value: str, cols: list, prefix: str = "") -> DataFrame:
    """One row per dataset in natural order, one column per budget, and how many cells exceed 1."""
    wide = curve.groupBy(row).pivot(col, cols).agg(F.first(value))
    over = sum([F.when(F.col(f"`{c}`") > 1.0, 1).otherwise(0) for c in cols], F.lit(0))
    return wide.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols], over.alias("above_one")) \
               .orderBy(natural_order(F.col(row)), row)


def fixed_config(tr: DataFrame, lm: str, k: int, clustering: str, threshold: str) -> DataFrame:
    """Trials of one configuration; the threshold is compared as an exact decimal."""
    return tr.where((F.col("lm") == lm) & (F.col("k") == k) & (F.col("clustering") == clustering)
                    & (F.col("threshold").cast("decimal(4,2)") == F.lit(threshold).cast("decimal(4,2)")))


def histogram(tr: DataFrame, by: list[str], value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum; the maximum is in the last bin."""
    ends = tr.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    pos = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    return (tr.select(*by, value).join(ends, by)
            .withColumn("bin", F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, nulls, mean, sample deviation, minimum and maximum per column, one pass."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}|count"), F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"{c}|nulls"),
                 F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"),
                 F.min(F.col(c).cast("double")).alias(f"{c}|min"), F.max(F.col(c).cast("double")).alias(f"{c}|max")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s)
                                             for s in ("count", "nulls", "mean", "std", "min", "max")]) for c in cols])))


def quantiles(df: DataFrame, col: str, shares: list[float], cells: int = 1024) -> DataFrame:
    """Exact interpolated quantiles without a global sort.

    Counts per value range find the ranges that hold the wanted ranks; only
    those ranges are looked at value by value.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    cell = F.least(F.lit(cells - 1), F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * cells,
                                                                     F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    placed = with_totals(v, ends).withColumn("cell", cell)
    per_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("cell")  # at most `cells` rows
    start = per_cell.withColumn("start", F.sum("c").over(w) - F.col("c"))
    wanted = with_totals(start, ends.select("n"))
    rank = [(q, F.lit(q) * (F.col("n") - 1)) for q in shares]
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), r.alias("r")) for q, r in rank])
    need = wanted.select("cell", "start", "c", F.inline(ranks)).where(
        (F.floor("r") < F.col("start") + F.col("c")) & (F.ceil("r") >= F.col("start")))
    values = placed.join(need.select("cell", "start").distinct(), "cell").groupBy("cell", "start", "v").agg(
        F.count(F.lit(1)).alias("c"))
    wv = Window.partitionBy("cell").orderBy("v")
    spans = values.withColumn("to", F.col("start") + F.sum("c").over(wv)).withColumn("from", F.col("to") - F.col("c"))
    hit = spans.join(need.select("cell", "q", "r"), "cell")
    at = lambda i: F.max(F.when((i >= F.col("from")) & (i < F.col("to")), F.col("v")))
    pair = hit.groupBy("q", "r").agg(at(F.floor("r")).alias("a"), at(F.ceil("r")).alias("b"))
    return pair.select("q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - F.floor("r"))).alias("value"))


def attach_runtime(results: DataFrame, tr: DataFrame) -> DataFrame:
    """Left join results to one trial per (dataset, configuration) on the threshold rounded to four digits."""
    t4 = lambda c: F.round(F.col(c), 4).cast("decimal(6,4)")
    keyed = tr.select(F.col("dataset").alias("TEST_SET"), F.col("clustering").alias("CLUSTERING"), F.col("lm").alias("LM"),
                      F.col("k").alias("K"), t4("threshold").alias("_t"), "trial", "runtime")
    one = keyed.groupBy("TEST_SET", "CLUSTERING", "LM", "K", "_t").agg(
        F.min(F.struct("trial", "runtime")).alias("b")).withColumn("PIPELINE_RUNTIME", F.col("b.runtime")).drop("b")
    return results.withColumn("_t", t4("THRESHOLD")).join(one, ["TEST_SET", "CLUSTERING", "LM", "K", "_t"], "left").drop("_t")


def without_runtime(results: DataFrame, tr: DataFrame) -> DataFrame:
    """Results whose configuration has no trial."""
    t4 = lambda c: F.round(F.col(c), 4).cast("decimal(6,4)")
    keyed = tr.select(F.col("dataset").alias("TEST_SET"), F.col("clustering").alias("CLUSTERING"), F.col("lm").alias("LM"),
                      F.col("k").alias("K"), t4("threshold").alias("_t")).distinct()
    return results.withColumn("_t", t4("THRESHOLD")).join(
        keyed, ["TEST_SET", "CLUSTERING", "LM", "K", "_t"], "left_anti").drop("_t")


def ordered_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows in a seeded random order, that of the MD5 of seed and keys, which does not depend on partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.orderBy(digest, *keys).limit(n)


def feature_gain(results: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with and without dataset features side by side, in one aggregate."""
    def value(flag):
        return F.max(F.when(F.col("WITH_DATA_FEATURES") == flag, F.col("PREDICTED_F1")))
    return results.groupBy(*keys).agg(value(1).alias("f1_with"), value(0).alias("f1_without")).where(
        F.col("f1_with").isNotNull())


def wins(side_by_side: DataFrame) -> DataFrame:
    won = F.sum(F.when(F.col("f1_with") >= F.col("f1_without"), 1).otherwise(0))
    return side_by_side.agg(won.alias("wins"), F.count(F.lit(1)).alias("rows"),
                            F.try_divide(won.cast("double"), F.count(F.lit(1))).alias("share"))


def presentation(results: DataFrame) -> DataFrame:
    """Best result per test set with hours, rounded scores and short names, in natural order."""
    w = Window.partitionBy("TEST_SET").orderBy(F.desc("PREDICTED_F1"), "DATASET", "REGRESSOR", "LM", "K", "CLUSTERING",
                                               "THRESHOLD")
    best = results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    return best.select(
        "TEST_SET", "DATASET", "REGRESSOR", F.round("PREDICTED_F1", 2).alias("F1"),
        F.round("GLOBAL_BEST_F1", 2).alias("GB_F1"), F.round("PERFORMANCE", 2).alias("F1_RATIO"),
        F.round(F.col("OPTIMIZATION_TIME") / 3600, 0).cast("int").alias("HOURS"),
        "LM", "K", lookup(CLUSTERING_SHORT, F.col("CLUSTERING")).alias("CLUSTERING"), "THRESHOLD",
    ).orderBy(natural_order(F.col("TEST_SET")), "TEST_SET")


def phase_times(results: DataFrame) -> DataFrame:
    """Mean optimisation, fit and prediction time per (test set, trials type, regressor)."""
    return results.groupBy("TEST_SET", "DATASET", "REGRESSOR").agg(
        F.avg("OPTIMIZATION_TIME").alias("optimization_time"), F.avg("BEST_REGRESSOR_FIT_TIME").alias("fit_time"),
        F.avg("BEST_REGRESSOR_PREDICTION_TIME").alias("prediction_time"))


def max_phase_times(times: DataFrame) -> DataFrame:
    return times.groupBy("REGRESSOR").agg(*[F.max(c).alias(c) for c in ("optimization_time", "fit_time", "prediction_time")])


def fold_feature(c: Column) -> Column:
    """One-hot columns of a parameter under the parameter's name."""
    return F.regexp_replace(F.regexp_replace(c, "^lm_.*", "lm"), "^clustering_.*", "clustering")


def importance_ranking(imp: DataFrame) -> DataFrame:
    """Mean importance per feature, one-hots folded and summed, ranked."""
    mean = imp.groupBy("FEATURE").agg(F.avg("IMPORTANCE").alias("IMPORTANCE"))
    folded = mean.groupBy(fold_feature(F.col("FEATURE")).alias("FEATURE")).agg(F.sum("IMPORTANCE").alias("IMPORTANCE"))
    return folded.orderBy(F.desc("IMPORTANCE"), "FEATURE")


def importance_matrix(imp: DataFrame) -> DataFrame:
    """Test sets by F1..F12, in natural order."""
    feats = list(FEATURE_SHORT)
    summed = (imp.withColumn("FEATURE", fold_feature(F.col("FEATURE"))).where(F.col("FEATURE").isin(feats))
              .groupBy("TEST_SET", "FEATURE").agg(F.sum("IMPORTANCE").alias("IMPORTANCE")))
    wide = summed.groupBy("TEST_SET").pivot("FEATURE", feats).agg(F.first("IMPORTANCE"))
    return wide.select("TEST_SET", *[F.col(f).alias(s) for f, s in FEATURE_SHORT.items()]).orderBy(
        natural_order(F.col("TEST_SET")), "TEST_SET")
