"""Whole pipelines composed from the operators."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators import analytics, cluster, em, evaluate, features, knn, linkage
from kindred.operators.blocking import overlap_block
from kindred.operators.encode import EmbeddingStore, encode_sides
from kindred.operators.prepare import serialise, side_union
from kindred.runtime import cut_lineage
from kindred.sources import trials

COMPONENTS = "ConnectedComponentsClustering"
STABLE = "KiralyMSMApproximateClustering"

RUN_SCHEMA = T.StructType([
    T.StructField("lm", T.StringType()), T.StructField("k", T.IntegerType()),
    T.StructField("clustering", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("runtime", T.DoubleType()),
    T.StructField("status", T.StringType()),
])


def similarity_graph(e1: DataFrame, e2: DataFrame, encoder: str, k: int, query_side: str = "left",
                     store: EmbeddingStore | None = None) -> DataFrame:
    """Entities -> candidate edges.  The encoder ``stored`` takes the frames' own ``embedding``; ``store`` keeps vectors for later runs."""
    if encoder == "stored":
        return knn.knn(e1, e2, k, query_side)
    both = side_union(e1 if "text" in e1.columns else serialise(e1), e2 if "text" in e2.columns else serialise(e2))
    left, right = encode_sides(both.select("side", "id", "text"), encoder, store)
    return knn.knn(left, right, k, query_side)


def match(ed: DataFrame, clustering: str, threshold: float) -> DataFrame:
    """One clustering of the pruned graph, as matches (or as a partition for components)."""
    pruned = cluster.prune(ed, threshold)
    return cluster.components(pruned) if clustering == COMPONENTS else cluster.MATCHERS[clustering](pruned)


def score(ed: DataFrame, gt: DataFrame, clustering: str, threshold: float) -> DataFrame:
    found = match(ed, clustering, threshold)
    return evaluate.evaluate_partition(found, gt) if clustering == COMPONENTS else evaluate.evaluate(found, gt)


def _tied(by_k: DataFrame) -> list[int]:
    """The k at which some record has edges of equal weight."""
    many = [by_k.groupBy("k", side, "sim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k").distinct() for side in ("l_id", "r_id")]
    return sorted(r["k"] for r in many[0].union(many[1]).distinct().collect())


def run_grid(ed: DataFrame, gt: DataFrame, ks: list[int], clusterings: list[str], thresholds: list[float]) -> DataFrame:
    """Scores of every (k, clustering, threshold) from one graph built at the largest k.

    A smaller k is a filter on rank.  Matchers that take edges in descending
    order run once per k and give all thresholds by counting; stable matching
    does so only without ties, so it runs for each threshold where a record has
    edges of equal weight.  Components of all (k, threshold) are read off the
    merges of one forest a k.  A (k, threshold) without edges scores 0.
    """
    ks, thresholds = sorted({int(k) for k in ks}), sorted({float(t) for t in thresholds})
    asked = ed.sparkSession.createDataFrame([(k, t) for k in ks for t in thresholds], "k int, threshold double")
    by_k = ed.withColumn("k", F.explode(F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: k >= F.col("rank"))))
    frames = []
    for name in clusterings:
        if name == COMPONENTS:
            out = linkage.component_curve(ed, gt, ks, thresholds)
        elif name == STABLE:
            above = cut_lineage(by_k.where(F.col("sim") >= min(thresholds)).select("k", "l_id", "r_id", "sim"), "above")
            tied = _tied(above)
            out = evaluate.threshold_curve(cluster.kiraly(above.where(~F.col("k").isin(tied)), ["k"]), gt, thresholds, ["k"])
            if tied:
                cuts = F.array(*[F.lit(t) for t in thresholds])
                at = above.where(F.col("k").isin(tied)).withColumn("threshold", F.explode(F.filter(cuts, lambda t: t <= F.col("sim"))))
                out = out.unionByName(evaluate.evaluate(cluster.kiraly(at, ["k", "threshold"]), gt, ["k", "threshold"]))
        else:
            # best match depends only on each record's best edges, so pruning commutes with it as well
            matched = cluster.MATCHERS[name](by_k.where(F.col("sim") >= float(min(thresholds))), ["k"])
            out = evaluate.threshold_curve(matched, gt, thresholds, ["k"])
        frames.append(evaluate.with_empty(out, asked, gt).withColumn("clustering", F.lit(name)))
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result.select("k", "clustering", "threshold", "tp", "predicted", "known", "precision", "recall", "f1")


def _one_run(graph: DataFrame, gt: DataFrame, config: dict) -> dict:
    """Scores of one configuration; nothing but its own k and threshold is evaluated."""
    k, t = int(config["k"]), float(config["threshold"])
    got = score(graph.where(F.col("rank") <= k), gt, config["clustering"], t).first()
    # a graph without an edge above the threshold predicts nothing
    return {c: float(got[c]) if got is not None else 0.0 for c in ("precision", "recall", "f1")}


def run_search(e1: DataFrame, e2: DataFrame, gt: DataFrame, configs: DataFrame, store: EmbeddingStore | None = None) -> DataFrame:
    """Run a list of configurations one by one: scores, own runtime in seconds, and a status.

    One graph is built for each encoder, at its largest k; its time is part of
    the runtime of each of its configurations, as if it ran alone.  Every
    configuration is a job group of its own.  Whatever fails inside one, an
    unknown name or a Spark job, is the status of its row and ends nothing else.
    For whole grids use ``run_grid``.
    """
    spark = e1.sparkSession
    asked = [r.asDict() for r in configs.select("lm", "k", "clustering", "threshold").distinct().orderBy("lm", "clustering", "k", "threshold").collect()]
    context, rows = spark.sparkContext, []
    for lm in sorted({c["lm"] for c in asked}):
        mine = [c for c in asked if c["lm"] == lm]
        graph, broken, started = None, None, time.perf_counter()
        try:
            context.setJobGroup(f"graph {lm}", f"similarity graph of {lm}")
            graph = cut_lineage(similarity_graph(e1, e2, lm, max(int(c["k"]) for c in mine), store=store), "graph")
        except Exception as problem:  # kept as the status of every configuration of this encoder
            broken = problem
        shared = time.perf_counter() - started
        for c in mine:
            started, scores, status = time.perf_counter(), dict.fromkeys(("precision", "recall", "f1")), "ok"
            try:
                if broken is not None:
                    raise broken
                context.setJobGroup(f"run {lm} {c['clustering']} {c['k']} {c['threshold']}", "one configuration")
                scores = _one_run(graph, gt, c)
            except Exception as problem:
                status = f"failed: {type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
            rows.append((lm, int(c["k"]), c["clustering"], float(c["threshold"]), scores["precision"], scores["recall"], scores["f1"],
                         round(shared + time.perf_counter() - started, 4), status))
    for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
        context.setLocalProperty(name, None)
    return spark.createDataFrame(rows, RUN_SCHEMA)


def search_to_log(e1: DataFrame, e2: DataFrame, gt: DataFrame, configs: DataFrame, path: str, sampler: str, dataset: str, seed: int,
                  at_once: int = 20, store: EmbeddingStore | None = None) -> int:
    """Run the configurations that the trials log does not hold yet for (sampler, dataset, seed), and append their trials.

    ``configs`` holds ``trial, lm, k, clustering, threshold``.  Trials are
    appended after every ``at_once`` runs, so an interrupted search goes on
    where it stopped, and a finished one adds nothing.  Failed runs are not
    logged and are tried again next time.  Returns how many trials were added.
    """
    spark = e1.sparkSession
    mine = (F.col("sampler") == sampler) & (F.col("dataset") == dataset) & (F.col("seed") == seed)
    done = trials.read_log(spark, path).where(mine).select(*trials.CONFIG)
    left = configs.join(done, trials.CONFIG, "left_anti").orderBy("lm", "trial").collect()  # a search's own list
    added, columns = 0, [*trials.CONFIG, "trial"]
    for i in range(0, len(left), at_once):
        part = spark.createDataFrame([tuple(r[c] for c in columns) for r in left[i:i + at_once]], "lm string, k int, clustering string, threshold double, trial bigint")
        ran = run_search(e1, e2, gt, part, store).where("status = 'ok'").join(part, trials.CONFIG)
        added += trials.append_new(ran.withColumns({"sampler": F.lit(sampler), "dataset": F.lit(dataset), "seed": F.lit(seed)}), path)
    return added


def run_recommended(e1: DataFrame, e2: DataFrame, gt: DataFrame, rec: DataFrame) -> DataFrame:
    """Measured scores of recommended configurations."""
    return run_search(e1, e2, gt, rec.select("lm", "k", "clustering", "threshold"))


def unsupervised_match(l: DataFrame, r: DataFrame, attr: str, n: int, types: dict[str, str], gt: DataFrame | None = None,
                       measures: set[str] | None = None, constraint: str | None = "dup_free", dedupe: bool = False,
                       max_iter: int = 40):
    """Block, compare, fit and decide: ``(parameters, scored pairs with pred)``."""
    cand = overlap_block(l, r, attr, n)
    if dedupe:
        cand = em_drop(cand)
    plan = features.feature_plan(types, measures)
    if gt is not None:
        cand = features.label(cand, gt)
    names = [p[0] for p in plan]
    table = cut_lineage(features.pair_features(cand, l, r, plan), "candidates")
    constant = features.constant_features(table, names)
    names = [c for c in names if c not in constant]
    keep = [c for c in table.columns if c not in constant]
    params, scored = em.em_fit(table.select(*keep), names, max_iter=max_iter, constraint=constraint)
    return params, em.decide(scored)


def em_drop(cand: DataFrame) -> DataFrame:
    return cand.where(F.col("l_id") < F.col("r_id"))


def convergence(tr: DataFrame, by: list[str]) -> DataFrame:
    """Budget curve with its ratio to the best grid trial of each dataset."""
    curve = analytics.budget_curve(tr.where(F.col("sampler") != "gridsearch"), by)
    top = analytics.max_f1(tr.where(F.col("sampler") == "gridsearch"), ["dataset"])
    return analytics.grid_ratio(curve, top, ["dataset"])
