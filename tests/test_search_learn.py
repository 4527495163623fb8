import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import configs as cf
from kindred.operators import encode, export
from kindred.operators import learn as ml
from kindred.operators.knn import knn
from kindred.operators.recommend import attach_real
from kindred.plans import pipeline
from kindred.sources import entities, trials


def test_grid_size_and_exact_thresholds(spark):
    g = cf.grid(spark)
    assert g.count() == 39_900 == g.distinct().count()
    assert g.where("threshold = 0.5 AND lm = 'st5' AND k = 10 AND clustering = 'UniqueMappingClustering'").count() == 1


def test_random_and_low_discrepancy_configurations(spark):
    a = cf.random_configs(spark, 200, 16).collect()
    assert a == cf.random_configs(spark, 200, 16).coalesce(1).collect() != cf.random_configs(spark, 200, 64).collect()
    assert all(1 <= r["k"] <= 100 and 0.05 <= r["threshold"] < 0.95 for r in a)
    h = [r[0] for r in spark.range(1, 5).select(cf.radical_inverse(F.col("id"), 2)).collect()]
    assert h == [0.5, 0.25, 0.75, 0.125]


def test_pending_configurations(spark):
    g = cf.grid(spark).where("k = 1 AND lm = 'st5'")
    done = g.limit(10).withColumn("threshold", F.col("threshold").cast("double") + 1e-12)
    assert trials.pending(g, done).count() == g.count() - 10


def test_grid_scores_equal_single_runs(spark):
    rng = random.Random(3)
    side = lambda s: spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(s)], "id long, embedding array<float>")
    l, r = side(18), side(15)
    ed = knn(l, r, 4)
    gt = spark.createDataFrame([(i, i) for i in range(15)], "l_id long, r_id long")
    names = ["UniqueMappingClustering", "KiralyMSMApproximateClustering", "BestMatchClustering", pipeline.COMPONENTS]
    grid = {(x["k"], x["clustering"], x["threshold"]): x["f1"] for x in pipeline.run_grid(ed, gt, [2, 4], names, [0.3, 0.6]).collect()}
    for (k, name, t), f1 in grid.items():
        assert pipeline.score(ed.where(F.col("rank") <= k), gt, name, t).first()["f1"] == f1, (k, name, t)


def test_grid_scores_with_ties_and_without_edges(spark):
    rng = random.Random(0)
    rows = [(a, b, rng.choice([0.2, 0.4, 0.6]), 1 + i) for a in range(6) for i, b in enumerate(rng.sample(range(6), 3))]
    ed = spark.createDataFrame(rows, "l_id long, r_id long, sim double, rank int").coalesce(1)
    gt = spark.createDataFrame([(i, i) for i in range(6)], "l_id long, r_id long").coalesce(1)
    names = ["UniqueMappingClustering", pipeline.STABLE]
    grid = {(x["clustering"], x["threshold"]): x for x in pipeline.run_grid(ed, gt, [3], names, [0.1, 0.5, 0.9]).collect()}
    assert set(grid) == {(n, t) for n in names for t in (0.1, 0.5, 0.9)}
    for name in names:  # no edge is so heavy
        x = grid[name, 0.9]
        assert (x["tp"], x["predicted"], x["known"], x["f1"]) == (0, 0, 6, 0.0)
    for t in (0.1, 0.5):
        x, one = grid[pipeline.STABLE, t], pipeline.score(ed, gt, pipeline.STABLE, t).first()
        assert (x["tp"], x["predicted"], x["f1"]) == (one["tp"], one["predicted"], one["f1"])


def test_failed_configuration_becomes_a_row(spark):
    e = spark.createDataFrame([(1, "a b"), (2, "c d")], "id long, text string")
    gt = spark.createDataFrame([(1, 1)], "l_id long, r_id long")
    asked = spark.createDataFrame([("unknown", 1, "UniqueMappingClustering", 0.5), ("hashed_words", 1, "UniqueMappingClustering", 0.5)],
                                  "lm string, k int, clustering string, threshold double")
    out = {r["lm"]: r for r in pipeline.run_search(e, e, gt, asked).collect()}
    assert out["unknown"]["status"].startswith("failed") and out["hashed_words"]["status"] == "ok"
    assert out["hashed_words"]["recall"] == 100.0


def test_user_model_plugs_in(spark):
    def load():
        import numpy as np
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    encode.register_model("length", load)
    e = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    assert [r["embedding"] for r in encode.encode(e, "length").orderBy("id").collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_validation_share_is_exact_and_stable(spark):
    df = spark.range(1037).select("id", F.when(F.col("id") % 10 == 0, "D2").otherwise("D1").alias("dataset"))
    pick = lambda d: {r["id"] for r in ml.validation_split(d, ["id"], 42).where("is_valid = 1").collect()}
    a = pick(df)
    assert len(a) == 94 + 11 and a == pick(df.repartition(9))


def test_pair_split_sizes(spark):
    pairs = spark.range(1003).select(F.col("id").alias("l_id"), F.col("id").alias("r_id"))
    n = {r["split"]: r["count"] for r in export.split_pairs(pairs).groupBy("split").count().collect()}
    assert n == {"train": 601, "test": 200, "valid": 202}


def test_regressors_learn_and_search_picks_the_lowest_error(spark):
    rng = random.Random(4)
    rows = [(f"D{i % 3}", float(i % 7), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(d, k, t, 3 * k + 10 * t) for d, k, t in rows], "dataset string, k double, threshold double, f1 double")
    linear = ml.regressor("LINEAR", ["k", "threshold"]).fit(df).transform(df)
    assert ml.error_scores(linear, "f1", "predicted").first()["r2"] > 0.999
    model, params, mse = ml.tune("RIDGE", ["k", "threshold"], df.where("dataset <> 'D0'"), df.where("dataset = 'D0'"), n=4)
    assert mse >= 0 and set(params) == {"regParam"} and ml.draw("RIDGE", 4, 42)[0] != ml.draw("RIDGE", 4, 42)[1]
    forest = ml.regressor("RF", ["k", "threshold"], numTrees=5, maxDepth=4).fit(df)
    assert abs(sum(r["Importance"] for r in ml.importance(forest, ["k", "threshold"], df).collect()) - 1) < 1e-9


def test_real_score_lookup(spark):
    rec = spark.createDataFrame([("D1", "st5", 10, "U", 0.7500000000000001), ("D1", "st5", 10, "U", 0.2)],
                                "dataset string, lm string, k int, clustering string, threshold double")
    tr = spark.createDataFrame([("D1", "st5", 10, "U", 0.75, 88.0)], "dataset string, lm string, k int, clustering string, threshold double, f1 double")
    assert {r["threshold"]: r["real_f1"] for r in attach_real(rec, tr).collect()} == {0.7500000000000001: 88.0, 0.2: -1.0}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key|name|size\n1|x y|007\n2||3\n")
    e = entities.read_entities(spark, str(tmp_path / "a.csv"), "|", "key")
    assert [tuple(r) for r in e.orderBy("id").collect()] == [("1", "x y", "007"), ("2", None, "3")]
    assert entities.read_pairs(spark).count() == 0
    (tmp_path / "b.csv").write_text("id,name\n1,x\n1,y\n")
    with pytest.raises(ValueError):
        entities.read_keyed(spark, str(tmp_path / "b.csv"))
