"""Clustering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.data import rounded, sql_greedy, sql_knn, vector_truth, vectors
from kindred.operators import cluster as cl
from kindred.operators import evaluate as ev
from kindred.operators.knn import knn

CUT = 0.3


def edges(spark, sf, k=10):
    l, r = vectors(spark, sf)
    return knn(l, r, k)


_EDGES = f"{sql_knn(10)}, ed AS MATERIALIZED (SELECT l_id, r_id, sim FROM knn WHERE sim >= {CUT})"

# Smallest reachable node per node, by a recursive walk over the pruned graph.
_COMPONENTS = """
nb AS MATERIALIZED (SELECT 'l' || l_id AS u, 'r' || r_id AS v FROM ed UNION SELECT 'r' || r_id, 'l' || l_id FROM ed),
walk AS (SELECT u, u AS v FROM nb UNION SELECT w.u, nb.v FROM walk w JOIN nb ON nb.u = w.v),
cc AS MATERIALIZED (SELECT u, min(v) AS cluster_id FROM walk GROUP BY u),
parts AS MATERIALIZED (SELECT u[1] AS side, u[2:] AS id, cluster_id FROM cc)"""


def sql_scores(tp: str, predicted: str, known: str, scale: int = 100, digits: int = 4) -> str:
    s = f"{scale}::DOUBLE * "
    return (f"round(coalesce({s}({tp}) / nullif({predicted}, 0), 0), {digits}) AS precision, "
            f"round(coalesce({s}({tp}) / nullif({known}, 0), 0), {digits}) AS recall, "
            f"round(coalesce({s}2 * ({tp}) / nullif(({predicted}) + ({known}), 0), 0), {digits}) AS f1")


@query("c1_prune_edges", f"WITH {_EDGES} SELECT l_id, r_id, sim FROM ed")
def _(spark, sf):
    return cl.prune(edges(spark, sf), CUT).drop("rank")


@query("c2_connected_components", f"WITH RECURSIVE {_EDGES}, {_COMPONENTS} SELECT side, id, cluster_id FROM parts")
def _(spark, sf):
    return cl.components(cl.prune(edges(spark, sf), CUT))


@query("c3_unique_mapping", f"WITH RECURSIVE {_EDGES}, {sql_greedy('ed')} SELECT l_id, r_id, sim FROM umc")
def _(spark, sf):
    return cl.unique_mapping(cl.prune(edges(spark, sf), CUT))


@query("c4_stable_matching", f"WITH RECURSIVE {_EDGES}, {sql_greedy('ed')} SELECT l_id, r_id, sim FROM umc")
def _(spark, sf):
    return cl.kiraly(cl.prune(edges(spark, sf), CUT))


@query("c5_best_match", f"""WITH {_EDGES},
a AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY sim DESC, l_id) AS n FROM ed),
b AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY sim DESC, r_id) AS m FROM a WHERE n = 1)
SELECT l_id, r_id, sim FROM b WHERE m = 1""")
def _(spark, sf):
    return cl.best_match(cl.prune(edges(spark, sf), CUT))


@query("c6_complete_partition", f"""WITH RECURSIVE {_EDGES}, {_COMPONENTS},
ids AS (SELECT 'l' AS side, CAST(l AS VARCHAR) AS id FROM vl UNION ALL SELECT 'r', CAST(r AS VARCHAR) FROM vr)
SELECT side, id, coalesce(cluster_id, side || id) AS cluster_id FROM ids LEFT JOIN parts USING (side, id)""")
def _(spark, sf):
    l, r = vectors(spark, sf)
    return cl.complete(cl.components(cl.prune(knn(l, r, 10), CUT)), l, r)


_UMC_COUNTS = """(SELECT count(*) FROM umc SEMI JOIN gt USING (l_id, r_id)) AS tp, (SELECT count(*) FROM umc) AS predicted,
  (SELECT count(*) FROM gt) AS known"""


@query("v1_evaluate_matches", f"""WITH RECURSIVE {_EDGES}, {sql_greedy('ed')}, s AS (SELECT {_UMC_COUNTS})
SELECT tp, predicted, known, {sql_scores('tp', 'predicted', 'known')} FROM s""")
def _(spark, sf):
    return ev.evaluate(cl.unique_mapping(cl.prune(edges(spark, sf), CUT)), vector_truth(spark, sf))


@query("v1_evaluate_components", f"""WITH RECURSIVE {_EDGES}, {_COMPONENTS},
sz AS (SELECT cluster_id, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr FROM parts GROUP BY cluster_id),
s AS (SELECT (SELECT count(*) FROM gt JOIN parts a ON a.side = 'l' AND a.id = CAST(l_id AS VARCHAR)
    JOIN parts b ON b.side = 'r' AND b.id = CAST(r_id AS VARCHAR) WHERE a.cluster_id = b.cluster_id) AS tp,
  (SELECT CAST(sum(nl * nr) AS BIGINT) FROM sz) AS predicted, (SELECT count(*) FROM gt) AS known)
SELECT tp, predicted, known, {sql_scores('tp', 'predicted', 'known')} FROM s""")
def _(spark, sf):
    return ev.evaluate_partition(cl.components(cl.prune(edges(spark, sf), CUT)), vector_truth(spark, sf))


@query("v1_cluster_level_precision", f"""WITH RECURSIVE {_EDGES}, {_COMPONENTS},
sz AS (SELECT cluster_id, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr FROM parts GROUP BY cluster_id),
h AS (SELECT a.cluster_id, count(*) AS hits FROM gt JOIN parts a ON a.side = 'l' AND a.id = CAST(l_id AS VARCHAR)
    JOIN parts b ON b.side = 'r' AND b.id = CAST(r_id AS VARCHAR) WHERE a.cluster_id = b.cluster_id GROUP BY a.cluster_id)
SELECT count(*) AS clusters, count(*) FILTER (coalesce(hits, 0) = nl * nr AND nl * nr > 0) AS correct,
  round(100.0::DOUBLE * count(*) FILTER (coalesce(hits, 0) = nl * nr AND nl * nr > 0) / count(*), 4) AS precision
FROM sz LEFT JOIN h USING (cluster_id) WHERE nl + nr > 1""")
def _(spark, sf):
    return ev.cluster_precision(cl.components(cl.prune(edges(spark, sf), CUT)), vector_truth(spark, sf))


@query("v2_evaluate_labels", f"""
WITH s AS (SELECT l_returnflag AS flag, CAST(sum(CASE WHEN l_tax > 0.04 AND l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS predicted,
  CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS known FROM lineitem GROUP BY 1)
SELECT flag, tp, predicted, known, {sql_scores('tp', 'predicted', 'known', 1, 6)} FROM s""")
def _(spark, sf):
    from catalog.data import table
    l = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("t"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("p"))
    return ev.evaluate_labels(l, "t", "p", ["flag"])


@query("v3_threshold_curve", f"""WITH RECURSIVE {sql_knn(10)}, ed AS MATERIALIZED (SELECT l_id, r_id, sim FROM knn WHERE sim >= 0.2), {sql_greedy('ed')},
t AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5])::DOUBLE AS threshold),
m AS (SELECT u.*, g.l_id IS NOT NULL AS hit FROM umc u LEFT JOIN gt g USING (l_id, r_id)),
s AS (SELECT threshold, count(*) FILTER (hit) AS tp, count(*) AS predicted, (SELECT count(*) FROM gt) AS known
  FROM t JOIN m ON m.sim >= threshold GROUP BY threshold)
SELECT threshold, tp, predicted, known, {sql_scores('tp', 'predicted', 'known')} FROM s""")
def _(spark, sf):
    matched = cl.unique_mapping(cl.prune(edges(spark, sf), 0.2))
    return ev.threshold_curve(matched, vector_truth(spark, sf), [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5])
