"""Candidate generation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.data import (
    SQL_PARTS, aggregated_parts, document_sides, document_truth, part_truth, rounded, sql_knn, sql_overlap, table,
    two_sides, vectors,
)
from kindred.operators import blocking as blk
from kindred.operators import knn as nn
from kindred.operators.encode import encode_sides
from kindred.operators.prepare import side_union
from kindred.runtime import shared_dir


@query("b1_encode_text", r"""
WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'l' ELSE 'r' END AS side, coalesce(text, '') AS text FROM documents),
x AS MATERIALIZED (SELECT DISTINCT text FROM d),
w AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS t FROM x),
f AS MATERIALIZED (SELECT text, CAST(('0x' || left(md5(t), 8))::BIGINT % 256 AS INT) AS dim, count(*) AS n FROM w GROUP BY ALL),
i AS (SELECT dim, ln(((SELECT count(*) FROM x) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM f GROUP BY dim),
v AS MATERIALIZED (SELECT text, dim, n * idf AS w FROM f JOIN i USING (dim)),
s AS (SELECT text, sqrt(sum(w * w)) AS norm FROM v GROUP BY text)
SELECT 'hashed_words' AS encoder, side, id, dim, round(CAST(CAST(w / norm AS FLOAT) AS DOUBLE), 5) AS value
FROM d JOIN v USING (text) JOIN s USING (text) WHERE w <> 0""")
def _(spark, sf):
    l, r = document_sides(spark, sf)
    left, right = encode_sides(side_union(l, r).select("side", "id", "text"), "hashed_words")
    out = left.unionByName(right).select("encoder", "side", "id", F.posexplode("embedding").alias("dim", "value"))
    return out.where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("b1_embedding_store", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT DISTINCT text FROM d WHERE doc_id % 2 = 0), r AS (SELECT DISTINCT text FROM d WHERE doc_id % 2 = 1)
SELECT 'left side' AS run, (SELECT count(*) FROM l) AS encoded UNION ALL SELECT 'both sides', (SELECT count(*) FROM r ANTI JOIN l USING (text))
UNION ALL SELECT 'both sides again', 0 UNION ALL SELECT 'records with a vector', (SELECT count(*) FROM d)""")
def _(spark, sf):
    """How many texts reach the model when the same records are encoded again and again?"""
    from kindred.operators import encode as en

    def load():
        import numpy as np
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts])
    en.register_model("text_shape", load)
    l, r = document_sides(spark, sf)
    both = side_union(l, r).select("side", "id", "text")
    store = en.EmbeddingStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.encode(l.select("id", "text"), "text_shape")
    store.encode(both, "text_shape")
    have = store.encode(both, "text_shape").where(F.size("embedding") == 2).count()
    rows = list(zip(["left side", "both sides", "both sides again", "records with a vector"], [*store.added, have], strict=True))
    return spark.createDataFrame(rows, "run string, encoded bigint")


@query("b2_knn_exact", f"WITH {sql_knn(10)} SELECT l_id, r_id, sim, rank FROM knn")
def _(spark, sf):
    l, r = vectors(spark, sf)
    return nn.knn(l, r, 10)


@query("b2_knn_exact_right_queries", f"""WITH {sql_knn(1)}
SELECT l_id, r_id, sim, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r_id ORDER BY sim DESC, l_id) AS INT) AS rank
  FROM sims) WHERE rank <= 5""")
def _(spark, sf):
    l, r = vectors(spark, sf)
    return nn.knn(l, r, 5, "right")


@query("b3_knn_approximate")
def _(spark, sf):
    l, r = vectors(spark, sf)
    return rounded(nn.recall_against(nn.knn_approx(l, r, 10, bands=16, bits=4), nn.knn(l, r, 10)))


@query("b3_recall_of_the_approximate_search", f"WITH {sql_knn(10)} SELECT count(*) AS exact_edges, true AS recall_of_nine_tenths FROM knn")
def _(spark, sf):
    """Is at least nine tenths of the exact result found?"""
    l, r = vectors(spark, sf)
    got = nn.recall_against(nn.knn_approx(l, r, 10, bands=32, bits=3), nn.knn(l, r, 10))
    return got.select("exact_edges", (F.col("recall") >= 0.9).alias("recall_of_nine_tenths"))


@query("b4_similarity_graph", f"WITH {sql_knn(5)} SELECT l_id, r_id, sim FROM knn")
def _(spark, sf):
    l, r = vectors(spark, sf)
    return nn.graph(nn.knn(l, r, 5))


@query("b5_word_overlap", f"WITH {SQL_PARTS}, {sql_overlap('pl', 'pr', 3)} SELECT l_id, r_id, overlap FROM cand")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    return blk.overlap_block(l, r, "aggregate value", 3)


@query("b5_word_overlap_single", """
WITH c AS (SELECT c_custkey AS l_id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS w FROM customer),
s AS (SELECT c_custkey AS r_id, regexp_replace(lower('customer' || right(c_name, 9)), '[^a-z0-9]', '', 'g') AS w FROM customer)
SELECT l_id, r_id, CAST(1 AS INT) AS overlap FROM c JOIN s USING (w)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    l = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    r = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("customer"), F.right("c_name", F.lit(9))).alias("name"))
    return blk.overlap_block(l, r, "name", 1)


_SQL_LOST = SQL_PARTS + """,
ml AS (SELECT id, CASE WHEN p_size = '50' AND p_type = 'PROMO' THEN NULL ELSE toks END AS toks FROM pl),
mr AS (SELECT id, CASE WHEN p_size = '49' AND p_type = 'PROMO' THEN NULL ELSE toks END AS toks FROM pr)"""


@query("b6_overlap_allow_missing", f"""
WITH {_SQL_LOST}, hl AS (SELECT * FROM ml WHERE toks IS NOT NULL), hr AS (SELECT * FROM mr WHERE toks IS NOT NULL), {sql_overlap('hl', 'hr', 4)}
SELECT l_id, r_id, overlap FROM cand
UNION ALL SELECT ml.id, mr.id, 0 FROM ml, mr WHERE ml.toks IS NULL OR mr.toks IS NULL""")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    lost = lambda size: (F.col("p_size") == size) & (F.col("p_type") == "PROMO")
    l = l.withColumn("agg", F.when(~lost("50"), F.col("aggregate value")))
    r = r.withColumn("agg", F.when(~lost("49"), F.col("aggregate value")))
    return blk.overlap_block(l, r, "agg", 4, allow_missing=True)


@query("b7_attribute_equivalence", """
SELECT lang AS key, count(*) FILTER (doc_id % 2 = 0) AS n_left, count(*) FILTER (doc_id % 2 = 1) AS n_right,
  count(*) FILTER (doc_id % 2 = 0) * count(*) FILTER (doc_id % 2 = 1) AS pairs
FROM documents GROUP BY lang HAVING count(*) FILTER (doc_id % 2 = 0) > 0 AND count(*) FILTER (doc_id % 2 = 1) > 0""")
def _(spark, sf):
    l, r = document_sides(spark, sf)
    return blk.equal_groups(l, r, "lang")


@query("b7_attribute_equivalence_pairs", """
SELECT a.p_partkey AS l_id, b.p_partkey AS r_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand
  AND a.p_type = b.p_type WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1""")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    key = F.concat_ws("|", "p_name", "p_brand", "p_type")
    return blk.equal_block(l.withColumn("key3", key), r.withColumn("key3", key), "key3")


@query("b8_equivalence_then_overlap", f"""
WITH {SQL_PARTS}, {sql_overlap('pl', 'pr', 3, extra='p_type')} SELECT l_id, r_id, overlap FROM cand""")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    return blk.overlap_block(l, r, "aggregate value", 3, equal_on=["p_type"])


@query("b8_filter_candidates", f"""
WITH {SQL_PARTS}, {sql_overlap('pl', 'pr', 3)} SELECT l_id, r_id, overlap FROM cand WHERE overlap >= 4""")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    return blk.overlap_filter(blk.overlap_block(l, r, "aggregate value", 3).drop("overlap"), l, r, "aggregate value", 4)


@query("b9_all_pairs", """
SELECT s_suppkey AS l_id, s_name AS l_name, n_nationkey AS r_id, n_name AS r_name FROM supplier, nation""")
def _(spark, sf):
    l = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    r = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return blk.cross_block(l, r).drop("_id")


def _names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size").alias("text"))


@query("b10_self_blocking", f"""WITH {SQL_PARTS}, {sql_overlap('pw', 'pw', 4)} SELECT l_id, r_id, overlap FROM cand""")
def _(spark, sf):
    e = _names(spark, sf)
    return blk.overlap_block(e, e, "text", 4)


@query("b11_drop_self_matches", f"""
WITH {SQL_PARTS}, {sql_overlap('pw', 'pw', 4)} SELECT l_id, r_id, overlap FROM cand WHERE l_id < r_id""")
def _(spark, sf):
    e = _names(spark, sf)
    return blk.drop_self(blk.overlap_block(e, e, "text", 4), unordered=True)


@query("b13_blocking_quality", f"""
WITH {SQL_PARTS}, {sql_overlap('pl', 'pr', 4)}
SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM pgt) AS known,
  (SELECT count(*) FROM pgt ANTI JOIN cand USING (l_id, r_id)) AS missed,
  round(1 - (SELECT count(*) FROM cand) / ((SELECT count(*) FROM pl) * (SELECT count(*) FROM pr)), 6) AS reduction_ratio,
  round(1 - (SELECT count(*) FROM pgt ANTI JOIN cand USING (l_id, r_id)) / (SELECT count(*) FROM pgt), 6) AS recall""")
def _(spark, sf):
    l, r = aggregated_parts(spark, sf)
    return rounded(blk.block_quality(blk.overlap_block(l, r, "aggregate value", 4), l, r, part_truth(spark, sf)))


@query("b13_exact_copy_blocking_quality", r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents),
l AS (SELECT norm, count(*) AS c FROM n WHERE doc_id % 2 = 0 GROUP BY norm), r AS (SELECT norm, count(*) AS c FROM n WHERE doc_id % 2 = 1 GROUP BY norm)
SELECT count(*) AS keys, CAST(sum(l.c * r.c) AS BIGINT) AS candidates,
  round(1 - sum(l.c * r.c) / ((SELECT sum(c) FROM l) * (SELECT sum(c) FROM r)), 6) AS reduction_ratio FROM l JOIN r USING (norm)""")
def _(spark, sf):
    l, r = document_sides(spark, sf)
    g = blk.equal_groups(l, r, "norm").agg(F.count(F.lit(1)).alias("keys"), F.sum("pairs").alias("candidates"))
    n = l.agg(F.count(F.lit(1)).alias("nl")).join(r.agg(F.count(F.lit(1)).alias("nr")), F.lit(True))
    return rounded(g.join(n, F.lit(True)).select(
        "keys", "candidates", (1 - F.col("candidates").cast("double") / (F.col("nl") * F.col("nr"))).alias("reduction_ratio")))
