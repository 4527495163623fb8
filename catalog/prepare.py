"""Serialisation, tokenisers, profiles and attribute types."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.data import PART_COLUMNS, SQL_PROFILE, parts, profiled_entities, profiles, rounded, table
from kindred.functions.text import tokens
from kindred.operators import prepare as prep


def _part(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *PART_COLUMNS)


def _gappy(spark, sf):
    return profiled_entities(spark, sf).drop("dataset", "side")


SQL_GAPPY = SQL_PROFILE


@query("p1_serialise_values", f"""
WITH {SQL_PROFILE} SELECT id, agg AS text FROM pt""")
def _(spark, sf):
    return prep.serialise(_gappy(spark, sf)).select("id", "text")


@query("p2_serialise_col_val", f"""
WITH {SQL_PROFILE} SELECT id, concat('COL p_name VAL ', lower(p_name), ' COL p_brand VAL ', lower(coalesce(p_brand, '')),
  ' COL p_type VAL ', lower(p_type), ' COL p_size VAL ', lower(coalesce(p_size, ''))) AS text FROM pe""")
def _(spark, sf):
    return prep.serialise_colval(_gappy(spark, sf)).select("id", "text")


@query("p3_name_value_pairs", f"""WITH {SQL_PROFILE} SELECT id, attr, value FROM pnv""")
def _(spark, sf):
    return prep.explode_pairs(_gappy(spark, sf)).select("id", "attr", "value")


@query("p4_tokenise_words", r"""
SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1] AS first_word,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words,
  list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[-1] AS last_word FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokens(F.col("text"), "dlm_dc0").alias("t"))
    return d.select("doc_id", F.try_element_at("t", F.lit(1)).alias("first_word"), F.size("t").cast("long").alias("n_words"),
                    F.try_element_at("t", F.lit(-1)).alias("last_word"))


@query("p4_tokenise_qgrams", """
WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT p_name, 2 AS q, '#' || p_name || '$' AS s FROM n
  UNION ALL SELECT p_name, 3, '##' || p_name || '$$' FROM n)
SELECT p_name, q, array_to_string([substring(s, i, q) for i in range(1, length(s) - q + 2)], '|') AS grams FROM q""")
def _(spark, sf):
    n = table(spark, sf, "part").select("p_name").distinct()
    both = n.select("p_name", F.inline(F.array(
        F.struct(F.lit(2).alias("q"), tokens(F.col("p_name"), "qgm_2").alias("g")),
        F.struct(F.lit(3).alias("q"), tokens(F.col("p_name"), "qgm_3").alias("g")))))
    return both.select("p_name", "q", F.array_join("g", "|").alias("grams"))


_PROFILE_OUT = ", ".join([f'"{c}"' if c in ("InputEntityProfiles", "NumberOfAttributes", "NumberOfDistinctValues",
                                            "NumberOfNameValuePairs", "MaxValuesPerEntity", "NumberOfMissingNVpairs")
                          else f'round("{c}", 6) AS "{c}"' for c in prep.PROFILE_COLUMNS])


@query("p5_dataset_profile", f"""WITH {SQL_PROFILE} SELECT dataset, {_PROFILE_OUT} FROM profiles""")
def _(spark, sf):
    return rounded(profiles(spark, sf))


@query("p5_profile_of_name_value_pairs", f"""WITH {SQL_PROFILE} SELECT dataset, {_PROFILE_OUT} FROM profiles""")
def _(spark, sf):
    return rounded(prep.profile_pairs(prep.explode_pairs(profiled_entities(spark, sf), ["p_name", "p_brand", "p_type", "p_size"]), ["dataset"]))


@query("p6_union_profiles", f"""
WITH {SQL_PROFILE} SELECT dataset, {_PROFILE_OUT} FROM profiles
UNION ALL SELECT 'X' || dataset, {_PROFILE_OUT} FROM profiles""")
def _(spark, sf):
    p = profiles(spark, sf)
    other = p.withColumn("dataset", F.concat(F.lit("X"), "dataset")).withColumnRenamed("dataset", "Dataset")
    return rounded(prep.union_profiles(p, other))


@query("p7_minmax_profiles", f"""
WITH {SQL_PROFILE} SELECT dataset, """ + ", ".join(
    f'round(("{c}" - min("{c}") OVER ()) / nullif((max("{c}") OVER () - min("{c}") OVER ())::DOUBLE, 0), 6) AS "{c}"'
    for c in prep.PROFILE_COLUMNS) + " FROM profiles")
def _(spark, sf):
    return rounded(prep.minmax(profiles(spark, sf), prep.PROFILE_COLUMNS))


_TYPED = ["c_name", "c_mktsegment", "c_acctbal", "text", "flag"]


def _typed(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal"),
                    F.concat_ws(" ", "c_mktsegment", "c_name", F.lit("a b c d")).alias("text"),
                    F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("flag"),
                    F.lit(None).cast("string").alias("void"))


@query("p8_infer_attribute_types", """
WITH c AS (SELECT c_name, c_mktsegment, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
  concat_ws(' ', c_mktsegment, c_name, 'a b c d') AS text, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS flag FROM customer),
v AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS value FROM c" for a in _TYPED) + r"""),
s AS (SELECT attr, count(*) AS n, count(*) FILTER (lower(value) IN ('true', 'false')) AS b, count(TRY_CAST(value AS DOUBLE)) AS d,
  avg(len(regexp_split_to_array(trim(value), '\s+'))) AS w FROM v GROUP BY attr)
SELECT attr, CASE WHEN b = n THEN 'boolean' WHEN d = n THEN 'numeric' WHEN w <= 1 THEN 'str_eq_1w' WHEN w <= 5 THEN 'str_bt_1w_5w'
  WHEN w <= 10 THEN 'str_bt_5w_10w' ELSE 'str_gt_10w' END AS type FROM s UNION ALL SELECT 'void', 'un_determined'""")
def _(spark, sf):
    return prep.infer_types(_typed(spark, sf))


_KIND = """CASE WHEN b = n THEN 'boolean' WHEN d = n THEN 'numeric' WHEN w <= 1 THEN 'str_eq_1w' WHEN w <= 5 THEN 'str_bt_1w_5w'
  WHEN w <= 10 THEN 'str_bt_5w_10w' ELSE 'str_gt_10w' END"""


@query("p8_corresponding_types", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT p_partkey % 2 AS side, '{a}' AS attr, CAST({a} AS VARCHAR) AS value FROM part" for a in PART_COLUMNS) + rf"""),
s AS (SELECT side, attr, count(*) AS n, count(*) FILTER (lower(value) IN ('true', 'false')) AS b, count(TRY_CAST(value AS DOUBLE)) AS d,
  avg(len(regexp_split_to_array(trim(value), '\s+'))) AS w FROM v GROUP BY ALL),
t AS (SELECT attr, {_KIND} AS type FROM s)
SELECT attr, max_by(type, list_position(['boolean', 'numeric', 'str_eq_1w', 'str_bt_1w_5w', 'str_bt_5w_10w', 'str_gt_10w'], type)) AS type
FROM t GROUP BY attr""")
def _(spark, sf):
    l, r = parts(spark, sf)
    return prep.corresponding_types(prep.infer_types(l), prep.infer_types(r))
