"""Inputs of the registered queries: whole driver tables, viewed as the shapes the operators expect.

Two-sided inputs split a table by id parity: each row is on exactly one side and
both sides together are the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.configs import SEEDS
from kindred.runtime import shared_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kindred-{label}-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema])


def side_of(id: str) -> Column:
    return F.when(F.col(id) % 2 == 0, "l").otherwise("r")


def two_sides(df: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    both = df.withColumn("_side", side_of(id)).withColumnRenamed(id, "id")
    return both.where("_side = 'l'").drop("_side"), both.where("_side = 'r'").drop("_side")


# ---------------------------------------------------------------- vectors

def vectors(spark, sf):
    return two_sides(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")


def vector_truth(spark, sf) -> DataFrame:
    """Known matches of the vector table: neighbours in id order with the same label (one to one)."""
    l, r = vectors(spark, sf)
    return l.select(F.col("id").alias("l_id"), "label", (F.col("id") + 1).alias("r_id")).join(
        r.select(F.col("id").alias("r_id"), "label"), ["r_id", "label"]).select("l_id", "r_id")


SQL_VECTORS = """
vl AS MATERIALIZED (SELECT vec_id AS l, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 2 = 0),
vr AS MATERIALIZED (SELECT vec_id AS r, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 2 = 1),
gt AS MATERIALIZED (SELECT l AS l_id, r AS r_id FROM vl JOIN vr ON vr.r = vl.l + 1 AND vl.label = vr.label)"""


def sql_knn(k: int) -> str:
    """CTE ``knn(l_id, r_id, sim, rank)``."""
    return SQL_VECTORS + f""",
sims AS MATERIALIZED (SELECT l AS l_id, r AS r_id, round(list_cosine_similarity(vl.e, vr.e), 8) AS sim FROM vl, vr),
knn AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_id ORDER BY sim DESC, r_id) AS INT) AS rank
  FROM sims) WHERE rank <= {k})"""


def sql_greedy(edges: str, out: str = "umc") -> str:
    """CTEs that scan the edges of ``edges(l_id, r_id, sim)`` best first, ties by key, and keep a one-to-one matching."""
    return f"""
{out}_e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sim DESC,
  ('0x' || left(md5(l_id || ':' || r_id), 15))::BIGINT, l_id, r_id) AS i, l_id, r_id, sim FROM {edges}),
{out}_g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ls, []::BIGINT[] AS rs, []::BIGINT[] AS taken
  UNION ALL
  SELECT e.i, CASE WHEN list_contains(g.ls, e.l_id) OR list_contains(g.rs, e.r_id) THEN ls ELSE list_append(ls, e.l_id) END,
         CASE WHEN list_contains(g.ls, e.l_id) OR list_contains(g.rs, e.r_id) THEN rs ELSE list_append(rs, e.r_id) END,
         CASE WHEN list_contains(g.ls, e.l_id) OR list_contains(g.rs, e.r_id) THEN taken ELSE list_append(taken, e.i) END
  FROM {out}_g g JOIN {out}_e e ON e.i = g.i + 1),
{out}_t AS (SELECT unnest(taken) AS i FROM (SELECT taken FROM {out}_g ORDER BY i DESC LIMIT 1)),
{out} AS MATERIALIZED (SELECT l_id, r_id, sim FROM {out}_e SEMI JOIN {out}_t USING (i))"""


# ---------------------------------------------------------------- short records (part)

PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


def parts(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", *[F.col(c).cast("string").alias(c) for c in PART_COLUMNS])
    return two_sides(df, "p_partkey")


def aggregated_parts(spark, sf):
    l, r = parts(spark, sf)
    text = F.concat_ws(" ", *PART_COLUMNS)
    return l.withColumn("aggregate value", text), r.withColumn("aggregate value", text)


def part_truth(spark, sf) -> DataFrame:
    """Known matches of the part table: per (name, brand, type) the smallest id of either side."""
    l, r = parts(spark, sf)
    keys = ["p_name", "p_brand", "p_type"]
    return (l.groupBy(*keys).agg(F.min("id").alias("l_id"))
            .join(r.groupBy(*keys).agg(F.min("id").alias("r_id")), keys).select("l_id", "r_id"))


SQL_PARTS = r"""
pv AS MATERIALIZED (SELECT p_partkey AS id, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
  concat_ws(' ', p_name, p_brand, p_type, p_size) AS agg FROM part),
pw AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(
  regexp_replace(lower(agg), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x <> ''))) AS toks FROM pv),
pl AS MATERIALIZED (SELECT * FROM pw WHERE id % 2 = 0),
pr AS MATERIALIZED (SELECT * FROM pw WHERE id % 2 = 1),
pgt AS MATERIALIZED (SELECT l_id, r_id FROM
  (SELECT p_name, p_brand, p_type, min(id) AS l_id FROM pl GROUP BY ALL)
  JOIN (SELECT p_name, p_brand, p_type, min(id) AS r_id FROM pr GROUP BY ALL) USING (p_name, p_brand, p_type))"""


def sql_overlap(left: str, right: str, n: int, name: str = "cand", extra: str = "") -> str:
    """CTE ``cand(l_id, r_id, overlap)`` by the plain token join; ``extra`` adds equality columns."""
    cols = "".join(f", {c}" for c in extra.split() if c)
    using = ", ".join(["w", *extra.split()])
    return f"""
{name}_l AS (SELECT id AS l_id{cols}, unnest(toks) AS w FROM {left}),
{name}_r AS (SELECT id AS r_id{cols}, unnest(toks) AS w FROM {right}),
{name} AS MATERIALIZED (SELECT l_id, r_id, CAST(count(*) AS INT) AS overlap FROM {name}_l JOIN {name}_r USING ({using})
  GROUP BY l_id, r_id HAVING count(*) >= {n})"""


# ---------------------------------------------------------------- documents

def documents(spark, sf):
    """Documents with normalised text: lower case, single blanks, trimmed."""
    df = table(spark, sf, "documents")
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return df.withColumn("norm", key)


def document_sides(spark, sf):
    return two_sides(documents(spark, sf), "doc_id")


def document_truth(spark, sf) -> DataFrame:
    l, r = document_sides(spark, sf)
    return (l.groupBy("norm").agg(F.min("id").alias("l_id"))
            .join(r.groupBy("norm").agg(F.min("id").alias("r_id")), "norm").select("l_id", "r_id"))


# ---------------------------------------------------------------- trials log

# Sampler and feature names of the stand-in logs.
SAMPLERS = ["random", "tpe", "qmc", "gps", "gridsearch"]


def trials(spark, sf) -> DataFrame:
    """The line items as a trials log, one trial per row."""
    l = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    tax = F.round(F.col("l_tax") * 100).cast("long")
    pick = lambda values, i: F.array(*[F.lit(v) for v in values])[i.cast("int")]
    zero = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"),
        F.concat(F.lit("D"), (F.col("l_suppkey") % 10 + 1).cast("string")).alias("dataset"),
        F.col("l_linestatus").alias("clustering"), F.col("l_returnflag").alias("lm"),
        F.col("l_quantity").cast("int").alias("k"), F.col("l_discount").alias("threshold"),
        pick(SAMPLERS, F.col("l_partkey") % 5).alias("sampler"),
        pick(SEEDS, F.col("l_linenumber") % 5).alias("seed"),
        ((cents % 9973) / 100).alias("precision"), ((cents % 7919) / 100).alias("recall"),
        F.when(zero, F.lit(0.0)).otherwise((cents % 1000000) / 10000).alias("f1"),
        ((tax * 100 + F.col("l_linenumber") * 25) / 100).alias("runtime"),
        ((F.col("l_orderkey") % 20 + 1) * 5).cast("int").alias("budget"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


SQL_TRIALS = """
tl AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem),
trials AS (SELECT l_orderkey * 10 + l_linenumber AS trial, 'D' || CAST(l_suppkey % 10 + 1 AS VARCHAR) AS dataset,
  l_linestatus AS clustering, l_returnflag AS lm, CAST(l_quantity AS INT) AS k, l_discount AS threshold,
  (['random','tpe','qmc','gps','gridsearch'])[l_partkey % 5 + 1] AS sampler,
  CAST(([16,64,256,1024,4096])[l_linenumber % 5 + 1] AS INT) AS seed,
  CAST(cents % 9973 AS DOUBLE) / 100 AS precision, CAST(cents % 7919 AS DOUBLE) / 100 AS recall,
  CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0::DOUBLE ELSE CAST(cents % 1000000 AS DOUBLE) / 10000 END AS f1,
  CAST(tax * 100 + l_linenumber * 25 AS DOUBLE) / 100 AS runtime,
  CAST((l_orderkey % 20 + 1) * 5 AS INT) AS budget, l_partkey AS part, l_suppkey AS supp FROM tl)"""

# ---------------------------------------------------------------- dataset profiles

def profiled_entities(spark, sf) -> DataFrame:
    """Parts as ten datasets D1..D10 (by supplier-like key), both sides, for profiling."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("D"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("dataset"),
        F.col("p_partkey").alias("id"), side_of("p_partkey").alias("side"),
        F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"), "p_type",
        F.when(F.col("p_size") % 3 > 0, F.col("p_size")).cast("string").alias("p_size"))


SQL_PROFILE = r"""
pe AS (SELECT 'D' || CAST(p_partkey % 10 + 1 AS VARCHAR) AS dataset, p_partkey AS id, p_name,
  CASE WHEN p_size > 10 THEN p_brand END AS p_brand, p_type,
  CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) END AS p_size FROM part),
pt AS (SELECT *, concat_ws(' ', p_name, coalesce(p_brand, ''), p_type, coalesce(p_size, '')) AS agg,
  1 + (p_brand IS NOT NULL)::INT + 1 + (p_size IS NOT NULL)::INT AS pairs FROM pe),
pnv AS (SELECT dataset, id, 'p_name' AS attr, p_name AS value FROM pe UNION ALL
  SELECT dataset, id, 'p_brand', p_brand FROM pe WHERE p_brand IS NOT NULL UNION ALL
  SELECT dataset, id, 'p_type', p_type FROM pe UNION ALL
  SELECT dataset, id, 'p_size', p_size FROM pe WHERE p_size IS NOT NULL),
prof AS (SELECT dataset, count(*) AS f1, sum(pairs)::BIGINT AS f4, max(pairs)::BIGINT AS f9,
  avg(len(list_filter(regexp_split_to_array(agg, '\s+'), lambda x: x <> ''))) AS f11, avg(length(agg)) AS f12 FROM pt GROUP BY dataset),
dom AS (SELECT dataset, count(DISTINCT value) AS f3, count(DISTINCT attr) AS f2 FROM pnv GROUP BY dataset),
profiles AS (SELECT dataset, f1 AS "InputEntityProfiles", f2 AS "NumberOfAttributes", f3 AS "NumberOfDistinctValues",
  f4 AS "NumberOfNameValuePairs", f4 / f1 AS "AverageNVPairsPerEntity", f4 / f2 AS "AverageNVpairsPerAttribute",
  f3 / f1 AS "AverageDistinctValuesPerEntity", f3 / f2 AS "AverageDistinctValuesPerAttribute", f9 AS "MaxValuesPerEntity",
  f1 * f9 - f4 AS "NumberOfMissingNVpairs", f11 AS "AverageValueTokens", f12 AS "AverageValueLength"
  FROM prof JOIN dom USING (dataset))"""


def profiles(spark, sf) -> DataFrame:
    from kindred.operators.prepare import profile
    return profile(profiled_entities(spark, sf), ["dataset"])


# ---------------------------------------------------------------- result sheets

REGRESSORS = ["RandomForestRegressor", "Lasso", "Ridge"]
SOURCES = ["gridsearch", "optuna", "all"]
FEATURES = [
    "InputEntityProfiles", "NumberOfAttributes", "NumberOfDistinctValues", "NumberOfNameValuePairs",
    "AverageNVPairsPerEntity", "AverageNVpairsPerAttribute", "AverageDistinctValuesPerEntity",
    "AverageDistinctValuesPerAttribute", "MaxValuesPerEntity", "NumberOfMissingNVpairs",
    "AverageValueTokens", "AverageValueLength", "lm_A", "lm_N", "lm_R", "clustering_F", "clustering_O", "k", "threshold",
]


def results(spark, sf) -> DataFrame:
    """The trials as rows of a result sheet; every third row names a k that has no trial."""
    t = trials(spark, sf)
    pick = lambda values, i: F.array(*[F.lit(v) for v in values])[i.cast("int")]
    return t.select(
        F.col("dataset").alias("TEST_SET"), pick(SOURCES, F.floor(F.col("trial") / 10) % 3).alias("DATASET"),
        pick(REGRESSORS, F.col("seed") % 3).alias("REGRESSOR"), (F.col("part") % 2).cast("int").alias("WITH_DATA_FEATURES"),
        F.col("f1").alias("PREDICTED_F1"), F.lit(100.0).alias("GLOBAL_BEST_F1"), (F.col("f1") / 100).alias("PERFORMANCE"),
        (F.col("runtime") * 3600).alias("OPTIMIZATION_TIME"), F.col("recall").alias("BEST_REGRESSOR_FIT_TIME"),
        F.col("precision").alias("BEST_REGRESSOR_PREDICTION_TIME"), F.col("lm").alias("LM"),
        (F.col("k") + F.when(F.col("part") % 3 == 0, 100).otherwise(0)).cast("int").alias("K"),
        F.col("clustering").alias("CLUSTERING"), (F.col("threshold") + 1e-9).alias("THRESHOLD"))


_SQL_LIST = lambda v: "[" + ",".join(f"'{x}'" for x in v) + "]"
SQL_RESULTS = SQL_TRIALS + f""",
results AS (SELECT dataset AS "TEST_SET", ({_SQL_LIST(SOURCES)})[(trial // 10) % 3 + 1] AS "DATASET",
  ({_SQL_LIST(REGRESSORS)})[seed % 3 + 1] AS "REGRESSOR", CAST(part % 2 AS INT) AS "WITH_DATA_FEATURES",
  f1 AS "PREDICTED_F1", 100.0::DOUBLE AS "GLOBAL_BEST_F1", f1 / 100 AS "PERFORMANCE", runtime * 3600 AS "OPTIMIZATION_TIME",
  recall AS "BEST_REGRESSOR_FIT_TIME", precision AS "BEST_REGRESSOR_PREDICTION_TIME", lm AS "LM",
  CAST(k + CASE WHEN part % 3 = 0 THEN 100 ELSE 0 END AS INT) AS "K", clustering AS "CLUSTERING",
  threshold + 1e-9::DOUBLE AS "THRESHOLD" FROM trials)"""


def importances(spark, sf) -> DataFrame:
    t = trials(spark, sf)
    return t.select(F.col("dataset").alias("TEST_SET"),
                    F.array(*[F.lit(f) for f in FEATURES])[(F.col("part") % len(FEATURES)).cast("int")].alias("FEATURE"),
                    (F.col("f1") / 100).alias("IMPORTANCE"))


SQL_IMPORTANCE = SQL_TRIALS + f""",
importance AS (SELECT dataset AS "TEST_SET", ({_SQL_LIST(FEATURES)})[part % {len(FEATURES)} + 1] AS "FEATURE",
  f1 / 100 AS "IMPORTANCE" FROM trials)"""


# ---------------------------------------------------------------- paired samples

METHODS = ["random", "tpe", "qmc", "gps"]


def paired_samples(spark, sf) -> DataFrame:
    """Mean F1 of each sampler per (dataset, budget, seed) block, rounded to eight digits."""
    from kindred.operators.significance import paired
    wide = paired(trials(spark, sf), "sampler", "f1", ["dataset", "budget", "seed"], METHODS)
    return wide.select("dataset", "budget", "seed", *[F.round(m, 8).alias(m) for m in METHODS])


SQL_PAIRED = SQL_TRIALS + """,
wide AS MATERIALIZED (SELECT dataset, budget, seed, """ + ", ".join(
    f"round(avg(f1) FILTER (sampler = '{m}'), 8) AS {m}" for m in METHODS) + """
  FROM trials GROUP BY dataset, budget, seed HAVING """ + " AND ".join(
    f"count(*) FILTER (sampler = '{m}') > 0" for m in METHODS) + ")"
