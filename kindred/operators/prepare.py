"""Entity preparation, dataset profiles and attribute types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import aggregate_value, col_val, words
from kindred.runtime import with_totals

# Profile columns F1..F12 in paper order.
PROFILE_COLUMNS = [
    "InputEntityProfiles", "NumberOfAttributes", "NumberOfDistinctValues", "NumberOfNameValuePairs",
    "AverageNVPairsPerEntity", "AverageNVpairsPerAttribute", "AverageDistinctValuesPerEntity",
    "AverageDistinctValuesPerAttribute", "MaxValuesPerEntity", "NumberOfMissingNVpairs",
    "AverageValueTokens", "AverageValueLength",
]

# Attribute types from narrow to wide.
TYPE_RANK = ["boolean", "numeric", "str_eq_1w", "str_bt_1w_5w", "str_bt_5w_10w", "str_gt_10w", "un_determined"]


def attributes(e: DataFrame) -> list[str]:
    return [c for c in e.columns if c not in ("id", "side", "dataset")]


def serialise(e: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Add ``text``: all attribute values, names left out."""
    return e.withColumn("text", aggregate_value(cols or attributes(e)))


def serialise_colval(e: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Add ``text`` in ``COL name VAL value`` form."""
    return e.withColumn("text", col_val(cols or attributes(e)))


def explode_pairs(e: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Name-value view: one row per non-missing value, other columns kept."""
    cols = cols or attributes(e)
    keep = [c for c in e.columns if c not in cols]
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in cols])
    return (e.select(*keep, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))))


def side_union(e1: DataFrame, e2: DataFrame) -> DataFrame:
    """Both collections in one frame, told apart by ``side``; attributes may differ."""
    return (e1.withColumn("side", F.lit("l"))
            .unionByName(e2.withColumn("side", F.lit("r")), allowMissingColumns=True))


def profile(e: DataFrame, by: list[str]) -> DataFrame:
    """Twelve size and shape features per group of ``by`` (usually ``dataset``).

    ``e`` holds both sides.  Counts that need no distinct come from one
    map-side-combined aggregate over the wide rows.  Distinct values are counted
    from pre-aggregated (group, attribute, value) rows in two levels, so a very
    frequent value collapses before the shuffle.
    """
    cols = [c for c in e.columns if c not in ("id", "side", *by)]
    filled = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in cols]
    n_filled = reduce(lambda a, b: a + b, filled)
    text = aggregate_value(cols)
    wide = e.select(*by, n_filled.alias("_pairs"), F.size(words(text)).alias("_toks"), F.length(text).alias("_len"))
    shape = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("InputEntityProfiles"),
        F.sum("_pairs").cast("long").alias("NumberOfNameValuePairs"),
        F.max("_pairs").cast("long").alias("MaxValuesPerEntity"),
        F.avg("_toks").alias("AverageValueTokens"),
        F.avg("_len").alias("AverageValueLength"),
    )
    pairs = explode_pairs(e.drop("id", "side"), cols)
    values = pairs.groupBy(*by, "value").agg(F.collect_set("attr").alias("_attrs"))
    domain = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("NumberOfDistinctValues"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_attrs")))).cast("long").alias("NumberOfAttributes"),
    )
    return _features(shape.join(domain, by), by)


def profile_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The features of ``profile`` from name-value rows ``(by, id, attr, value)``, empty and null values left out.

    The plan has the same size for any number of attributes; records are put
    together by adding up their values' words and lengths, and a text of all
    attributes of the table has one blank less than attributes.
    """
    rows = pairs.select(*by, "id", "attr", F.col("value").cast("string").alias("value")).where("value is not null and value <> ''")
    record = rows.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("_pairs"), F.sum(F.size(words(F.col("value")))).alias("_toks"),
                                         F.sum(F.length("value")).alias("_len"))
    shape = record.groupBy(*by).agg(
        F.count(F.lit(1)).alias("InputEntityProfiles"), F.sum("_pairs").alias("NumberOfNameValuePairs"), F.max("_pairs").alias("MaxValuesPerEntity"),
        F.avg("_toks").alias("AverageValueTokens"), F.avg("_len").alias("_length"))
    values = rows.groupBy(*by, "value").agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count(F.lit(1)).alias("NumberOfDistinctValues"))
    named = rows.groupBy(*by, "attr").agg(F.lit(1).alias("_one"))
    attrs = named.groupBy(*by).agg(F.count(F.lit(1)).alias("NumberOfAttributes"))
    blanks = named.groupBy("attr").agg(F.lit(1).alias("_one")).agg((F.count(F.lit(1)) - 1).alias("_blanks"))
    whole = with_totals(shape.join(values, by).join(attrs, by), blanks)
    return _features(whole.withColumn("AverageValueLength", F.col("_length") + F.col("_blanks")), by)


def _features(joined: DataFrame, by: list[str]) -> DataFrame:
    f1, f2 = F.col("InputEntityProfiles"), F.col("NumberOfAttributes")
    f3, f4 = F.col("NumberOfDistinctValues"), F.col("NumberOfNameValuePairs")
    return joined.select(
        *by, f1, f2, f3, f4,
        (f4 / f1).alias("AverageNVPairsPerEntity"),
        (f4 / f2).alias("AverageNVpairsPerAttribute"),
        (f3 / f1).alias("AverageDistinctValuesPerEntity"),
        (f3 / f2).alias("AverageDistinctValuesPerAttribute"),
        "MaxValuesPerEntity",
        (f1 * F.col("MaxValuesPerEntity") - f4).alias("NumberOfMissingNVpairs"),
        "AverageValueTokens", "AverageValueLength",
    )


def union_profiles(*frames: DataFrame) -> DataFrame:
    """Profiles of several sources, with ``Dataset`` aligned to ``dataset``."""
    aligned = [f.withColumnRenamed("Dataset", "dataset") for f in frames]
    return reduce(lambda a, b: a.unionByName(b), aligned)


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale each column to [0, 1] over all rows; a constant column becomes null."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = with_totals(df, bounds)
    scaled = {c: F.try_divide((F.col(c) - F.col(f"_lo_{c}")).cast("double"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
              for c in cols}
    return out.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def _is_boolean(c: Column) -> Column:
    return F.lower(c).isin("true", "false")


def infer_types(e: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(attr, type)`` by content, one aggregate over all attributes.

    All values boolean or numeric decide the first two classes.  Else the mean
    number of words decides: exactly 1, up to 5, up to 10, more.  An attribute
    without values is undetermined.
    """
    cols = cols or attributes(e)
    aggs = []
    for c in cols:
        v = F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
        aggs += [
            F.count(v).alias(f"{c}|n"),
            F.sum(F.when(_is_boolean(v), 1).otherwise(0)).alias(f"{c}|b"),
            F.count(v.try_cast("double")).alias(f"{c}|d"),
            F.avg(F.size(words(v))).alias(f"{c}|w"),
        ]
    stats = e.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("attr"), F.col(f"`{c}|n`").alias("n"), F.col(f"`{c}|b`").alias("b"),
                 F.col(f"`{c}|d`").alias("d"), F.col(f"`{c}|w`").alias("w")) for c in cols])
    kind = (F.when(F.col("n") == 0, "un_determined")
            .when(F.col("b") == F.col("n"), "boolean")
            .when(F.col("d") == F.col("n"), "numeric")
            .when(F.col("w") <= 1, "str_eq_1w")
            .when(F.col("w") <= 5, "str_bt_1w_5w")
            .when(F.col("w") <= 10, "str_bt_5w_10w")
            .otherwise("str_gt_10w"))
    return stats.select(F.inline(rows)).select("attr", kind.alias("type"))


def corresponding_types(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attributes of the same name on both sides, with the wider of the two types."""
    rank = F.create_map(*[x for i, t in enumerate(TYPE_RANK) for x in (F.lit(t), F.lit(i))])
    both = left.select("attr", F.col("type").alias("lt")).join(right.select("attr", F.col("type").alias("rt")), "attr")
    return both.select("attr", F.when(rank[F.col("lt")] >= rank[F.col("rt")], F.col("lt"))
                       .otherwise(F.col("rt")).alias("type"))
