"""Readers for entity collections, known matches and experiment descriptors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _delimited(spark: SparkSession, path, sep: str, encoding: str, header: list[str] | None):
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
              .option("inferSchema", False).option("nullValue", "").option("emptyValue", ""))
    if header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return reader.csv(path)


def read_entities(spark: SparkSession, path, sep: str = "|", key: str = "id",
                  encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    """Entity file with a header row: every column a string, an empty cell is null.

    Without ``columns`` only the header line is read to learn the schema; the
    data is never scanned for types.  The key column is renamed to ``id``.
    """
    df = _delimited(spark, path, sep, encoding, columns)
    return df.withColumnRenamed(key, "id")


def key_violations(df: DataFrame, key: str = "id") -> DataFrame:
    """Key values that are missing or occur more than once; empty means the key holds."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def read_keyed(spark: SparkSession, path, sep: str = ",", key: str = "id",
               encoding: str = "ISO-8859-1") -> DataFrame:
    """``read_entities`` plus a check that ``key`` is a key."""
    df = read_entities(spark, path, sep, key, encoding)
    broken = key_violations(df).limit(1).count()
    if broken:
        raise ValueError(f"{key!r} is not a key of {path}")
    return df


def empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "l_id string, r_id string")


def read_pairs(spark: SparkSession, path=None, sep: str = "|", encoding: str = "UTF-8") -> DataFrame:
    """Known matches as distinct ``(l_id, r_id)``; no path means no known matches."""
    if path is None:
        return empty_pairs(spark)
    df = _delimited(spark, path, sep, encoding, None)
    left, right = df.columns[:2]
    return df.select(F.col(left).alias("l_id"), F.col(right).alias("r_id")).distinct()


def load_json(path: str) -> dict:
    """A small JSON descriptor or experiment file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_described(spark: SparkSession, descriptor: dict, base: str = ""):
    """Both collections and the known matches named by a dataset descriptor."""
    folder = "/".join(p for p in (base.rstrip("/"), descriptor["dir"]) if p)
    ext, sep = descriptor["format"], descriptor["separator"]
    left = read_entities(spark, f"{folder}/{descriptor['d1']}.{ext}", sep, descriptor["d1_id"])
    right = read_entities(spark, f"{folder}/{descriptor['d2']}.{ext}", sep, descriptor["d2_id"])
    gt = read_pairs(spark, f"{folder}/{descriptor['gt']}.{ext}" if descriptor.get("gt") else None, sep)
    return left, right, gt
