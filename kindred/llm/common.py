"""What several operators share: words, rows kept whole, per-key numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order (null: none); only ASCII white space separates them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct ``doc``: results go beside it and cannot clash with its columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0, gapless, without meeting a large group in one task.

    Rows are numbered inside (group, hash bucket); a running sum over the small
    table of bucket sizes gives each bucket's start.  ``order`` must name
    enough columns to tell all rows apart that are not equal.
    """
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(start), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    return (cut.withColumn("_i", F.row_number().over(inside))
            .join(starts, [*group, "_b"])
            .withColumn(out, (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_start"))
