"""Session-level helpers: checkpoint tables, one-row totals, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_FOLDERS: dict[str, str] = {}


def set_shared_dir(spark: SparkSession, path: str) -> None:
    """Name the folder for intermediate tables of this application; it goes before ``spark.checkpoint.dir``."""
    _FOLDERS[spark.sparkContext.applicationId] = path


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one set here, the one the cluster names, else (local runs only) a temp one.

    No session setting is changed: ``spark.checkpoint.dir`` is a core setting that cannot be set on a running session.
    """
    app = spark.sparkContext.applicationId
    named = _FOLDERS.get(app) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that all executors can reach: spark.checkpoint.dir or set_shared_dir()")
        named = _FOLDERS[app] = tempfile.mkdtemp(prefix="kindred-")
    return named.rstrip("/")


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Compared with an RDD checkpoint this computes the plan once, stays columnar
    and gives the next plan a real size, so broadcast decisions stay sound.  It
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing reads any more."""
    path = getattr(df, "_kindred_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (always exactly one row) to every row."""
    return df.join(F.broadcast(totals), F.lit(True), "inner")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 32 * 1024 * 1024) -> DataFrame:
    """Broadcast hint only while Catalyst's estimate is below ``limit``; else let AQE choose."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def running_sums(df: DataFrame, by: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Adds running sums inside each group of ``by`` in ``order``: ``sums`` names new columns and the ones they add up.

    Rows are dealt out by ranges of (group, order), so a large group is spread
    over tasks, and the ranges' own sums, a few numbers each, give every range
    its start.  ``order`` holds columns or ``desc`` columns that tell the rows
    of a group apart.  The result does not depend on the number of ranges.
    """
    groups = [F.col(c) for c in by]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    held = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    parts = held.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = held.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(starts, [*by, "_range"])
    return ran.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_range", *[f"_b_{n}" for n in sums])


def spread(df: DataFrame, keys: list[str], rows_per_task: int = 50_000) -> DataFrame:
    """Partition by row count instead of bytes, for narrow rows whose processing is expensive.

    Spark sizes tasks by bytes; a table of id pairs would get far too few.
    """
    n = -(-df.count() // rows_per_task)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, n), *keys)
