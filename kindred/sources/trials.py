"""The trials log: schema, append, read, consolidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.runtime import cut_lineage

# Column order of a trials file.
TRIAL_SCHEMA = T.StructType([
    T.StructField("trial", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("clustering", T.StringType()),
    T.StructField("lm", T.StringType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("sampler", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("runtime", T.DoubleType()),
])


def as_trials(df: DataFrame) -> DataFrame:
    """Project and cast to the trials schema; extra columns are dropped."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRIAL_SCHEMA])


def append_trials(tr: DataFrame, path: str) -> None:
    """Append to the Parquet log, laid out by sampler and dataset.

    Rows are clustered by the partition columns first, so a task writes few
    files.  A random bucket splits a hot (sampler, dataset) over many tasks.
    """
    spread = F.pmod(F.xxhash64("trial", "seed", "k", "lm"), F.lit(8))
    (tr.repartition("sampler", "dataset", spread)
       .write.mode("append").partitionBy("sampler", "dataset").parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet log; filters on sampler or dataset prune folders.  A log that nothing was written to yet is empty."""
    return as_trials(spark.read.parquet(path)) if _exists(spark, path) else spark.createDataFrame([], TRIAL_SCHEMA)


# What tells one trial of a log from another.
STUDY = ["sampler", "dataset", "seed"]
CONFIG = ["lm", "k", "clustering", "threshold"]


def append_new(tr: DataFrame, path: str) -> int:
    """Append the trials that the log does not hold: one a study (sampler, dataset, seed) and configuration.

    Appending the same trials again changes nothing.  Returns how many are new.
    """
    spark, keys = tr.sparkSession, [*STUDY, *CONFIG]
    studies = tr.select(*STUDY).distinct()
    held = read_log(spark, path).join(F.broadcast(studies) if studies.count() < 10_000 else studies, STUDY, "left_semi")
    new = cut_lineage(as_trials(tr).dropDuplicates(keys).join(held.select(*keys), keys, "left_anti"), "new_trials")
    n = new.count()
    if n:
        append_trials(new, path)
    return n


def read_trials(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trials CSV files of several samplers as one table."""
    return spark.read.schema(TRIAL_SCHEMA).option("header", True).csv(paths)


def pending(configs: DataFrame, tr: DataFrame) -> DataFrame:
    """Configurations of a search that have no trial yet (resume of an interrupted run)."""
    keys = ["lm", "k", "clustering", "threshold"]
    done = tr.select("lm", "k", "clustering", F.col("threshold").cast("decimal(4,2)").alias("threshold"))
    return configs.join(done.distinct(), keys, "left_anti")
