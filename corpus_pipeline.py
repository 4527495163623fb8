"""Documents to training sequences: language, quality rules, near copies, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of its input; the last one returns places of token pieces.  Results of
a stage are written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import jaccard, langid, packing, quality
from kindred.runtime import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those too far from every learned language."""
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).where("accepted").select("doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or do not look like prose of their language."""
    return quality.judge(docs).where("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest ``doc_id``.

    Rows with the id of a group's first document but with another text, or
    with no id, are documents of their own groups; of rows that repeat the
    kept document one stays.
    """
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("quality", rules), ("near_copies", near_copies), ("packing", pack)]

#: Trained centroids and token ids have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, name)
    return docs
