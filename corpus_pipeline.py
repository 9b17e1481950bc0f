"""From raw documents to packed training sequences: toxicity, exact and near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import exact, mixing, near, packing, toxicity
from tallyloom.llm.common import prepare
from tallyloom.session import scratch_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    return toxicity.drop_toxic(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    prepare(spark)
    return exact.keep_one_of_each(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    prepare(spark)
    return near.keep_one_per_component(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn; a document that is taken twice is two rows."""
    prepare(spark)
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact_duplicates), ("near dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Scores, signatures and token ids cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
