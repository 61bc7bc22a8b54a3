"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and is given what the one before wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontaminate, near_dup, packing, toxicity
from lociframe.llm.common import shared_dir, table, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be toxic."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # the row as a struct: none of its columns can clash with new ones
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxicity.score(whole, net).where("predicted = 0").select("row.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the least id;
    unlike texts stay, whatever their ids, and so do rows without an id."""
    return near_dup.one_of_each(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained network and a search within a Hamming radius have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        path = f"{base}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
