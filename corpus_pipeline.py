"""The corpus pipeline: toxicity, exact and near duplicates, mixing, packing.

Each stage reads what its predecessor kept, written as Parquet.  The first four
return rows with the columns of ``documents``, other columns included, whatever
their names; the last returns the pieces of the packed sequences.  An empty table
passes all stages and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carteel.llm import exact, mixing, near, packing, toxicity
from carteel.llm.store import workspace, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels, scores below 0.5.

    Null and empty texts, and texts of any length without an offending sentence, stay; repeated rows are judged each;
    without labels of both kinds all rows are judged by the share of toxic labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.learn(toxicity.sample(docs, labels)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the row with the largest doc_id, a null one last; null and empty texts are one group."""
    return exact.distinct_documents(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row with the least doc_id; texts without words all stay."""
    return near.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a shard in each file in shuffled order; texts without words are never taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens in the order in which the mix stored the documents; one that it repeats is packed as often."""
    return packing.pack(docs, stored=True)


STAGES = [("toxicity", drop_toxic), ("exact", drop_copies), ("near", drop_near), ("mix", mix), ("pack", pack)]

#: Trained models and tokenizers can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    folder = workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
