"""The corpus pipeline: stages that each call one operator of priorline.llm, in this order.

toxicity: documents that the network rejects go. lines: recurring line templates are dropped. near_duplicates: one
document of each component of the n-gram Jaccard join stays. leaks: documents that hold a benchmark item go. packing:
what is left, in sequences of 4096 tokens. Each stage reads what its predecessor has written; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorline.llm import decontaminate, jaccard, queries, templates, toxicity
from priorline.llm.common import collected, durable


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    net = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.below(docs, net, queries.TOXIC_FROM)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return templates.without_lines(docs).drop("_pl_dropped")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return jaccard.one_of_each(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    # After four stages an executor's heap is full, so the workers beside it remember fewer words.
    return queries.packed_documents(docs, remembered=(250_000, 150_000))


STAGES = [
    ("toxicity", toxicity_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("leaks", leaks_stage),
    ("packing", packing_stage),
]

#: A trained network decides the first stage, so SQL cannot give the rows; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
