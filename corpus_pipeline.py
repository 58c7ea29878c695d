"""The corpus pipeline: STAGES in order, each stage's output written as Parquet and read again as the next one's input.

toxicity drops documents that score as toxic; near_duplicates keeps one document of each group (the least doc_id);
pii replaces personal data; mixing draws the sources to their target weights (a document appears once for each epoch
that takes words of it), in the order of the mix; packing cuts the mixed texts into token sequences.

Every stage but the last returns the columns of its docs, whatever their names. A null or empty text is never toxic, has
no copies and no personal data, takes no place in the mix, and so does not reach packing. A row without doc_id is scored,
linked and mixed like others; of a group of copies with no id at all one row stays. Repeated rows are one document after
near_duplicates. An empty table gives empty stages. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayloom.llm import jaccard, mixing, packing, pii, toxicity
from assayloom.llm.common import table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs, nulls=True)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near_duplicates", one_of_each), ("pii", redacted), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
