"""The registered queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, jaccard, katz, licences, media, mixing, packing, pii, toxicity
from .common import table, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.page_images(table(spark, sf_dir, "pages")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = written(chat.conversations(table(spark, sf_dir, "conversations")), "talks")
    return chat.digest(chat.preferences(chat.swapped(talks)))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("matches")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), order=3, cuts=(1, 1, 1))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = written(pii.annotate(table(spark, sf_dir, "documents")).select("doc_id", "base", "candidates"), "pii")
    return pii.digest(pii.selected(spans, pii.fit(spans)))


QUERIES: dict = {"op3_media": op3_media, "op4_chat": op4_chat, "op8_licences": op8_licences, "op7_katz": op7_katz, "op9_ann": op9_ann, "op5_toxicity": op5_toxicity, "op1_mixing": op1_mixing, "op2_jaccard": op2_jaccard, "op6_packing": op6_packing, "op10_pii": op10_pii}
ORACLES: dict = {"op2_jaccard": jaccard.ORACLE, "op4_chat": chat.ORACLE, "op8_licences": licences.oracle()}
