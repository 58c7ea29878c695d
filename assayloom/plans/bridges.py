"""The driver's tables as data sets, and the same bridges as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    ordinal = (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("int")
    return joined.select(F.col("s_suppkey").alias("sample_id"), ordinal.alias("sample_ord"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_acctbal").alias("acctbal"))


def dense(spark: SparkSession, sf_dir: str) -> Dataset:
    """Supplier x brand, summed quantities: no cell is empty."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # quantities are summed per supplier and part before the brand is joined on: the join sees fewer rows
    per = items.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).join(parts, "l_partkey")
    values = per.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature_id")).agg(F.sum("q").alias("value"))
    return Dataset(values, suppliers(spark, sf_dir), _features(values))


def graded(spark: SparkSession, sf_dir: str) -> Dataset:
    """Supplier x (part size, line status), summed quantities: a hundred features, few cells empty at any scale."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    per = items.groupBy("l_suppkey", "l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("q")).join(parts, "l_partkey")
    feature = F.concat_ws("-", "p_size", "l_linestatus")
    values = per.groupBy(F.col("l_suppkey").alias("sample_id"), feature.alias("feature_id")).agg(F.sum("q").alias("value"))
    return Dataset(values, suppliers(spark, sf_dir), _features(values))


def sparse(spark: SparkSession, sf_dir: str) -> Dataset:
    """Supplier x part, summed quantities: most cells are empty."""
    values = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    return Dataset(values, suppliers(spark, sf_dir), _features(values))


def runs(spark: SparkSession, sf_dir: str) -> Dataset:
    """Runs of users (six-day blocks of events) x event type, mean values, taken as log2; the unit is the user."""
    e = table(spark, sf_dir, "events").withColumn("block", F.floor(F.unix_date(F.to_date("ts")) / 6))
    e = e.withColumn("sample_id", F.concat_ws("-", "user_id", "block"))
    values = e.groupBy("sample_id", F.col("event_type").alias("feature_id")).agg(F.avg("value").alias("value"))
    who = e.select("sample_id", "user_id", "block").distinct()
    samples = who.withColumn("sample_ord", (F.row_number().over(Window.orderBy("user_id", "block")) - 1).cast("int"))
    return Dataset(values, samples, _features(values), "log2")


def embedded(spark: SparkSession, sf_dir: str) -> Dataset:
    """Vector x position; each vector's label is its class."""
    e = table(spark, sf_dir, "embeddings")
    values = e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "v")).select("sample_id", "feature_id", F.col("v").cast("double").alias("value"))
    samples = e.select(F.col("vec_id").alias("sample_id"), (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("int").alias("sample_ord"), "label")
    return Dataset(values, samples, _features(values), "zscore")


def _features(values: DataFrame) -> DataFrame:
    ids = values.select("feature_id").distinct()
    return ids.withColumn("feature_ord", (F.row_number().over(Window.orderBy("feature_id")) - 1).cast("int"))


SUPPLIERS = "smp as (select s_suppkey sample_id, r_name region, n_name nation, s_acctbal acctbal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
DENSE = SUPPLIERS + ", v as (select l_suppkey sample_id, p_brand feature_id, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by all)"
SPARSE = SUPPLIERS + ", v as (select l_suppkey sample_id, l_partkey feature_id, sum(l_quantity) as value from lineitem group by all)"
GRADED = SUPPLIERS + ", v as (select l_suppkey sample_id, p_size || '-' || l_linestatus feature_id, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by all)"
RUNS = "v as (select user_id || '-' || floor(date_diff('day', date '1970-01-01', ts::date) / 6)::bigint sample_id, user_id, event_type feature_id, avg(value) as value from events group by all)"
