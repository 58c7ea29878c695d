"""Column and window building blocks that many operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import t_two_sided

SMALLEST = 2.2250738585072014e-308


def average_rank(value: str, partition: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    by = Window.partitionBy(*partition)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def benjamini_hochberg(df: DataFrame, p: str = "p", family: Sequence[str] = (), out: str = "q") -> DataFrame:
    """q of each p: the step-up minimum from the largest p down. A null p is outside the family and stays null."""
    key = [F.col(c) for c in family] + [F.col(p).isNull().alias("_none")]
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_m", F.count(p).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p)))
    raw = F.col(p) * F.col("_m") / F.col("_r")
    # from the largest rank downwards; equal p fall back on the same minimum
    q = F.min(raw).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("_m", "_r")


def safe_neg_log10(p: Column) -> Column:
    return F.when(p.isNotNull() & ~F.isnan(p), -F.log10(F.greatest(p, F.lit(SMALLEST))))


def t_p_value(df: DataFrame, statistic: str, degrees: str, out: str = "p") -> DataFrame:
    """Two-sided p of a t statistic, in Arrow batches; null where the statistic is."""

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, d in batches:
            p = t_two_sided(t.to_numpy(float), d.to_numpy(float))
            yield pd.Series(np.where(np.isnan(p), None, p), dtype=object).astype(float)

    return df.withColumn(out, F.nanvl(tail(statistic, degrees), F.lit(None).cast("double")))


def auc(scores: DataFrame, score: str, positive: str, group: Sequence[str]) -> DataFrame:
    """Rank-sum AUC per group; null where a class is missing."""
    ranked = scores.withColumn("_r", average_rank(score, list(group)))
    up = F.col(positive).cast("int")
    per = ranked.groupBy(*group).agg(F.sum(F.col("_r") * up).alias("_s"), F.sum(up).alias("_p"), F.sum(1 - up).alias("_n"))
    return per.select(*group, F.expr("try_divide(_s - _p * (_p + 1) / 2, _p * _n)").alias("auc"))
