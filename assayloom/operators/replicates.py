"""Technical replicates: one row per biological unit, variance components and precision weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import LOG_SCALES, Dataset, Refusal, require_scale


@dataclass(frozen=True)
class Aggregated:
    dataset: Dataset
    technical_fraction: float | None
    histogram: DataFrame


def units(samples: DataFrame, by: str) -> DataFrame:
    """Unit codes in the order of first appearance."""
    if samples.filter(F.col(by).isNull()).limit(1).count():
        raise Refusal(f"samples without {by}")
    per = samples.groupBy(by).agg(F.min("sample_ord").alias("_first"), F.count("*").alias("n_replicates"))
    return per.withColumn("unit_ord", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int")).drop("_first")


def varying_columns(samples: DataFrame, by: str, columns: list[str]) -> list[str]:
    """Columns with more than one value (null counts as one) inside some unit: one aggregate for all of them."""
    kinds = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    worst = samples.groupBy(by).agg(*kinds).agg(*[F.max(c).alias(c) for c in columns]).first() if columns else None
    return [c for c in columns if worst[c] is not None and worst[c] > 1]


def summarized(samples: DataFrame, by: str, column: str, categorical: bool) -> DataFrame:
    """A run-level column per unit: its mean, or the share of each level but the first."""
    if not categorical:
        return samples.groupBy(by).agg(F.avg(F.col(column).cast("double")).alias(column))
    levels = [r[0] for r in samples.select(column).distinct().orderBy(column).collect()][1:]
    return samples.groupBy(by).agg(*[F.avg((F.col(column) == F.lit(v)).cast("double")).alias(f"{column}[frac {v}]") for v in levels])


def design_matrix(rows: list[dict], columns: list[str], categorical: set[str]) -> np.ndarray:
    """Intercept, numbers as they are, k-1 dummies of each category."""
    parts = [np.ones(len(rows))]
    for c in columns:
        values = [r[c] for r in rows]
        if c in categorical or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            levels = sorted({str(v) for v in values})
            parts += [np.array([float(str(v) == level) for v in values]) for level in levels[1:]]
        else:
            parts.append(np.array(values, float))
    x = np.stack(parts, axis=1)
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise Refusal("the design is singular")
    if len(rows) <= x.shape[1]:
        raise Refusal("the design leaves no degrees of freedom")
    return x


def technical_fraction(ds: Dataset, by: str, design: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> float | None:
    """Median over features of the share of variance within units, between 0 and 1; None without repeats.

    Within-unit variance is a pooled aggregate; the coefficients of unit means are sums over the units' columns of the (small)
    design's solver, and residuals are taken over the units that have the feature.
    """
    samples = ds.samples
    info = samples.groupBy(by).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in design], F.min("sample_ord").alias("_o")).orderBy("_o").collect()
    runs, n_units = sum(r["n"] for r in info), len(info)
    if runs == n_units:
        return None
    x = design_matrix([r.asDict() for r in info], list(design), set(categorical))
    solver = np.linalg.pinv(x)
    spark, k = samples.sparkSession, x.shape[1]
    kind = dict(samples.dtypes)[by]
    # a row a unit: its column of the solver and its row of the design
    per_unit = spark.createDataFrame([(r[by], solver[:, i].tolist(), x[i].tolist()) for i, r in enumerate(info)], f"_v {kind}, _p array<double>, _x array<double>")
    leverage = float(((1 - np.einsum("ij,ji->i", x, solver)) / np.array([r["n"] for r in info])).sum())
    values = ds.values.join(F.broadcast(samples.select("sample_id", F.col(by).alias("_v"))), "sample_id")
    means = values.groupBy("feature_id", "_v").agg(F.avg("value").alias("_m"), (F.var_pop("value") * F.count("*")).alias("_ss"))
    within = means.groupBy("feature_id").agg((F.sum("_ss") / (runs - n_units)).alias("_t"))
    placed = means.join(F.broadcast(per_unit), "_v")
    beta = placed.groupBy("feature_id").agg(F.array(*[F.sum(F.col("_p")[i] * F.col("_m")) for i in range(k)]).alias("_b"))
    fitted = placed.join(beta, "feature_id").select("feature_id", (F.col("_m") - F.expr("aggregate(zip_with(_x, _b, (a, b) -> a * b), 0D, (s, v) -> s + v)")).alias("_r"))
    rss = fitted.groupBy("feature_id").agg(F.sum(F.col("_r") * F.col("_r")).alias("_rss"))
    between = F.greatest(F.lit(0.0), (F.col("_rss") - F.col("_t") * leverage) / (n_units - x.shape[1]))
    share = within.join(rss, "feature_id").select((F.col("_t") / F.nullif(F.col("_t") + between, F.lit(0.0))).alias("f"))
    f = share.agg(F.median("f")).first()[0]
    return None if f is None else min(1.0, max(0.0, f))


def precision_weight(fraction: float | None, n: str = "n_replicates"):
    """1 / ((1 - f) + f / n), as a column, before it is scaled to mean 1."""
    f = fraction or 0.0
    return 1 / ((1 - f) + f / F.col(n))


def aggregate(ds: Dataset, by: str, *, method: str = "mean", run_level: tuple[str, ...] = (), summarize: tuple[str, ...] = (), weight_design: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> Aggregated:
    """One row per unit: mean or median of its runs, its constant columns, n_replicates and precision_weight (mean 1)."""
    require_scale(ds, LOG_SCALES, "aggregate")
    if method not in ("mean", "median"):
        raise Refusal(f"unknown method {method!r}")
    info = units(ds.samples, by)
    others = [c for c in ds.samples.columns if c not in ("sample_id", "sample_ord", by, *run_level, *summarize)]
    if bad := varying_columns(ds.samples, by, others):
        raise Refusal(f"{', '.join(bad)} vary within {by}: name them in run_level or summarize")
    constant = ds.samples.groupBy(by).agg(*[F.first(c, ignorenulls=False).alias(c) for c in others]) if others else ds.samples.select(by).distinct()
    for c in summarize:
        constant = constant.join(summarized(ds.samples, by, c, c in categorical), by)
    f = technical_fraction(ds, by, weight_design, categorical)
    samples = info.join(constant, by).withColumn("_w", precision_weight(f))
    samples = samples.withColumn("precision_weight", F.col("_w") / F.avg("_w").over(Window.partitionBy())).drop("_w")
    samples = samples.withColumn("sample_id", F.col(by).cast("string")).withColumnRenamed("unit_ord", "sample_ord")
    if samples.groupBy("sample_id").count().filter("count > 1").limit(1).count():
        raise Refusal(f"two units of {by} read alike")
    rows = ds.values.join(F.broadcast(ds.samples.select("sample_id", F.col(by).cast("string").alias("_u"))), "sample_id")
    how = {"mean": F.avg, "median": F.median}[method]
    values = rows.groupBy("_u", "feature_id").agg(how("value").alias("value")).withColumnRenamed("_u", "sample_id")
    return Aggregated(Dataset(values, samples, ds.features, ds.scale), f, info.groupBy("n_replicates").agg(F.count("*").alias("n_units")))
