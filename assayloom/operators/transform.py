"""Matrix transforms: scales, normalisation, missing values, batch correction."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import LOG_SCALES, Dataset, Refusal, detected, finite, require_finite, require_scale
from ..functions.gram import cells, meeting, numbered, tiled, together

MAD_TO_SD = 1.4826
ASKED = 64  # samples whose distances to all others are held at once


def log2_transform(ds: Dataset, pseudocount: float = 1.0) -> Dataset:
    """log2(value + pseudocount); a value of exactly -pseudocount, whose logarithm does not exist, is refused too."""
    require_scale(ds, ("linear",), "log2_transform")
    require_finite(ds, "log2_transform")
    if ds.values.filter(F.col("value") <= -pseudocount).limit(1).count():
        raise Refusal("values at or below minus the pseudocount")
    return ds.with_values(ds.values.withColumn("value", F.log2(F.col("value") + pseudocount)), "log2")


def to_linear(ds: Dataset) -> Dataset:
    require_scale(ds, ("log2", "log10", "ln"), "to_linear")
    v = F.col("value")
    back = {"log2": F.pow(F.lit(2.0), v), "log10": F.pow(F.lit(10.0), v), "ln": F.exp(v)}[ds.scale]
    out = ds.values.withColumn("value", back)
    if out.filter(F.col("value").isNotNull() & ~finite(F.col("value"))).limit(1).count():
        raise Refusal("values overflow on the linear scale")
    return ds.with_values(out, "linear")


def median_center(ds: Dataset) -> Dataset:
    require_scale(ds, LOG_SCALES, "median_center")
    medians = ds.values.groupBy("sample_id").agg(F.median("value").alias("_med"))
    return ds.with_values(ds.values.join(medians, "sample_id").withColumn("value", F.col("value") - F.col("_med")))


def normalize(ds: Dataset, method: str) -> Dataset:
    """median (linear), mad (z-scores of log2) or vsn (glog2 by per-sample affine maps, arsinh scale)."""
    require_scale(ds, ("linear",), "normalize")
    require_finite(ds, "normalize")
    v = F.col("value")
    if method == "median":
        medians = ds.values.groupBy("sample_id").agg(F.median("value").alias("_med"))
        if medians.filter("_med <= 0").limit(1).count():
            raise Refusal("a sample's median is not positive")
        level = medians.agg(F.avg("_med").alias("_level"))
        joined = ds.values.join(medians, "sample_id").join(F.broadcast(level))
        return ds.with_values(joined.withColumn("value", v * F.col("_level") / F.col("_med")))
    if method == "mad":
        y = ds.values.withColumn("value", F.log2(v + 1))
        y = y.join(y.groupBy("sample_id").agg(F.median("value").alias("_med")), "sample_id").withColumn("_d", F.abs(F.col("value") - F.col("_med")))
        spread = y.groupBy("sample_id").agg((F.median("_d") * MAD_TO_SD).alias("_mad"))
        if spread.filter("_mad <= 0").limit(1).count():
            raise Refusal("a sample has no spread")
        return ds.with_values(y.join(spread, "sample_id").withColumn("value", (v - F.col("_med")) / F.col("_mad")), "zscore")
    if method == "vsn":
        return _variance_stabilised(ds)
    raise Refusal(f"unknown method {method!r}")


def _variance_stabilised(ds: Dataset) -> Dataset:
    """glog2((x - offset_s) / factor_s): the published model's transform, with quantiles in place of its likelihood fit.

    The factor is the sample's median distance from its lower quartile, the offset its lower decile;
    glog2(y) = log2((y + sqrt(y^2 + 1)) / 2). It stabilises variances alike but gives other digits than a fitted model.
    """
    per = ds.values.groupBy("sample_id").agg(F.percentile("value", 0.1).alias("_o"), (F.median("value") - F.percentile("value", 0.25)).alias("_f"))
    per = per.withColumn("_f", F.greatest(F.col("_f"), F.lit(1e-12)))
    y = (F.col("value") - F.col("_o")) / F.col("_f")
    joined = ds.values.join(per, "sample_id").withColumn("value", F.log2((y + F.sqrt(y * y + 1)) / 2))
    return ds.with_values(joined, "glog2")


def detection_filter(ds: Dataset, max_missing_fraction: float, min_intensity: float = 0.0) -> Dataset:
    """Features whose share of undetected cells is at most the given one."""
    n = ds.samples.count()
    hits = ds.values.groupBy("feature_id").agg(F.count_if(detected(F.col("value"), min_intensity)).alias("_hits"))
    all_ = ds.features.select("feature_id").join(hits, "feature_id", "left")
    return ds.keep_features(all_.filter((F.lit(n) - F.coalesce("_hits", F.lit(0))) / F.lit(n) <= max_missing_fraction))


def handle_missing(ds: Dataset, *, max_missing_fraction: float, impute: str, min_intensity: float = 0.0, knn_neighbors: int = 5) -> Dataset:
    """Filter, then impute: zero, mean, median (of the feature's detected values) or knn (nearest samples)."""
    require_scale(ds, ("linear",), "handle_missing")
    if impute not in ("zero", "mean", "median", "knn"):
        raise Refusal(f"unknown imputation {impute!r}")
    kept = detection_filter(ds, max_missing_fraction, min_intensity)
    grid = kept.dense()
    seen = detected(F.col("value"), min_intensity)
    value = F.when(seen, F.col("value"))
    if impute == "zero":
        return kept.with_values(grid.withColumn("value", F.coalesce(value, F.lit(0.0))))
    if grid.groupBy("feature_id").agg(F.count_if(seen).alias("n")).filter("n = 0").limit(1).count():
        raise Refusal("a feature was never detected: nothing to impute from")
    grid = grid.withColumn("value", value)
    if impute == "knn":
        return kept.with_values(_nearest_samples(grid, knn_neighbors))
    fill = {"mean": F.avg, "median": F.median}[impute]("value")
    return kept.with_values(grid.join(grid.groupBy("feature_id").agg(fill.alias("_fill")), "feature_id").withColumn("value", F.coalesce("value", "_fill")))


def _nearest_samples(kept: DataFrame, k: int) -> DataFrame:
    """Missing cells from the k nearest samples that have the feature; distance over shared features, scaled to all.

    A tile of samples meets all samples in one task, which holds their values; what leaves it is a row for each missing cell.
    """
    kind = dict(kept.dtypes)["sample_id"]
    places = numbered(kept, "feature_id", "j")
    n = places.count()
    rows, tiles = tiled(kept.filter("value is not null"), places)
    everyone = F.sequence(F.lit(0), F.lit(tiles - 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches):
            ids, mine = part.column("sample_id").combine_chunks(), part.column("t").to_numpy() == part.column("k").to_numpy()
            row, at, v = cells(part)
            x, m = np.zeros((2, len(ids), n))
            x[row, at], m[row, at] = v, 1
            # sums of whole numbers are exact in any order, so products of matrices give them; others are summed as differences
            whole = bool((v == np.rint(v)).all()) and 4 * float(np.abs(v).max()) ** 2 * n < 2.0**53
            square = x * x if whole else None
            asked = np.nonzero(mine & (m.sum(1) < n))[0]
            for some in np.array_split(asked, -(-len(asked) // ASKED)) if len(asked) else ():
                both = m[some] @ m.T
                if whole:
                    total = square[some] @ m.T + m[some] @ square.T - 2 * (x[some] @ x.T)
                else:
                    total = np.stack([(np.square(x - x[i]) * m) @ m[i] for i in some])
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = np.where(both > 0, np.sqrt(total * n / both), np.inf)
                d[np.arange(len(some)), some] = np.inf
                out = [_given(d[r], x, m, np.nonzero(m[i] == 0)[0], k) for r, i in enumerate(some)]
                at_row = np.repeat(some, [len(j) for j, _ in out])
                j, fill = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at_row)), pa.array(j, pa.int32()), pa.array(fill, pa.float64())], names=["sample_id", "j", "_fill"])

    fill = meeting(rows, everyone, tiles).mapInArrow(nearest, f"sample_id {kind}, j int, _fill double")
    fill = fill.join(F.broadcast(places), "j").select("sample_id", "feature_id", "_fill")
    mean = kept.groupBy("feature_id").agg(F.avg("value").alias("_mean"))
    return kept.join(fill, ["sample_id", "feature_id"], "left").join(mean, "feature_id").withColumn("value", F.coalesce("value", "_fill", "_mean"))


def _given(d: np.ndarray, x: np.ndarray, m: np.ndarray, holes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of one sample's holes that a sample at distance d can fill, and the mean of the k nearest that have each; of equal
    distances the first. Ever more of the nearest are looked at until each hole has k."""
    most, finite_ = 16 * k, int(np.isfinite(d).sum())
    while True:
        near = np.nonzero(d <= np.partition(d, most - 1)[most - 1])[0] if most < finite_ else np.nonzero(np.isfinite(d))[0]
        near = near[np.argsort(d[near], kind="stable")]
        has = m[np.ix_(near, holes)] > 0
        seen = np.cumsum(has, axis=0)
        if most >= finite_ or (len(near) and seen[-1].min() >= k):
            break
        most *= 8
    used = has & (seen <= k)
    count = used.sum(0)
    some = count > 0
    return holes[some], (x[np.ix_(near, holes)] * used).sum(0)[some] / count[some]


class BatchPassthroughWarning(UserWarning):
    pass


def combat_correct(ds: Dataset, batch_column: str, *, sample_mask: Column | str | None = None, min_variance: float = 0.0, iterations: int = 100) -> Dataset:
    """Location and scale of each batch, shrunk over features by empirical Bayes (Johnson, Li and Rabinovic 2007).

    sample_mask: a condition on the samples; those that fail it have no part in the fit and pass through uncorrected.
    Features with next to no variance inside a batch pass through. Moments are grouped aggregates; only the shrinkage,
    which needs all features of one batch together, runs as a grouped function, a batch a task.
    """
    require_scale(ds, LOG_SCALES, "combat_correct")
    require_finite(ds, "combat_correct")
    fitted = ds.samples if sample_mask is None else ds.samples.filter(sample_mask)
    batches = fitted.groupBy(batch_column).count().collect()
    if len(batches) < 2 or min(r["count"] for r in batches) < 2:
        raise Refusal("needs two batches or more, of two samples or more")
    rows = ds.values.join(F.broadcast(fitted.select("sample_id", F.col(batch_column).alias("_b"))), "sample_id")
    per = rows.groupBy("feature_id", "_b").agg(F.avg("value").alias("_m"), F.var_samp("value").alias("_v"), F.var_pop("value").alias("_vp"), F.count("*").alias("_n"))
    pooled = per.groupBy("feature_id").agg(F.sum(F.col("_m") * F.col("_n")).alias("_s"), F.sum(F.col("_vp") * F.col("_n")).alias("_ss"), F.sum("_n").alias("_N"), F.min("_v").alias("_least"))
    pooled = pooled.select("feature_id", (F.col("_s") / F.col("_N")).alias("_g"), F.sqrt(F.col("_ss") / F.col("_N")).alias("_sd"), "_least")
    flat = pooled.filter(F.col("_least") <= min_variance)
    skipped = flat.count()
    if skipped:
        warnings.warn(f"{skipped} nearly constant features pass through", BatchPassthroughWarning, stacklevel=2)
    good = pooled.filter(F.col("_least") > min_variance)
    z = per.join(good, "feature_id").select("feature_id", "_b", ((F.col("_m") - F.col("_g")) / F.col("_sd")).alias("gamma"), (F.col("_v") / F.col("_sd") ** 2).alias("delta"), "_n")

    def shrink(p: pd.DataFrame) -> pd.DataFrame:
        g, d, n = p["gamma"].to_numpy(), p["delta"].to_numpy(), p["_n"].to_numpy(float)
        bar, tau = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
        m, s = d.mean(), d.var(ddof=1) if len(d) > 1 else 0.0
        if s > 0:
            alpha, beta = (2 * s + m * m) / s, (m * s + m**3) / s
        gg, dd = g.copy(), d.copy()
        for _ in range(iterations):
            new_g = (n * tau * g + dd * bar) / (n * tau + dd) if tau > 0 else np.full_like(g, bar)
            new_d = (beta + 0.5 * ((n - 1) * d + n * (g - new_g) ** 2)) / (n / 2 + alpha - 1) if s > 0 else dd
            moved = max(np.abs(new_g - gg).max(), np.abs(new_d - dd).max())
            gg, dd = new_g, new_d
            if moved < 1e-8:
                break
        return pd.DataFrame({"feature_id": p["feature_id"], "_b": p["_b"], "_gs": gg, "_ds": dd})

    schema = f"feature_id {dict(z.dtypes)['feature_id']}, _b {dict(z.dtypes)['_b']}, _gs double, _ds double"
    shrunk = z.groupBy("_b").applyInPandas(shrink, schema)
    fixed = rows.join(good, "feature_id", "left").join(shrunk, ["feature_id", "_b"], "left")
    corrected = F.col("_sd") * (((F.col("value") - F.col("_g")) / F.col("_sd")) - F.col("_gs")) / F.sqrt("_ds") + F.col("_g")
    fixed = fixed.withColumn("value", F.coalesce(corrected, F.col("value"))).select(*ds.values.columns)
    if sample_mask is not None:
        fixed = fixed.unionByName(ds.values.join(F.broadcast(fitted.select("sample_id")), "sample_id", "left_anti").select(*ds.values.columns))
    return ds.with_values(fixed)
