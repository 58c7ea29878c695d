"""Quality control: the tables behind every QC figure."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Dataset, Refusal, detected, finite, require_finite, require_scale
from ..functions.columns import average_rank
from ..functions.gram import BLOCK, MOST, cells, meeting, numbered, summed, tiled, together

STRIP = 128  # samples whose correlations with a tile are made at once


def cv(ds: Dataset) -> DataFrame:
    """Coefficient of variation per feature; null where the mean is not positive."""
    require_scale(ds, ("linear",), "cv")
    if ds.samples.count() < 2:
        raise Refusal("cv needs two samples")
    v = F.when(finite(F.col("value")), F.col("value"))
    per = ds.values.groupBy("feature_id").agg(F.stddev_samp(v).alias("sd"), F.avg(v).alias("mean"))
    return per.select("feature_id", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).alias("cv"))


def cv_by_state(states: dict[str, Dataset]) -> DataFrame:
    """Median CV of each processing state and the pooled 99.5th percentile that bounds a plot."""
    frames = [cv(ds).withColumn("state", F.lit(name)) for name, ds in states.items()]
    all_ = frames[0]
    for f in frames[1:]:
        all_ = all_.unionByName(f)
    bound = all_.agg(F.percentile("cv", 0.995).alias("upper_bound"))
    return all_.groupBy("state").agg(F.median("cv").alias("median_cv"), F.count("cv").alias("n")).join(F.broadcast(bound))


def sample_medians(ds: Dataset) -> DataFrame:
    seen = ds.values.groupBy("sample_id").agg(F.median(F.when(finite(F.col("value")), F.col("value"))).alias("median"))
    return ds.samples.select("sample_id").join(seen, "sample_id", "left")


def detection_counts(ds: Dataset, min_intensity: float = 0.0) -> DataFrame:
    require_scale(ds, ("linear",), "detection_counts")
    seen = ds.values.groupBy("sample_id").agg(F.count_if(detected(F.col("value"), min_intensity)).alias("n_detected"))
    return ds.samples.select("sample_id").join(seen, "sample_id", "left").select("sample_id", F.coalesce("n_detected", F.lit(0)).alias("n_detected"))


def reference_median(ds: Dataset, where: Column | str | None = None, min_intensity: float = 0.0) -> float | None:
    """Median number of detected features of the samples that satisfy `where` (all without it); None where there are none."""
    counts = detection_counts(ds, min_intensity)
    if where is not None:
        counts = counts.join(ds.samples.filter(where).select("sample_id"), "sample_id", "left_semi")
    return counts.agg(F.median("n_detected")).first()[0]


def feature_completeness(ds: Dataset, min_intensity: float = 0.0) -> DataFrame:
    """Rate of detection and mean log2 of the positive detected values, per feature."""
    require_scale(ds, ("linear",), "completeness")
    n = ds.samples.count()
    seen = detected(F.col("value"), min_intensity)
    per = ds.values.groupBy("feature_id").agg(F.count_if(seen).alias("n_detected"), F.avg(F.when(seen & (F.col("value") > 0), F.log2("value"))).alias("mean_log2"))
    all_ = ds.features.select("feature_id").join(per, "feature_id", "left")
    return all_.select("feature_id", F.coalesce("n_detected", F.lit(0)).alias("n_detected"), (F.coalesce("n_detected", F.lit(0)) / n).alias("rate"), "mean_log2")


def sample_completeness(ds: Dataset, min_intensity: float = 0.0) -> DataFrame:
    return detection_counts(ds, min_intensity).select("sample_id", (F.col("n_detected") / ds.features.count()).alias("rate"))


def mnar_correlation(completeness: DataFrame) -> DataFrame:
    """Pearson r of mean log2 intensity and detection rate over features; null without spread."""
    known = completeness.filter("mean_log2 is not null")
    stats = known.agg(F.corr("mean_log2", "rate").alias("r"), F.count("*").alias("n"), F.stddev_samp("mean_log2").alias("a"), F.stddev_samp("rate").alias("b"))
    return stats.select(F.when((F.col("n") > 1) & (F.col("a") > 0) & (F.col("b") > 0), F.nanvl("r", F.lit(None).cast("double"))).alias("r"), "n")


def completeness_curve(completeness: DataFrame, n_samples: int) -> DataFrame:
    """Features detected in k samples or more, for k from 1: one reverse running sum over the histogram of counts."""
    histogram = completeness.groupBy("n_detected").agg(F.count("*").alias("c"))
    ks = completeness.sparkSession.range(1, n_samples + 1).withColumnRenamed("id", "k")
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ks.join(F.broadcast(histogram.withColumnRenamed("n_detected", "k")), "k", "left").select("k", F.sum(F.coalesce("c", F.lit(0))).over(w).alias("n_features"))


def binned_median(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Median y between percentile edges of x, both ends closed: a value on an edge counts in both bins."""
    edges = df.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("e"))
    spans = edges.select(F.posexplode(F.expr("transform(sequence(0, size(e) - 2), i -> named_struct('lo', e[i], 'hi', e[i + 1]))")).alias("bin", "s"))
    joined = df.join(F.broadcast(spans), (F.col(x) >= F.col("s.lo")) & (F.col(x) <= F.col("s.hi")))
    return joined.groupBy("bin").agg(F.median(y).alias("median"), F.count("*").alias("n"), F.first("s.lo").alias("lo"), F.first("s.hi").alias("hi"))


def dynamic_range(ds: Dataset, min_intensity: float = 0.0, by: str | None = None) -> DataFrame:
    """Median, quartiles and rank of the detected features (rank by median, then feature); `by`: per class of samples."""
    require_scale(ds, ("linear",), "dynamic_range")
    rows = ds.values.filter(detected(F.col("value"), min_intensity))
    key = ["feature_id"]
    if by:
        rows = rows.join(F.broadcast(ds.samples.select("sample_id", F.col(by).alias("class"))), "sample_id")
        key = ["class", "feature_id"]
    per = rows.groupBy(*key).agg(F.median("value").alias("median"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"))
    w = Window.partitionBy(*key[:-1]).orderBy(F.col("median").desc(), "feature_id")
    out = per.withColumn("rank", F.row_number().over(w))
    return out.select(*key, "rank", *[F.log2(c).alias(f"log2_{c}") for c in ("median", "q25", "q75")], "median")


def orders_of_magnitude(ranked: DataFrame, by: str | None = None) -> DataFrame:
    return ranked.groupBy(*([by] if by else [])).agg(F.log10(F.max("median") / F.min("median")).alias("orders"), F.count("*").alias("n"))


def correlation(ds: Dataset, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of samples (a < b) over shared features: sums of products by blocks of features, and for
    more samples than such sums allow by tiles of samples."""
    require_finite(ds, "correlation")
    if method not in ("pearson", "spearman"):
        raise Refusal(f"unknown method {method!r}")
    v = ds.values
    if method == "spearman":
        v = v.withColumn("value", average_rank("value", ["sample_id"]))
    names = [r[0] for r in v.select("sample_id").distinct().orderBy("sample_id").limit(MOST + 1).collect()]
    if len(names) <= MOST:
        return _correlated(v, names)
    return _tiles_correlated(v)


def _tiles_correlated(v: DataFrame) -> DataFrame:
    """The pairs of two tiles are made and sent on in one task, strip by strip: no product and no sum travels."""
    kind = dict(v.dtypes)["sample_id"]
    rows, tiles = tiled(v, numbered(v, "feature_id", "j"))
    # key of a pair of tiles: the lesser one, then the greater one
    pair = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda u: F.least(u, F.col("t")) * tiles + F.greatest(u, F.col("t")))

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches):
            first, second = divmod(part.column("k")[0].as_py(), tiles)
            ids, t = part.column("sample_id").combine_chunks(), part.column("t").to_numpy()
            row, at, x = cells(part)
            x = x - (np.bincount(row, x) / np.bincount(row))[row]  # values from their sample's mean: what is subtracted below stays small
            feature = np.unique(at, return_inverse=True)[1]
            order = np.lexsort((feature, row))
            row, feature, x = row[order], feature[order], x[order]
            left, right = np.nonzero(t == first)[0], np.nonzero(t == second)[0]
            blocks = range(0, int(feature.max()) + 1, BLOCK)
            whole = [_block(row, feature, x, right[0], right[-1] + 1, b) for b in blocks] if len(blocks) == 1 else None
            for lo in range(left[0], left[-1] + 1, STRIP):
                hi = min(lo + STRIP, left[-1] + 1)
                xy, n, sx, sxx, sy, syy = total = np.zeros((6, hi - lo, len(right)))
                for k, b in enumerate(blocks):
                    (p, m), (q, w) = _block(row, feature, x, lo, hi, b), whole[k] if whole else _block(row, feature, x, right[0], right[-1] + 1, b)
                    for sums, one, other in zip(total, (p, m, p, p * p, m, m), (q, w, w, w, q, q * q)):
                        sums += one @ other.T
                i, j = np.nonzero((n > 0) & (np.arange(lo, hi)[:, None] < right[None, :]))
                xy, n, sx, sxx, sy, syy = (s[i, j] for s in total)
                across, one, other = xy - sx * sy / n, sxx - sx**2 / n, syy - sy**2 / n
                solid = (one > 1e-12 * sxx) & (other > 1e-12 * syy)
                r = np.clip(across / np.sqrt(np.where(solid, one * other, 1.0)), -1, 1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + lo)), ids.take(pa.array(right[j])), pa.array(r, mask=~solid)], names=["a", "b", "r"])

    return meeting(rows, pair, tiles * (tiles + 1) // 2).mapInArrow(correlated, f"a {kind}, b {kind}, r double")


def _block(row: np.ndarray, feature: np.ndarray, x: np.ndarray, lo: int, hi: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where missing) and presence of the samples lo to hi at BLOCK features; cells come in order of row."""
    some = slice(*np.searchsorted(row, [lo, hi]))
    here = (feature[some] >= at) & (feature[some] < at + BLOCK)
    width = min(BLOCK, int(feature.max()) + 1 - at)
    out = np.zeros((2, hi - lo, width))
    i, j = row[some][here] - lo, feature[some][here] - at
    out[0, i, j], out[1, i, j] = x[some][here], 1
    return out[0], out[1]


def _correlated(v: DataFrame, names: list) -> DataFrame:
    spark, kind = v.sparkSession, dict(v.dtypes)["sample_id"]
    order = spark.createDataFrame(list(zip(names, range(len(names)))), f"sample_id {kind}, i int")
    # values from their sample's mean: what is subtracted below stays small
    centred = v.join(v.groupBy("sample_id").agg(F.avg("value").alias("_m")), "sample_id").select("sample_id", "feature_id", (F.col("value") - F.col("_m")).alias("value"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, xy, n, x, xx in batch.itertuples(index=False):
                yield pd.DataFrame({"i": i, "j": np.arange(len(names)), "xy": xy, "n": n, "x": x, "xx": xx})

    tall = summed(centred, order, len(names), True).mapInPandas(pairs, "i long, j long, xy double, n double, x double, xx double")
    # what the other sample sums to over the shared features stands in its own row
    both = tall.filter("i < j").join(tall.filter("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy")), ["i", "j"]).filter("n > 0")
    across, left, right = F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") ** 2 / F.col("n"), F.col("yy") - F.col("y") ** 2 / F.col("n")
    solid = (left > 1e-12 * F.col("xx")) & (right > 1e-12 * F.col("yy"))
    r = F.when(solid, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), across / F.sqrt(left * right))))
    named = [order.select(F.col("sample_id").alias(k), F.col("i").cast("long").alias(p)) for k, p in (("a", "i"), ("b", "j"))]
    return both.select("i", "j", r.alias("r")).join(F.broadcast(named[0]), "i").join(F.broadcast(named[1]), "j").select("a", "b", "r")


def leaf_order(pairs: DataFrame) -> list:
    """Samples in the order of an average-linkage tree on 1 - r (the n x n matrix of samples is small)."""
    rows = pairs.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {s: i for i, s in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = 1 - (r["r"] if r["r"] is not None else 0.0)
    groups = {i: [i] for i in range(len(names))}
    while len(groups) > 1:
        keys = list(groups)
        x, y = min(((p, q) for i, p in enumerate(keys) for q in keys[i + 1 :]), key=lambda pq: (d[np.ix_(groups[pq[0]], groups[pq[1]])].mean(), pq))
        groups[x] = groups[x] + groups.pop(y)
    return [names[i] for i in next(iter(groups.values()))] if names else []


def pca(ds: Dataset, n_components: int = 4, standardize: bool = True) -> tuple[DataFrame, list[float]]:
    """Scores (sample_id, component, score) and explained variance shares, from the n x n Gram matrix of samples or, where
    samples are more than such sums allow, the p x p one of features.

    Features are standardised with the population SD; constant ones drop out. The Gram matrix is summed by blocks, so no
    row for each product is formed. Of each component, the entry of largest size is positive.
    """
    require_finite(ds, "pca")
    spark, kind = ds.values.sparkSession, dict(ds.samples.dtypes)["sample_id"]
    stats = ds.values.groupBy("feature_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi")
    z = ds.values.join(stats, "feature_id").select("feature_id", "sample_id", ((F.col("value") - F.col("m")) / (F.col("s") if standardize else F.lit(1.0))).alias("value"))
    ids = ds.samples.select("sample_id", "sample_ord").toArrow().sort_by("sample_ord").column("sample_id").combine_chunks()
    n = len(ids)
    if n <= MOST:
        values, vectors = _components(z, spark.createDataFrame(list(zip(ids.to_pylist(), range(n))), f"sample_id {kind}, i int"), n)
        k = min(n_components, n)
        scores = vectors[:, :k] * np.sqrt(values[:k])
    else:
        names = [r[0] for r in stats.select("feature_id").orderBy("feature_id").limit(MOST + 1).collect()]
        if len(names) > MOST:
            raise Refusal(f"components need {MOST} samples or {MOST} varying features at most, not more of both")
        turned = z.select(F.col("sample_id").alias("feature_id"), F.col("feature_id").alias("sample_id"), "value")
        of = dict(ds.values.dtypes)["feature_id"]
        values, vectors = _components(turned, spark.createDataFrame(list(zip(names, range(len(names)))), f"sample_id {of}, i int"), len(names))
        k = min(n_components, len(names))
        weights = spark.createDataFrame([(f, [float(w) for w in vectors[j, :k]]) for j, f in enumerate(names)], f"feature_id {of}, w array<double>")
        # a sample's scores are sums over its features: a row a sample comes back
        sums = [F.sum(F.col("value") * F.col("w")[c]).alias(f"c{c}") for c in range(k)]
        per = z.join(F.broadcast(weights), "feature_id").groupBy("sample_id").agg(*sums)
        got = ds.samples.select("sample_id", "sample_ord").join(per, "sample_id", "left").fillna(0.0, [f"c{c}" for c in range(k)]).toArrow().sort_by("sample_ord")
        scores = np.column_stack([got.column(f"c{c}").to_numpy() for c in range(k)]) if k else np.zeros((n, 0))
    scores = scores * np.where(scores[np.abs(scores).argmax(axis=0), np.arange(k)] < 0, -1, 1) if k else scores
    rows = pa.table({"sample_id": ids.take(pa.array(np.repeat(np.arange(n), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), "score": pa.array(scores.ravel())})
    share = (values[:k] / values.sum()).tolist() if values.sum() > 0 else [0.0] * k
    return spark.createDataFrame(rows, f"sample_id {kind}, component int, score double"), share


def _components(z: DataFrame, order: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, from the largest down, and eigenvectors of the Gram matrix of what order names."""
    g = np.zeros((n, n))
    for r in summed(z, order, n, False).collect():  # a row of the matrix each
        g[r["i"]] = r["xy"]
    values, vectors = np.linalg.eigh(g) if n else (np.zeros(0), g)
    return np.maximum(values[::-1], 0), vectors[:, ::-1]


def cramers_v(samples: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected Cramer's V of two columns; 0 where degenerate. Empty cells count, so the levels are crossed."""
    cells = samples.filter(f"`{a}` is not null and `{b}` is not null").groupBy(a, b).count()
    rows, cols = cells.groupBy(a).agg(F.sum("count").alias("ra")), cells.groupBy(b).agg(F.sum("count").alias("cb"))
    total = cells.agg(F.sum("count").alias("n"))
    full = rows.join(cols, how="cross").join(cells, [a, b], "left").join(F.broadcast(total)).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    chi = full.agg(F.sum((F.coalesce("count", F.lit(0)) - F.col("e")) ** 2 / F.col("e")).alias("chi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"), F.max("n").alias("n"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("r") - 1) * (F.col("c") - 1) / (F.col("n") - 1))
    rc, cc = F.col("r") - (F.col("r") - 1) ** 2 / (F.col("n") - 1), F.col("c") - (F.col("c") - 1) ** 2 / (F.col("n") - 1)
    least = F.least(rc - 1, cc - 1)
    return chi.select(F.when((F.col("n") > 1) & (least > 0), F.sqrt(phi / F.when(least > 0, least))).otherwise(0.0).alias("v"), "chi2", "n")


class BatchConfoundingWarning(UserWarning):
    pass


def batch_confounding(ds: Dataset, batch: str, covariates: list[str], warn_threshold: float = 0.5) -> DataFrame:
    """Per covariate: Cramer's V with the batch, and whether every batch has a single level of it."""
    out = None
    for c in covariates:
        v = cramers_v(ds.samples, batch, c).select(F.lit(c).alias("covariate"), "v")
        levels = ds.samples.groupBy(batch).agg(F.count_distinct(c).alias("k")).agg((F.max("k") == 1).alias("perfect"))
        one = v.join(levels)
        out = one if out is None else out.unionByName(one)
    for r in out.collect():
        if r["perfect"] or r["v"] >= warn_threshold:
            warnings.warn(f"{r['covariate']} is {'fully' if r['perfect'] else 'partly'} confounded with {batch} (V = {r['v']:.2f})", BatchConfoundingWarning, stacklevel=2)
    return out
