"""Differential abundance: per-feature tests over the whole matrix, one shuffle by feature each."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import LOG_SCALES, Dataset, Refusal, require_finite
from ..functions.columns import benjamini_hochberg, safe_neg_log10, t_p_value
from ..functions.special import bisect, digamma, normal_quantile, t_quantile, trigamma

METHODS = ("moderated", "ols", "welch", "mannwhitney", "signedrank")
LEAST_VARIANCES = 50
TABLE = ("feature", "term", "is_contrast", "effect", "ci_low", "ci_high", "statistic", "p", "q", "mean_abundance", "n")


class ScaleWarning(UserWarning):
    pass


class LowCardinalityNumericWarning(UserWarning):
    pass


class UnweightedReplicatesWarning(UserWarning):
    pass


class UnpairedUnitWarning(UserWarning):
    pass


class LowPowerRankTestWarning(UserWarning):
    pass


@dataclass(frozen=True)
class Term:
    name: str
    contrast: bool
    tested: bool
    values: tuple[float, ...]


@dataclass(frozen=True)
class Differential:
    table: DataFrame
    method: str
    contrast: str
    terms: tuple[str, ...]
    unit_plan: str
    n: int
    prior_variance: float | None = None
    prior_df: float | None = None


def column_terms(rows: list[dict], column: str, contrast: bool, categorical: bool, reference: str | None = None) -> list[Term]:
    """A slope for numbers, k-1 dummies against the reference (first level in order) otherwise."""
    values = [r[column] for r in rows]
    if any(v is None for v in values):
        raise Refusal(f"{column} has missing values")
    number = not categorical and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    if number:
        if len(set(values)) <= 5 and all(float(v).is_integer() for v in values):
            warnings.warn(f"{column} has {len(set(values))} whole-number levels and is taken as a slope", LowCardinalityNumericWarning, stacklevel=3)
        return [Term(column, contrast, True, tuple(map(float, values)))]
    levels = sorted({str(v) for v in values})
    if len(levels) < 2:
        raise Refusal(f"{column} has a single level")
    ref = reference if reference is not None else levels[0]
    if ref not in levels:
        raise Refusal(f"{column} has no level {ref}")
    return [Term(f"{column}[{v} vs {ref}]", contrast, True, tuple(float(str(x) == v) for x in values)) for v in levels if v != ref]


def unit_plan(rows: list[dict], contrast: str, unit: str | None) -> str:
    """plain (no repeats), or within (fixed effect of each unit); repeats inside a level are refused."""
    if unit is None:
        return "plain"
    per: dict = {}
    for r in rows:
        if r[unit] is None:
            raise Refusal(f"{unit} has missing values")
        per.setdefault(r[unit], []).append(r[contrast])
    if all(len(v) == 1 for v in per.values()):
        return "plain"
    if any(len(v) != len(set(v)) for v in per.values()):
        if all(len(set(v)) == 1 for v in per.values()):
            raise Refusal(f"several rows per {unit} and {contrast} is constant within {unit}: aggregate replicates first")
        raise Refusal(f"several rows per {unit} and level of {contrast}: aggregate them first")
    return "within"


def fit_prior(log_mean: float, log_var: float, df: float, count: int) -> tuple[float, float]:
    """(s0 squared, d0) of the scaled F prior from the mean and sample variance of log variances."""
    if count < LEAST_VARIANCES:
        raise Refusal(f"the prior needs {LEAST_VARIANCES} positive variances, not {count}")
    centre = log_mean - digamma(df / 2) + math.log(df / 2)
    excess = log_var - trigamma(df / 2)
    if excess <= trigamma(5e5):
        return math.exp(centre), math.inf
    d0 = bisect(lambda d: excess - trigamma(d / 2), 1e-6, 1e6)
    return math.exp(centre + digamma(d0 / 2) - math.log(d0 / 2)), d0


def design(rows: list[dict], terms: list[Term], weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(X'WX)^-1 X'W and the diagonal of (X'WX)^-1; singular or saturated designs are refused."""
    x = np.column_stack([np.ones(len(rows)), *[np.array(t.values) for t in terms]])
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise Refusal("the design is singular")
    if len(rows) <= x.shape[1]:
        raise Refusal("the design leaves no degrees of freedom")
    xw = x if weights is None else x * weights[:, None]
    inverse = np.linalg.inv(x.T @ xw)
    return inverse @ xw.T, np.diag(inverse)


def linear_fit(ds: Dataset, rows: list[dict], terms: list[Term], weights: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Coefficients (feature_id, k, beta), variances (feature_id, s2, mean, n) and the residual degrees of freedom.

    The projector and the annihilator I - X(X'WX)^-1X'W are computed once, broadcast as columns of each sample, and the
    coefficients and the residual sum of squares are plain sums: y'W(I - H)y needs no second pass over the values.
    """
    projector, _ = design(rows, terms, weights)
    k = projector.shape[0]
    spark, kind = ds.values.sparkSession, dict(ds.samples.dtypes)["sample_id"]
    w = np.ones(len(rows)) if weights is None else weights
    x = np.column_stack([np.ones(len(rows)), *[np.array(t.values) for t in terms]])
    per_sample = spark.createDataFrame([(r["sample_id"], float(w[i]), [float(v) for v in projector[:, i]], [float(v) for v in x[i]]) for i, r in enumerate(rows)], f"sample_id {kind}, w double, proj array<double>, x array<double>")
    joined = ds.values.join(F.broadcast(per_sample), "sample_id")
    sums = joined.groupBy("feature_id").agg(*[F.sum(F.col("proj")[i] * F.col("value")).alias(f"b{i}") for i in range(k)], F.avg("value").alias("mean"), F.count("value").alias("n"))
    if sums.filter(F.col("n") != len(rows)).limit(1).count():
        raise Refusal("a feature lacks values: resolve missing ones first")
    # residuals by a second aggregate over the same exchange key keep their precision where y'y would cancel
    beta = sums.select("feature_id", F.array(*[F.col(f"b{i}") for i in range(k)]).alias("beta"), "mean", "n")
    fitted = F.expr("aggregate(zip_with(x, beta, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    residual = joined.join(beta, "feature_id").withColumn("e", F.col("value") - fitted)
    df = len(rows) - k
    var = residual.groupBy("feature_id").agg((F.sum(F.col("w") * F.col("e") * F.col("e")) / df).alias("s2"), F.first("mean").alias("mean"), F.first("n").alias("n"), F.first("beta").alias("beta"))
    return beta, var, df


def _finish(per_term: DataFrame, contrast_first: bool = True) -> DataFrame:
    tested = benjamini_hochberg(per_term, "p", ["term"])
    return tested.select(*TABLE)


def linear_model(ds: Dataset, rows: list[dict], terms: list[Term], method: str, weights: np.ndarray | None, alpha: float) -> tuple[DataFrame, float | None, float | None]:
    _, var, df = linear_fit(ds, rows, terms, weights)
    _, diag = design(rows, terms, weights)
    s0 = d0 = None
    s2, degrees = F.col("s2"), float(df)
    if method == "moderated":
        logs = var.filter("s2 > 0").agg(F.avg(F.log("s2")), F.var_samp(F.log("s2")), F.count("*")).first()
        s0, d0 = fit_prior(logs[0] or 0.0, logs[1] or 0.0, df, logs[2])
        s2 = F.lit(s0) if math.isinf(d0) else (d0 * s0 + df * F.col("s2")) / (d0 + df)
        degrees = d0 + df
    quantile = t_quantile(1 - alpha / 2, degrees)
    tested = [(i + 1, t) for i, t in enumerate(terms) if t.tested]
    described = F.array(*[F.struct(F.lit(t.name).alias("term"), F.lit(t.contrast).alias("is_contrast"), F.lit(i).alias("k"), F.lit(float(diag[i])).alias("d")) for i, t in tested])
    each = var.withColumn("t", F.explode(described)).withColumn("se", F.sqrt(s2 * F.col("t.d"))).withColumn("effect", F.get("beta", F.col("t.k")))
    each = each.withColumn("statistic", F.when(F.col("se") > 0, F.col("effect") / F.col("se"))).withColumn("_df", F.lit(degrees))
    each = t_p_value(each, "statistic", "_df")
    half = quantile * F.col("se")
    out = each.select(F.col("feature_id").alias("feature"), "t.term", "t.is_contrast", "effect", (F.col("effect") - half).alias("ci_low"), (F.col("effect") + half).alias("ci_high"), "statistic", "p", F.col("mean").alias("mean_abundance"), F.col("n").cast("int").alias("n"))
    return _finish(out), s0, d0


def welch(ds: Dataset, column: str, level: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t of level against reference per feature."""
    groups = ds.samples.filter(F.col(column).cast("string").isin(level, reference)).select("sample_id", F.col(column).cast("string").alias("_g"))
    v = ds.values.join(F.broadcast(groups), "sample_id")
    of = lambda f, g: f(F.when(F.col("_g") == g, F.col("value")))
    per = v.groupBy("feature_id").agg(of(F.avg, level).alias("m1"), of(F.avg, reference).alias("m0"), of(F.var_samp, level).alias("v1"), of(F.var_samp, reference).alias("v0"), of(F.count, level).alias("n1"), of(F.count, reference).alias("n0"), F.avg("value").alias("mean"))
    if per.filter("n1 < 2 or n0 < 2").limit(1).count():
        raise Refusal("Welch's test needs two values in each group")
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    per = per.withColumn("effect", F.col("m1") - F.col("m0")).withColumn("se", F.sqrt(a + b)).withColumn("statistic", F.when(F.col("se") > 0, F.col("effect") / F.col("se")))
    per = per.withColumn("_df", F.when(F.col("se") > 0, (a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).otherwise(1.0))
    per = t_p_value(per, "statistic", "_df")

    @F.pandas_udf("double")
    def quantile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for d in batches:
            yield pd.Series([t_quantile(1 - alpha / 2, x) for x in d])

    half = quantile("_df") * F.col("se")
    return per.select(F.col("feature_id").alias("feature"), F.lit(f"{column}[{level} vs {reference}]").alias("term"), F.lit(True).alias("is_contrast"), "effect", (F.col("effect") - half).alias("ci_low"), (F.col("effect") + half).alias("ci_high"), "statistic", "p", F.col("mean").alias("mean_abundance"), (F.col("n1") + F.col("n0")).cast("int").alias("n"), F.col("_df").alias("df"))


def ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    s = x[order]
    start = np.append(True, s[1:] != s[:-1])
    group = np.cumsum(start) - 1
    first = np.nonzero(start)[0]
    last = np.append(first[1:], len(x))
    out[order] = ((first + last + 1) / 2)[group]
    return out


def remembered(f):
    """f with a memory that travels with it (functools' own caches only pickle by name)."""
    known: dict = {}

    def g(*key):
        if key not in known:
            known[key] = f(*key)
        return known[key]

    return g


@remembered
def mann_whitney_counts(n1: int, n0: int) -> tuple[float, ...]:
    """Probability of each U under the null, by the standard recurrence over group sizes."""
    table = {(0, j): np.ones(1) for j in range(n0 + 1)}
    for i in range(1, n1 + 1):
        table[i, 0] = np.ones(1)
        for j in range(1, n0 + 1):
            out = np.zeros(i * j + 1)
            a, b = table[i - 1, j], table[i, j - 1]
            out[j : j + len(a)] += a
            out[: len(b)] += b
            table[i, j] = out
    c = table[n1, n0]
    return tuple(c / c.sum())


def mann_whitney(x: np.ndarray, y: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float, float, float]:
    """U of x, p, Hodges-Lehmann shift, interval: exact when a group has at most 8 and nothing ties, else normal."""
    n1, n0 = len(x), len(y)
    both = np.concatenate([x, y])
    r = ranks(both)
    u = r[:n1].sum() - n1 * (n1 + 1) / 2
    _, tied = np.unique(both, return_counts=True)
    n = n1 + n0
    if min(n1, n0) <= 8 and tied.max() == 1:
        null = np.array(mann_whitney_counts(n1, n0))
        p = min(1.0, 2 * null[int(max(u, n1 * n0 - u)) :].sum())
    else:
        var = n1 * n0 / 12 * ((n + 1) - (tied**3 - tied).sum() / (n * (n - 1)))
        z = (abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(var) if var > 0 else math.nan
        p = min(1.0, math.erfc(z / math.sqrt(2))) if var > 0 else math.nan
    d = np.sort((x[:, None] - y[None, :]).ravel())
    k = math.floor(n1 * n0 / 2 - normal_quantile(1 - alpha / 2) * math.sqrt(n1 * n0 * (n + 1) / 12))
    low, high = (d[k], d[len(d) - 1 - k]) if k >= 0 else (math.nan, math.nan)
    return u, p, float(np.median(d)), low, high


@remembered
def signed_rank_cdf(n: int) -> tuple[float, ...]:
    """P(W <= w) of the signed-rank sum of n differences: subset sums of 1..n."""
    c = np.ones(1)
    for i in range(1, n + 1):
        out = np.zeros(len(c) + i)
        out[: len(c)] += c
        out[i:] += c
        c = out / 2
    return tuple(np.minimum(1, np.cumsum(c)))


def signed_rank(d: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float, float, float]:
    """W+, p, pseudo-median, interval; zeros drop, exact up to 50 untied differences."""
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return math.nan, math.nan, 0.0, math.nan, math.nan
    r = ranks(np.abs(d))
    w = r[d > 0].sum()
    top = n * (n + 1) / 2
    _, tied = np.unique(np.abs(d), return_counts=True)
    exact = n <= 50 and tied.max() == 1
    if exact:
        p = min(1.0, 2 * signed_rank_cdf(n)[int(min(w, top - w))])
    else:
        var = n * (n + 1) * (2 * n + 1) / 24 - (tied**3 - tied).sum() / 48
        p = math.erfc(abs(w - top / 2) / math.sqrt(2 * var))
    i, j = np.triu_indices(n)
    walsh = np.sort((d[i] + d[j]) / 2)
    if exact:
        cdf = np.array(signed_rank_cdf(n))
        c = int(np.searchsorted(cdf, alpha / 2, "right")) - 1
    else:
        c = math.floor(len(walsh) / 2 - normal_quantile(1 - alpha / 2) * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    low, high = (walsh[c], walsh[len(walsh) - 1 - c]) if c >= 0 else (math.nan, math.nan)
    return w, p, float(np.median(walsh)), low, high


RANKED = "feature {kind}, statistic double, p double, effect double, ci_low double, ci_high double, mean_abundance double, n int"


def rank_test(ds: Dataset, column: str, level: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """Mann-Whitney per feature, each feature's values in one grouped call (n is small, p large)."""
    groups = ds.samples.filter(F.col(column).cast("string").isin(level, reference)).select("sample_id", (F.col(column).cast("string") == level).alias("_up"))
    v = ds.values.join(F.broadcast(groups), "sample_id")

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        up = f["_up"].to_numpy()
        x = f["value"].to_numpy(float)
        return pd.DataFrame([(key[0], *mann_whitney(x[up], x[~up], alpha), x.mean(), len(x))], columns=["feature", "statistic", "p", "effect", "ci_low", "ci_high", "mean_abundance", "n"])

    out = v.groupBy("feature_id").applyInPandas(one, RANKED.format(kind=dict(ds.values.dtypes)["feature_id"]))
    return _nulls(out).withColumn("term", F.lit(f"{column}[{level} vs {reference}]")).withColumn("is_contrast", F.lit(True))


def paired_test(ds: Dataset, column: str, level: str, reference: str, unit: str, alpha: float = 0.05) -> DataFrame:
    """Signed-rank per feature over units that have both levels."""
    groups = ds.samples.filter(F.col(column).cast("string").isin(level, reference)).select("sample_id", F.col(column).cast("string").alias("_g"), F.col(unit).alias("_u"))
    per_unit = groups.groupBy("_u").agg(F.count("*").alias("k"), F.count_distinct("_g").alias("d"))
    if per_unit.filter("k > d").limit(1).count():
        raise Refusal(f"several rows per {unit} and level: aggregate them first")
    counts = per_unit.agg(F.count_if(F.col("d") == 2), F.count_if(F.col("d") == 1)).first()
    if counts[1]:
        warnings.warn(f"{counts[1]} units without a pair are left out", UnpairedUnitWarning, stacklevel=2)
    if 2 / 2 ** counts[0] > alpha:
        warnings.warn(f"{counts[0]} pairs cannot reach {alpha}", LowPowerRankTestWarning, stacklevel=2)
    v = ds.values.join(F.broadcast(groups), "sample_id")
    of = lambda g: F.max(F.when(F.col("_g") == g, F.col("value")))
    pairs = v.groupBy("feature_id", "_u").agg(of(level).alias("a"), of(reference).alias("b")).filter("a is not null and b is not null")

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        a, b = f["a"].to_numpy(float), f["b"].to_numpy(float)
        return pd.DataFrame([(key[0], *signed_rank(a - b, alpha), np.concatenate([a, b]).mean(), len(a))], columns=["feature", "statistic", "p", "effect", "ci_low", "ci_high", "mean_abundance", "n"])

    out = pairs.groupBy("feature_id").applyInPandas(one, RANKED.format(kind=dict(ds.values.dtypes)["feature_id"]))
    return _nulls(out).withColumn("term", F.lit(f"{column}[{level} vs {reference}]")).withColumn("is_contrast", F.lit(True))


def _nulls(df: DataFrame) -> DataFrame:
    for c in ("statistic", "p", "effect", "ci_low", "ci_high"):
        df = df.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return df


def differential_abundance(ds: Dataset, contrast: str, *, covariates: tuple[str, ...] = (), reference: str | None = None, method: str = "moderated", categorical: tuple[str, ...] = (), alpha: float = 0.05, unit: str | None = None, weights: str | None = None) -> Differential:
    """Table of all tested terms: effect, interval, statistic, p and q (Benjamini-Hochberg within a term)."""
    if method not in METHODS:
        raise Refusal(f"unknown method {method!r}")
    if ds.scale not in LOG_SCALES:
        warnings.warn(f"effects on the {ds.scale} scale are not fold changes", ScaleWarning, stacklevel=2)
    require_finite(ds, "differential_abundance")
    rows = [r.asDict() for r in ds.samples.orderBy("sample_ord").collect()]  # one row a sample: the design is small
    plan = unit_plan(rows, contrast, unit) if method in ("moderated", "ols") else "plain"
    if weights is None and "n_replicates" in ds.samples.columns and len({r["n_replicates"] for r in rows}) > 1:
        warnings.warn("replicate counts differ and no weights are given", UnweightedReplicatesWarning, stacklevel=2)
    if method in ("moderated", "ols"):
        terms = column_terms(rows, contrast, True, contrast in categorical, reference)
        for c in covariates:
            terms += column_terms(rows, c, False, c in categorical)
        if plan == "within":
            first, *others = sorted({str(r[unit]) for r in rows})
            for t in terms:
                per: dict = {}
                for r, v in zip(rows, t.values):
                    per.setdefault(r[unit], set()).add(v)
                if all(len(v) == 1 for v in per.values()):
                    raise Refusal(f"{t.name} is constant within every {unit} and would be absorbed")
            terms += [Term(f"{unit}[{u}]", False, False, tuple(float(str(r[unit]) == u) for r in rows)) for u in others]
        w = None
        if weights is not None:
            w = np.array([r[weights] if r[weights] is not None else math.nan for r in rows], float)
            if not (np.isfinite(w).all() and (w > 0).all()):
                raise Refusal("weights must be finite and positive")
        table, s0, d0 = linear_model(ds, rows, terms, method, w, alpha)
        return Differential(table, method, contrast, tuple(t.name for t in terms if t.tested), plan, len(rows), s0, d0)
    if covariates:
        raise Refusal(f"{method} takes no covariates")
    levels = sorted({str(r[contrast]) for r in rows if r[contrast] is not None})
    if len(levels) < 2 or (contrast not in categorical and all(isinstance(r[contrast], (int, float)) and not isinstance(r[contrast], bool) for r in rows)):
        raise Refusal(f"{method} compares the levels of a category")
    ref = reference or levels[0]
    parts = []
    for level in (v for v in levels if v != ref):
        if method == "welch":
            parts.append(welch(ds, contrast, level, ref, alpha).drop("df"))
        elif method == "mannwhitney":
            parts.append(rank_test(ds, contrast, level, ref, alpha))
        else:
            if unit is None:
                raise Refusal("signedrank needs a unit to pair by")
            parts.append(paired_test(ds, contrast, level, ref, unit, alpha))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return Differential(_finish(table), method, contrast, tuple(f"{contrast}[{v} vs {ref}]" for v in levels if v != ref), plan, len(rows))


def volcano(table: DataFrame, fdr: float = 0.05, effect_threshold: float = 0.0) -> DataFrame:
    """Each feature with -log10 q and its bucket: up, down or ns; rows without a finite q or effect are left out."""
    hit = (F.col("q") <= fdr) & (F.abs("effect") >= effect_threshold)
    bucket = F.when(hit & (F.col("effect") > 0), "up").when(hit & (F.col("effect") < 0), "down").otherwise("ns")
    return table.filter("q is not null and effect is not null and abs(effect) < double('Infinity')").withColumn("neg_log10_q", safe_neg_log10(F.col("q"))).withColumn("bucket", bucket)


def p_histogram(table: DataFrame, bins: int = 20) -> DataFrame:
    """Density of p in equal bins on [0, 1]; p = 1 falls in the last."""
    if table.filter("p < 0 or p > 1").limit(1).count():
        raise Refusal("p-values outside [0, 1]")
    hist = table.filter("p is not null").groupBy(F.least(F.expr(f"width_bucket(p, 0, 1, {bins})"), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n").alias("total"))
    return hist.join(F.broadcast(total)).select(F.col("bin").cast("int").alias("bin"), "n", (F.col("n") * bins / F.col("total")).alias("density"))


def pi0(table: DataFrame, lam: float = 0.5) -> DataFrame:
    """Storey's share of true nulls at a fixed lambda."""
    return table.agg(F.least(F.lit(1.0), F.count_if(F.col("p") > lam) / (F.count("p") * (1 - lam))).alias("pi0"), F.count("p").alias("m"))
