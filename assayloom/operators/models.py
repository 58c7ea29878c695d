"""Cross-validated predictive models as a grid of independent tasks.

The matrix of samples is small next to the number of fits, so it travels once to every task; the grid of (analysis, repeat,
fold, permutation) is the distributed frame. One fold table serves all estimators, so their scores pair. Every
estimator reports nested out-of-fold scores, a fit on all data with a stability read, and an optional shuffle null.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import LOG_SCALES, Dataset, Refusal, require_finite
from ..functions.special import t_quantile, t_two_sided

C_GRID = tuple(10.0**k for k in (-3, -2, -1, 0, 1))
L1_GRID = (0.1, 0.5, 0.9)
SVM_GRID = tuple(10.0**k for k in range(-5, 3))
ALPHA_GRID = tuple(10.0**k for k in (-3, -2, -1, 0))


class FeatureListWarning(UserWarning):
    pass


class SingletonGroupsWarning(UserWarning):
    pass


class NullPermutationWarning(UserWarning):
    pass


class CGridEdgeWarning(UserWarning):
    pass


class ShrinkageSaturationWarning(UserWarning):
    pass


class ModelScaleWarning(UserWarning):
    pass


# -- labels -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Threshold:
    cut: float
    drop_below: float | None = None
    drop_at_or_above: float | None = None


@dataclass(frozen=True)
class LevelMap:
    positive: tuple[str, ...]
    negative: tuple[str, ...]


def labelled(samples: DataFrame, outcome: str, binarize: Threshold | LevelMap | None = None, positive: str | None = None) -> DataFrame:
    """samples with `y` (1 positive, 0 negative); samples without a label, or in a dropped band, are left out."""
    c = F.col(outcome)
    if isinstance(binarize, Threshold):
        out = samples.filter(c.isNotNull()).withColumn("y", (c >= binarize.cut).cast("int"))
        if binarize.drop_below is not None and binarize.drop_at_or_above is not None:
            out = out.filter(~((c >= binarize.drop_below) & (c < binarize.drop_at_or_above)))
        return out
    text = c.cast("string")
    if isinstance(binarize, LevelMap):
        if set(binarize.positive) & set(binarize.negative):
            raise Refusal("a level is both positive and negative")
        known = {r[0] for r in samples.select(text).distinct().collect()}
        if unknown := sorted((set(binarize.positive) | set(binarize.negative)) - known):
            raise Refusal(f"{outcome} has no level {', '.join(unknown)}")
        return samples.filter(text.isin(*binarize.positive, *binarize.negative)).withColumn("y", text.isin(*binarize.positive).cast("int"))
    levels = sorted(r[0] for r in samples.filter(c.isNotNull()).select(text).distinct().collect())
    if len(levels) != 2:
        raise Refusal(f"{outcome} has {len(levels)} levels; two are needed, or a rule to make two")
    top = positive if positive is not None else levels[1]
    if top not in levels:
        raise Refusal(f"{outcome} has no level {top}")
    return samples.filter(c.isNotNull()).withColumn("y", (text == top).cast("int"))


def prior_features(ds: Dataset, names: list[str] | None) -> Dataset:
    if names is None:
        return ds
    wanted = list(dict.fromkeys(names))
    if not wanted:
        raise Refusal("the feature list is empty")
    kept = ds.features.filter(F.col("feature_id").cast("string").isin([str(n) for n in wanted]))
    n = kept.count()
    if not n:
        raise Refusal("no feature of the list is in the data")
    if n < len(wanted) / 2:
        warnings.warn(f"only {n} of {len(wanted)} listed features are in the data", FeatureListWarning, stacklevel=3)
    return ds.keep_features(kept)


def varying(ds: Dataset) -> Dataset:
    """Without constant features: least below greatest, which rounding cannot blur."""
    return ds.keep_features(ds.values.groupBy("feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi"))


# -- folds ------------------------------------------------------------------------------------------------------


def folds(y: np.ndarray, groups: np.ndarray | None, n_splits: int, n_repeats: int, seed: int, stratify: bool = True) -> np.ndarray:
    """Fold of each sample in each repeat (repeats x samples): stratified by label, whole groups together.

    Units (samples or groups) are shuffled, then each goes to the fold with the fewest of its label so far.
    """
    out = np.zeros((n_repeats, len(y)), int)
    kinds = np.unique(y) if stratify else np.array([0])
    if groups is None:
        kind = np.searchsorted(kinds, y).tolist() if stratify else [0] * len(y)
        for r in range(n_repeats):
            out[r] = _dealt(np.random.default_rng(seed + r).permutation(len(y)).tolist(), kind, len(kinds), n_splits)
        return out
    unit = np.unique(groups, return_inverse=True)[1]
    members = [np.nonzero(unit == u)[0] for u in range(unit.max() + 1)]
    for r in range(n_repeats):
        rng = np.random.default_rng(seed + r)
        held = np.zeros((n_splits, len(kinds)))
        order = rng.permutation(len(members))
        for u in sorted(order, key=lambda u: -len(members[u])):
            mine = np.array([(y[members[u]] == k).sum() for k in kinds]) if stratify else np.array([len(members[u])])
            # the fold that ends most even, fewest rows among equals
            cost = [(((held + 0)[f] + mine) ** 2 - held[f] ** 2).sum() + 1e-6 * held[f].sum() for f in range(n_splits)]
            f = int(np.argmin(cost))
            held[f] += mine
            out[r, members[u]] = f
    return out


def _dealt(order: list[int], kind: list[int], n_kinds: int, n_splits: int) -> np.ndarray:
    """The fold of each sample where every sample is a unit: the same costs as for groups, in plain numbers."""
    held, total, out = [[0] * n_splits for _ in range(n_kinds)], [0] * n_splits, np.zeros(len(order), int)
    for u in order:
        mine = held[kind[u]]
        costs = [2 * h + 1 + 1e-6 * t for h, t in zip(mine, total)]
        f = costs.index(min(costs))
        mine[f] += 1
        total[f] += 1
        out[u] = f
    return out


def check_sizes(y: np.ndarray, groups: np.ndarray | None, n_splits: int) -> None:
    for k in np.unique(y):
        n = (y == k).sum() if groups is None else len(np.unique(groups[y == k]))
        if n - math.ceil(n / n_splits) < n_splits:
            raise Refusal(f"class {k} has {n} units: too few for {n_splits} nested folds")


# -- estimators -------------------------------------------------------------------------------------------------


def scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by the mean and population SD of the first; features constant there become zero."""
    m, s = train.mean(0), train.std(0)
    s = np.where(s > 0, s, np.inf)
    return (train - m) / s, (test - m) / s


def balanced(y: np.ndarray) -> np.ndarray:
    n1 = y.sum()
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))


def logistic(x: np.ndarray, y: np.ndarray, c: float, l1: float, steps: int = 300, tol: float = 1e-5) -> tuple[np.ndarray, float]:
    """Elastic-net logistic regression with balanced weights, by accelerated proximal gradient."""
    w = balanced(y) * c
    n, p = x.shape
    bound = 0.25 * np.linalg.norm(np.sqrt(w)[:, None] * x, 2) ** 2 + 0.25 * w.sum() + (1 - l1)
    beta, b, z, zb, t = np.zeros(p), 0.0, np.zeros(p), 0.0, 1.0
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-np.clip(x @ z + zb, -500, 500))) - y)
        v = z - (x.T @ g + (1 - l1) * z) / bound
        new = np.sign(v) * np.maximum(np.abs(v) - l1 / bound, 0)
        nb = zb - g.sum() / bound
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - beta), nb + (t - 1) / t2 * (nb - b)
        moved = np.abs(new - beta).max(initial=abs(nb - b))
        beta, b, t = new, nb, t2
        if moved < tol:
            break
    return beta, b


def svm(x: np.ndarray, y: np.ndarray, c: float, sweeps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, balanced weights) by dual coordinate ascent; the intercept is a constant feature."""
    s = np.where(y == 1, 1.0, -1.0)
    a = np.column_stack([x, np.ones(len(x))])
    d = 1 / (2 * c * balanced(y))
    q = (a * a).sum(1) + d
    alpha, w, rng = np.zeros(len(y)), np.zeros(a.shape[1]), np.random.default_rng(0)
    for _ in range(sweeps):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = s[i] * (a[i] @ w) - 1 + d[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            worst = max(worst, abs(new - alpha[i]))
            w += (new - alpha[i]) * s[i] * a[i]
            alpha[i] = new
        if worst < 1e-7:
            break
    return w[:-1], float(w[-1])


def ledoit_wolf(gram: np.ndarray, p: int) -> float:
    """Ledoit and Wolf's (2004) shrinkage of n centred rows: the sampling error of their covariance S over its squared distance
    from the scaled identity. All norms come from the Gram matrix, whose squares sum to n^2 |S|^2."""
    return _shrinkage((gram * gram).sum(), np.diag(gram), p)


def _shrinkage(squares: float, sizes: np.ndarray, p: int) -> float:
    """The same from the sum of squares of the Gram matrix, of rows or of columns, and each row's squared length."""
    n = len(sizes)
    norm, eigenvalue = squares / n**2, sizes.sum() / (n * p)
    distance = norm - p * eigenvalue**2
    error = (np.square(sizes).mean() - norm) / n
    return float(min(error, distance) / distance) if min(error, distance) > 0 else 0.0


def lda(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Shrinkage discriminant: weights, intercept (log priors included), shrinkage. Its matrices have the lesser of n and p rows.

    The pooled covariance is a I + U'U with U stacking the scaled, centred rows of both classes, so its inverse on the
    difference of means is an n x n solve, or with fewer features than rows a p x p one.
    """
    p, a, parts, means, priors, lam = x.shape[1], 0.0, [], [], [], 0.0
    scale = x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = x / scale
    for k in (0, 1):
        rows = z[y == k]
        centre, prior = rows.mean(0), len(rows) / len(z)
        c = rows - centre
        sizes = np.einsum("ij,ij->i", c, c)
        gram = c @ c.T if len(c) <= p else c.T @ c
        shrink = _shrinkage((gram * gram).sum(), sizes, p)
        a += prior * shrink * sizes.sum() / (len(rows) * p)
        parts.append(math.sqrt(prior * (1 - shrink) / len(rows)) * c)
        means.append(centre)
        priors.append(prior)
        lam = max(lam, shrink)
    a = max(a, 1e-12)
    u, d = np.vstack(parts), means[1] - means[0]
    if len(u) <= p:
        beta = d / a - u.T @ np.linalg.solve(np.eye(len(u)) + u @ u.T / a, u @ d) / a**2
    else:
        beta = np.linalg.solve(a * np.eye(p) + u.T @ u, d)
    return beta / scale, float(-0.5 * (means[0] + means[1]) @ beta + math.log(priors[1] / priors[0])), lam


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, sweeps: int = 500) -> tuple[np.ndarray, float]:
    """Elastic-net least squares by coordinate descent on 1/(2n) |y - Xb|^2 + alpha (l1 |b| + (1-l1)/2 |b|^2)."""
    n, p = x.shape
    xm, ym = x.mean(0), y.mean()
    a, r = x - xm, y - ym
    sq, b = (a * a).sum(0) / n, np.zeros(p)
    for _ in range(sweeps):
        worst = 0.0
        for j in np.nonzero(sq > 0)[0]:
            rho = a[:, j] @ r / n + sq[j] * b[j]
            new = math.copysign(max(abs(rho) - alpha * l1, 0), rho) / (sq[j] + alpha * (1 - l1))
            if new != b[j]:
                r = r - (new - b[j]) * a[:, j]
                worst = max(worst, abs(new - b[j]))
                b[j] = new
        if worst < 1e-7:
            break
    return b, float(ym - xm @ b)


def boosted_trees(x: np.ndarray, y: np.ndarray, depth: int, rate: float, trees: int, l2: float = 1.0, bins: int = 32) -> tuple[list, np.ndarray, list]:
    """Histogram gradient boosting of the logistic loss: trees, total gain per feature (shares), bin edges."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)])
    weight = np.where(y == 1, (len(y) - y.sum()) / max(1, y.sum()), 1.0)
    gains, score, out = np.zeros(x.shape[1]), np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, d: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = total_g / (total_h + l2) * rate
        if d == 0 or len(rows) < 2:
            return leaf
        flat = (code[rows] + np.arange(x.shape[1]) * bins).ravel()
        gs = np.bincount(flat, np.repeat(g[rows], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1)
        hs = np.bincount(flat, np.repeat(h[rows], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1)
        gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
        gain[(hs <= 1e-12) | (total_h - hs <= 1e-12)] = 0
        j, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, k] <= 1e-9:
            return leaf
        gains[j] += gain[j, k]
        low = code[rows, j] <= k
        return (j, k, grow(rows[low], g, h, d - 1), grow(rows[~low], g, h, d - 1))

    for _ in range(trees):
        pr = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(y)), weight * (y - pr), weight * pr * (1 - pr), depth))
        score += tree_scores(out[-1], code)
    return out, gains / gains.sum() if gains.sum() > 0 else gains, edges


def tree_scores(tree, code: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(code), tree)
    j, k, low, high = tree
    return np.where(code[:, j] <= k, tree_scores(low, code), tree_scores(high, code))


@dataclass(frozen=True)
class Estimator:
    """fit(x, y, cell) gives a function of x and the coefficients (or importances); a cell takes a value of each axis."""

    name: str
    axes: tuple[tuple[float, ...], ...]
    fit: Callable[[np.ndarray, np.ndarray, tuple[float, ...]], tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]]
    regression: bool = False
    dense: bool = False
    any_scale: bool = False

    @property
    def cells(self) -> tuple[tuple[float, ...], ...]:
        return tuple(itertools.product(*self.axes))


def _linear(solver: Callable, scale: bool = True) -> Callable:
    def fit(x: np.ndarray, y: np.ndarray, cell: tuple[float, ...]):
        z, _ = scaled(x, x) if scale else (x, x)
        beta, b = solver(z, y, *cell)[:2]
        return (lambda new: (scaled(x, new)[1] if scale else new) @ beta + b), beta

    return fit


def _trees(x: np.ndarray, y: np.ndarray, cell: tuple[float, ...]):
    trees, shares, edges = boosted_trees(x, y, int(cell[0]), cell[1], int(cell[2]))

    def score(new: np.ndarray) -> np.ndarray:
        code = np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(edges, new.T)])
        return sum(tree_scores(t, code) for t in trees)

    return score, shares


DEPTHS, RATES, TREES = (2.0, 3.0, 4.0, 5.0), (0.03, 0.1, 0.3), (300.0,)
ESTIMATORS = {
    "elastic_net": Estimator("elastic_net", (C_GRID, L1_GRID), _linear(logistic)),
    "svm": Estimator("svm", (SVM_GRID,), _linear(svm), dense=True),
    "lda": Estimator("lda", (), _linear(lda, scale=False), dense=True),
    "trees": Estimator("trees", (DEPTHS, RATES, TREES), _trees, any_scale=True),
    "regression": Estimator("regression", (ALPHA_GRID, L1_GRID), _linear(elastic_net), regression=True),
}


def rank_auc(y: np.ndarray, score: np.ndarray) -> float:
    n1 = int(y.sum())
    if n1 in (0, len(y)):
        return math.nan
    order = np.argsort(score, kind="stable")
    s = score[order]
    start = np.append(True, s[1:] != s[:-1])
    at = np.nonzero(start)[0]
    mean = (at + np.append(at[1:], len(s)) + 1) / 2
    rank = mean[np.cumsum(start) - 1]
    return (rank[y[order] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Precision at each score, weighed by the recall it adds; equal scores are one step."""
    order = np.argsort(-score, kind="stable")
    hits, last = np.cumsum(y[order] == 1), np.append(np.diff(score[order]) != 0, True)
    if not len(y) or not hits[-1]:
        return math.nan
    found, seen = hits[last], np.nonzero(last)[0] + 1
    return float((np.diff(found, prepend=0) * found / seen).sum() / hits[-1])


def balanced_accuracy(y: np.ndarray, score: np.ndarray) -> float:
    up = score > 0
    return ((up[y == 1]).mean() + (~up[y == 0]).mean()) / 2


def explained(y: np.ndarray, score: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum()
    return 1 - ((y - score) ** 2).sum() / spread if spread > 0 else math.nan


# What a cell may be chosen by, and whether the target is a number.
METRICS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], float], bool]] = {
    "auc": (rank_auc, False),
    "average_precision": (average_precision, False),
    "balanced_accuracy": (balanced_accuracy, False),
    "r2": (explained, True),
    "neg_rmse": (lambda y, score: -float(np.sqrt(np.square(y - score).mean())), True),
}


def quality(est: Estimator, y: np.ndarray, score: np.ndarray) -> float:
    return explained(y, score) if est.regression else rank_auc(y, score)


def chosen(est: Estimator, scores: np.ndarray, select: str = "best") -> int:
    """The cell of the best score, or of the best mean of itself and its neighbours along each axis; the first of equals in the
    order of the grid. Cells without a score are never chosen, nor count as neighbours."""
    if np.isnan(scores).all():
        raise Refusal("no cell of the grid has a score")
    if select == "smoothed" and est.axes:
        field_ = scores.reshape([len(a) for a in est.axes])
        padded = np.pad(field_, 1, constant_values=np.nan)
        inner = tuple(slice(1, -1) for _ in est.axes)
        near = [padded[inner]] + [np.roll(padded, d, k)[inner] for k in range(field_.ndim) for d in (1, -1)]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # a cell without any scored neighbour stays without a score
            scores = np.where(np.isnan(scores), np.nan, np.nanmean(near, axis=0).ravel())
    elif select not in ("best", "smoothed"):
        raise Refusal(f"unknown choice {select!r}")
    return int(np.argmax(np.where(np.isnan(scores), -np.inf, scores) >= np.nanmax(scores) - 1e-9))


# -- the grid ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    """predictions(repeat, fold, sample_ord, y, score), performance by fold and its summary, coefficients(feature, ...),
    grid(cell, score: the inner mean on all data) and null(perm, score)."""

    estimator: str
    outcome: str
    predictions: DataFrame
    performance: DataFrame
    coefficients: DataFrame
    null: DataFrame | None
    p_value: float | None
    cell: tuple[float, ...]
    seed: int
    n: int
    summary: dict = field(default_factory=dict)
    grid: DataFrame | None = None
    positive: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def validated(self) -> bool:
        return self.null is not None


def matrix(ds: Dataset, ids: list, names: list) -> np.ndarray:
    """Samples x features as one array: of one study, so bounded; cells come as numbers, not as row objects."""
    spark = ds.values.sparkSession
    rows = spark.createDataFrame(list(zip(ids, range(len(ids)))), ds.samples.select("sample_id").withColumn("i", F.lit(0)).schema)
    cols = spark.createDataFrame(list(zip(names, range(len(names)))), ds.features.select("feature_id").withColumn("j", F.lit(0)).schema)
    cells = ds.values.join(F.broadcast(rows), "sample_id").join(F.broadcast(cols), "feature_id").select("i", "j", F.col("value").cast("double").alias("v")).toArrow()
    x = np.zeros((len(ids), len(names)))
    x[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return x


def run(
    ds: Dataset, outcome: str, estimator: str = "elastic_net", *, binarize: Threshold | LevelMap | None = None, positive: str | None = None, groups: str | None = None,
    feature_list: list[str] | None = None, n_splits: int = 5, n_repeats: int = 2, stability_repeats: int = 2, n_permutations: int = 0, null_repeats: int = 3, permute: str = "rows", top_k: int = 20, seed: int = 0,
    axes: tuple[tuple[float, ...], ...] | None = None, select: str = "best", tuning_metric: str | None = None,
) -> Fitted:
    """Nested performance, fit on all data with stability, and a shuffle null of n_permutations (0: none).

    Every cell of the grid on every inner fold is a task of its own; then every outer, stability and null fit is one.
    """
    est = ESTIMATORS[estimator] if axes is None else replace(ESTIMATORS[estimator], axes=axes)
    metric, numeric = METRICS[tuning_metric or ("r2" if est.regression else "auc")]
    if numeric != est.regression:
        raise Refusal(f"{tuning_metric} does not suit {estimator}")
    require_finite(ds, "models")
    if ds.scale not in LOG_SCALES and not est.any_scale:
        warnings.warn(f"the {ds.scale} scale suits {estimator} badly", ModelScaleWarning, stacklevel=2)
    number = F.col(outcome).try_cast("double")
    samples = ds.samples.withColumn("y", number).filter(F.abs(number) < float("inf")) if est.regression else labelled(ds.samples, outcome, binarize, positive)
    ds = varying(prior_features(ds, feature_list))
    meta = samples.orderBy("sample_ord").select("sample_id", "sample_ord", "y", F.col(outcome).cast("string").alias("level"), *([F.col(groups).cast("string").alias("g")] if groups else [])).collect()
    names = [r[0] for r in ds.features.orderBy("feature_ord").select("feature_id").collect()]
    y = np.array([r["y"] for r in meta], float if est.regression else int)
    x = matrix(ds, [r["sample_id"] for r in meta], names)
    g = None
    if groups:
        g = np.array([r["g"] for r in meta], object)
        if any(v is None for v in g):
            raise Refusal(f"{groups} has missing values")
        if len(np.unique(g.astype(str))) == len(g):
            warnings.warn(f"every {groups} has one row: rows are split", SingletonGroupsWarning, stacklevel=2)
            g = None
        else:
            g = g.astype(str)
    if not est.regression:
        check_sizes(y, g, n_splits)
    outer = folds(y, g, n_splits, n_repeats, seed, not est.regression)
    spark = ds.values.sparkSession
    rng = np.random.default_rng(seed + 1)
    shuffles = [permuted(y, g, permute, rng) for _ in range(n_permutations)]
    stable = folds(y, g, n_splits, max(1, stability_repeats), seed + 1000, not est.regression)
    shared = spark.sparkContext.broadcast((x, y, g, outer, stable, np.array(shuffles)))

    def part(r: int, f: int) -> tuple[np.ndarray, int]:
        """Training rows of an outer fold (all of them for repeat -1) and the seed of its inner folds."""
        return (outer[r] != f, seed + r) if r >= 0 else (np.ones(len(y), bool), seed)

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, g, *_ = shared.value
        for batch in batches:
            out = []
            for r, f, i, h in batch.itertuples(index=False):
                a, start = part(r, f)
                t, fold = y[a], folds(y[a], None if g is None else g[a], n_splits, 1, start, not est.regression)[0]
                if not est.regression and len(np.unique(t[fold == h])) < 2:
                    raise Refusal("an inner test fold has a single class")
                z = x[a]
                out.append((r, f, i, float(metric(t[fold == h], est.fit(z[fold != h], t[fold != h], est.cells[i])[0](z[fold == h])))))
            yield pd.DataFrame(out, columns=["repeat", "fold", "cell", "score"])

    outers = [(-1, 0)] + [(r, f) for r in range(n_repeats) for f in range(n_splits)]
    best, scores = dict.fromkeys(outers, 0), {}
    if len(est.cells) > 1:
        tasks = [(r, f, i, h) for r, f in outers for i in range(len(est.cells)) for h in range(n_splits)]
        done = _spread(spark, tasks, "repeat int, fold int, cell int, inner int").mapInPandas(inner, "repeat int, fold int, cell int, score double")
        for r in done.groupBy("repeat", "fold", "cell").agg(F.avg("score").alias("score")).collect():
            scores.setdefault((r["repeat"], r["fold"]), np.full(len(est.cells), np.nan))[r["cell"]] = r["score"]
        best = {k: chosen(est, v, select) for k, v in scores.items()}
    cell = est.cells[best[-1, 0]]

    def whole(x: np.ndarray, s: np.ndarray, g: np.ndarray | None) -> float:
        """Mean score of null_repeats rounds of folds drawn for these labels, at the chosen cell: what the null compares."""
        parts = []
        for fold in folds(s, g, n_splits, null_repeats, seed, not est.regression):
            parts += [quality(est, s[fold == h], est.fit(x[fold != h], s[fold != h], cell)[0](x[fold == h])) for h in range(n_splits)]
        return float(np.mean(parts))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, g, outer, stable, shuffles = shared.value
        for batch in batches:
            out = []
            for kind, r, f, k in batch.itertuples(index=False):
                if kind == "nested":
                    a = outer[r] != f
                    score = est.fit(x[a], y[a], est.cells[best[r, f]])[0](x[~a])
                    out += [(kind, r, f, int(i), float(y[i]), float(v)) for i, v in zip(np.nonzero(~a)[0], score)]
                elif kind == "stability":
                    a = stable[r] != f
                    out += [(kind, r, f, j, 0.0, float(v)) for j, v in enumerate(est.fit(x[a], y[a], cell)[1])]
                else:
                    out.append((kind, k, 0, 0, 0.0, whole(x, shuffles[k], g)))
            yield pd.DataFrame(out, columns=["kind", "repeat", "fold", "at", "y", "score"])

    tasks = [("nested", r, f, 0) for r, f in outers[1:]] + [("stability", r, f, 0) for r in range(stability_repeats) for f in range(n_splits)] + [("null", 0, 0, k) for k in range(n_permutations)]
    rows = _spread(spark, tasks, "kind string, repeat int, fold int, perm int").mapInPandas(work, "kind string, repeat int, fold int, at int, y double, score double").collect()
    predictions = spark.createDataFrame([(r["repeat"], r["fold"], meta[r["at"]]["sample_ord"], r["y"], r["score"]) for r in rows if r["kind"] == "nested"], "repeat int, fold int, sample_ord int, y double, score double")
    performance, summary = _performance(spark, est, [r for r in rows if r["kind"] == "nested"])
    coefficients = coefficient_table(spark, names, est, [r for r in rows if r["kind"] == "stability"], est.fit(x, y, cell)[1], top_k)
    nulls = [r["score"] for r in rows if r["kind"] == "null"]
    null = p = None
    if n_permutations:
        if any(v is None or not math.isfinite(v) for v in nulls):
            raise Refusal("a permuted fit has no score")
        observed = whole(x, y, g)
        null = spark.createDataFrame([(k, float(v)) for k, v in enumerate(nulls)], "perm int, score double")
        p = (sum(v >= observed for v in nulls) + 1) / (len(nulls) + 1)
    if estimator == "lda" and (lam := lda(x, y)[2]) >= 0.95:
        warnings.warn(f"shrinkage {lam:.2f}: little covariance is left", ShrinkageSaturationWarning, stacklevel=2)
    if estimator == "svm" and cell in (est.cells[0], est.cells[-1]):
        warnings.warn("the best C lies at an edge of the grid", CGridEdgeWarning, stacklevel=2)
    grid = spark.createDataFrame([([float(v) for v in c], float(v)) for c, v in zip(est.cells, scores.get((-1, 0), [math.nan]))], "cell array<double>, score double")
    up = None if est.regression else str(binarize) if binarize is not None else next((r["level"] for r in meta if r["y"] == 1), None)
    return Fitted(estimator, outcome, predictions, performance, coefficients, null, p, cell, seed, len(y), summary, grid, up)


def _spread(spark, tasks: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(tasks, schema).repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))


def _performance(spark, est: Estimator, rows: list) -> tuple[DataFrame, dict]:
    """Scores by fold; their mean and population SD; and the scores of each repeat's folds taken together, and of all."""
    per: dict = {}
    for r in rows:
        per.setdefault((r["repeat"], r["fold"]), []).append((r["y"], r["score"]))
    per = {k: tuple(np.array(c) for c in zip(*v)) for k, v in sorted(per.items())}
    if not est.regression and any(len(np.unique(t)) < 2 for t, _ in per.values()):
        raise Refusal("an outer test fold has a single class")
    second = (lambda t, s: float(np.sqrt(np.square(t - s).mean()))) if est.regression else balanced_accuracy
    third = (lambda t, s: None) if est.regression else average_precision
    metric = [(r, f, float(quality(est, t, s)), float(second(t, s)), third(t, s)) for (r, f), (t, s) in per.items()]
    pooled = lambda keys: float(quality(est, *(np.concatenate([per[k][i] for k in keys]) for i in (0, 1))))
    summary = {name: (float(np.mean(v)), float(np.std(v))) for name, v in zip(("score", "second", "average_precision"), zip(*[m[2:] for m in metric])) if v[0] is not None}
    summary["by_repeat"] = [pooled([k for k in per if k[0] == r]) for r in sorted({k[0] for k in per})]
    summary["pooled"] = pooled(list(per))
    return spark.createDataFrame(metric, "repeat int, fold int, score double, second double, average_precision double"), summary


def averaged(predictions: DataFrame) -> DataFrame:
    """Held-out scores averaged over repeats: one row per sample."""
    return predictions.groupBy("sample_ord").agg(F.first("y").alias("y"), F.avg("score").alias("score"), F.count("*").alias("folds"))


def permuted(y: np.ndarray, groups: np.ndarray | None, how: str, rng: np.random.Generator) -> np.ndarray:
    """Labels shuffled over rows, over whole units (which must be of one label; of numbers, their means), or within each unit."""
    if how == "rows" or groups is None:
        return rng.permutation(y)
    codes = np.unique(groups, return_inverse=True)[1]
    if how == "units" and y.dtype == float:
        return rng.permutation(np.bincount(codes, weights=y) / np.bincount(codes))[codes]
    if how == "units":
        first = np.array([y[codes == u][0] for u in range(codes.max() + 1)])
        if any((y[codes == u] != first[u]).any() for u in range(len(first))):
            raise Refusal("a unit carries several labels: its label cannot be shuffled as one")
        return rng.permutation(first)[codes]
    if how == "within_units":
        arrangements = math.prod(math.comb(int((codes == u).sum()), int(y[codes == u].sum())) for u in range(codes.max() + 1))
        if arrangements == 1:
            raise Refusal("labels cannot be rearranged within units")
        out = y.copy()
        for u in range(codes.max() + 1):
            out[codes == u] = rng.permutation(y[codes == u])
        return out
    raise Refusal(f"unknown permutation {how!r}")


def coefficient_table(spark, names: list, est: Estimator, rows: list, all_data: np.ndarray, top_k: int) -> DataFrame:
    """Per feature over resamples: selection (or top-k) frequency, sign consistency, median and quartiles; and the fit on all data."""
    runs: dict = {}
    for r in rows:
        runs.setdefault((r["repeat"], r["fold"]), {})[r["at"]] = r["score"]
    m = np.array([[v[j] for j in range(len(names))] for v in runs.values()]) if runs else all_data[None]
    live = np.abs(m) > (1e-12 if est.name == "trees" else 1e-10)
    if est.dense and len(names) > top_k:
        kth = np.sort(np.abs(m), axis=1)[:, -top_k][:, None]
        frequency = (np.abs(m) >= kth).mean(0)
    else:
        frequency = live.mean(0)
    sign = np.abs(np.sign(m).sum(0)) / (len(m) if est.dense else np.maximum(1, live.sum(0)))
    out = []
    for j, f in enumerate(names):
        v = m[live[:, j], j]
        q = np.quantile(v, [0.25, 0.5, 0.75]) if len(v) else [None] * 3
        out.append((str(f), float(all_data[j]), float(frequency[j]), float(sign[j]) if live[:, j].any() else None, *[None if z is None else float(z) for z in q]))
    return spark.createDataFrame(out, "feature string, coefficient double, frequency double, sign_consistency double, q25 double, median double, q75 double")


# -- Boruta -----------------------------------------------------------------------------------------------------


def forest_importance(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Impurity importance of a bagged forest of histogram trees on random feature subsets (squared loss of the target)."""
    total = np.zeros(x.shape[1])
    k = max(1, int(math.sqrt(x.shape[1])))
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        stack = [(rows, depth)]
        while stack:
            r, d = stack.pop()
            if d == 0 or len(r) < 4 or y[r].std() == 0:
                continue
            cols = rng.choice(x.shape[1], k, replace=False)
            order = np.argsort(x[r][:, cols], axis=0)
            s = np.cumsum(y[r][order], axis=0)[:-1]
            n = np.arange(1, len(r))[:, None]
            gain = s**2 / n + (y[r].sum() - s) ** 2 / (len(r) - n) - y[r].sum() ** 2 / len(r)
            xs = np.take_along_axis(x[r][:, cols], order, axis=0)
            gain[xs[1:] == xs[:-1]] = -1
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] <= 0:
                continue
            total[cols[j]] += gain[i, j]
            low = x[r, cols[j]] <= xs[i, j]
            stack += [(r[low], d - 1), (r[~low], d - 1)]
    return total


class FewLevelsWarning(UserWarning):
    pass


@dataclass(frozen=True)
class Selection:
    """table(feature, hits, importance, decision, ranking), history(iteration, bar, live: features still in the forest), task."""

    table: DataFrame
    history: DataFrame
    task: str


def boruta(ds: Dataset, target: str, **options) -> DataFrame:
    """The table of `select_features`."""
    return select_features(ds, target, **options).table


def select_features(
    ds: Dataset, target: str, *, task: str = "auto", iterations: int = 30, trees: int = 60, depth: int = 5, alpha: float = 0.05, perc: float = 100.0, two_step: bool = True, every: int = 10, seed: int = 0,
) -> Selection:
    """Real features against shuffled shadows (Kursa and Rudnicki 2010).

    An iteration is a task; after every `every` of them hits are tested as a binomial: with two_step, by false discovery rate
    over the features and then by Bonferroni over the tests so far, else by Bonferroni over the features. Rejected features
    leave the forest, confirmed ones stay in it but are tested no more. Confirmed features rank 1, tentative ones 2, rejected
    ones from 3 on, the later retired and more important first.
    """
    require_finite(ds, "boruta")
    ds = varying(ds)
    meta = ds.samples.filter(F.col(target).isNotNull()).orderBy("sample_ord").select("sample_id", target).collect()
    values = [r[target] for r in meta]
    number = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    if task == "auto":
        task = "regression" if number else "classification"
        if number and 2 <= len(set(values)) <= 5:
            warnings.warn(f"{target} is a number with few values: it is regressed on; name the task if classes are meant", FewLevelsWarning, stacklevel=3)
    levels = sorted({str(v) for v in values})
    if task == "classification":
        if len(levels) < 2 or min(sum(str(v) == k for v in values) for k in levels) < 2:
            raise Refusal(f"{target} needs two classes of two samples or more")
        y = np.array([levels.index(str(v)) for v in values], float)
    elif task == "regression" and number:
        y = np.array(values, float)
    else:
        raise Refusal(f"{target} does not suit the task {task!r}")
    names = [r[0] for r in ds.features.orderBy("feature_ord").select("feature_id").collect()]
    spark = ds.values.sparkSession
    shared = spark.sparkContext.broadcast((matrix(ds, [r["sample_id"] for r in meta], names), y))
    p = len(names)
    live, hits, total, state, retired, history = np.ones(p, bool), np.zeros(p, int), np.zeros(p), np.zeros(p, int), np.zeros(p, int), []
    done = tests = 0
    while done < iterations and (state == 0).any():
        step, columns = min(every, iterations - done), np.nonzero(live)[0]

        def work(batches: Iterator[pd.DataFrame], columns: np.ndarray = columns) -> Iterator[pd.DataFrame]:
            x, y = shared.value
            x = x[:, columns]
            for batch in batches:
                for k in batch["id"]:
                    rng = np.random.default_rng(seed * 1000 + int(k))
                    shadow = np.column_stack([rng.permutation(c) for c in x.T])
                    imp = forest_importance(np.hstack([x, shadow]), y, trees, depth, rng)
                    bar = np.percentile(imp[len(columns) :], perc)
                    yield pd.DataFrame({"k": int(k), "j": columns, "hit": (imp[: len(columns)] > bar).astype(int), "importance": imp[: len(columns)], "bar": bar})

        rows = spark.range(done, done + step, 1, min(step, spark.sparkContext.defaultParallelism)).mapInPandas(work, "k long, j int, hit int, importance double, bar double")
        for r in _hits(rows, history, len(columns)):
            hits[r["j"]] += r["hits"]
            total[r["j"]] += r["importance"]
        done, tests = done + step, tests + 1
        tail = np.array([math.fsum(math.comb(done, i) for i in range(h, done + 1)) / 2.0**done for h in range(done + 2)])
        open_ = np.nonzero(state == 0)[0]
        for sign, q in ((1, tail[hits[open_]]), (-1, 1 - tail[hits[open_] + 1])):
            passed = _fdr(q, alpha) & (q * tests <= alpha) if two_step else q * p <= alpha
            state[open_[passed & (state[open_] == 0)]] = sign
        retired[(state < 0) & live] = done
        live &= state >= 0
    mean = total / np.maximum(1, np.where(retired > 0, retired, done))
    ranking = np.where(state > 0, 1, 2)
    out = sorted(np.nonzero(state < 0)[0], key=lambda j: (-retired[j], -mean[j]))
    ranking[out] = 3 + np.arange(len(out))
    decision = {1: "Confirmed", 0: "Tentative", -1: "Rejected"}
    table = spark.createDataFrame([(str(f), int(hits[j]), float(mean[j]), decision[int(state[j])], int(ranking[j])) for j, f in enumerate(names)], "feature string, hits int, importance double, decision string, ranking int")
    return Selection(table, spark.createDataFrame(history, "iteration int, bar double, live int"), task)


def _hits(rows: DataFrame, history: list, live: int) -> list:
    """Hits and summed importance by feature, and each iteration's bar added to history."""
    cells = rows.toPandas()
    history += [(int(k), float(b), live) for k, b in sorted(cells.groupby("k")["bar"].first().items())]
    return [{"j": int(j), "hits": int(h), "importance": float(i)} for j, h, i in cells.groupby("j")[["hit", "importance"]].sum().itertuples()]


def _fdr(p: np.ndarray, alpha: float) -> np.ndarray:
    """Which p values Benjamini and Hochberg's rule passes."""
    order = np.argsort(p)
    good = np.nonzero(p[order] <= alpha * np.arange(1, len(p) + 1) / len(p))[0]
    out = np.zeros(len(p), bool)
    out[order[: good[-1] + 1 if len(good) else 0]] = True
    return out


# -- comparison -------------------------------------------------------------------------------------------------


def fold_scores(fit: Fitted) -> DataFrame:
    """AUC of each (repeat, fold), from the stored scores."""
    from ..functions.columns import auc

    return auc(fit.predictions.withColumn("up", F.col("y") == 1), "score", "up", ["repeat", "fold"])


def corrected_t(d: np.ndarray, n_train: np.ndarray, n_test: np.ndarray) -> tuple[float, float]:
    """Nadeau and Bengio's corrected resampled t and its two-sided p; without variance, 0 or infinite."""
    j, rho = len(d), float((n_test / n_train).mean())
    var = d.var(ddof=1) if j > 1 else 0.0
    if var == 0:
        return (0.0, 1.0) if d.mean() == 0 else (math.copysign(math.inf, d.mean()), 0.0)
    t = d.mean() / math.sqrt(var * (1 / j + rho))
    return float(t), float(t_two_sided(t, j - 1))


READINGS = ("sparse", "module", "covariance-adjusted", "non-linear")
LEAST_SIGNED = 5  # differences that a signed-rank test needs


def same_design(reference: Fitted, alternative: Fitted) -> None:
    """Refuses two results that do not pair, in this order: samples, seed, folds, who is held out, labels, outcome, positive level."""
    for what in ("n", "seed"):
        if getattr(reference, what) != getattr(alternative, what):
            raise Refusal(f"the two results differ in {what}")
    key = ["repeat", "fold", "sample_ord"]
    a, b = (r.predictions.select(*key, F.col("y").alias(name)) for r, name in ((reference, "ya"), (alternative, "yb")))
    count = lambda d: d.select("repeat", "fold").distinct().count()
    if count(a) != count(b):
        raise Refusal("the two results differ in their number of folds")
    unpaired = a.join(b, key, "full_outer").filter("ya is null or yb is null or ya <> yb").agg(F.count_if(F.expr("ya is null or yb is null")).alias("rows"), F.count("*").alias("all")).first()
    if unpaired["rows"]:
        raise Refusal("the held-out samples do not pair")
    if unpaired["all"]:
        raise Refusal("the held-out labels do not pair")
    for what in ("outcome", "positive"):
        if getattr(reference, what) != getattr(alternative, what):
            raise Refusal(f"the two results differ in {what}")


def signed_rank_p(d: np.ndarray) -> float | None:
    """Two-sided p of the signed ranks of the non-zero differences, or None for fewer than LEAST_SIGNED: exact where no ranks
    tie and there are 50 at most, else by the tie-corrected normal law. Folds overlap, so it only indicates."""
    d = d[d != 0]
    if len(d) < LEAST_SIGNED:
        return None
    size = np.abs(d)
    rank = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
    n, low = len(d), min(rank[d > 0].sum(), rank[d < 0].sum())
    if n <= 50 and len(np.unique(size)) == n:
        ways = np.ones(1)  # of each sum of ranks
        for k in range(1, n + 1):
            ways = np.pad(ways, (0, k)) + np.pad(ways, (k, 0))
        return min(1.0, float(2 * ways[: int(low) + 1].sum() / 2.0**n))
    ties = np.unique(size, return_counts=True)[1]
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return math.erfc(abs(low - n * (n + 1) / 4) / sd / math.sqrt(2))


def compare(reference: Fitted, alternative: Fitted, tie: float = 1e-9, reading: str | None = None) -> dict:
    """Paired comparison over equal folds: mean difference with its interval, corrected t (decisive), signed ranks
    (indicative), wins, losses and ties. reading: how features were to be read, stated beforehand; it is only recorded."""
    if reading is not None and reading not in READINGS:
        raise Refusal(f"unknown reading {reading!r}")
    if tie < 0:
        raise Refusal("the tolerance of a tie must not be negative")
    same_design(reference, alternative)
    pairs = fold_scores(reference).withColumnRenamed("auc", "x").join(fold_scores(alternative).withColumnRenamed("auc", "z"), ["repeat", "fold"])
    sizes = reference.predictions.groupBy("repeat", "fold").agg(F.count("*").alias("n"))
    rows = pairs.join(sizes, ["repeat", "fold"]).orderBy("repeat", "fold").collect()
    if len(rows) < 2:
        raise Refusal("a comparison needs two folds or more")
    d, n = np.array([r["z"] - r["x"] for r in rows]), np.array([r["n"] for r in rows], float)
    t, p = corrected_t(d, reference.n - n, n)
    width = t_quantile(0.975, len(d) - 1) * math.sqrt(d.var(ddof=1) * (1 / len(d) + float((n / (reference.n - n)).mean())))
    sides = {"reference": float(np.mean([r["x"] for r in rows])), "alternative": float(np.mean([r["z"] for r in rows]))}
    return sides | {"difference": float(d.mean()), "half_width": float(width), "t": t, "p": p, "signed_rank_p": signed_rank_p(d), "wins": int((d > tie).sum()), "losses": int((d < -tie).sum()), "ties": int((np.abs(d) <= tie).sum()), "reading": reading}


def compare_across_seeds(pairs: list[tuple[Fitted, Fitted]]) -> dict:
    """A verdict only if the sign agrees in every seed, of two or more."""
    if len({a.seed for a, _ in pairs}) < 2:
        raise Refusal("two seeds are needed")
    found = [compare(a, b) for a, b in pairs]
    signs = {np.sign(f["difference"]) for f in found}
    return {"agree": len(signs) == 1 and 0 not in signs, "differences": [f["difference"] for f in found]}


def roc_curve(predictions: DataFrame) -> DataFrame:
    """fpr and tpr after each score, from running sums in order of score."""
    from pyspark.sql import Window

    per = predictions.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    return per.select("score", (F.sum("n").over(w) / F.sum("n").over(whole)).alias("fpr"), (F.sum("p").over(w) / F.sum("p").over(whole)).alias("tpr"))


def roc_grid(predictions: DataFrame, points: int = 100) -> DataFrame:
    """Per (repeat, fold): the true-positive rate on `points` even false-positive rates, the greatest where a rate repeats,
    linear between. A fold's held-out samples are few, so each curve is made in one group."""

    def curve(part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(-part["score"].to_numpy(), kind="stable")
        y, s = part["y"].to_numpy()[order], part["score"].to_numpy()[order]
        last = np.append(np.diff(s) != 0, True)
        up, down = np.cumsum(y == 1)[last], np.cumsum(y != 1)[last]
        fpr, at = np.unique(np.append(0, down / max(1, down[-1])), return_index=True)
        tpr = np.maximum.accumulate(np.append(0, up / max(1, up[-1])))
        top = np.append(tpr[at[1:] - 1], tpr[-1])
        grid = np.linspace(0, 1, points)
        return pd.DataFrame({"repeat": part["repeat"].iloc[0], "fold": part["fold"].iloc[0], "fpr": grid, "tpr": np.interp(grid, fpr, top)})

    return predictions.groupBy("repeat", "fold").applyInPandas(curve, "repeat int, fold int, fpr double, tpr double")
