"""Special functions, differential tests, component tests and models against known values and brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.dataset import Refusal
from assayloom.functions import special
from assayloom.functions.columns import benjamini_hochberg
from assayloom.operators import differential as de
from assayloom.operators import models, pca_tests
from tests_support import dataset


def test_special_functions():
    assert math.isclose(special.digamma(1), -0.5772156649015329, abs_tol=1e-12)
    assert math.isclose(special.trigamma(1), math.pi**2 / 6, abs_tol=1e-12)
    assert math.isclose(float(special.t_two_sided(2.228138852, 10)), 0.05, abs_tol=1e-9)
    assert math.isclose(float(special.t_two_sided(12.7062047362, 1)), 0.05, abs_tol=1e-9)
    assert math.isclose(float(special.t_two_sided(1.959963984540054, math.inf)), 0.05, abs_tol=1e-12)
    assert math.isclose(special.t_quantile(0.975, 10), 2.228138852, abs_tol=1e-8)
    assert math.isclose(special.chi2_sf(3.841458820694124, 1), 0.05, abs_tol=1e-10)
    assert math.isclose(special.hypergeometric_sf(2, 10, 4, 3), 1 / 3, abs_tol=1e-12)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.3, 30), st.floats(0.3, 30), st.floats(0, 1))
def test_incomplete_beta_is_symmetric(a, b, x):
    assert math.isclose(float(special.betainc(a, b, x)), 1 - float(special.betainc(b, a, 1 - x)), abs_tol=1e-9)


def test_bh(spark):
    got = lambda p: [r["q"] for r in benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double")).orderBy("i").collect()]
    assert np.allclose(got([0.01, 0.02, 0.03, 0.04]), 0.04)
    q = got([0.01, None, 0.5])
    assert q[1] is None and np.allclose([q[0], q[2]], [0.02, 0.5])


@pytest.mark.parametrize("n", [1, 4, 7])
def test_signed_rank_null(n):
    sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
    cdf = [sum(s <= w for s in sums) / 2**n for w in range(n * (n + 1) // 2 + 1)]
    assert np.allclose(de.signed_rank_cdf(n), cdf)


def test_mann_whitney_null():
    us = [sum(b for b in c) - 6 for c in itertools.combinations(range(1, 8), 3)]
    want = [us.count(u) / len(us) for u in range(13)]
    assert np.allclose(de.mann_whitney_counts(3, 4), want)
    u, p, shift, _, _ = de.mann_whitney(np.array([4.0, 5, 6]), np.array([1.0, 2, 3]))
    assert (u, shift) == (9, 3) and math.isclose(p, 0.1)


def test_least_squares_and_moderation(spark):
    rng = np.random.default_rng(0)
    g, age = ["a"] * 8 + ["b"] * 8, rng.normal(50, 9, 16)
    x = rng.normal(0, 1, (16, 60))
    x[8:, 0] += 3
    ds = dataset(spark, x, g=g, age=age.tolist())
    table = {r["feature"]: r for r in de.differential_abundance(ds, "g", covariates=("age",), method="ols").table.filter("is_contrast").collect()}
    m = np.column_stack([np.ones(16), np.array(g) == "b", age])
    beta, rss, *_ = np.linalg.lstsq(m, x, rcond=None)
    se = np.sqrt(rss / 13 * np.linalg.inv(m.T @ m)[1, 1])
    for j in range(60):
        r = table[f"F{j}"]
        assert math.isclose(r["effect"], beta[1, j], abs_tol=1e-9) and math.isclose(r["statistic"], beta[1, j] / se[j], rel_tol=1e-9)
        assert math.isclose(r["p"], float(special.t_two_sided(r["statistic"], 13)), rel_tol=1e-9)
    out = de.differential_abundance(ds, "g", method="moderated")
    assert out.prior_df > 0 and out.table.orderBy("p").first()["feature"] == "F0"
    w = de.differential_abundance(dataset(spark, x, g=g, w=[2.0] * 16), "g", method="ols", weights="w").table.filter("feature = 'F0'").first()
    plain = de.differential_abundance(ds, "g", method="ols").table.filter("feature = 'F0'").first()
    assert math.isclose(w["statistic"], plain["statistic"], rel_tol=1e-9)


def test_prior_is_recovered():
    rng = np.random.default_rng(1)
    d0, s0, df = 6.0, 0.5, 10
    s2 = s0 * d0 / rng.chisquare(d0, 40000) * rng.chisquare(df, 40000) / df
    v, d = de.fit_prior(np.log(s2).mean(), np.log(s2).var(ddof=1), df, 40000)
    assert abs(d - d0) < 0.6 and abs(v - s0) < 0.03


def test_two_group_methods(spark):
    ds = dataset(spark, [[1, 1], [3, 1], [4, 2], [8, 4]], g=["a", "a", "b", "b"], u=["p", "q", "p", "q"])
    with pytest.warns(de.LowPowerRankTestWarning):
        assert de.differential_abundance(ds, "g", method="signedrank", unit="u").table.filter("feature = 'F0'").first()["effect"] == 4
    assert de.differential_abundance(ds, "g", method="welch").table.filter("feature = 'F0'").first()["effect"] == 4
    assert de.differential_abundance(ds, "g", method="mannwhitney").table.filter("feature = 'F1'").first()["effect"] == 2
    with pytest.raises(Refusal):
        de.differential_abundance(ds, "g", method="welch", covariates=("u",))
    with pytest.raises(Refusal):
        de.differential_abundance(ds, "g", method="moderated")  # too few variances for a prior
    within = de.differential_abundance(ds, "g", method="ols", unit="u")
    assert within.unit_plan == "within" and math.isclose(within.table.filter("feature = 'F0'").first()["effect"], 4)
    with pytest.raises(Refusal, match="aggregate"):
        de.differential_abundance(dataset(spark, np.ones((4, 1)), g=["a", "a", "b", "b"], u=["p", "p", "q", "q"]), "g", method="ols", unit="u")


def test_component_tests(spark):
    rows = [{"sample_id": f"s{i}", "g": "ab"[i // 3], "u": f"u{i // 2}"} for i in range(6)]
    assert pca_tests.orderings(list("aabb")) == 6 and len(list(pca_tests.distinct_arrangements(list("aabb")))) == 6
    drawn, exact = pca_tests.arrangements(rows, "g", None)
    assert exact and len(drawn) == 20 and len(set(drawn)) == 20
    scores = spark.createDataFrame([(f"s{i}", 1, float(i)) for i in range(6)], "sample_id string, component int, score double")
    samples = spark.createDataFrame([(f"s{i}", i, "ab"[i // 3], float(i)) for i in range(6)], "sample_id string, sample_ord int, g string, x double")
    with pytest.warns(pca_tests.ResolutionWarning):
        out = pca_tests.group_tests(scores, samples, "g").first()
    assert math.isclose(out["h"], 27 / 7) and math.isclose(out["p_permutation"], 0.1)
    assert math.isclose(pca_tests.correlation_tests(scores, samples, "x").first()["r"], 1)
    band = pca_tests.bootstrap_band(samples.withColumnRenamed("g", "u"), scores, "x", "sample_id", draws=30).first()
    assert math.isclose(band["low"], 1) and math.isclose(band["high"], 1)


def signal(spark, n=48, p=60, seed=0, shift=2.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    grp = ["A", "B"] * (n // 2)
    x[1::2, :6] += shift
    return dataset(spark, x, grp=grp, dose=[float(v) for v in x[:, 0] * 2 + rng.normal(0, 0.1, n)], subject=[f"u{i // 2}" for i in range(n)])


@pytest.mark.parametrize("name", ["elastic_net", "svm", "lda", "trees"])
def test_classifiers_find_the_signal(spark, name):
    fit = models.run(signal(spark), "grp", name, n_splits=3, n_repeats=1, stability_repeats=1)
    assert np.mean([r["score"] for r in fit.performance.collect()]) > 0.85
    top = {r["feature"] for r in fit.coefficients.collect() if r["frequency"] >= 0.5}
    assert {f"F{j}" for j in range(6)} & top
    assert not fit.validated


def test_null_and_comparison(spark):
    ds = signal(spark)
    a = models.run(ds, "grp", "lda", n_splits=3, n_repeats=2, stability_repeats=0, n_permutations=19)
    b = models.run(ds, "grp", "trees", n_splits=3, n_repeats=2, stability_repeats=0)
    assert a.validated and a.p_value == 0.05
    out = models.compare(a, b)
    assert out["wins"] + out["losses"] + out["ties"] == 6
    noise = models.run(signal(spark, shift=0.0, seed=3), "grp", "lda", n_splits=3, n_repeats=1, stability_repeats=0, n_permutations=19)
    assert noise.p_value > 0.05
    with pytest.raises(Refusal):
        models.compare(a, noise if noise.seed != a.seed else models.run(ds, "grp", "lda", n_splits=3, n_repeats=2, stability_repeats=0, seed=5))
    assert models.corrected_t(np.zeros(5), np.ones(5) * 8, np.ones(5) * 2) == (0.0, 1.0)


def test_folds_keep_groups_and_classes():
    y, g = np.array([0, 1] * 20), np.repeat(np.arange(20), 2)
    f = models.folds(y, g, 4, 2, 0)
    assert all(len(np.unique(f[r][g == k])) == 1 for r in range(2) for k in range(20))
    f = models.folds(y, None, 5, 1, 0)[0]
    assert all((y[f == k] == 1).sum() == 4 for k in range(5))


def test_lda_equals_the_dense_solution():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 8)), np.array([0, 1] * 15)
    beta, b, _ = models.lda(x, y)
    s = x.std(0)
    z = x / s
    cov = np.zeros((8, 8))
    for k in (0, 1):
        c = z[y == k] - z[y == k].mean(0)
        lam = models.ledoit_wolf(c @ c.T, 8)
        emp = c.T @ c / len(c)
        cov += 0.5 * ((1 - lam) * emp + lam * np.trace(emp) / 8 * np.eye(8))
    d = z[y == 1].mean(0) - z[y == 0].mean(0)
    assert np.allclose(beta * s, np.linalg.solve(cov, d))


def test_regression_and_boruta(spark):
    ds = signal(spark)
    fit = models.run(ds, "dose", "regression", n_splits=3, n_repeats=1, stability_repeats=0)
    assert np.mean([r["score"] for r in fit.performance.collect()]) > 0.8
    out = {r["feature"]: r["decision"] for r in models.boruta(ds, "grp", iterations=40, trees=60).collect()}
    assert sum(out[f"F{j}"] == "Confirmed" for j in range(6)) >= 4 and sum(v == "Confirmed" for k, v in out.items() if int(k[1:]) >= 6) <= 2


def test_labels_are_checked(spark):
    s = signal(spark).samples
    assert models.labelled(s, "dose", models.Threshold(0.0, -1.0, 1.0)).filter("dose >= -1 and dose < 1").count() == 0
    with pytest.raises(Refusal):
        models.labelled(s, "grp", models.LevelMap(("A",), ("A",)))
    with pytest.raises(Refusal):
        models.labelled(s, "subject")
    with pytest.raises(Refusal):
        models.permuted(np.array([0, 1]), np.array(["a", "a"]), "units", np.random.default_rng(0))
