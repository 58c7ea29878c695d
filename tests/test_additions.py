"""What the second round added to models, comparisons, selection, quality control and findings."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_statistics import signal

from assayloom.dataset import Refusal
from assayloom.operators import enrichment, findings, models, pca_tests, qc, transform


def test_average_precision_by_hand():
    y, s = np.array([1, 0, 1, 1, 0]), np.array([0.9, 0.8, 0.7, 0.7, 0.1])
    assert math.isclose(models.average_precision(y, s), (1 / 3) * 1 + (2 / 3) * (3 / 4))
    assert math.isnan(models.average_precision(np.zeros(3), np.arange(3.0)))


def test_cells_are_chosen_by_best_or_smoothed_scores():
    est = models.Estimator("x", ((1.0, 2.0, 3.0), (1.0, 2.0, 3.0)), None)
    scores = np.array([0.9, 0.1, 0.1, 0.1, 0.6, 0.7, 0.1, 0.7, np.nan])
    assert models.chosen(est, scores) == 0
    assert models.chosen(est, scores, "smoothed") == 5  # (0.7 + 0.1 + 0.6) / 3: the cell without a score is no neighbour
    assert models.chosen(est, np.array([0.5, 0.5] + [0.1] * 7)) == 0
    with pytest.raises(Refusal):
        models.chosen(est, np.full(9, np.nan))


@pytest.mark.parametrize("d", [[0.1, 0.3, -0.2, 0.5, 0.7, -0.05], [0.2, 0.1, 0.4, 0.3, 0.6, 0.5, 0.9]])
def test_signed_ranks_equal_enumeration(d):
    d = np.array(d)
    rank = np.argsort(np.argsort(np.abs(d))) + 1
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    low = min(rank[d > 0].sum(), rank[d < 0].sum())
    assert math.isclose(models.signed_rank_p(d), min(1, 2 * np.mean([s <= low for s in sums])))
    assert models.signed_rank_p(np.array([0.1, 0, 0, 0.2, 0.3, 0.1])) is None


def test_runs_report_grid_pooled_scores_and_curves(spark):
    ds = signal(spark)
    fit = models.run(ds, "grp", "elastic_net", n_splits=3, n_repeats=2, stability_repeats=0, select="smoothed", tuning_metric="average_precision", axes=((0.01, 0.1, 1.0), (0.1, 0.9)))
    assert fit.grid.count() == 6 and len(fit.summary["by_repeat"]) == 2 and fit.summary["pooled"] > 0.8 and fit.summary["average_precision"][0] > 0.8
    assert fit.positive == "B" and fit.cell in [tuple(r["cell"]) for r in fit.grid.collect()]
    assert models.averaged(fit.predictions).filter("folds = 2").count() == fit.n
    curve = models.roc_grid(fit.predictions).collect()
    assert len(curve) == 6 * 100
    area = np.mean([np.trapezoid([r["tpr"] for r in c], [r["fpr"] for r in c]) for c in ([r for r in curve if (r["repeat"], r["fold"]) == k] for k in {(r["repeat"], r["fold"]) for r in curve})])
    assert abs(area - fit.summary["score"][0]) < 0.06
    other = models.run(ds, "grp", "lda", n_splits=3, n_repeats=2, stability_repeats=0)
    out = models.compare(fit, other, reading="covariance-adjusted")
    assert out["half_width"] >= 0 and math.isclose(out["alternative"] - out["reference"], out["difference"], abs_tol=1e-12)
    with pytest.raises(Refusal):
        models.compare(fit, other, reading="dense")
    with pytest.raises(Refusal):
        models.run(ds, "grp", "lda", tuning_metric="r2")


def test_targets_of_units_are_shuffled_by_their_means():
    y, g = np.array([1.0, 3.0, 5.0, 5.0, 8.0]), np.array(list("aabbc"))
    out = models.permuted(y, g, "units", np.random.default_rng(0))
    assert sorted({float(v) for v in out}) == [2.0, 5.0, 8.0] and out[0] == out[1] and out[2] == out[3]


def test_selection_keeps_history_and_ranks(spark):
    ds = signal(spark)
    got = models.select_features(ds, "grp", iterations=40, trees=40)
    rows = got.table.collect()
    bars = got.history.orderBy("iteration").collect()
    assert got.task == "classification" and [r["iteration"] for r in bars] == list(range(len(bars))) and bars[-1]["live"] < bars[0]["live"]
    assert {r["ranking"] for r in rows if r["decision"] == "Confirmed"} == {1} and sum(r["decision"] == "Confirmed" for r in rows) >= 4
    assert sorted(r["ranking"] for r in rows if r["decision"] == "Rejected") == list(range(3, 3 + sum(r["decision"] == "Rejected" for r in rows)))
    with pytest.raises(Refusal):
        models.select_features(ds, "grp", task="regression")


def test_two_groups_get_a_rank_test(spark):
    scores = spark.createDataFrame([(f"s{i}", 1, float(v)) for i, v in enumerate([1, 2, 3, 10, 11, 12])], "sample_id string, component int, score double")
    samples = spark.createDataFrame([(f"s{i}", i, "ab"[i > 2]) for i in range(6)], "sample_id string, sample_ord int, g string")
    r = pca_tests.group_tests(scores, samples, "g", n_permutations=19).first()
    assert r["u"] == 0 and math.isclose(r["p_mann_whitney"], 0.1)


def test_masked_samples_pass_uncorrected(spark):
    ds = signal(spark)
    ds = type(ds)(ds.values, ds.samples.withColumn("batch", F.col("sample_ord") % 2).withColumn("kept", F.col("sample_ord") < 40), ds.features, ds.scale)
    out = transform.combat_correct(ds, "batch", sample_mask="kept")
    diff = out.values.withColumnRenamed("value", "z").join(ds.values, ["sample_id", "feature_id"]).join(ds.samples, "sample_id").groupBy("kept").agg(F.max(F.abs(F.col("z") - F.col("value"))).alias("d")).collect()
    assert {r["kept"]: r["d"] > 0 for r in diff} == {True: True, False: False} and out.values.count() == ds.values.count()


def test_reference_median_of_no_samples(spark):
    ds = signal(spark)
    linear = type(ds)(ds.values.withColumn("value", F.abs("value")), ds.samples, ds.features, "linear")
    assert qc.reference_median(linear) == 60 and qc.reference_median(linear, "sample_ord < 0") is None


def test_figures_and_mentions_are_found_in_every_form(spark):
    body = """x ![a](figures/qc/r/a.png) ![b \\] c](<figures/qc/r/b c.png> "t") <IMG alt='q' src="figures/qc/c.png"> <img src='figures/metadata/r/s/d.png'>
see Finding #0042 and findings 0007, not 00071 nor refinding 0003"""
    doc = spark.createDataFrame([("findings/0001-x.md", f"---\nid: 0001\nstatus: candidate\n---\n{body}\n")], "path string, content string")
    p = findings.parsed(doc)
    r = p.select(F.transform("shown", findings.relative).alias("shown"), "mentions").first()
    assert r["shown"] == ["figures/qc/r/a.png", "figures/qc/r/b c.png", "figures/qc/c.png", "figures/metadata/r/s/d.png"] and r["mentions"] == ["0042", "0007"]
    bad = {v["detail"] for v in findings.violations(p, structured=True).filter("rule = 7").collect()}
    assert bad == {"figures/qc/c.png"}


def test_enrichment_in_one_call(spark):
    ids = [f"sp|P0000{i}|X" for i in range(10)]
    background = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, ord int")
    query = background.filter("ord < 4").union(spark.createDataFrame([("sp|P00001|Y", 9)], "id string, ord int"))
    terms = spark.createDataFrame([("S", "hit", f"P0000{i}") for i in range(4)] + [("S", "miss", f"P0000{i}") for i in range(4, 8)] + [("T", "other", "P00000")], "source string, term string, gene string")
    whole = background.union(spark.createDataFrame([("sp|P00001|Y", 9)], "id string, ord int"))
    got = enrichment.enrich(query, whole, terms=terms, sources=("S",))
    (row,) = got.table.collect()
    assert row["term"] == "hit" and math.isclose(row["p_raw"], 1 / math.comb(10, 4)) and row["intersecting_ids"] == ";".join(ids[:4])
    assert (got.recognized, got.asked) == (4, 4)
    said = {}

    def transport(url, payload, timeout):
        said.update(payload)
        return '{"result": [], "meta": {"version": "v1", "genes_metadata": {"failed": ["P00002"]}}}'

    far = enrichment.enrich(query, whole, transport=transport, organism="x")
    assert said["significance_threshold_method"] == "g_SCS" and far.version == "v1" and far.recognized == 3 and far.table.count() == 0
    for bad in ({}, {"terms": terms, "transport": transport}, {"terms": terms, "correction": "g_SCS"}):
        with pytest.raises(Refusal):
            enrichment.enrich(query, whole, **bad)
