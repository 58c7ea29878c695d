"""What the findings of the second round asked for."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.dataset import Dataset
from assayloom.functions import gram
from assayloom.operators import findings, models, pca_tests, qc, transform
from assayloom.plans import catalog


def _peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _tall(n=6000, p=8):
    rng = np.random.default_rng(3)
    y = np.arange(n) % 2
    return rng.normal(size=(n, p)) + 0.2 * y[:, None], y


def test_discriminant_of_many_samples_has_no_matrix_of_samples():  # F1, F2, F4, F5, F6
    x, y = _tall()
    assert _peak_mb(lambda: models.lda(x, y)) < 20  # two Gram matrices of 3000 samples alone take 144 MB


@pytest.mark.parametrize("n,p", [(20, 30), (300, 12)])
def test_discriminant_solves_its_equation_either_way(n, p):
    x, y = _tall(n, p)
    beta, _, lam = models.lda(x, y)
    z, cov = x / x.std(0), np.zeros((p, p))
    for k in (0, 1):
        c = z[y == k] - z[y == k].mean(0)
        shrink = models.ledoit_wolf(c @ c.T, p)
        cov += len(c) / n * ((1 - shrink) * c.T @ c / len(c) + shrink * np.square(c).sum() / (len(c) * p) * np.eye(p))
    assert np.allclose(cov @ (beta * x.std(0)), z[y == 1].mean(0) - z[y == 0].mean(0))
    assert 0 <= lam <= 1


@pytest.mark.parametrize("stratify", [True, False])
def test_folds_of_single_samples_are_those_of_groups_of_one(stratify):
    y = (np.random.default_rng(5).random(61) < 0.3).astype(int)
    assert (models.folds(y, None, 4, 3, 7, stratify) == models.folds(y, np.arange(61), 4, 3, 7, stratify)).all()


def _study(spark, n, p, holes=0.1, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 50, (n, p)).astype(float)
    seen = rng.random((n, p)) >= holes
    cells = [(f"s{i:05d}", f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(seen))]
    values = spark.createDataFrame(cells, "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([(f"s{i:05d}", i, "ab"[i % 2]) for i in range(n)], "sample_id string, sample_ord int, g string")
    features = spark.createDataFrame([(f"f{j}", j) for j in range(p)], "feature_id string, feature_ord int")
    return Dataset(values, samples, features), x, seen


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_of_many_samples_is_made_in_tiles(spark, monkeypatch, method):  # F3, F7
    ds, _, _ = _study(spark, 45, 9, holes=0.3)
    want = {(r["a"], r["b"]): r["r"] for r in qc.correlation(ds, method).collect()}
    monkeypatch.setattr(qc, "MOST", 10)
    monkeypatch.setattr(gram, "LEAST_TILE", 4)
    monkeypatch.setattr(qc, "BLOCK", 4)
    monkeypatch.setattr(qc, "STRIP", 2)
    out = qc.correlation(ds, method)
    assert "corr(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no aggregate over a row for each product
    got = {(r["a"], r["b"]): r["r"] for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 900
    for k, r in want.items():
        assert (r is None) == (got[k] is None) and (r is None or abs(r - got[k]) < 1e-9)


def test_components_of_many_samples_come_from_features(spark, monkeypatch):  # F8
    ds, x, _ = _study(spark, 40, 6, holes=0)
    want, share = qc.pca(ds, 3)
    want = {(r["sample_id"], r["component"]): r["score"] for r in want.collect()}
    monkeypatch.setattr(qc, "MOST", 8)
    got, other = qc.pca(ds, 3)
    assert got.columns == ["sample_id", "component", "score"] and np.allclose(share, other)
    got = {(r["sample_id"], r["component"]): r["score"] for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_group_tests_hold_one_labelling_at_a_time(spark):  # F9
    n = 3000
    scores = spark.createDataFrame([(f"s{i:05d}", c, float((i * 7919) % 2003)) for i in range(n) for c in (1, 2)], "sample_id string, component int, score double")
    samples = spark.createDataFrame([(f"s{i:05d}", i, "abc"[i % 3]) for i in range(n)], "sample_id string, sample_ord int, g string")
    out = {}
    assert _peak_mb(lambda: out.update(r=pca_tests.group_tests(scores, samples, "g", n_permutations=99).collect())) < 20
    assert [r["arrangements"] for r in out["r"]] == [99, 99] and all(0.01 <= r["p_permutation"] <= 1 for r in out["r"])


def test_permuted_hits_are_those_of_the_rank_test(spark):  # F9
    rng = np.random.default_rng(2)
    rows = [{"sample_id": f"s{i}", "g": "ab"[i % 2]} for i in range(8)]
    scores = spark.createDataFrame([(r["sample_id"], 1, float(v)) for r, v in zip(rows, rng.integers(0, 5, 8))], "sample_id string, component int, score double")
    samples = spark.createDataFrame([(r["sample_id"], i, r["g"]) for i, r in enumerate(rows)], "sample_id string, sample_ord int, g string")
    got = pca_tests.group_tests(scores, samples, "g", n_permutations=99).first()
    drawn, exact = pca_tests.arrangements(rows, "g", None, 99)
    table = spark.createDataFrame([(p, r["sample_id"], v) for p, d in enumerate(drawn) for r, v in zip(rows, d)], "perm int, sample_id string, label string")
    null = [r["h"] for r in pca_tests.kruskal(table.join(scores, "sample_id"), "label", ["component", "perm"]).collect()]
    assert exact and len(null) == 70 and got["p_permutation"] == sum(h >= got["h"] - 1e-9 * abs(got["h"]) for h in null) / 70


def _filled_by_hand(x, seen, k):
    n, p = x.shape
    out = np.where(seen, x, np.nan)
    for i in range(n):
        both = seen & seen[i]
        d = [np.sqrt(((x[o] - x[i])[both[o]] ** 2).sum() * p / both[o].sum()) if o != i and both[o].any() else np.inf for o in range(n)]
        order = [o for o in np.argsort(d, kind="stable") if d[o] < np.inf]
        for j in np.nonzero(~seen[i])[0]:
            given = [x[o, j] for o in order if seen[o, j]][:k]
            out[i, j] = np.mean(given) if given else x[seen[:, j], j].mean()
    return out


@pytest.mark.parametrize("step", [1.0, 0.37])
def test_nearest_samples_are_found_in_tiles(spark, monkeypatch, step):  # F10
    ds, x, seen = _study(spark, 60, 7, holes=0.4)
    x = (x % 6 + 1) * step  # many ties
    ds = ds.with_values(ds.values.withColumn("value", (F.col("value") % 6 + 1) * step))
    monkeypatch.setattr(gram, "LEAST_TILE", 8)
    monkeypatch.setattr(transform, "ASKED", 3)
    got = transform.handle_missing(ds, max_missing_fraction=0.9, impute="knn", knn_neighbors=3).values
    want = _filled_by_hand(x, seen, 3)
    rows = got.collect()
    assert len(rows) == 60 * 7
    assert all(abs(r["value"] - want[int(r["sample_id"][1:]), int(r["feature_id"][1:])]) < 1e-9 for r in rows)


def test_nearest_samples_plan_has_no_join_of_samples(spark):  # F10
    ds, _, _ = _study(spark, 20, 4, holes=0.3)
    plan = transform.handle_missing(ds, max_missing_fraction=0.9, impute="knn").values._jdf.queryExecution().analyzed().toString()
    assert "NOT (sample_id" not in plan and "MapInArrow nearest" in plan


def test_findings_of_five_digits_are_not_cut(spark):  # F12, F13
    text = "---\nid: 10000\ntitle: x\nstatus: candidate\n---\nSee finding 1000.\n"
    docs = findings.parsed(spark.createDataFrame([("findings/10000-x.md", text)], "path string, content string"))
    assert [(r["id"], r["rule"], r["detail"]) for r in findings.violations(docs).collect()] == [(10000, 5, "1000")]


@pytest.mark.parametrize("name", ["finding_violations", "finding_first_violation"])
def test_finding_queries_equal_their_sql_beyond_four_digits(spark, tmp_path, name):  # F12, F13
    rows = [(k, f"Supplier {k}") for k in (1, 999, 1000, 9998, 9999, 10000, 10001, 10009, 12345, 60000)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
