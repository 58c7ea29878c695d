"""Loaders, transforms, quality control and replicates against planted values."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.dataset import Dataset, Refusal, ScaleRefusal
from assayloom.operators import qc, replicates, transform
from assayloom.sources import matrix, store


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


WIDE = "protein\tsA\tsB\tsC\nP1\t101\t102\t100\nP2\t201\t202\t200\nP3\t301\t302\t300\n"
META = "Replicate,RunOrder,Group\nsB.raw,3,t\nsA.raw,2,t\nsC.raw,1,c\n"


def dataset(spark, x, scale="log2", **meta):
    x = np.asarray(x, float)
    values = spark.createDataFrame([(f"s{i}", f"F{j}", None if math.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "sample_id string, feature_id string, value double")
    names = list(meta)
    samples = spark.createDataFrame([(f"s{i}", i, *[meta[k][i] for k in names]) for i in range(len(x))], ["sample_id", "sample_ord", *names])
    features = spark.createDataFrame([(f"F{j}", j) for j in range(x.shape[1])], "feature_id string, feature_ord int")
    return Dataset(values, samples, features, scale)


def as_matrix(ds):
    rows = {(r["sample_id"], r["feature_id"]): r["value"] for r in ds.values.collect()}
    s = [r[0] for r in ds.samples.orderBy("sample_ord").select("sample_id").collect()]
    f = [r[0] for r in ds.features.orderBy("feature_ord").select("feature_id").collect()]
    return np.array([[rows[a, b] if rows.get((a, b)) is not None else math.nan for b in f] for a in s])


def test_wide_table_follows_the_metadata_order(spark, tmp_path):
    ds = matrix.load_wide(spark, put(tmp_path, "w.tsv", WIDE), put(tmp_path, "m.csv", META), join_key="Replicate", suffix=".raw", order_by="RunOrder", expected_n_samples=3, expected_n_features=3)
    assert as_matrix(ds).tolist() == [[100, 200, 300], [101, 201, 301], [102, 202, 302]]
    assert [r["Group"] for r in ds.samples.orderBy("sample_ord").collect()] == ["c", "t", "t"]


@pytest.mark.parametrize(
    ("wide", "meta", "more"),
    [
        ("protein\tsA\tsA\nP\t1\t2\n", "Replicate\nsA\n", {}), ("x\tsA\nP\t1\n", "Replicate\nsA\n", {}), ("protein\nP\n", "Replicate\nsA\n", {}), ("protein\tsA\n\t1\n", "Replicate\nsA\n", {}),
        ("protein\tsA\nP\t1\nP\t2\n", "Replicate\nsA\n", {}), ("protein\tsA\nP\tx\n", "Replicate\nsA\n", {}), ("protein\tsA\nP\tNA\n", "Replicate\nsA\n", {}), ("protein\tsA\tsB\nP\t1\t2\n", "Replicate\nsA\n", {}),
        ("protein\tsA\nP\t1\n", "Replicate\nsA\nsB\n", {}), ("protein\tsA\nP\t1\n", "Replicate\nsA\nsA\n", {}), ("protein\tsA\n", "Replicate\nsA\n", {}), ("protein\tsA\nP\t1\n", "Replicate\nsA\n", {"expected_n_features": 2}),
    ],
)
def test_loader_refuses(spark, tmp_path, wide, meta, more):
    with pytest.raises(Refusal):
        matrix.load_wide(spark, put(tmp_path, "w.tsv", wide), put(tmp_path, "m.csv", meta), join_key="Replicate", **more)


def test_identifiers_stay_text_and_missing_is_kept_on_demand(spark, tmp_path):
    ds = matrix.load_wide(spark, put(tmp_path, "w.tsv", "protein\t0001\t1E5\nTRUE\t0\tNA\n"), put(tmp_path, "m.csv", "Replicate\n0001\n1E5\n"), join_key="Replicate", missing="preserve")
    assert [r[0] for r in ds.samples.orderBy("sample_ord").select("sample_id").collect()] == ["0001", "1E5"]
    assert {(r["sample_id"], r["value"]) for r in ds.values.collect()} == {("0001", 0.0), ("1E5", None)}


def test_precursors_keep_the_strongest_charge(spark, tmp_path):
    wide = "protein\tmodifiedSequence\tprecursorCharge\tsA\tsB\nPA\tSEQ1\t2\t10\t12\nPA\tSEQ1\t3\t100\t120\nPB\tSEQ1\t3\t100\t120\nPC\tSEQ2\t2\t5\t6\nPD\tSEQ3\t10\t1\t1\nPD\tSEQ3\t2\t1\t1\n"
    ds = matrix.load_precursors(spark, put(tmp_path, "p.tsv", wide), put(tmp_path, "m.csv", "Replicate\nsA\nsB\n"), join_key="Replicate")
    f = {r["feature_id"]: r for r in ds.features.collect()}
    assert (f["SEQ1"]["protein"], f["SEQ1"]["precursorCharge"]) == ("PA,PB", "3") and f["SEQ3"]["precursorCharge"] == "10"  # charges compare as text
    assert {(r["sample_id"], r["value"]) for r in ds.values.filter("feature_id = 'SEQ1'").collect()} == {("sA", 100.0), ("sB", 120.0)}


def test_scales_are_guarded(spark):
    ds = dataset(spark, [[1, 2], [3, 4]])
    for f in (lambda: transform.log2_transform(ds), lambda: transform.normalize(ds, "median"), lambda: qc.cv(ds), lambda: transform.handle_missing(ds, max_missing_fraction=1, impute="zero")):
        with pytest.raises(ScaleRefusal):
            f()
    linear = dataset(spark, [[1, 2], [3, 4]], "linear")
    with pytest.raises(ScaleRefusal):
        transform.median_center(linear)
    assert np.allclose(as_matrix(transform.to_linear(transform.log2_transform(linear))), [[2, 3], [4, 5]])
    with pytest.raises(Refusal):
        transform.log2_transform(dataset(spark, [[-1.0, 1]], "linear"))
    with pytest.raises(Refusal):
        transform.log2_transform(dataset(spark, [[math.nan, 1]], "linear"))


def test_normalisations(spark):
    x = np.array([[1.0, 2, 3, 10], [2, 4, 6, 8], [5, 1, 9, 7]])
    ds = dataset(spark, x, "linear")
    med = np.median(x, axis=1, keepdims=True)
    assert np.allclose(as_matrix(transform.normalize(ds, "median")), x * med.mean() / med)
    y = np.log2(x + 1)
    d = np.abs(y - np.median(y, axis=1, keepdims=True))
    assert np.allclose(as_matrix(transform.normalize(ds, "mad")), (y - np.median(y, axis=1, keepdims=True)) / (1.4826 * np.median(d, axis=1, keepdims=True)))
    assert transform.normalize(ds, "vsn").scale == "glog2"


def test_imputation(spark):
    x = [[1, 0, 5, 0], [3, 2, 0, 0], [5, 4, 7, 9]]
    ds = dataset(spark, x, "linear")
    kept = transform.handle_missing(ds, max_missing_fraction=0.5, impute="mean")
    assert np.allclose(as_matrix(kept), [[1, 3, 5], [3, 2, 6], [5, 4, 7]])
    assert as_matrix(transform.handle_missing(ds, max_missing_fraction=1, impute="zero"))[0, 3] == 0
    assert np.allclose(as_matrix(transform.handle_missing(ds, max_missing_fraction=0.5, impute="knn", knn_neighbors=1)), [[1, 2, 5], [3, 2, 5], [5, 4, 7]])
    with pytest.raises(Refusal):
        transform.handle_missing(dataset(spark, [[0, 1], [0, 2]], "linear"), max_missing_fraction=1, impute="median")


def test_combat_removes_a_batch_shift(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(5, 10, 30) + rng.normal(0, 0.3, (10, 30))
    x[5:] += 2 + rng.normal(0, 0.2, 30)
    ds = dataset(spark, np.column_stack([x, np.full(10, 3.0)]), batch=["A"] * 5 + ["B"] * 5)
    with pytest.warns(transform.BatchPassthroughWarning):
        out = as_matrix(transform.combat_correct(ds, "batch"))
    assert np.abs(out[:5, :30].mean(0) - out[5:, :30].mean(0)).mean() < 0.2 and (out[:, 30] == 3).all()
    assert np.allclose(out[:, :30].mean(), x.mean(), atol=0.05)
    with pytest.raises(Refusal):
        transform.combat_correct(dataset(spark, x[:3], batch=["A", "A", "B"]), "batch")


def test_quality_control(spark):
    ds = dataset(spark, [[1, 5, 0, 8], [2, 5, 0, 0], [3, 5, 4, 0]], "linear", g=["a", "a", "b"])
    cv = {r["feature_id"]: r["cv"] for r in qc.cv(ds).collect()}
    assert cv["F0"] == 0.5 and cv["F1"] == 0
    assert {r["sample_id"]: r["n_detected"] for r in qc.detection_counts(ds).collect()} == {"s0": 3, "s1": 2, "s2": 3}
    c = qc.feature_completeness(ds)
    assert {r["feature_id"]: r["n_detected"] for r in c.collect()} == {"F0": 3, "F1": 3, "F2": 1, "F3": 1}
    assert [r["n_features"] for r in qc.completeness_curve(c, 3).orderBy("k").collect()] == [4, 2, 2]
    ranked = qc.dynamic_range(ds).orderBy("rank").collect()
    assert [r["feature_id"] for r in ranked] == ["F3", "F1", "F2", "F0"]
    assert math.isclose(qc.orders_of_magnitude(qc.dynamic_range(ds)).first()["orders"], math.log10(4))
    assert math.isnan(qc.cv(dataset(spark, [[-1], [0]], "linear")).first()["cv"] or math.nan)


def test_binned_median_counts_edges_twice(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "x double, y double")
    assert [(r["bin"], r["n"], r["median"]) for r in qc.binned_median(df, "x", "y", 2).orderBy("bin").collect()] == [(0, 3, 1.0), (1, 3, 3.0)]


def test_correlation_and_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 40))
    x[1], x[3] = x[0] * 2 + 1, -x[2]
    ds = dataset(spark, x)
    r = {(a["a"], a["b"]): a["r"] for a in qc.correlation(ds).collect()}
    assert math.isclose(r["s0", "s1"], 1) and math.isclose(r["s2", "s3"], -1)
    order = qc.leaf_order(qc.correlation(ds, "spearman"))
    assert abs(order.index("s0") - order.index("s1")) == 1
    scores, share = qc.pca(ds, 3)
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = np.zeros((6, 3))
    for q in scores.collect():
        got[int(q["sample_id"][1:]), q["component"] - 1] = q["score"]
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3])) and np.allclose(share, (s**2 / (s**2).sum())[:3])


def test_cramers_v(spark):
    same = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "p string, q string")
    assert math.isclose(qc.cramers_v(same, "p", "q").first()["v"], 1.0)
    ds = dataset(spark, np.ones((4, 1)), batch=["A", "A", "B", "B"], g=["c", "c", "t", "t"])
    with pytest.warns(qc.BatchConfoundingWarning):
        assert qc.batch_confounding(ds, "batch", ["g"]).first()["perfect"]


def test_replicates(spark):
    ds = dataset(spark, [[1, 10], [5, 20], [2, 11], [7, 30], [6, 13], [9, 34]], animal=list("ABACAC"), group=list("xyxzxz"), run=[1, 2, 3, 4, 5, 6])
    out = replicates.aggregate(ds, "animal", run_level=("run",))
    assert np.allclose(as_matrix(out.dataset), [[3, 34 / 3], [5, 20], [8, 32]])
    assert [r["n_replicates"] for r in out.dataset.samples.orderBy("sample_ord").collect()] == [3, 1, 2]
    assert math.isclose(out.dataset.samples.agg(F.avg("precision_weight")).first()[0], 1)
    with pytest.raises(Refusal, match="run"):
        replicates.aggregate(ds, "animal")
    summed = replicates.aggregate(ds, "animal", summarize=("run",)).dataset.samples.orderBy("sample_ord").collect()
    assert [r["run"] for r in summed] == [3.0, 2.0, 5.0]


@pytest.mark.parametrize("planted", [0.2, 0.8])
def test_technical_fraction_is_recovered(spark, planted):
    rng = np.random.default_rng(2)
    unit = rng.normal(0, math.sqrt(1 - planted), (12, 600))
    x = np.repeat(unit, 3, axis=0) + rng.normal(0, math.sqrt(planted), (36, 600))
    f = replicates.technical_fraction(dataset(spark, x, u=[f"u{i // 3}" for i in range(36)]), "u")
    assert abs(f - planted) < 0.06


def test_data_sets_and_results_are_stored(spark, tmp_path):
    from dataclasses import dataclass

    ds = dataset(spark, [[1, 2], [3, 4]], "linear", g=["a", "b"])
    store.save_dataset(ds, f"{tmp_path}/ds")
    back = store.load_dataset(spark, f"{tmp_path}/ds")
    assert back.scale == "linear" and (as_matrix(back) == as_matrix(ds)).all()
    assert store.fingerprint(analysis="classification", data_version="v1", params={"run_null": True, "outcome": "grp"}, seed=0) == "bdc844a59060"

    @dataclass(frozen=True)
    class Result:
        table: object
        n: int
        note: str = "none"

    key = store.save_cached(Result(ds.values, 4), f"{tmp_path}/c", spark, analysis="a", data_version="v", params={}, seed=1)
    again = store.load_cached(f"{tmp_path}/c", Result, spark, analysis="a", data_version="v", params={}, seed=1)
    assert again.n == 4 and again.table.count() == 4 and store.read_meta(f"{tmp_path}/c", spark, "a", key)["seed"] == 1

    @dataclass(frozen=True)
    class Older:
        n: int

    store.save_result(Older(3), f"{tmp_path}/o", spark)

    @dataclass(frozen=True)
    class Newer:
        n: int
        more: int = 7

    Newer.__name__ = "Older"
    with pytest.warns(store.ResultSchemaWarning):
        assert store.load_result(f"{tmp_path}/o", Newer, spark).more == 7
    warnings.resetwarnings()
