"""Parameter searches, resampled scores and tables behind drawings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.model import Search, Variogram
from stratafold.operators import panels, tuning
from stratafold.operators.interpolate import GLOBAL_LIMIT, global_rows, kernel_values


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(x + 2 * y), i % 3) for i, (x, y) in enumerate(rng.random((60, 2)))]
    return spark.createDataFrame(rows, "id long, x double, y double, value double, fold int").cache()


def test_left_out_errors_equal_refits():
    rng = np.random.default_rng(1)
    rows = np.column_stack([rng.random((12, 2)), rng.random(12)])
    gap = np.linalg.norm(rows[:, None, :2] - rows[None, :, :2], axis=2)
    for degree in (-1, 0, 1):
        errors = []
        for i in range(12):
            own = np.delete(np.arange(12), i)
            n = len(own)
            poly = np.column_stack([np.ones(n), rows[own, :2]])[:, : 1 + 2 * degree] if degree >= 0 else np.zeros((n, 0))
            m = poly.shape[1]
            system = np.block([[kernel_values("multiquadric", gap[np.ix_(own, own)], 2.0) + 1e-6 * np.eye(n), poly], [poly.T, np.zeros((m, m))]])
            w = np.linalg.solve(system, np.concatenate([rows[own, 2], np.zeros(m)]))
            at = np.r_[1.0, rows[i, :2]][:m] if m else np.zeros(0)
            errors.append(kernel_values("multiquadric", gap[i, own], 2.0) @ w[:n] + at @ w[n:] - rows[i, 2])
        assert tuning.left_out_rmse(gap, rows, "multiquadric", 2.0, 1e-6, degree) == pytest.approx(np.sqrt(np.mean(np.square(errors))), rel=1e-5)


def test_searches_find_good_parameters(spark, plane):
    drawn = tuning.rbf_random(plane, 12).collect()
    assert len(drawn) == 12 and {r.draw for r in drawn} == set(range(12)) and min(r.rmse for r in drawn) < 0.2
    evolved = tuning.rbf_evolution(plane, ("multiquadric", "gaussian"), 4, 6).collect()
    assert {r.kernel for r in evolved} == {"multiquadric", "gaussian"} and all(1e-2 <= r.epsilon <= 1e2 and r.rmse < 0.2 for r in evolved)
    advice = tuning.rbf_advice(plane, 1e9)
    assert (advice["size"], advice["method"], advice["regularization"]) == ("small", "grid", 1e-10)


def test_global_systems_refuse_and_do_not_cut(spark):
    with pytest.raises(ValueError, match="at most"):
        global_rows(spark.range(GLOBAL_LIMIT + 1).select("id", *(F.lit(0.0).alias(c) for c in ("x", "y", "value"))))


def test_clusterings(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(c + rng.normal(0, 0.02)), float(c + rng.normal(0, 0.02)), 0.0) for i, c in enumerate([0, 1, 2] * 15)]
    p = spark.createDataFrame(rows, "id long, x double, y double, value double")
    by_k = {r.k: r for r in tuning.silhouettes(p, [2, 3, 4, 5]).collect()}
    assert max(by_k.values(), key=lambda r: r.silhouette).k == 3 and [k for k, r in by_k.items() if r.best] == [3]
    found = tuning.density_search(p, (2.0,), (3,)).first()
    assert found.clusters == 3 and found.score == pytest.approx(3 / (1 + found.noise / 45))


def test_cross_validated_kriging(spark, plane):
    model, search = Variogram("linear", 0.0, 1.0, 1.0), Search(radius=2.0, max_points=12)
    rows = tuning.krige_folds(plane, "fold", model, search).collect()
    assert len(rows) == 60 and all(abs(r.predicted - r.actual) < 0.6 and r.variance >= 0 for r in rows)
    alone = plane.withColumn("fold", F.lit(0))
    mean = plane.agg(F.avg("value")).first()[0]
    assert all(r.predicted == pytest.approx(mean) for r in tuning.krige_folds(alone, "fold", model, search).collect())
    assert {r.model: r.r2 > 0.9 for r in tuning.model_scores(plane, "fold", {"a": model}, search).collect()} == {"a": True}


def test_user_metric_by_bootstrap(spark, plane):
    search = Search(radius=2.0, max_points=8)
    largest = lambda a, p: F.max(F.abs(a - p))
    big = {r.rep: r.metric for r in tuning.bootstrap_metric(plane, largest, 10, search=search).collect()}
    rms = {r.rep: (r.metric, r.n) for r in tuning.bootstrap_metric(plane, replicates=10, search=search).collect()}
    assert set(big) == set(rms) and all(big[k] >= rms[k][0] for k in rms) and 5 < np.mean([n for _, n in rms.values()]) < 20
    again = {r.rep: r.metric for r in tuning.bootstrap_metric(plane.repartition(7), largest, 10, search=search).collect()}
    assert again == pytest.approx(big)


def test_panels(spark, plane):
    flags = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "b")], "id long, method string")
    s = panels.vote_summary(flags).first()
    assert (s.methods, s.any, s.majority, s.all, s.agreement) == (2, 3, 1, 1, pytest.approx(1 / 3))
    none = panels.vote_summary(flags.limit(0), 3).first()
    assert (none.methods, none.any, none.all, none.agreement) == (3, 0, 0, 0.0)
    # votes of ids 0 to 3 are 0, 2, 1, 1: their 75 % quantile is 1.25, their median 1
    assert {r.id for r in panels.top_votes(flags, spark.range(4), 0.25).collect()} == {1}
    assert {r.id for r in panels.top_votes(flags, spark.range(4), 0.5).collect()} == {1, 2, 3}
    assert panels.residuals(spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "id long, actual double, predicted double")).first().z is None
    assert panels.error_histogram(plane.select("id", F.col("value").alias("actual"), F.col("x").alias("predicted"))).agg(F.sum("n")).first()[0] == 60
    assert panels.coal_curves(["DEPT", "ASH_PCT", "GCx"]) == ["ASH_PCT", "GCx"]
    assert panels.composite_quality(100, 50, 0.1, 0.9) == {"score": 1.0, "grade": "excellent", "issues": []}
    assert panels.composite_quality(100, 5, samples=2)["grade"] == "poor" and len(panels.composite_quality(100, 5, samples=2)["issues"]) == 2
