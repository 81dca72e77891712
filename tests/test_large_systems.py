"""Global systems beyond the limit of points: the same results by a factor in a file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.model import Kriging, Rbf, Variogram
from stratafold.operators import dense, interpolate, iterated

NAMES = ["kriging_at_points", "kriging_of_constant", "kriging_ordinary", "kriging_universal", "kriging_intervals", "kriging_of_plane", "kriging_simple", "rbf_at_points"]
MODELS = [Variogram("spherical", 0.05, 1.0, 3.0), Variogram("exponential", 0.0, 1.0, 2.0), Variogram("linear", 0.1, 0.5, 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([rng.random((150, 2)) * 5, rng.normal(0, 1, 150)]))]
    points = spark.createDataFrame(rows, "id long, x double, y double, value double").localCheckpoint()
    targets = spark.createDataFrame([(i, 0.4 * i, 5 - 0.3 * i) for i in range(12)], "id long, x double, y double").unionByName(points.where("id < 3").select((F.col("id") + 100).alias("id"), "x", "y"))
    return points, targets.localCheckpoint()


def _both(monkeypatch, make, names):
    small = {r.id: [r[c] for c in names] for r in make().collect()}
    monkeypatch.setattr(interpolate, "GLOBAL_LIMIT", 100)
    monkeypatch.setattr(interpolate, "TARGETS", 4)
    monkeypatch.setattr(dense, "ROWS", 64)
    large = {r.id: [r[c] for c in names] for r in make().collect()}
    assert large.keys() == small.keys()
    for i in small:
        assert large[i] == pytest.approx(small[i], abs=1e-7)


@pytest.mark.parametrize("kind", ["ordinary", "simple", "universal"])
@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.kind)
def test_kriging(tables, monkeypatch, kind, model):
    if kind == "simple" and model.kind == "linear":
        pytest.skip("a model without a sill has no covariances")
    _both(monkeypatch, lambda: interpolate.kriging(*tables, model, Kriging(kind)), ["estimate", "variance"])


def test_estimates_alone(tables, monkeypatch):
    _both(monkeypatch, lambda: interpolate.kriging(*tables, MODELS[1], variance=False), ["estimate"])


@pytest.mark.parametrize("degree", [-1, 0, 1])
def test_linear_kernel(tables, monkeypatch, degree):
    _both(monkeypatch, lambda: interpolate.rbf(*tables, Rbf("linear", degree=degree)), ["estimate"])


def test_copies(tables, monkeypatch):
    points, targets = tables
    twice = points.unionByName(points.select((F.col("id") + 1000).alias("id"), "x", "y", (F.col("value") + 1).alias("value")))
    monkeypatch.setattr(interpolate, "GLOBAL_LIMIT", 100)
    found = {r.id: r.estimate for r in interpolate.kriging(twice, targets, MODELS[1]).collect()}
    for i, v in points.where("id < 3").select("id", "value").collect():
        assert found[i + 100] == pytest.approx(v + 0.5, abs=1e-3)


def test_other_kernels_are_refused(tables, monkeypatch):
    monkeypatch.setattr(interpolate, "GLOBAL_LIMIT", 100)
    with pytest.raises(ValueError):
        interpolate.rbf(*tables, Rbf("cubic", degree=1))


def test_nearest_earlier_points():
    places = np.random.default_rng(2).normal(0, 1, (900, 3))
    order = iterated.ordered(places)
    assert sorted(order) == list(range(900))
    p = places[order]
    for i, near in zip(range(700, 760), iterated._earlier(p, 700, 760, 30)):
        assert set(near) == set(np.argsort(np.linalg.norm(p[:i] - p[i], axis=1))[:30])


@pytest.mark.parametrize("name", NAMES)
def test_queries_without_a_factor(spark, sf, monkeypatch, name):
    """The registered queries beyond the limit, where n³ operations and 4 n² bytes of a factor are not to be had."""
    import __spark_entry__ as entry

    def none(*_):
        raise AssertionError("a factor was made")

    small = sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())
    monkeypatch.setattr(interpolate, "GLOBAL_LIMIT", 100)
    monkeypatch.setattr(interpolate, "Factor", none)
    monkeypatch.setattr(iterated, "BLOCK", 96)
    large = sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())
    assert len(large) == len(small)
    for a, b in zip(large, small):
        assert a == pytest.approx(b, abs=3e-6)
