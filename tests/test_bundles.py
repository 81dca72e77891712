"""Whole analyses, added methods, three dimensions, and the ways around single tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.model import Grid, Kriging, Rbf, Search, Variogram
from stratafold.operators import bundles, grid, interpolate, more, neighbours, ranks, spatial, validation
from stratafold.sources import sinks, text

MODEL = Variogram("spherical", 0.1, 1.0, 3.0)


@pytest.fixture(scope="module")
def solid(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.uniform(0, 4, 3)), float(rng.normal())) for i in range(30)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, value double").cache()


def test_kriging_in_three_dimensions(spark, solid):
    rows, points = solid
    targets = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 0.5, 0.5, 0.5)], "id long, x double, y double, z double")
    a = np.array(rows)
    gap = np.linalg.norm(a[:, None, 1:4] - a[None, :, 1:4], axis=2)
    system = np.block([[interpolate.model_values(MODEL, gap) + 1e-10 * np.eye(30), np.ones((30, 1))], [np.ones((1, 30)), np.zeros((1, 1))]])
    got = {r.id: r for r in interpolate.kriging(points, targets, MODEL, axes=("x", "y", "z")).collect()}
    near = {r.id: r for r in interpolate.kriging(points, targets, MODEL, search=Search(radius=100.0, max_points=30), axes=("x", "y", "z")).collect()}
    for t in targets.collect():
        right = np.append(interpolate.model_values(MODEL, np.linalg.norm(a[:, 1:4] - np.array(t[1:]), axis=1)), 1)
        w = np.linalg.solve(system, right)
        for found in (got[t.id], near[t.id]):
            assert found.estimate == pytest.approx(w[:30] @ a[:, 4], abs=1e-8) and found.variance == pytest.approx(w @ right, abs=1e-8)


def test_radial_bases_of_degree_two_in_three_dimensions(spark, solid):
    _, points = solid
    value = "1 + x - 2*y + z + x*x - y*z + 3*z*z"
    targets = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 9.0, -4.0, 2.0)], "id long, x double, y double, z double")
    got = interpolate.rbf(points.withColumn("value", F.expr(value)), targets, Rbf("cubic", degree=2), axes=("x", "y", "z")).join(targets, "id")
    for r in got.withColumn("want", F.expr(value)).collect():
        assert r.estimate == pytest.approx(r.want, abs=1e-5)


def test_order_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=999), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(7)
    p = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(ranks.order_quantiles(df, "v", p), np.quantile(v, p))
    assert ranks.order_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert ranks.order_quantiles(df.limit(1), "v", [0.1, 0.9]) is not None


def test_interval_join_of_a_long_hole(spark):
    rng = np.random.default_rng(2)
    rows = [("h", float(a), float(a + rng.choice([0.0, 0.5, 3.0, 40.0])), i) for i, a in enumerate(np.round(rng.uniform(-50, 200, 120), 1))]
    df = spark.createDataFrame(rows, "hole string, from double, to double, i long")
    got = {(r[0], r[1]): r[2] for r in neighbours.interval_join(df, df, "hole").select("a.i", "b.i", "overlap").collect()}
    want = {(i, j): min(b, d) - max(a, c) for _, a, b, i in rows for _, c, d, j in rows if a < d and b > c and a < b and c < d}
    assert got == pytest.approx(want)


def test_nearest_join_passes_over_points_without_place(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0), (2, None, 0.0, 3.0), (3, float("nan"), 1.0, 4.0), (4, 5.0, 5.0, 5.0)], "id long, x double, y double, value double")
    got = {(r.qid, r.nid) for r in neighbours.nearest_join(df, df, 1, other=True).collect()}
    assert got == {(0, 1), (1, 0), (4, 1)}


def test_header_is_found_by_place(spark, tmp_path):
    sinks.put(spark, str(tmp_path / "a.csv"), b"site;north\nwell;grade\n1;2\nsite;north\nwell;grade\n")
    got = [tuple(r) for r in text.read_csv(spark, str(tmp_path / "a.csv"), sep=";", header=1).collect()]
    assert got == [("1", "2"), ("site", "north"), ("well", "grade")]


def test_large_inputs_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        more.shapiro(spark.range(more.SHAPIRO_LIMIT + 1).withColumn("v", F.col("id").cast("double")), "v")
    monkeypatch.setattr(sinks, "MOST", 10)
    nodes = grid.regular(spark, Grid(bounds=(0, 1, 0, 1), nx=4, ny=3)).withColumn("value", F.lit(1.0))
    for writer in (sinks.surfer_ascii, sinks.vtk_points, sinks.dxf_points):
        with pytest.raises(ValueError):
            writer(nodes)


def test_reports_escape(spark):
    page = sinks.report("a < b", {"<i>": spark.createDataFrame([("x & <y>",)], "t string")})
    assert "a &lt; b" in page and "&lt;i&gt;" in page and "x &amp; &lt;y&gt;" in page


def test_added_method_and_comparison(spark, solid):
    _, points = solid
    bundles.register_method("mean", lambda: lambda p, t: t.select("id").crossJoin(p.agg(F.avg("value").alias("estimate"))))
    try:
        out = bundles.run(points, "mean", cell_size=2.0).collect()
        assert len({r.estimate for r in out}) == 1 and len(out) > 4
        folds = points.withColumn("fold", F.col("id") % 3)
        methods = {"mean": bundles.METHODS["mean"](), "kriging": bundles.kriged(MODEL), "rbf": bundles.radial(Rbf("linear"))}
        got = {r.method: r.n for r in bundles.compare_methods(folds, "fold", methods).collect()}
        assert got == {"mean": 30, "kriging": 30, "rbf": 30}
        for r in bundles.fold_predictions(folds, "fold", bundles.METHODS["mean"]()).collect():
            rest = [x.value for x in points.collect() if x.id % 3 != r.fold]
            assert r.predicted == pytest.approx(np.mean(rest))
    finally:
        bundles.METHODS.pop("mean")


def test_fitted_kriging(spark, solid):
    _, points = solid
    out = bundles.kriged(k=Kriging("simple"), max_distance=3.0, lags=5)(points, points.select("id", "x", "y")).collect()
    assert len(out) == 30 and all(np.isfinite(r.estimate) for r in out)


def test_trends(spark):
    nodes = grid.regular(spark, Grid(bounds=(0, 10, 0, 10), nx=11, ny=11))
    kind = lambda e: bundles.trend_kind(nodes.withColumn("value", F.expr(e))).first().kind
    assert kind("x + y") == "linear" and kind("x + (y-5)*(y-5)") == "quadratic" and kind("pmod(id * 7919, 13)") is None
    assert bundles.trend_kind(nodes.limit(5).withColumn("value", F.col("x"))).first().kind is None


def test_medians_words_events_and_grids(spark, solid):
    _, points = solid
    m = bundles.median_interval(points, "value", 100).first()
    assert m.low <= m.median <= m.high
    assert bundles.power_words(1) != bundles.power_words(3) and "spacing" in bundles.radius_words(3.0, 1.0)
    seen, events = [], bundles.Events()
    events.bind("done", seen.append)
    events.bind("done", lambda x: 1 / 0)
    events.bind("done", seen.append)
    assert len(events.emit("done", 3)) == 1 and seen == [3, 3] and events.emit("none") == []
    nodes = grid.regular(spark, Grid(bounds=(0, 1, 0, 1), nx=3, ny=2)).withColumn("value", F.lit(1.0))
    assert bundles.grid_problems(nodes) == [] and len(bundles.grid_problems(nodes.limit(0))) == 1
    assert bundles.grid_problems(nodes.where("id <> 2")) == ["nodes are missing"] and bundles.grid_problems(nodes.union(nodes)) == ["nodes occur twice"]
    assert bundles.grid_problems(nodes.withColumn("value", F.lit(None).cast("double"))) == ["no value is known"]


def test_analyses(spark, solid):
    _, points = solid
    values = bundles.analyse_values(points, "value")
    assert {"descriptive", "shape", "quantiles", "variability", "outliers", "intervals", "normality"} == {r.section for r in values.select("section").distinct().collect()}
    report = bundles.summary_report(values, "values")
    assert report.startswith("values\n======") and "mean: " in report
    assert bundles.analyse_places(points).count() > 20 and bundles.analyse_places(points.limit(2)).count() > 3
    assert bundles.analyse_variogram(points, 3.0, 4).where("section = 'models'").count() > 0
    assert {r.section for r in bundles.analyse_quality(points, {"value": (-1, 1)}).collect()} >= {"completeness", "duplicates", "ranges"}
    with pytest.raises(ValueError):
        bundles.analyse_correlations(points.withColumn("c", F.lit(1.0)), ["c", "value"])


def test_folds_are_even(spark, solid):
    _, points = solid
    assert sorted(r["count"] for r in validation.folds(points, 4).groupBy("fold").count().collect()) == [7, 7, 8, 8]
    strata = validation.stratified_folds(points, 3, 2).groupBy("stratum", "fold").count().collect()
    assert {r["count"] for r in strata} == {5}


def test_hull_of_many_partitions(spark):
    nodes = grid.regular(spark, Grid(bounds=(0, 3, 0, 2), nx=31, ny=21)).repartition(9)
    assert spatial.hull_measures(nodes).first().area == pytest.approx(6.0)
    assert sorted((r.x, r.y) for r in spatial.hull(nodes).collect()) == [(0.0, 0.0), (0.0, 2.0), (3.0, 0.0), (3.0, 2.0)]
