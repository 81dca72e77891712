"""Operators against plain Python on the small fixtures, and the registered queries against SQL."""

import glob
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratafold.functions import scalar
from stratafold.model import Grid, Kriging, Rbf, Search, Variogram
from stratafold.operators import clean, compositing, correlation, grid, interpolate, neighbours, outliers, quality, ranks, recommend, spatial, statistics, validation, variograms
from stratafold.plans import queries as plans


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rows)], "id long, x double, y double, value double")


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(42)
    xy = rng.uniform(0, 1000, (50, 2))
    return points(spark, [(x, y, 15 + 5 * math.sin(x / 200) + 3 * math.cos(y / 300)) for x, y in xy])


def rows_of(df):
    return np.array([(r.x, r.y, r.value) for r in df.orderBy("id").collect()])


def test_idw_square(spark):
    square = points(spark, [(0, 0, 0), (1, 0, 1), (0, 1, 2), (1, 1, 3), (0.5, 0.5, 1.5)])
    targets = points(spark, [(0, 0, 0), (0.5, 0.25, 0), (50, 50, 0)])
    got = {r.id: r.estimate for r in interpolate.idw(square, targets, Search(radius=10)).collect()}
    d = np.linalg.norm(np.array([[0, 0], [1, 0], [0, 1], [1, 1], [0.5, 0.5]]) - [0.5, 0.25], axis=1)
    assert got[0] == 0 and got[2] is None and got[1] == pytest.approx((np.array([0, 1, 2, 3, 1.5]) / d**2).sum() / (1 / d**2).sum())


def test_nearest_join_is_exact(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(500, 0.1, (5, 2)), [[9000, 9000]]])
    p = points(spark, [(x, y, 0) for x, y in xy])
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbours.nearest_join(p, p, 6, other=True).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    for i in range(len(xy)):
        assert [n for _, n in sorted(got[i])] == np.argsort(d[i], kind="stable")[:6].tolist()


def test_fallback_and_sectors(spark):
    p = points(spark, [(k, 0, k) for k in range(10)])
    t = points(spark, [(0.1, 0, 0), (100, 0, 0)])
    got = {}
    for r in neighbours.with_fallback(t, p, 3, 1.5, 2).collect():
        got.setdefault(r.qid, set()).add(r.nid)
    assert got == {0: {0, 1}, 1: {9, 8, 7}}
    assert {r.id: r.n for r in interpolate.idw(p, t, Search(radius=3.0, sectors=4, max_per_sector=1, max_points=2)).collect()} == {0: 2, 1: 2}


def test_kriging_is_exact_and_has_variance(spark):
    p = points(spark, [(0, 0, 1), (1000, 0, 2), (0, 1000, 3), (1000, 1000, 4)])
    for kind in ("ordinary", "simple", "universal"):
        out = interpolate.kriging(p, p, Variogram("spherical", 0.0, 1.0, 2000.0), Kriging(kind)).orderBy("id").collect()
        assert [r.estimate for r in out] == pytest.approx([1, 2, 3, 4], rel=1e-3) and all(r.variance < 1e-6 for r in out)
    middle = interpolate.kriging(p, points(spark, [(500, 500, 0)]), Variogram("spherical", 0.0, 1.0, 2000.0)).first()
    assert middle.estimate == pytest.approx(2.5) and middle.variance > 0.1


def test_local_kriging_equals_global_with_all_points(spark, field):
    t = points(spark, [(x, y, 0) for x in (100, 480, 900) for y in (50, 700)])
    m = Variogram("exponential", 0.1, 9.0, 300.0)
    for kind in ("ordinary", "simple", "universal"):
        one, two = (interpolate.kriging(field, t, m, Kriging(kind), s).orderBy("id").collect() for s in (None, Search(radius=1e5, max_points=50)))
        assert [r.estimate for r in one] == pytest.approx([r.estimate for r in two], rel=1e-6)
        assert [r.variance for r in one] == pytest.approx([r.variance for r in two], rel=1e-5, abs=1e-6)
    assert interpolate.kriging(field.limit(0), t, m, Kriging(), Search()).count() == 6


def test_rbf_exact_plane_and_errors(spark):
    p = points(spark, [(0, 0, 1), (1, 0, 2), (0, 1, 3), (1, 1, 4)])
    for kernel in ("gaussian", "multiquadric", "inverse_multiquadric", "thin_plate", "linear", "cubic", "quintic"):
        out = interpolate.rbf(p, p, Rbf(kernel, 1.0, 0.0, 1 if kernel in ("thin_plate", "cubic", "quintic") else -1)).orderBy("id").collect()
        assert [r.estimate for r in out] == pytest.approx([1, 2, 3, 4], abs=1e-6)
    plane = points(spark, [(i, j, i + j) for i in range(5) for j in range(5)])
    assert interpolate.rbf(plane, points(spark, [(1.5, 2.25, 0)]), Rbf("thin_plate", degree=1)).first().estimate == pytest.approx(3.75, abs=1e-6)
    assert interpolate.rbf(plane, points(spark, [(1.5, 2.25, 0)]), Rbf("thin_plate"), Search(radius=9, max_points=9)).first().estimate == pytest.approx(3.75, rel=0.1)
    squares = points(spark, [(i, j, i * i + j) for i in range(5) for j in range(5)])
    assert interpolate.rbf(squares, points(spark, [(1.5, 2.25, 0)]), Rbf("thin_plate", degree=2)).first().estimate == pytest.approx(4.5, abs=1e-6)


def test_leave_one_out_shape_matches_refits(spark, field):
    got = {round(r.epsilon, 9): r.rmse for r in interpolate.rbf_shape(field.limit(20), "gaussian", 1e-6, 5).collect()}
    r = rows_of(field.limit(20))
    for e in np.logspace(-2, 2, 5)[1:]:
        errors = []
        for i in range(len(r)):
            rest = np.delete(r, i, 0)
            phi = interpolate.kernel_values("gaussian", np.linalg.norm(rest[:, None, :2] - rest[None, :, :2], axis=2), e) + 1e-6 * np.eye(len(rest))
            errors.append(r[i, 2] - interpolate.kernel_values("gaussian", np.linalg.norm(rest[:, :2] - r[i, :2], axis=1), e) @ np.linalg.solve(phi, rest[:, 2]))
        assert got[round(float(e), 9)] == pytest.approx(float(np.sqrt(np.mean(np.square(errors)))), rel=1e-3)


def test_variogram_fit_recovers_model(spark):
    h = np.linspace(5, 100, 20)
    for kind in ("spherical", "exponential", "gaussian"):
        model, fit = variograms.fit(h, interpolate.model_values(Variogram(kind, 1.0, 4.0, 40.0), h), np.ones(20), kind)
        assert (model.nugget, model.sill, model.range) == pytest.approx((1, 4, 40), rel=1e-2) and fit["r2"] > 0.999


def test_variogram_against_loops(spark, field):
    r = rows_of(field)
    got = {x.lag: (x.gamma, x.n_pairs) for x in variograms.experimental(field, 600.0, 6).collect()}
    d = [(np.hypot(*(r[i, :2] - r[j, :2])), (r[i, 2] - r[j, 2]) ** 2 / 2) for i in range(50) for j in range(i)]
    for lag in range(6):
        own = [g for x, g in d if lag * 100 - 50 <= x < (lag + 1) * 100 + 50]
        assert got[lag][1] == len(own) and got[lag][0] == pytest.approx(np.mean(own))


def test_grid_rules(spark):
    assert grid.regular(spark, Grid(bounds=(0, 10, 0, 5), nx=3, ny=2)).orderBy("id").collect()[4][3:] == (5.0, 5.0)
    assert grid.info(Grid(bounds=(0, 100, 0, 50), cell_size=10))["nx"] == 10
    assert "error" in grid.info(Grid(bounds=(0, 1, 0, 1), nx=2000, ny=2000)) and "error" in grid.info(Grid(bounds=(1, 0, 0, 1)))
    assert grid.info(Grid(bounds=(0, 500, 0, 5)))["nx"] == 50 and grid.info(Grid(bounds=(0, 1, 0, 1), nx=1, ny=1))["dx"] == 0
    assert grid.grid_bounds(Grid(bounds=(0, 10, 0, 10), buffer=0.1), None) == (-1, 11, -1, 11) and grid.grid_bounds(Grid(bounds=(0, 10, 0, 10), buffer=2), None) == (-2, 12, -2, 12)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "1", "2", "3"), (2, "1", "2", "9"), (3, "NA", "2", "3"), (4, "5", "-", "1"), (5, "7", "8", "x"), (6, "2", "2", "4"), (7, "3", "2", "NaN"), (8, "9", "9", "1e3")], "id long, a string, b string, v string")
    out = clean.training_points(df, "a", "b", "v")
    assert sorted((r.id, r.x, r.value) for r in out.collect()) == [(1, 1.0, 3.0), (6, 2.0, 4.0), (8, 9.0, 1000.0)]
    with pytest.raises(ValueError):
        clean.training_points(df.limit(1), "a", "b", "v")
    assert clean.roles(["Dhid", "East", "North", "Elev", "TD"]) == {"x": "East", "y": "North", "z": "Elev"}
    assert {(r.level, r.rule) for r in clean.validate(df, "a", "b", "v").collect()} >= {("warning", "few rows"), ("error", "v: not numeric")}
    assert clean.validate(df, "a", "zz", "v").first().level == "error"
    filled = clean.load_settings(spark.createDataFrame([(1, 1.0, 1.0, 5.0), (2, 2.0, 1.0, None), (3, 1.0, 1.0, 7.0)], "id long, a double, b double, v double"), "a", "b", ["v"], "id", fill=True)
    assert [tuple(r) for r in filled.orderBy("id").collect()] == [(1, 1.0, 1.0, 5.0), (2, 2.0, 1.0, 5.0)]


def test_intervals(spark):
    rows = [("a", 0.0, 1.0, 1.0), ("a", 1.0, 2.5, 3.0), ("a", 4.0, 5.0, None), ("b", 10.0, 10.4, 5.0)]
    df = spark.createDataFrame(rows, "hole string, f double, t double, v double")
    got = {(r.hole, r["from"]): (r.v, r.recovery, r.n_intervals) for r in compositing.composite_intervals(df, "hole", "f", "t", ["v"], 2.0).collect()}
    assert got == {("a", 0.0): (2.0, 1.0, 2), ("a", 4.0): (None, 0.5, 1)}


def test_declustering(spark):
    p = points(spark, [(0, 0, 1), (0.1, 0, 1), (0, 0.1, 1), (10, 10, 9), (9, 0, 4), (0, 9, 5)])
    for out in (compositing.decluster_cells(p, 1.0), compositing.decluster_distance(p, 2)):
        w = {r.id: r.weight for r in out.collect()}
        assert sum(w.values()) == pytest.approx(6) and w[3] > w[0]
    assert compositing.decluster_distance(p.limit(2), 5).first().weight == 1.0
    assert {r.weight for r in compositing.decluster_polygons(p).collect()} == {1.0}  # all cells are open
    lattice = points(spark, [(i, j, 0) for i in range(5) for j in range(5)])
    assert compositing._cell_area(2, 2, [1, 3, 2, 2], [2, 2, 1, 3], (-9, 9, -9, 9)) == pytest.approx(1.0)
    assert {round(r.weight, 6) for r in compositing.decluster_polygons(lattice).collect()} == {1.0}


def test_polygon_areas_are_exact(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(50, 0.01, (150, 2)), rng.uniform(0, 100, (60, 2)), np.full((60, 2), 48.0), [[0, 0], [0, 100], [100, 0], [100, 100]]])
    got = {r.id: r.weight for r in compositing.decluster_polygons(points(spark, [(x, y, 0) for x, y in xy])).collect()}
    box = (-1e8, 1e8, -1e8, 1e8)
    near = [xy[np.argsort(np.hypot(*(xy - p).T))] for p in xy]
    areas = [compositing._cell_area(x, y, n[:, 0].tolist(), n[:, 1].tolist(), box) for (x, y), n in zip(xy.tolist(), near)]
    middle = np.median([a for a in areas if a is not None])
    want = np.array([middle if a is None else a for a in areas])
    assert [got[i] for i in range(len(xy))] == pytest.approx(want / want.mean(), rel=1e-5)


def test_ranks(spark):
    v = [3.0, 1.0, 2.0, 2.0, None, 7.0, 2.0]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    got = {r.id: r.k for r in ranks.average_ranks(df, "v", "k").collect()}
    assert got == {0: 5.0, 1: 1.0, 2: 3.0, 3: 3.0, 4: None, 5: 6.0, 6: 3.0}
    assert [r.row for r in ranks.numbered(spark.range(1000).repartition(7), ["id"]).orderBy("id").collect()] == list(range(1, 1001))


def test_kendall_against_loops(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.randrange(5)) for _ in range(60)]
    s = sum(np.sign(a - c) * np.sign(b - d) for i, (a, b) in enumerate(rows) for c, d in rows[:i])
    n = 60 * 59 / 2
    ties = [sum(k * (k - 1) / 2 for k in np.unique([r[i] for r in rows], return_counts=True)[1]) for i in (0, 1)]
    assert correlation.kendall(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().tau == pytest.approx(s / math.sqrt((n - ties[0]) * (n - ties[1])))
    assert correlation.clusters(np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1.0]]), 2) == [0, 0, 1]
    assert correlation.significance(spark, 0.5, 30)["p"] == pytest.approx(0.00490, abs=1e-4)


def test_normality(spark):
    rng = np.random.default_rng(0)
    normal = spark.createDataFrame([(float(x),) for x in rng.normal(100, 15, 1000)], "v double")
    skewed = spark.createDataFrame([(float(x),) for x in rng.exponential(2, 1000)], "v double")
    assert all(r.normal for r in statistics.normality(normal, "v").collect()) and not any(r.normal for r in statistics.normality(skewed, "v").collect())
    low, high = statistics.confidence_intervals(normal, "v").first()[2:]
    assert low < 100 < high


def test_outliers_find_planted(spark):
    rng = np.random.default_rng(3)
    rows = [(*rng.uniform(0, 100, 2), v) for v in [*rng.normal(50, 10, 95), 100.0, 0.0, 150.0, -20.0, 200.0]]
    p = points(spark, rows)
    for f, must in ((outliers.fences, {97, 98, 99}), (outliers.z_scores, {97, 99}), (outliers.modified_z, {97, 98, 99}), (outliers.grubbs, {99}), (outliers.mahalanobis, {97, 99}), (outliers.robust_distance, {97, 98, 99}), (outliers.isolation, {97, 99}), (outliers.one_class, {97, 99})):
        assert must <= {r.id for r in f(p).collect()}, f.__name__
    assert outliers.votes([outliers.fences(p), outliers.z_scores(p)]).where("id = 99").first().unanimous


@pytest.mark.parametrize("block", [3, 40, 1000])
def test_grubbs_goes_on(spark, block):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 1, 300), 10.0 ** np.linspace(2, 9, 30), -(10.0 ** np.linspace(2, 9, 15))])
    want, left = set(), list(range(len(v)))
    while True:
        x = v[left]
        n, z = len(x), np.abs(x - x.mean()) / x.std(ddof=1)
        t = statistics.t_critical(spark, 1 - 0.05 / (2 * n), n - 2)
        if z.max() <= (n - 1) / n**0.5 * (t * t / (n - 2 + t * t)) ** 0.5:
            break
        want.add(left.pop(int(z.argmax())))
    assert len(want) > 20
    assert {r.id for r in outliers.grubbs(points(spark, [(i, 0, x) for i, x in enumerate(v.tolist())]), **({"block": block} if block != 1000 else {})).collect()} == want


def test_one_class_fits_all_points(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(0, 1, (1400, 3))
    x = (rows - rows.mean(0)) / rows.std(0)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (3 * x.var()))
    alpha, top = np.full(len(x), 1 / len(x)), 10 / len(x)
    slope = k @ alpha
    while True:
        up, down = np.where(alpha < top - 1e-12, slope, np.inf), np.where(alpha > 1e-12, slope, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < 1e-6:
            break
        step = min((slope[j] - slope[i]) / max(2 - 2 * k[i, j], 1e-12), top - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        slope += step * (k[i] - k[j])
    rho = slope[(alpha > 1e-9) & (alpha < top - 1e-9)].mean()
    got = {r.id for r in outliers.one_class(points(spark, rows.tolist())).collect()}
    assert {int(i) for i in np.flatnonzero(slope < rho - 1e-4)} <= got <= {int(i) for i in np.flatnonzero(slope < rho + 1e-4)}
    with pytest.raises(ValueError):
        outliers.one_class(points(spark, rows.tolist()), most=1399)


def test_dbscan_and_hull(spark):
    rng = np.random.default_rng(5)
    p = points(spark, [(x, y, 0) for x, y in np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[50.0, 50.0]]])])
    got = {r.id: r.cluster for r in spatial.dbscan(p, 0.5, 4).collect()}
    assert {got[i] for i in range(30)} == {got[0]} and {got[i] for i in range(30, 60)} == {got[30]} and got[0] != got[30] and got[60] == -1
    m = spatial.hull_measures(points(spark, [(0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0), (1, 1, 0)])).first()
    assert (m.area, m.perimeter) == pytest.approx((12, 14)) and spatial.hull_measures(p.limit(1)).first().area == 0


def test_bootstrap_and_monte_carlo(spark, field):
    t = points(spark, [(500, 500, 0), (100, 900, 0)])
    for f in (lambda: validation.bootstrap_idw(field, t, 40), lambda: validation.monte_carlo_idw(field, t, 1.0, 40)):
        one, two = (sorted(map(tuple, f().collect())) for _ in range(2))
        assert one == two and all(low <= mean <= high and std > 0 for _, mean, std, low, high in one)
    assert validation.sobol(lambda a: 4 * a["p"] + a["q"], {"p": (0, 1), "q": (0, 1)}, 400)["p"]["total"] > 0.8
    assert validation.morris(lambda a: 3 * a["p"], {"p": (0.0, 2.0)})["p"]["mean"] == pytest.approx(6)


def test_folds(spark, field):
    assert {r["count"] for r in validation.folds(field, 5).groupBy("fold").count().collect()} == {10}
    s = validation.stratified_folds(field, 5, 5).groupBy("stratum", "fold").count().collect()
    assert {r["count"] for r in s} == {2}
    assert validation.spatial_folds(field, 3).select("fold").distinct().count() == 3


def test_recommendation(spark, field):
    out = recommend.recommend(field).collect()
    assert [r.score for r in out] == sorted((r.score for r in out), reverse=True) and {r.method for r in out} == {"idw", "kriging", "rbf"}
    c = {"n": 40, "density": 1, "uniformity": 0.8, "outliers": 0, "trend": False, "anisotropy": 0.9, "clustering": 0.2, "cv": 0.5, "range": 10, "std": 1}
    assert recommend.scores(c) == {"idw": 85.0, "kriging": 50.0, "rbf": 80.0}


def test_formats(spark):
    row = spark.range(1).select(scalar.format_dms(F.lit(-12.5)).alias("a"), scalar.format_percentage(F.lit(0.125)).alias("b"), scalar.format_short(F.lit(2500000.0)).alias("c"), scalar.parse_number(F.lit("1.234,5 ₽"), "ru_RU").alias("d"), scalar.parse_number(F.lit("$1,234.5")).alias("e"), scalar.parse_date(F.lit("31.12.2023")).cast("string").alias("f"), scalar.format_number(F.lit(float("nan"))).alias("g"), scalar.normal_cdf(F.lit(1.96)).alias("h")).first()
    assert row[:3] == ("-12°30'0.00\"", "12.5%", "2.5M") and row.e == 1234.5 and row.f == "2023-12-31" and row.g == "N/A" and row.h == pytest.approx(0.9750021, abs=1e-6)


def test_quality(spark):
    df = spark.createDataFrame([(1.0, "a", 9500.0), (2.0, None, 10.0), (2.0, "c", -600.0)], "grade double, name string, elevation double")
    assert {(r.rule, r.n) for r in quality.business_rules(df).collect()} == {("height", 2), ("negative", 0)}
    assert {r.column for r in quality.completeness(df).where("critical").collect()} == {"name"}
    assert quality.score(1.0, 0.0, 0.0) == (100.0, "excellent") and quality.score(0.5, 0.5, 0)[1] == "unusable" or quality.score(0.5, 0.5, 0)[0] == 0


def _plain(v):
    return None if v is None or v != v else round(v, 5) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = plans.QUERIES[name](spark, sf)
    want = con.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(([_plain(r[c]) for c in order] for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in order]
    assert got == sorted(([_plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_entry_without_text_operators(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(plans.SQL) <= set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_relational_and_further_operators(spark, field):
    from stratafold.operators import more

    rng = np.random.default_rng(0)
    normal = spark.createDataFrame([(float(x),) for x in rng.normal(0, 1, 200)], "v double")
    skewed = spark.createDataFrame([(float(x),) for x in rng.exponential(1, 200)], "v double")
    (w, p), (w2, p2) = more.shapiro(normal, "v"), more.shapiro(skewed, "v")
    assert w > 0.98 and p > 0.05 and w2 < 0.9 and p2 < 1e-6
    assert abs(more.best_power(skewed.select(F.exp("v").alias("v")), "v", "box_cox")) < 1.2
    found = more.rbf_search(field.limit(20), ("gaussian",), 3, (1e-6,)).collect()
    assert len(found) == 3 and all(r.rmse > 0 for r in found)
    words = spark.createDataFrame([("open",), ("close",)], "message string")
    table = spark.createDataFrame([("open", "öffnen"), ("menu|open", "auf")], "key string, text string")
    assert {r.message: r.translated for r in more.translate(words, "message", table, "menu").collect()} == {"open": "auf", "close": "close"}
    assert more.method_checks(field.limit(8), "kriging").where("level = 'error'").count() == 1
    assert more.create_table_sql("w", {"id": "INTEGER"})[0] == "CREATE TABLE IF NOT EXISTS w (id INTEGER)"
    assert more.table_info(field).count() == 4
