"""Crowded points: searches and sums over pairs in which no pair becomes a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.model import Search
from stratafold.operators import bundles, interpolate, neighbours, spatial, statistics, tuning, validation, variograms

RADIUS = 3.0


def _rows(n=300):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(v), i % 3) for i, (x, y, v) in enumerate(np.column_stack([rng.normal(0, 1, (n, 2)).round(1), rng.normal(0, 1, n)]))]
    rows += [(1000 + i, 0.5, 0.5, float(i), i % 2) for i in range(80)]  # copies of one place
    rows += [(2000, 9.0, 9.0, 1.0, 0), (2001, None, 0.0, 1.0, 0), (2002, float("nan"), 0.0, 1.0, 0), (2003, 0.2, 0.1, None, 1)]
    return rows


@pytest.fixture(scope="module")
def crowd(spark):
    return spark.createDataFrame(_rows(), "id long, x double, y double, value double, fold int").localCheckpoint()


@pytest.fixture
def no_pairs(monkeypatch):
    """Fails whatever makes a row of each pair within the radius."""

    def none(*_, **__):
        raise AssertionError("pairs became rows")

    for module in (neighbours, validation, tuning, spatial):
        monkeypatch.setattr(module, "radius_join", none)
    for module in (neighbours, spatial, variograms):
        monkeypatch.setattr(module, "pairs", none)


def _near(k, test=lambda q, n: q[0] != n[0], sector=None, radius=RADIUS, closed=False):
    out, rows = set(), [r for r in _rows() if r[1] is not None and r[1] == r[1]]
    for q in rows:
        found = {}
        for n in rows:
            d = float(np.sqrt((n[1] - q[1]) ** 2 + (n[2] - q[2]) ** 2))
            if (d <= radius if closed else d < radius) and test(q, n):
                found.setdefault(sector(q, n) if sector else 0, []).append((d, n[0]))
        for s, near in found.items():
            out |= {(q[0], n, s, i + 1) for i, (_, n) in enumerate(sorted(near)[:k])}
    return out


def _got(df, *more):
    return {(r.qid, r.nid, *(r[c] for c in more), r["rank"]) for r in df.collect()}


def test_nearest_within_a_radius(crowd, no_pairs):
    found = _got(neighbours.radius_nearest(crowd, crowd, 5, RADIUS, other=True).withColumn("s", F.lit(0)), "s")
    assert found == _near(5)


def test_nearest_in_other_folds(crowd, no_pairs):
    found = interpolate.fold_nearest(crowd, "fold", Search(radius=RADIUS, max_points=4)).withColumn("s", F.lit(0))
    assert _got(found, "s") == _near(4, lambda q, n: q[4] != n[4])


def test_sectors(crowd, no_pairs):
    def sector(q, n):
        t = np.arctan2(n[2] - q[2], n[1] - q[1])
        return min(int(np.floor((t + 2 * np.pi if t < 0 else t) / (np.pi / 2))), 3)

    assert _got(neighbours.sector_join(crowd, crowd, RADIUS, 4, 2, keep=()), "sector") == _near(2, lambda q, n: True, sector, closed=True)


def test_errors_of_crowded_points(crowd, no_pairs):
    search = Search(radius=RADIUS, max_points=5)
    left = interpolate.idw_leave_one_out(crowd, search)
    assert left.count() == len(_rows()) and left.where("predicted is not null").count() == len(_rows()) - 3
    assert statistics.error_distribution(left).count() == 1 and bundles.directional_errors(left).count() == 8
    powers = validation.compare(crowd, {"one": (search, 1.0), "two": (search, 2.0)}).collect()
    assert len(powers) == 2 and powers[0].rmse != powers[1].rmse


def test_resampled_metric(spark, crowd, monkeypatch):
    search = Search(radius=RADIUS, max_points=5)
    monkeypatch.setattr(neighbours, "DENSE", 10**9)
    plain = {r.rep: (r.n, pytest.approx(r.metric)) for r in tuning.bootstrap_metric(crowd, replicates=4, search=search).collect()}
    monkeypatch.undo()
    found = {r.rep: (r.n, r.metric) for r in tuning.bootstrap_metric(crowd, replicates=4, search=search).collect()}
    assert found == plain
    # too few neighbours were kept: the replicates that lack some are made good from all
    monkeypatch.setattr(tuning, "ceil", lambda _: 6)
    assert {r.rep: (r.n, r.metric) for r in tuning.bootstrap_metric(crowd, replicates=4, search=search).collect()} == plain


def _lags(rows, width, lags, inside=lambda dx, dy: True):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] or not inside(b[1] - a[1], b[2] - a[2]):
                continue
            d = float(np.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2))
            for k in range(lags):
                if k * width - 0.5 * width <= d < (k + 1) * width + 0.5 * width:
                    n, g = out.setdefault(k, (0, []))
                    out[k] = (n + 1, g + ([(a[3] - b[3]) ** 2 / 2] if None not in (a[3], b[3]) else []))
    return {k: (n, pytest.approx(np.mean(g))) for k, (n, g) in out.items()}


@pytest.mark.parametrize("block", [4096, 70])
def test_variograms(crowd, no_pairs, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "AT_ONCE", 5000)
    rows = [r for r in _rows() if r[1] is not None and r[1] == r[1]]
    found = {r.lag: (r.n_pairs, r.gamma) for r in variograms.experimental(crowd, 2.0, 5).collect()}
    assert found == _lags(rows, 0.4, 5)

    def inside(a):
        def test(dx, dy):
            az = np.degrees(np.arctan2(dy, dx))
            az = az + 180 if az < 0 else az - 180 if az >= 180 else az
            return min(abs(az - a), abs(abs(az - a) - 180)) <= 45

        return test

    found = {}
    for r in variograms.directional(crowd, 2.0, 5, 4, direction_tolerance=45.0).collect():
        found.setdefault(r.direction, {})[r.lag] = (r.n_pairs, r.gamma)
    assert found == {a: _lags(rows, 0.4, 5, inside(a)) for a in (0.0, 45.0, 90.0, 135.0)}


def test_autocorrelation(crowd, no_pairs, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 90)
    rows = [r for r in _rows() if r[1] is not None and r[1] == r[1]]
    at, v = np.array([r[1:3] for r in rows]), np.array([np.nan if r[3] is None else r[3] for r in rows])
    known = np.array([r[3] for r in _rows() if r[3] is not None])
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    w = np.where((d > 0) & (d <= RADIUS), 1 / np.where(d > 0, d, 1), 0)
    z = np.nan_to_num(v - known.mean())
    expected = len(_rows()) * (z @ w @ z) / (w.sum() * ((known - known.mean()) ** 2).sum())
    assert spatial.moran(crowd, RADIUS).first().moran_i == pytest.approx(expected)


def test_crowded_analysis(crowd, no_pairs):
    assert {r.section for r in bundles.analyse_variogram(crowd, 2.0, 5).select("section").distinct().collect()} == {"experimental", "directional", "models"}
    assert variograms.anisotropy(crowd, 2.0, 5).count() == 4


def test_local_kriging_of_crowded_points(crowd, no_pairs):
    known = crowd.where("value is not null and x is not null and not isnan(x) and id < 1000")
    found = tuning.krige_folds(known, "fold", variograms.Variogram("spherical", 0.1, 1.0, 2.0), Search(radius=RADIUS, max_points=6))
    assert found.count() == 300 and found.where("predicted is null or isnan(predicted)").isEmpty()


def _table(folder, name):
    """An embeddings table whose middle is crowded and whose rim is sparse, so that a search takes several rounds."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    at = np.concatenate([rng.normal(0.05, 0.02, (500, 2)), rng.normal(0, 0.2, (100, 2))])
    rows = np.column_stack([at, rng.normal(0, 0.1, (600, 2))]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(600), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 600, pa.int32())}), f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", ["sector_join", "residuals", "gridded_errors", "leave_one_out", "method_comparison"])
def test_sparse_places_beside_crowded_ones_as_in_sql(spark, tmp_path, no_pairs, name):
    import __spark_entry__ as entry
    import duckdb

    _table(tmp_path, "embeddings")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
