"""SQL of queries registered elsewhere, and queries of methods whose results on chosen inputs SQL can state.

Kriging and radial bases have no SQL in general, but they reproduce the data at the data's places and, with a drift or
a polynomial, planes and squares everywhere; resampling without noise gives the plain estimate.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.model import Grid, Kriging, Rbf, Search, Variogram
from stratafold.operators import compositing, grid, interpolate, outliers, spatial, validation
from stratafold.plans.queries import _EM_LOO, _EMS, _FENCE, _METRICS, _MODZ, _ZED, IDW_SQL, KNN_SQL, NEAR_SQL, SQL, R, nodes_sql, register
from stratafold.plans.tables import table, vector_points, with_

_NODES = Grid(bounds=(-0.3, 0.3, -0.3, 0.3), nx=12, ny=12)
_NODES_SQL = nodes_sql(-0.3, 0.3, 12, -0.3, 0.3, 12)
_FOLD_LOO = f", {NEAR_SQL.format(q='em', n='em', w='q.id % 5 <> n.id % 5', r=0.1, k=12)}, lv AS (SELECT em.id, em.value AS a, e.estimate AS p FROM em JOIN (SELECT qid, {IDW_SQL} AS estimate FROM near GROUP BY qid) e ON e.qid = em.id)"
_TO_NODES = "kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS dist, n.value FROM nodes q, em n)) WHERE rank <= {k})"

# --- SQL of registered queries -----------------------------------------------------------------------------------

SQL["shuffled_folds"] = with_("em") + "SELECT id, CAST((row_number() OVER (ORDER BY md5('42:' || id), id) - 1) % 5 AS BIGINT) AS fold FROM em"
SQL["stratified_folds"] = (
    with_("em")
    + ", b AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS b FROM em), s AS (SELECT id, CAST(len(list_filter(b, lambda x: value >= x)) AS BIGINT) AS stratum FROM em, b) "
    + "SELECT id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) - 1) % 5 AS BIGINT) AS fold FROM s"
)
_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
SQL["column_info"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS n_null, "
    + ", ".join(R(f"{f}({c})" if t in ("bigint", "double") else "NULL", n) for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std")))
    + " FROM orders"
    for c, t in _KINDS.items()
)
SQL["nearest_grid"] = with_("em") + f", {nodes_sql(-0.3, 0.3, 20, -0.3, 0.3, 20)}, {_TO_NODES.format(k=1)} SELECT nodes.id, {R('kn.value', 'value')} FROM nodes LEFT JOIN kn ON kn.qid = nodes.id AND kn.dist < 0.06"
SQL["nearest_with_fallback"] = (
    with_("em")
    + ", al AS (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS dist FROM em q, em n), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM al), nr AS (SELECT * FROM rk WHERE dist <= 0.03 AND rank <= 4), ok AS (SELECT qid FROM nr GROUP BY qid HAVING count(*) >= 3) "
    + f"SELECT qid, nid, {R('dist', 'dist')}, rank FROM nr WHERE qid IN (SELECT qid FROM ok) UNION ALL SELECT qid, nid, {R('dist', 'dist')}, rank FROM rk WHERE rank <= 4 AND qid NOT IN (SELECT qid FROM ok)"
)
SQL["error_autocorrelation"] = (
    with_("em")
    + _EM_LOO
    + f", e AS (SELECT em.id, em.x, em.y, p - a AS value FROM lv JOIN em USING (id) WHERE p IS NOT NULL), pr AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, a.value AS vi, b.value AS vj FROM e a JOIN e b ON a.id < b.id), m AS (SELECT avg(value) AS m, count(*) AS n, var_pop(value) * count(*) AS v FROM e) SELECT {R('max(n) * sum(2 / dist * (vi - m) * (vj - m)) / (sum(2 / dist) * max(v))', 'moran_i')} FROM pr, m WHERE dist > 0 AND dist <= 0.1"
)
SQL["ensemble_summary"] = with_("em") + f", {_FENCE}, {_ZED}, {_MODZ}, c AS (SELECT id, count(*) AS v FROM (SELECT * FROM fl UNION SELECT * FROM fz UNION SELECT * FROM fm) GROUP BY id) SELECT CAST(3 AS BIGINT) AS methods, count(*) AS \"any\", count(*) FILTER (WHERE v * 2 > 3) AS majority, count(*) FILTER (WHERE v = 3) AS \"all\", {R('count(*) FILTER (WHERE v = 3) / count(*)', 'agreement')} FROM c"
SQL["fold_variability"] = with_("em") + _FOLD_LOO + f", f AS (SELECT id % 5 AS fold, sqrt(avg(pow(p - a, 2))) AS r, avg(abs(p - a)) AS m FROM lv WHERE p IS NOT NULL GROUP BY 1) SELECT {R('avg(r)', 'mean_rmse')}, {R('stddev_samp(r)', 'std_rmse')}, {R('avg(m)', 'mean_mae')}, {R('stddev_samp(m)', 'std_mae')} FROM f"
_CLASS = "(greatest(r2, 0) + least(greatest((r2 + 1) / 2, 0), 1) + greatest(willmott, 0) + greatest(1 - mape / 100, 0)) / 4"
SQL["quality_class"] = f"SELECT {R(_CLASS, 'score')}, CASE WHEN {_CLASS} >= 0.9 THEN 'excellent' WHEN {_CLASS} >= 0.8 THEN 'good' WHEN {_CLASS} >= 0.7 THEN 'fair' WHEN {_CLASS} >= 0.6 THEN 'poor' ELSE 'bad' END AS label FROM ({SQL['leave_one_out']})"
SQL["distance_uncertainty"] = with_("em") + f", {_NODES_SQL}, {_TO_NODES.format(k=5)}, d AS (SELECT qid AS id, avg(dist) AS d FROM kn GROUP BY qid), s AS (SELECT stddev_pop(value) AS s FROM em), m AS (SELECT avg(d) AS m FROM d) SELECT id, {R('s * d / m', 'uncertainty')}, {R('1.96 * s * d / m', 'half_width')} FROM d, s, m"
SQL["method_comparison"] = " UNION ALL ".join(f"SELECT *, 'power {p}' AS method FROM (" + with_("em") + _EM_LOO.replace("pow(dist, 2)", f"pow(dist, {p})") + _METRICS.format(lead="") + ")" for p in (1, 2, 3))
_ESTIMATES = with_("pt", "up") + f", {nodes_sql(0.0, 96.0, 25, 1.0, 50.0, 15)}, {NEAR_SQL.format(q='nodes', n='up', w='true', r=8.0, k=12)}, g AS (SELECT ix, iy, x, y, e.estimate AS v FROM nodes JOIN (SELECT qid, {IDW_SQL} AS estimate FROM near GROUP BY qid) e ON e.qid = nodes.id)"
SQL["contour_crossings"] = _ESTIMATES + f", b AS (SELECT min(v) AS lo, max(v) AS hi FROM g), l AS (SELECT lo + (hi - lo) * k / 4 AS level FROM b, (SELECT unnest([1, 2, 3]) AS k)), e AS (SELECT a.x, a.y, a.v, c.x AS x2, c.y AS y2, c.v AS v2 FROM g a JOIN g c ON (c.ix = a.ix + 1 AND c.iy = a.iy) OR (c.ix = a.ix AND c.iy = a.iy + 1)) SELECT {R('level', 'level')}, {R('x + (level - v) / (v2 - v) * (x2 - x)', 'x')}, {R('y + (level - v) / (v2 - v) * (y2 - y)', 'y')} FROM e, l WHERE (v < level) <> (v2 < level)"


# --- methods on inputs whose results are known -------------------------------------------------------------------

_PLANE, _SQUARES = "1 + 2 * x - 3 * y", "1 + 2 * x - 3 * y + 4 * x * x - x * y + 2 * y * y"
_SMOOTH = Variogram("exponential", 0.0, 0.02, 0.3)


def _valued(s, d, value: str):
    return vector_points(s, d).withColumn("value", F.expr(value))


def _at_points(name: str, estimate):
    register(name, with_("em") + f"SELECT id, {R('value', 'estimate', 4)} FROM em", 4)(lambda s, d: estimate(vector_points(s, d), vector_points(s, d)).select("id", "estimate"))


_at_points("kriging_at_points", lambda p, t: interpolate.kriging(p, t, _SMOOTH, variance=False))
_at_points("simple_kriging_at_points", lambda p, t: interpolate.kriging(p, t, _SMOOTH, Kriging("simple")))
_at_points("local_kriging_at_points", lambda p, t: interpolate.kriging(p, t, _SMOOTH, search=Search(radius=0.1, max_points=8, min_points=3)))
_at_points("solid_kriging_at_points", lambda p, t: interpolate.kriging(p, t, _SMOOTH, axes=("x", "y", "z")))
_at_points("rbf_at_points", lambda p, t: interpolate.rbf(p, t, Rbf("linear")))
_at_points("local_rbf_at_points", lambda p, t: interpolate.rbf(p, t, Rbf("linear"), Search(radius=0.1, max_points=8, min_points=3)))


@register("kriging_of_constant", f"WITH {_NODES_SQL} SELECT id, {R('5', 'estimate')} FROM nodes")
def _(s, d):
    return interpolate.kriging(_valued(s, d, "5.0D"), grid.regular(s, _NODES), _SMOOTH, variance=False).select("id", "estimate")


@register("kriging_of_plane", f"WITH {_NODES_SQL} SELECT id, {R(_PLANE, 'estimate', 4)} FROM nodes", 4)
def _(s, d):
    return interpolate.kriging(_valued(s, d, _PLANE), grid.regular(s, _NODES), _SMOOTH, Kriging("universal"), variance=False).select("id", "estimate")


@register("rbf_of_plane", f"WITH {_NODES_SQL} SELECT id, {R(_PLANE, 'estimate', 4)} FROM nodes", 4)
def _(s, d):
    return interpolate.rbf(_valued(s, d, _PLANE), grid.regular(s, _NODES), Rbf("linear", degree=1))


@register("rbf_of_squares", f"WITH {_NODES_SQL} SELECT id, {R(_SQUARES, 'estimate', 4)} FROM nodes", 4)
def _(s, d):
    return interpolate.rbf(_valued(s, d, _SQUARES), grid.regular(s, _NODES), Rbf("cubic", degree=2))


@register("bootstrap_of_constant", with_("em") + f", {_NODES_SQL} SELECT nodes.id, {R('7', 'mean')}, {R('0', 'std')}, {R('7', 'low')}, {R('7', 'high')} FROM nodes WHERE EXISTS (SELECT 1 FROM em WHERE sqrt(pow(em.x - nodes.x, 2) + pow(em.y - nodes.y, 2)) < 0.1)")
def _(s, d):
    return validation.bootstrap_idw(_valued(s, d, "7.0D"), grid.regular(s, _NODES), search=_EMS)


@register("monte_carlo_without_noise", with_("em") + f", {_NODES_SQL}, {NEAR_SQL.format(q='nodes', n='em', w='true', r=0.1, k=12)}, e AS (SELECT qid AS id, {IDW_SQL} AS e FROM near GROUP BY qid) SELECT id, {R('e', 'mean', 5)}, {R('0', 'std', 5)}, {R('e', 'low', 5)}, {R('e', 'high', 5)} FROM e", 5)
def _(s, d):
    return validation.monte_carlo_idw(vector_points(s, d), grid.regular(s, _NODES), 0.0, 20, _EMS)


def _apart(s, d):
    """Five groups of five places, far from one another."""
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 100.0 + F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("value"))


@register("clusters_apart", "SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation")
def _(s, d):
    found = spatial.dbscan(_apart(s, d), 1.5, 2)
    label = next(c for c in found.columns if c != "id")
    least = found.groupBy(label).agg(F.min("id").alias("first"))
    return found.join(least, label).select("id", "first")


@register("hull_of_grid", f"SELECT {R('96.0 * 49', 'area')}, {R('2 * (96.0 + 49)', 'perimeter')}, {R('4 * pi() * 96 * 49 / pow(2 * (96.0 + 49), 2)', 'compactness')}")
def _(s, d):
    return spatial.hull_measures(grid.regular(s, Grid(bounds=(0.0, 96.0, 1.0, 50.0), nx=25, ny=15)))


@register("polygons_of_grid", f"SELECT i AS id, {R('1', 'weight')} FROM range(375) t(i)")
def _(s, d):
    return compositing.decluster_polygons(grid.regular(s, Grid(bounds=(0.0, 24.0, 0.0, 14.0), nx=25, ny=15)).withColumn("value", F.lit(1.0))).select("id", "weight")


@register("planted_outliers", "SELECT p_partkey AS id FROM part WHERE p_partkey % 1000 = 7")
def _(s, d):
    """Far points that robust distances flag at a contamination of their own share."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).cast("double").alias("x"), (F.col("p_partkey") % 89).cast("double").alias("y"), (F.col("p_partkey") % 83).cast("double").alias("value"))
    far = p.withColumns({c: F.when(F.col("id") % 1000 == 7, F.col(c) + 5000).otherwise(F.col(c)) for c in ("x", "y", "value")})
    return outliers.robust_distance(far, 0.001).select("id")
