"""Queries of functions, of checks by name, and of whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.functions import scalar as S
from stratafold.model import Grid, Rbf, Search
from stratafold.operators import bundles, clean, correlation, grid, more, panels, quality, tuning, validation
from stratafold.operators import interpolate as ip
from stratafold.plans.queries import _EM_LOO, _EMS, _PEARSON, _VARS, IDW_SQL, KNN_SQL, NEAR_SQL, R, register
from stratafold.plans.tables import part_points, place_points, table, vector_points, with_

_FOLDED = lambda s, d: vector_points(s, d).withColumn("fold", F.col("id") % 5)


# --- functions ---------------------------------------------------------------------------------------------------


@register("further_models", f"SELECT i AS h, {R('CASE WHEN i <= 0 THEN 0 ELSE 1 + 3 * i END', 'linear')}, {R('CASE WHEN i <= 0 THEN 0 ELSE 1 + 3 * pow(i, 1.5) END', 'power')}, {R('CASE WHEN i <= 0 THEN 0 ELSE 1 END', 'nugget')} FROM (SELECT CAST(unnest(range(25)) AS DOUBLE) AS i)")
def _(s, d):
    h = F.col("h")
    return s.range(25).select(F.col("id").cast("double").alias("h")).select("h", *(S.variogram(k, h, 1, 3, 1.5, "kriging").alias(k) for k in ("linear", "power", "nugget")))


@register("further_kernels", f"SELECT i AS r, {R('i', 'linear')}, {R('pow(i, 5)', 'quintic')} FROM (SELECT CAST(unnest(range(10)) AS DOUBLE) AS i)")
def _(s, d):
    r = F.col("r")
    return s.range(10).select(F.col("id").cast("double").alias("r")).select("r", S.kernel("linear", r).alias("linear"), S.kernel("quintic", r).alias("quintic"))


@register("short_numbers", "SELECT c_custkey, CASE WHEN abs(v) >= 1e6 THEN format('{:.1f}M', v / 1e6) WHEN abs(v) >= 1e3 THEN format('{:.1f}K', v / 1e3) ELSE format('{:.1f}', v) END AS short FROM (SELECT c_custkey, CAST(c_custkey * 1000 + 3 AS DOUBLE) AS v FROM customer)")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", S.format_short(F.col("c_custkey") * 1000.0 + 3).alias("short"))


@register("percentages_and_prices", "SELECT n_nationkey, format('{:.1f}%', n_nationkey / 32.0 * 100) AS share, '$' || format('{:,.2f}', n_nationkey * 1000.0) AS us, translate(format('{:,.2f}', n_nationkey * 1000.0), ',.', chr(160) || ',') || ' ₽' AS ru FROM nation")
def _(s, d):
    n = F.col("n_nationkey").cast("double")
    return table(s, d, "nation").select("n_nationkey", S.format_percentage(n / 32).alias("share"), S.format_currency(n * 1000).alias("us"), S.format_currency(n * 1000, "ru_RU").alias("ru"))


@register("coordinate_formats", """SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN '-' ELSE '' END || abs(n_nationkey - 10) || '°15''0.00"' AS dms FROM nation WHERE n_nationkey >= 10 OR n_nationkey < 0""")
def _(s, d):
    return table(s, d, "nation").where("n_nationkey >= 10").select("n_nationkey", S.format_dms(F.col("n_nationkey") - 10 + 0.25).alias("dms"))


@register("coordinate_precision", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 0 WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS decimals FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", S.decimals(F.col("n_nationkey").cast("double") / 4).alias("decimals"))


@register("parsed_inputs", f"SELECT n_nationkey, {R('n_nationkey * 1000 + 0.5', 'us')}, {R('n_nationkey * 1000 + 0.5', 'ru')}, DATE '2024-01-01' + n_nationkey AS day, CAST(NULL AS DOUBLE) AS none FROM nation")
def _(s, d):
    v, day = F.col("n_nationkey") * 1000 + 0.5, F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey"))
    return table(s, d, "nation").select(
        "n_nationkey", S.parse_number(F.concat(F.lit("$"), F.format_number(v, 1))).alias("us"), S.parse_number(F.concat(F.translate(F.format_number(v, 1), ",.", " ,"), F.lit(" ₽")), "ru_RU").alias("ru"), S.parse_date(F.date_format(day, "dd.MM.yyyy")).alias("day"), S.parse_number(F.col("n_name")).alias("none")
    )


@register("translated", "SELECT r_name, CASE r_name WHEN 'ASIA' THEN 'Asien (Karte)' WHEN 'EUROPE' THEN 'Europa' ELSE r_name END AS translated FROM region")
def _(s, d):
    texts = s.createDataFrame([("ASIA", "Asien"), ("map|ASIA", "Asien (Karte)"), ("EUROPE", "Europa")], "key string, text string")
    return more.translate(table(s, d, "region").select("r_name"), "r_name", texts, "map").select("r_name", "translated")


# --- checks by name ----------------------------------------------------------------------------------------------


@register("column_roles", "SELECT * FROM (VALUES ('x', 'EASTING'), ('y', 'Latitude'), ('z', 'depth_m')) t(role, name)")
def _(s, d):
    return s.createDataFrame(sorted(clean.roles(["sample", "EASTING", "Latitude", "depth_m", "lon2"]).items()), "role string, name string")


@register("value_columns", "SELECT unnest(['p_retailprice', 'depth']) AS name")
def _(s, d):
    return s.createDataFrame([(c,) for c in clean.value_columns(table(s, d, "part").withColumn("depth", F.lit(1.0)))], "name string")


@register("business_rules", "SELECT 'height' AS rule, 'elevation' AS \"column\", count(*) FILTER (WHERE p_retailprice * 10 > 9000) AS n FROM part UNION ALL SELECT 'negative', 'gold_ppm', count(*) FILTER (WHERE p_size < 10) FROM part")
def _(s, d):
    return quality.business_rules(table(s, d, "part").select((F.col("p_retailprice") * 10).alias("elevation"), (F.col("p_size") - 10).alias("gold_ppm")))


@register("quality_scores", "SELECT CAST(complete AS DOUBLE) AS complete, CAST(repeated AS DOUBLE) AS repeated, CAST(outlying AS DOUBLE) AS outlying, CAST(score AS DOUBLE) AS score, level FROM (VALUES (1.0, 0.0, 0.0, 100.0, 'excellent'), (0.95, 0.05, 0.1, 77.5, 'good'), (0.5, 0.5, 0.0, 0.0, 'unusable')) t(complete, repeated, outlying, score, level)")
def _(s, d):
    rows = [(1.0, 0.0, 0.0), (0.95, 0.05, 0.1), (0.5, 0.5, 0.0)]
    return s.createDataFrame([(*r, *quality.score(*r)) for r in rows], "complete double, repeated double, outlying double, score double, level string")


@register("composite_quality", f"SELECT * FROM (SELECT 'kept' AS what, {R('1.0', 'score')}, 'excellent' AS grade, CAST(0 AS BIGINT) AS n_issues UNION ALL SELECT 'poor', {R('0.0', 'score')}, 'poor', CAST(3 AS BIGINT))")
def _(s, d):
    rows = [("kept", panels.composite_quality(100, 50, 0.1, 0.9)), ("poor", panels.composite_quality(100, 90, 0.5, 0.5))]
    return s.createDataFrame([(k, q["score"], q["grade"], len(q["issues"])) for k, q in rows], "what string, score double, grade string, n_issues long")


@register("load_settings", with_("pt") + 'SELECT id, x AS "X", y AS "Y", value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY id) AS n FROM pt) WHERE n = 1')
def _(s, d):
    return clean.load_settings(part_points(s, d), "x", "y", ["value"], "id")


@register("fisher_intervals", "SELECT var1, var2, " + ", ".join(R(f"tanh(atanh(r) {sign} 1.959963984540054 / sqrt(n - 3))", name) for sign, name in (("-", "low"), ("+", "high"))) + f" FROM ({_PEARSON.format(t='lineitem')})")
def _(s, d):
    rows = correlation.pearson(table(s, d, "lineitem"), _VARS).collect()
    found = [(r.var1, r.var2, correlation.significance(s, r.r, r.n)) for r in rows]
    return s.createDataFrame([(a, b, f["low"], f["high"]) for a, b, f in found], "var1 string, var2 string, low double, high double")


@register("correlation_clusters", "SELECT * FROM (VALUES ('a', 0), ('b', 0), ('c', 1), ('d', 1)) t(variable, cluster)")
def _(s, d):
    import numpy as np

    m = np.array([[1, 0.9, 0.1, 0], [0.9, 1, 0, 0.1], [0.1, 0, 1, -0.8], [0, 0.1, -0.8, 1]])
    return s.createDataFrame(list(zip("abcd", correlation.clusters(m, 2))), "variable string, cluster int")


@register("rbf_advice", with_("em") + f"SELECT count(*) AS n, CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'medium' ELSE 'large' END AS size, {R('1 / ((max(x) - min(x) + max(y) - min(y)) / 2)', 'epsilon')}, {R('max(value) - min(value)', 'value_range')}, {R('count(*) / ((max(x) - min(x)) * (max(y) - min(y)))', 'density')} FROM em")
def _(s, d):
    a = tuning.rbf_advice(vector_points(s, d))
    return s.createDataFrame([tuple(a[k] for k in ("n", "size", "epsilon", "value_range", "density"))], "n long, size string, epsilon double, value_range double, density double")


@register("elementary_effects", f"SELECT * FROM (SELECT 'a' AS parameter, {R('8.0', 'mean')}, {R('8.0', 'mean_abs')}, {R('0.0', 'std')} UNION ALL SELECT 'b', {R('-3.0', 'mean')}, {R('3.0', 'mean_abs')}, {R('0.0', 'std')})")
def _(s, d):
    found = validation.morris(lambda at: 2 * at["a"] - 3 * at["b"], {"a": (0.0, 4.0), "b": (1.0, 2.0)})
    return s.createDataFrame([(k, v["mean"], v["mean_abs"], v["std"]) for k, v in found.items()], "parameter string, mean double, mean_abs double, std double")


@register("variance_shares")
def _(s, d):
    found = validation.sobol(lambda at: 2 * at["a"] + at["b"], {"a": (0.0, 1.0), "b": (0.0, 1.0)}, 512)
    return s.createDataFrame([(k, v["first"], v["total"]) for k, v in found.items()], "parameter string, first double, total double")


# --- places and errors -------------------------------------------------------------------------------------------

_BOX = "(max(x) - min(x)) * (max(y) - min(y))"


@register("spatial_distribution", with_("em") + f", {KNN_SQL.format(k=1)}, m AS (SELECT avg(dist) AS a, stddev_pop(dist) AS s, count(*) AS c FROM knn), v AS (SELECT count(*) AS v FROM knn, m WHERE dist < 0.1 * a) SELECT count(*) AS n, {R('max(x) - min(x)', 'x_range')}, {R('max(y) - min(y)', 'y_range')}, {R(_BOX, 'area')}, {R(f'count(*) / ({_BOX})', 'density', 4)}, {R('max(a)', 'mean_nearest')}, {R('max(s)', 'std_nearest')}, max(v) AS very_close, max(v) > 0.1 * count(*) AS crowded FROM em, m, v")
def _(s, d):
    return bundles.spatial_distribution(vector_points(s, d)).withColumn("density", F.round("density", 4))


@register("spatial_coverage", with_("pt") + f", c AS (SELECT count(*) AS n FROM (SELECT least(CAST(floor((x - x0) / (x1 - x0) * 10) AS BIGINT), 9) AS ix, least(CAST(floor((y - y0) / (y1 - y0) * 10) AS BIGINT), 9) AS iy FROM pt, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt)) GROUP BY ix, iy), u AS (SELECT 1 / (1 + sqrt(sum(n * n) / 100 - pow(sum(n) / 100, 2)) / (sum(n) / 100)) AS u FROM c) SELECT count(*) AS n, {R(_BOX, 'area')}, {R(f'count(*) / ({_BOX})', 'density')}, {R('max(u)', 'uniformity')} FROM pt, u")
def _(s, d):
    return bundles.spatial_coverage(part_points(s, d))


_LV = with_("em") + _EM_LOO


@register("directional_errors", _LV + f" SELECT a * 45.0 AS angle, {R('avg(p - a_)', 'bias')}, {R('sqrt(avg(pow(p - a_, 2)))', 'rmse')} FROM (SELECT a AS a_, p FROM lv), (SELECT CAST(unnest(range(8)) AS DOUBLE) AS a) GROUP BY a")
def _(s, d):
    return bundles.directional_errors(ip.idw_leave_one_out(vector_points(s, d), _EMS))


@register("trend_kind", with_("pt") + f", t AS (SELECT id, x, y, value + 5 * x + pow(y - 25, 2) AS value FROM pt) SELECT 'quadratic' AS kind, count(*) AS n FROM t")
def _(s, d):
    p = part_points(s, d).withColumn("value", F.col("value") + 5 * F.col("x") + (F.col("y") - 25) * (F.col("y") - 25))
    return bundles.trend_kind(p).select("kind").crossJoin(p.agg(F.count("*").alias("n")))


_LIKE = "ln(sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * {h} * {h})))) - ln((SELECT count(*) FROM em) * 2 * pi() * {h} * {h})"
_BANDS = (0.02, 0.05, 0.1)


@register("bandwidths", with_("em") + ", l AS (" + " UNION ALL ".join(f"SELECT CAST({h} AS DOUBLE) AS bandwidth, sum(l) AS log_likelihood FROM (SELECT {_LIKE.format(h=h)} AS l FROM em a, em b GROUP BY a.id)" for h in _BANDS) + f") SELECT bandwidth, {R('log_likelihood', 'log_likelihood', 4)}, log_likelihood = (SELECT max(log_likelihood) FROM l) AS best FROM l", 4)
def _(s, d):
    return bundles.best_bandwidth(vector_points(s, d), _BANDS)


@register("median_interval")
def _(s, d):
    return bundles.median_interval(part_points(s, d), "value", 200)


# --- any method --------------------------------------------------------------------------------------------------

_FOLDS = NEAR_SQL.format(q="em", n="em", w="q.id % 5 <> n.id % 5", r=0.1, k=12)


@register("fold_predictions", with_("em") + f", {_FOLDS} SELECT em.id, em.id % 5 AS fold, {R('em.value', 'actual')}, {R('e.p', 'predicted')} FROM em LEFT JOIN (SELECT qid, {IDW_SQL} AS p FROM near GROUP BY qid) e ON e.qid = em.id")
def _(s, d):
    return bundles.fold_predictions(_FOLDED(s, d), "fold", bundles.inverse_distance(_EMS))


@register("method_folds")
def _(s, d):
    local = Search(radius=0.1, max_points=8, min_points=3)
    return bundles.compare_methods(_FOLDED(s, d), "fold", {"idw": bundles.inverse_distance(_EMS), "kriging": bundles.kriged(search=local, max_distance=0.5, lags=10), "rbf": bundles.radial(Rbf("linear"), local)}).select("method", "n", "rmse", "mae", "bias")


@register("run_method", with_("pt", "up") + f", b AS (SELECT min(x) - 0.1 * (max(x) - min(x)) AS x0, max(x) + 0.1 * (max(x) - min(x)) AS x1, min(y) - 0.1 * (max(y) - min(y)) AS y0, max(y) + 0.1 * (max(y) - min(y)) AS y1 FROM up), z AS (SELECT *, CAST(ceil((x1 - x0) / 10) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 10) AS BIGINT) AS ny FROM b), nodes AS (SELECT i AS id, x0 + (i % nx) * (x1 - x0) / (nx - 1) AS x, y0 + (i // nx) * (y1 - y0) / (ny - 1) AS y FROM z, range(400) t(i) WHERE i < nx * ny), {NEAR_SQL.format(q='nodes', n='up', w='true', r=8.0, k=12)} SELECT nodes.id, {R('x', 'x')}, {R('y', 'y')}, {R('e.p', 'estimate')} FROM nodes LEFT JOIN (SELECT qid, {IDW_SQL} AS p FROM near GROUP BY qid) e ON e.qid = nodes.id")
def _(s, d):
    return bundles.run(place_points(s, d), "idw", 10.0, search=Search(radius=8.0, max_points=12)).select("id", "x", "y", "estimate")


@register("kriging_intervals")
def _(s, d):
    from stratafold.plans.queries import _MODEL, _NODES

    return bundles.analytical_uncertainty(vector_points(s, d), grid.regular(s, _NODES), _MODEL, 0.01)


def _solid(s):
    return grid.regular(s, Grid(bounds=(-0.2, 0.2, -0.2, 0.2), nx=6, ny=6)).withColumn("z", F.lit(0.05))


@register("kriging_solid")
def _(s, d):
    from stratafold.plans.queries import _MODEL

    return ip.kriging(vector_points(s, d), _solid(s), _MODEL, search=Search(radius=0.2, max_points=10, min_points=3), axes=("x", "y", "z"))


@register("rbf_solid")
def _(s, d):
    return ip.rbf(vector_points(s, d), _solid(s), Rbf("linear", degree=2), axes=("x", "y", "z"))


_SOLID = "q AS (SELECT i AS id, -0.2 + (i % 6) * CAST(0.08 AS DOUBLE) AS x, -0.2 + (i // 6) * CAST(0.08 AS DOUBLE) AS y, CAST(0.05 AS DOUBLE) AS z FROM range(36) t(i))"


@register("idw_solid", with_("em") + f", {_SOLID}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2) + pow(q.z - n.z, 2)) AS dist, n.value FROM q, em n) WHERE dist < 0.2) WHERE rank <= 12) SELECT q.id, {R('e.p', 'estimate')}, coalesce(e.n, 0) AS n FROM q LEFT JOIN (SELECT qid, {IDW_SQL} AS p, count(*) AS n FROM near GROUP BY qid) e ON e.qid = q.id")
def _(s, d):
    return ip.idw(vector_points(s, d), _solid(s), Search(radius=0.2, max_points=12), axes=("x", "y", "z"))


# --- whole analyses ----------------------------------------------------------------------------------------------


@register("analysis_of_correlations", f"SELECT 'pearson' AS section, var1 || '/' || var2 AS item, 'r' AS metric, {R('r', 'value')} FROM ({_PEARSON.format(t='lineitem')})")
def _(s, d):
    return bundles.analyse_correlations(table(s, d, "lineitem"), _VARS).where("section = 'pearson' and metric = 'r'")


@register("analysis_of_values", f"SELECT 'quantiles' AS section, CAST(CAST(p AS BIGINT) AS VARCHAR) AS item, 'quantile' AS metric, {R('q', 'value')} FROM (SELECT unnest([1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99]) AS p, unnest(quantile_cont(p_retailprice, [0.01, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99])) AS q FROM part) UNION ALL SELECT 'descriptive', 'all', 'mean', {R('avg(p_retailprice)', 'value')} FROM part")
def _(s, d):
    return bundles.analyse_values(part_points(s, d), "value").where("section = 'quantiles' or section = 'descriptive' and metric = 'mean'")


@register("analysis_of_places", with_("em") + f"SELECT 'bounds' AS section, 'all' AS item, metric, {R('value', 'value')} FROM (SELECT unnest(['n', 'x_min', 'x_max', 'y_min', 'y_max']) AS metric, unnest([count(*), min(x), max(x), min(y), max(y)]) AS value FROM em)")
def _(s, d):
    return bundles.analyse_places(vector_points(s, d)).where("section = 'bounds' and metric not in ('area', 'density')")


@register("analysis_of_quality", f"SELECT 'duplicates' AS section, 'all' AS item, metric, {R('value', 'value')} FROM (SELECT unnest(['n', 'n_distinct', 'duplicate_rate']) AS metric, unnest([count(*), count(DISTINCT (p_partkey % 97, p_size)), (count(*) - count(DISTINCT (p_partkey % 97, p_size))) / count(*)]) AS value FROM part)")
def _(s, d):
    return bundles.analyse_quality(part_points(s, d), {"value": (0, 1e6)}, ["x", "y"]).where("section = 'duplicates'")


@register("analysis_of_variograms")
def _(s, d):
    return bundles.analyse_variogram(vector_points(s, d), 0.5, 10)


@register("flags_by_kind")
def _(s, d):
    out = None
    for kind in ("statistical", "spatial", "multivariate"):
        part = bundles.flags(vector_points(s, d), kind).groupBy("method").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@register("words", "SELECT * FROM (VALUES ('clustered'), ('even'), ('moderately even'), ('uneven')) t(pattern)")
def _(s, d):
    return s.createDataFrame([(bundles.pattern_words(*a),) for a in ((0.9, 0.8), (0.8, 0.1), (0.5, 0.1), (0.1, 0.1))], "pattern string")


