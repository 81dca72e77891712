"""Registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import scalar as S
from stratafold.model import Grid, Kriging, Rbf, Search, Variogram
from stratafold.operators import clean, compositing, correlation, grid, interpolate, neighbours, outliers, quality, ranks, recommend, spatial, statistics, validation, variograms
from stratafold.plans.tables import intervals, part_points, place_points, rounded, table, vector_points, with_
from stratafold.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return f

    return keep


def R(expression: str, name: str, digits: int = 6) -> str:  # noqa: N802
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


def nodes_sql(x0, x1, nx, y0, y1, ny) -> str:
    sx, sy = (x1 - x0) / (nx - 1), (y1 - y0) / (ny - 1)
    return f"nodes AS (SELECT i AS id, i % {nx} AS ix, i // {nx} AS iy, {float(x0)} + (i % {nx}) * CAST({sx!r} AS DOUBLE) AS x, {float(y0)} + (i // {nx}) * CAST({sy!r} AS DOUBLE) AS y FROM range({nx * ny}) t(i))"


BOX = (0.0, 96.0, 1.0, 50.0)
GRID = Grid(bounds=BOX, nx=25, ny=15)
NODES = nodes_sql(0.0, 96.0, 25, 1.0, 50.0, 15)
SEARCH = Search(radius=8.0, max_points=12)
NEAR_SQL = "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS dist, n.value FROM {q} q, {n} n WHERE {w}) WHERE dist < {r}) WHERE rank <= {k})"
IDW_SQL = "coalesce(avg(CASE WHEN dist < 1e-10 THEN value END), sum(CASE WHEN dist >= 1e-10 THEN value / pow(dist, 2) END) / sum(CASE WHEN dist >= 1e-10 THEN 1 / pow(dist, 2) END))"
KNN_SQL = "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS dist, n.value FROM em q, em n WHERE q.id <> n.id)) WHERE rank <= {k})"


# --- grid and inverse distance -------------------------------------------------------------------------------------


@register("grid_regular", f"WITH {NODES} SELECT id, ix, iy, {R('x', 'x')}, {R('y', 'y')} FROM nodes")
def _(s, d):
    return grid.regular(s, GRID)


@register("points_clean", with_("pt", "up") + "SELECT id, x, y, value FROM up")
def _(s, d):
    return clean.training_points(part_points(s, d), "x", "y", "value")


@register("idw_grid", with_("pt", "up") + f", {NODES}, {NEAR_SQL.format(q='nodes', n='up', w='true', r=8.0, k=12)} SELECT nodes.id, {R('e.estimate', 'estimate')}, coalesce(e.n, 0) AS n FROM nodes LEFT JOIN (SELECT qid, {IDW_SQL} AS estimate, count(*) AS n FROM near GROUP BY qid) e ON e.qid = nodes.id")
def idw_grid(s, d):
    return interpolate.idw(place_points(s, d), grid.regular(s, GRID), SEARCH)


def _turn(alias: str) -> str:
    x, y = f"{alias}.x", f"{alias}.y"
    c, sn = "cos(radians(30.0))", "sin(radians(30.0))"
    u, v = f"({x} * {c} + {y} * {sn})", f"(({y} * {c} - {x} * {sn}) * 0.5)"
    return f"({u} * {c} - {v} * {sn})", f"({u} * {sn} + {v} * {c})"


@register("idw_anisotropic", with_("pt", "up") + f", {NODES}, tn AS (SELECT id, {_turn('nodes')[0]} AS x, {_turn('nodes')[1]} AS y FROM nodes), tp AS (SELECT id, value, {_turn('up')[0]} AS x, {_turn('up')[1]} AS y FROM up), {NEAR_SQL.format(q='tn', n='tp', w='true', r=5.3, k=100000)} SELECT qid AS id, {R(IDW_SQL, 'estimate', 5)} FROM near GROUP BY qid", 5)
def _(s, d):
    return interpolate.idw(place_points(s, d), grid.regular(s, GRID), Search(radius=5.3, max_points=100000, anisotropy_ratio=0.5, anisotropy_angle=30.0)).where("n > 0").select("id", "estimate")


@register("rasterised_points", with_("pt") + "SELECT ix, iy, arg_max(value, id) AS value FROM (SELECT CAST(round((x - (SELECT min(x) FROM pt) + 0.1 * ((SELECT max(x) FROM pt) - (SELECT min(x) FROM pt))) / 7.0) AS BIGINT) AS ix, CAST(round((y - (SELECT min(y) FROM pt) + 0.1 * ((SELECT max(y) FROM pt) - (SELECT min(y) FROM pt))) / 7.0) AS BIGINT) AS iy, value, id FROM pt) GROUP BY ix, iy")
def _(s, d):
    return grid.rasterise(part_points(s, d), 7.0)


@register("contour_crossings")
def _(s, d):
    est = idw_grid(s, d).join(grid.regular(s, GRID), "id").select("ix", "iy", "x", "y", F.col("estimate").alias("value"))
    low, high = est.agg(F.min("value"), F.max("value")).first()
    return grid.contour_crossings(est, [low + (high - low) * k / 4 for k in (1, 2, 3)])


# --- neighbours ----------------------------------------------------------------------------------------------------


@register("nearest_join", with_("em") + f", {KNN_SQL.format(k=5)} SELECT qid, nid, {R('dist', 'dist')}, rank FROM knn")
def _(s, d):
    p = vector_points(s, d)
    return neighbours.nearest_join(p, p, 5, other=True, keep=())


@register("radius_join", with_("pt", "up") + f", {NODES} SELECT q.id AS qid, n.id AS nid, {R('sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2))', 'dist')} FROM nodes q, up n WHERE sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) <= 3.0")
def _(s, d):
    return neighbours.radius_join(grid.regular(s, GRID), place_points(s, d), 3.0, keep=())


_SECTOR = "least(CAST(floor((CASE WHEN atan2(n.y - q.y, n.x - q.x) < 0 THEN atan2(n.y - q.y, n.x - q.x) + 2 * pi() ELSE atan2(n.y - q.y, n.x - q.x) END) / (2 * pi() / 4)) AS BIGINT), 3)"


@register("sector_join", with_("em") + f"SELECT qid, nid, {R('dist', 'dist')}, sector, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, sector ORDER BY dist, nid) AS rank FROM (SELECT q.id AS qid, n.id AS nid, sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS dist, {_SECTOR} AS sector FROM em q, em n) WHERE dist <= 0.1) WHERE rank <= 3")
def _(s, d):
    p = vector_points(s, d)
    return neighbours.sector_join(p, p, 0.1, 4, 3, keep=())


@register("interval_overlaps", with_("iv") + f', a AS (SELECT * FROM iv) SELECT a.hole, count(*) AS n, {R("""sum(least(a."to", b."to") - greatest(a."from", b."from"))""", "overlap")} FROM a JOIN a b ON a.hole = b.hole AND a."from" < b."to" AND a."to" > b."from" GROUP BY a.hole')
def _(s, d):
    i = intervals(s, d)
    return neighbours.interval_join(i, i, "hole").groupBy("a.hole").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"))


# --- statistics ----------------------------------------------------------------------------------------------------

_MED = "(SELECT quantile_cont(value, 0.5) FROM pt)"


@register("descriptive", with_("pt") + f"SELECT count(*) AS count, {R('avg(value)', 'mean')}, {R('quantile_cont(value, 0.5)', 'median')}, {R('(SELECT value FROM pt GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)', 'mode')}, {R('stddev_samp(value)', 'std')}, {R('var_samp(value)', 'variance', 4)}, {R('min(value)', 'min')}, {R('max(value)', 'max')}, {R('max(value) - min(value)', 'range')}, {R('sum(value)', 'sum', 4)}, {R(f'quantile_cont(abs(value - {_MED}), 0.5)', 'mad')}, {R('count(*) / sum(1 / value)', 'harmonic_mean')}, {R('exp(avg(ln(value)))', 'geometric_mean')} FROM pt")
def _(s, d):
    out = statistics.descriptive(part_points(s, d), "value")
    return out.withColumns({c: F.round(c, 4) for c in ("variance", "sum")})


@register("trimmed_mean", with_("pt") + f"SELECT {R('avg(value)', 'trimmed_mean')} FROM (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM pt) WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)")
def _(s, d):
    return statistics.trimmed_mean(part_points(s, d), "value", 0.1)


_MOM = "m AS (SELECT avg(v) AS m, count(*) AS n FROM v), c AS (SELECT avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4, max(n) AS n FROM v, m)"


@register("shape", f"WITH v AS (SELECT l_extendedprice AS v FROM lineitem), {_MOM} SELECT {R('m3 / pow(m2, 1.5)', 'skewness')}, {R('m4 / (m2 * m2) - 3', 'kurtosis')}, CASE WHEN m3 / pow(m2, 1.5) > 0.5 THEN 'right' WHEN m3 / pow(m2, 1.5) < -0.5 THEN 'left' ELSE 'symmetric' END AS skew_label, CASE WHEN m4 / (m2 * m2) - 3 > 0.5 THEN 'heavy' WHEN m4 / (m2 * m2) - 3 < -0.5 THEN 'light' ELSE 'normal' END AS kurtosis_label FROM c")
def _(s, d):
    return statistics.shape(table(s, d, "lineitem"), "l_extendedprice")


@register("bias_corrected_shape", f"WITH v AS (SELECT l_extendedprice AS v FROM lineitem), {_MOM} SELECT n, {R('sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) * m3 / pow(m2, 1.5)', 'skewness')}, {R('(n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6)', 'kurtosis')} FROM c")
def _(s, d):
    return statistics.bias_corrected_shape(table(s, d, "lineitem"), "l_extendedprice")


@register("quantiles", f"SELECT CAST(p AS BIGINT) AS percent, {R('q', 'quantile')} FROM (SELECT unnest([1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99]) AS p, unnest(quantile_cont(l_extendedprice, [0.01, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99])) AS q FROM lineitem)")
def _(s, d):
    return statistics.quantile_table(table(s, d, "lineitem"), "l_extendedprice")


@register("variability", with_("pt") + f", b AS (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM pt), a AS (SELECT avg(abs(value - m)) AS aad, quantile_cont(abs(value - med), 0.5) AS mad FROM pt, b) SELECT {R('sd / m', 'cv')}, {R('q3 - q1', 'iqr')}, {R('(q3 - q1) / 2', 'quartile_deviation')}, {R('(q3 - q1) / (q3 + q1)', 'quartile_coefficient')}, {R('aad', 'mean_abs_deviation')}, {R('mad', 'mad')}, {R('(hi - lo) / (hi + lo)', 'range_coefficient')}, {R('mad / med', 'robust_cv')} FROM a, b")
def _(s, d):
    return statistics.variability(part_points(s, d), "value")


@register("gini", with_("pt") + f", o AS (SELECT value - (SELECT min(value) FROM pt) + 1e-10 AS x, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM pt) SELECT {R('2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n)', 'gini')} FROM o")
def _(s, d):
    return statistics.gini(part_points(s, d), "value")


@register("extremes", with_("pt") + "SELECT side, row_number() OVER (PARTITION BY side ORDER BY value) AS rank, value FROM (SELECT 'low' AS side, value FROM (SELECT value FROM pt ORDER BY value LIMIT 5) UNION ALL SELECT 'high', value FROM (SELECT value FROM pt ORDER BY value DESC LIMIT 5))")
def _(s, d):
    return statistics.extremes(part_points(s, d), "value")


@register("outlier_counts", f"WITH v AS (SELECT l_extendedprice AS v FROM lineitem), b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, stddev_pop(v) AS sd FROM v) SELECT count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_1_5, count(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS iqr_3, count(*) FILTER (WHERE abs((v - m) / sd) > 2) AS z_2, count(*) FILTER (WHERE abs((v - m) / sd) > 3) AS z_3, {R('max(abs((v - m) / sd))', 'max_z')} FROM v, b")
def _(s, d):
    return statistics.outlier_counts(table(s, d, "lineitem"), "l_extendedprice")


@register("histogram", f"WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT i AS bin, {R('lo + i * ((hi - lo) / 20)', 'low')}, {R('lo + (i + 1) * ((hi - lo) / 20)', 'high')}, coalesce(n, 0) AS n FROM range(20) t(i), b LEFT JOIN c ON c.bin = i")
def _(s, d):
    return statistics.histogram(table(s, d, "lineitem"), "l_extendedprice", 20)


@register("box", f"WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), f AS (SELECT l_extendedprice AS v, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside, q1, median, q3 FROM lineitem, b) SELECT {R('q1', 'q1')}, {R('median', 'median')}, {R('q3', 'q3')}, {R('min(v) FILTER (WHERE inside)', 'whisker_low')}, {R('max(v) FILTER (WHERE inside)', 'whisker_high')}, count(*) FILTER (WHERE NOT inside) AS n_outliers FROM f GROUP BY f.q1, f.median, f.q3")
def _(s, d):
    return statistics.box(table(s, d, "lineitem"), "l_extendedprice")


@register("confidence_intervals")
def _(s, d):
    return statistics.confidence_intervals(part_points(s, d), "value")


@register("normality_tests")
def _(s, d):
    return statistics.normality(part_points(s, d), "value")


@register("transforms", with_("pt") + f"SELECT id, {R('ln(value)', 'logged')}, {R('(pow(value, 0.5) - 1) / 0.5', 'box_cox')}, {R('(pow(value + 1, 0.5) - 1) / 0.5', 'yeo_johnson')}, {R('value', 'back')} FROM pt")
def _(s, d):
    v = F.col("value")
    return part_points(s, d).select("id", F.log(v).alias("logged"), S.box_cox(v, 0.5).alias("box_cox"), S.yeo_johnson(v, 0.5).alias("yeo_johnson"), S.yeo_johnson_inverse(S.yeo_johnson(v, 0.5), 0.5).alias("back"))


@register("quantile_pairs", with_("pt") + "SELECT i AS row, value FROM (SELECT row_number() OVER (ORDER BY value, id) AS i, value FROM pt)")
def _(s, d):
    return ranks.numbered(part_points(s, d).select("value", "id"), ["value", "id"]).select("row", "value")


@register("running_moments_batch", f"SELECT event_id, {R('avg(value) OVER w', 'running_mean')}, {R('stddev_samp(value) OVER w', 'running_std')} FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    return ranks.running(table(s, d, "events"), "value", ["event_type"], "event_id").select("event_id", "running_mean", "running_std")


@register("forward_fill", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return ranks.forward_fill(e, ["v"], "event_id", ["event_type"]).select("event_id", "v")


@register("number_formats", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(s_acctbal)) AS us, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || translate(format('{:,.2f}', abs(s_acctbal)), ',.', chr(160) || ',') AS ru FROM supplier")
def _(s, d):
    v = F.col("s_acctbal")
    return table(s, d, "supplier").select("s_suppkey", S.format_number(v).alias("us"), S.format_number(v, 2, "ru_RU").alias("ru"))


@register("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d.%m.%Y') AS ru FROM orders")
def _(s, d):
    t = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", S.format_date(t).alias("us"), S.format_date(t, "ru_RU").alias("ru"))


# --- spatial -------------------------------------------------------------------------------------------------------


@register("bounds", with_("pt") + f"SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, (max(x) - min(x)) * (max(y) - min(y)) AS area, {R('count(*) / ((max(x) - min(x)) * (max(y) - min(y)))', 'density')} FROM pt")
def _(s, d):
    return spatial.bounds(part_points(s, d))


@register("centre", with_("pt") + f", c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pt) SELECT {R('cx', 'cx')}, {R('cy', 'cy')}, {R('avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2)))', 'mean_distance')}, {R('stddev_pop(sqrt(pow(x - cx, 2) + pow(y - cy, 2)))', 'std_distance')}, {R('max(sqrt(pow(x - cx, 2) + pow(y - cy, 2)))', 'max_distance')} FROM pt, c GROUP BY c.cx, c.cy")
def _(s, d):
    return spatial.centre(part_points(s, d))


@register("nearest_statistics", with_("em") + f", {KNN_SQL.format(k=1)}, b AS (SELECT count(*) / ((max(x) - min(x)) * (max(y) - min(y))) AS density FROM em), t AS (SELECT count(*) AS n, avg(dist) AS mean, stddev_pop(dist) AS std, min(dist) AS min, max(dist) AS max FROM knn) SELECT n, {R('mean', 'mean')}, {R('std', 'std')}, {R('min', 'min')}, {R('max', 'max')}, {R('mean / (0.5 / sqrt(density))', 'clark_evans')}, {R('1 / (1 + std / mean)', 'regularity')}, {R('1 - 1 / (1 + (0.5 / sqrt(density)) / mean)', 'clustering')} FROM t, b")
def _(s, d):
    return spatial.nearest_neighbours(vector_points(s, d))


@register("local_density", with_("em") + f", {KNN_SQL.format(k=5)} SELECT qid AS id, {R('5 / (pi() * max(dist) * max(dist))', 'density', 4)} FROM knn GROUP BY qid", 4)
def _(s, d):
    return spatial.local_density(vector_points(s, d), 5)


_CELLS = "cells AS (SELECT ix, iy, count(*) AS n FROM (SELECT least(CAST(floor((x - x0) / (x1 - x0) * {b}) AS BIGINT), {b} - 1) AS ix, least(CAST(floor((y - y0) / (y1 - y0) * {b}) AS BIGINT), {b} - 1) AS iy FROM pt, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt)) GROUP BY ix, iy)"


@register("density_variation", with_("pt") + f", {_CELLS.format(b=15)} SELECT count(*) AS occupied, {R('count(*) / 225.0', 'occupancy')}, {R('avg(n)', 'mean')}, {R('stddev_pop(n)', 'std')}, max(n) AS max, {R('stddev_pop(n) / avg(n)', 'cv')}, {R('1 / (1 + stddev_pop(n) / avg(n))', 'uniformity')} FROM cells")
def _(s, d):
    return spatial.density_variation(part_points(s, d), 15)


@register("quadrats", with_("pt") + f", {_CELLS.format(b=4)} SELECT {R('sum(n) / 16.0', 'mean')}, {R('sum(n * n) / 16.0 - pow(sum(n) / 16.0, 2)', 'variance')}, {R('(sum(n * n) / 16.0 - pow(sum(n) / 16.0, 2)) / (sum(n) / 16.0)', 'vmr')} FROM cells")
def _(s, d):
    return spatial.quadrats(part_points(s, d), 4)


_PAIRS = "pr AS (SELECT a.id AS i, b.id AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, a.value AS vi, b.value AS vj, b.x - a.x AS dx, b.y - a.y AS dy FROM em a JOIN em b ON a.id < b.id)"


@register("ripley_k", with_("em") + f", {_PAIRS}, b AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM em) SELECT d, {R('(SELECT count(*) FROM pr WHERE dist <= d) / (n * (n / area))', 'k')} FROM b, (SELECT unnest([CAST(0.02 AS DOUBLE), 0.05, 0.1, 0.2]) AS d)")
def _(s, d):
    return spatial.ripley_k(vector_points(s, d), [0.02, 0.05, 0.1, 0.2])


@register("moran", with_("em") + f", {_PAIRS}, m AS (SELECT avg(value) AS m, count(*) AS n, var_pop(value) * count(*) AS v FROM em) SELECT {R('max(n) * sum(2 / dist * (vi - m) * (vj - m)) / (sum(2 / dist) * max(v))', 'moran_i')} FROM pr, m WHERE dist > 0 AND dist <= 0.15")
def _(s, d):
    return spatial.moran(vector_points(s, d), 0.15)


@register("directional_extent", with_("pt") + f"SELECT a AS angle, {R('max(x * cos(radians(a)) + y * sin(radians(a))) - min(x * cos(radians(a)) + y * sin(radians(a)))', 'extent')} FROM pt, (SELECT i * 22.5 AS a FROM (SELECT CAST(unnest(range(8)) AS DOUBLE) AS i)) GROUP BY a")
def _(s, d):
    return spatial.directional_extent(part_points(s, d))


@register("ellipse", with_("em") + f", c AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM em), e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS big, greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0) AS small FROM c) SELECT {R('2 * sqrt(big)', 'major')}, {R('2 * sqrt(small)', 'minor')}, {R('degrees(atan2(2 * c, a - b)) / 2', 'orientation')}, {R('sqrt(1 - small / big)', 'eccentricity')}, {R('sqrt(small / big)', 'ratio')} FROM e")
def _(s, d):
    return spatial.ellipse(vector_points(s, d))


_TREND = "tr AS (SELECT mv - b * mx - c * my AS a, b, c, (b * sxv + c * syv) / svv AS r2 FROM (SELECT *, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS b, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS c FROM (SELECT avg(value) AS mv, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, value) AS sxv, covar_pop(y, value) AS syv, var_pop(value) AS svv FROM em)))"


@register("trend_plane", with_("em") + f", {_TREND} SELECT {R('a', 'a')}, {R('b', 'b')}, {R('c', 'c')}, {R('r2', 'r2')} FROM tr")
def _(s, d):
    return spatial.trend(vector_points(s, d))


@register("kernel_density", with_("em") + f"SELECT a.id, {R('ln(sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * 0.05 * 0.05)))) - ln((SELECT count(*) FROM em) * 2 * pi() * 0.05 * 0.05)', 'log_density')} FROM em a, em b GROUP BY a.id")
def _(s, d):
    return spatial.density_kernel(vector_points(s, d), 0.05)


@register("hull_measures")
def _(s, d):
    return spatial.hull_measures(part_points(s, d))


@register("density_clusters")
def _(s, d):
    return spatial.dbscan(vector_points(s, d), 0.05, 4)


@register("kmeans_inertia")
def _(s, d):
    return spatial.kmeans(vector_points(s, d), [2, 3, 4, 5])


# --- variograms, kriging, radial bases -------------------------------------------------------------------------------

_LAGS = "SELECT k AS lag, {h}, {g}, count(*) AS n_pairs FROM pr, range(10) t(k) WHERE dist >= k * 0.05 - 0.025 AND dist < (k + 1) * 0.05 + 0.025 {w} GROUP BY k"


@register("variogram", with_("em") + f", {_PAIRS} " + _LAGS.format(h=R("(k + 0.5) * 0.05", "h"), g=R("avg(pow(vi - vj, 2) / 2)", "gamma"), w=""))
def _(s, d):
    return variograms.experimental(vector_points(s, d), 0.5, 10)


_AZ = "(CASE WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 180 WHEN degrees(atan2(dy, dx)) >= 180 THEN degrees(atan2(dy, dx)) - 180 ELSE degrees(atan2(dy, dx)) END)"


@register("variogram_directional", with_("em") + f", {_PAIRS} " + " UNION ALL ".join(f"SELECT * FROM ({_LAGS.format(h=R('(k + 0.5) * 0.05', 'h'), g=R('avg(pow(vi - vj, 2) / 2)', 'gamma'), w=f'AND least(abs({_AZ} - {a}), abs(abs({_AZ} - {a}) - 180)) <= 22.5')}), (SELECT CAST({a} AS DOUBLE) AS direction)" for a in (0.0, 45.0, 90.0, 135.0)))
def _(s, d):
    return variograms.directional(vector_points(s, d), 0.5, 10)


@register("variogram_models", f"SELECT i AS h, {R('CASE WHEN i <= 0 THEN 0 WHEN i < 12 THEN 1 + 3 * (1.5 * i / 12 - 0.5 * pow(i / 12, 3)) ELSE 4 END', 'spherical')}, {R('CASE WHEN i <= 0 THEN 0 ELSE 1 + 3 * (1 - exp(-i / 12)) END', 'exponential')}, {R('CASE WHEN i <= 0 THEN 0 ELSE 1 + 3 * (1 - exp(-pow(i / 12, 2))) END', 'gaussian')} FROM (SELECT CAST(unnest(range(25)) AS DOUBLE) AS i)")
def _(s, d):
    h = F.col("h")
    return s.range(25).select(F.col("id").cast("double").alias("h")).select("h", *(S.variogram(k, h, 1, 3, 12).alias(k) for k in ("spherical", "exponential", "gaussian")))


@register("kernels", f"SELECT i AS r, {R('exp(-pow(0.5 * i, 2))', 'gaussian')}, {R('sqrt(1 + pow(0.5 * i, 2))', 'multiquadric')}, {R('1 / sqrt(1 + pow(0.5 * i, 2))', 'inverse_multiquadric')}, {R('CASE WHEN i > 0 THEN i * i * ln(i + 1e-15) ELSE 0 END', 'thin_plate')}, {R('pow(i, 3)', 'cubic')} FROM (SELECT CAST(unnest(range(10)) AS DOUBLE) AS i)")
def _(s, d):
    r = F.col("r")
    return s.range(10).select(F.col("id").cast("double").alias("r")).select("r", *(S.kernel(k, r, 0.5).alias(k) for k in ("gaussian", "multiquadric", "inverse_multiquadric", "thin_plate", "cubic")))


@register("variogram_fits")
def _(s, d):
    return variograms.fit_all(variograms.experimental(vector_points(s, d), 0.5, 10))


@register("variogram_anisotropy")
def _(s, d):
    return variograms.anisotropy(vector_points(s, d), 0.5, 10)


_NODES = Grid(bounds=(-0.3, 0.3, -0.3, 0.3), nx=12, ny=12)
_MODEL = Variogram("spherical", 0.001, 0.015, 0.3)


@register("kriging_ordinary")
def _(s, d):
    return interpolate.kriging(vector_points(s, d), grid.regular(s, _NODES), _MODEL)


@register("kriging_simple")
def _(s, d):
    return interpolate.kriging(vector_points(s, d), grid.regular(s, _NODES), _MODEL, Kriging("simple"))


@register("kriging_universal")
def _(s, d):
    return interpolate.kriging(vector_points(s, d), grid.regular(s, _NODES), _MODEL, Kriging("universal"))


@register("kriging_local")
def _(s, d):
    return interpolate.kriging(vector_points(s, d), grid.regular(s, _NODES), _MODEL, Kriging(), Search(radius=0.1, max_points=12, min_points=3))


@register("rbf_global")
def _(s, d):
    return interpolate.rbf(vector_points(s, d), grid.regular(s, _NODES), Rbf("multiquadric", 5.0, 1e-8, 1))


@register("rbf_local")
def _(s, d):
    return interpolate.rbf(vector_points(s, d), grid.regular(s, _NODES), Rbf("thin_plate"), Search(radius=0.1, max_points=12, min_points=3))


@register("rbf_shape")
def _(s, d):
    return interpolate.rbf_shape(vector_points(s, d))


# --- compositing and declustering ------------------------------------------------------------------------------------


@register("composite_intervals", with_("iv") + f""", h AS (SELECT hole, min("from") AS top, max("to") AS bottom FROM iv GROUP BY hole), w AS (SELECT hole, top, unnest(range(CAST(ceil((bottom - top) / 20.0) AS BIGINT))) AS k FROM h), o AS (SELECT w.hole, w.top + k * 20.0 AS f, least("to", w.top + k * 20.0 + 20) - greatest("from", w.top + k * 20.0) AS ov, l_discount, l_tax FROM w JOIN iv ON iv.hole = w.hole AND iv."from" < w.top + k * 20.0 + 20 AND iv."to" > w.top + k * 20.0) SELECT hole, {R('f', '"from"')}, {R('f + 20', '"to"')}, {R('sum(l_discount * ov) / sum(ov)', 'l_discount')}, {R('sum(l_tax * ov) / sum(ov)', 'l_tax')}, {R('sum(ov) / 20', 'recovery')}, count(*) AS n_intervals FROM o GROUP BY hole, f HAVING sum(ov) / 20 >= 0.5""")
def _(s, d):
    return compositing.composite_intervals(intervals(s, d), "hole", "from", "to", ["l_discount", "l_tax"], 20.0)


@register("composite_domains", with_("pt") + f"SELECT domain, {R('avg(value)', 'value_mean')}, {R('stddev_samp(value)', 'value_std')}, count(value) AS value_count, count(*) AS domain_sample_count FROM pt GROUP BY domain")
def _(s, d):
    return compositing.composite_domains(part_points(s, d), "domain", ["value"])


@register("composite_places", with_("em") + f", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM em), g AS (SELECT x0 + i * 0.05 AS nx, y0 + j * 0.05 AS ny FROM b, range(200) s(i), range(200) t(j) WHERE i < ceil((x1 - x0 + 0.05) / 0.05) AND j < ceil((y1 - y0 + 0.05) / 0.05)), o AS (SELECT nx, ny, value, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) AS dist, id FROM g, em WHERE abs(x - nx) <= 0.1001 AND abs(y - ny) <= 0.1001), k AS (SELECT *, row_number() OVER (PARTITION BY nx, ny ORDER BY dist, id) AS rank FROM o WHERE dist <= 0.1) SELECT {R('nx', 'x')}, {R('ny', 'y')}, {R('sum(value / pow(dist + 1e-10, 2)) / sum(1 / pow(dist + 1e-10, 2))', 'value')}, count(*) AS n_samples, {R('least(1.0, count(*) / 10.0)', 'quality')} FROM k WHERE rank <= 10 GROUP BY nx, ny HAVING count(*) >= 2")
def _(s, d):
    return compositing.composite_places(vector_points(s, d), 0.1)


_DCELL = "b AS (SELECT min(x) AS x0, max(x) - min(x) AS wx, min(y) AS y0, max(y) - min(y) AS wy FROM pt), dc AS (SELECT id, value, least(greatest(floor((x - (x0 - 0.01 * wx)) / (1.02 * wx / greatest(10, ceil(1.02 * wx / 5.0)))), 0), greatest(10, ceil(1.02 * wx / 5.0)) - 1) AS cx, least(greatest(floor((y - (y0 - 0.01 * wy)) / (1.02 * wy / greatest(10, ceil(1.02 * wy / 5.0)))), 0), greatest(10, ceil(1.02 * wy / 5.0)) - 1) AS cy FROM pt, b), dw AS (SELECT id, value, 1.0 / count(*) OVER (PARTITION BY cx, cy) AS w FROM dc), wt AS (SELECT id, value, w * count(*) OVER () / sum(w) OVER () AS weight FROM dw)"


@register("decluster_cells", with_("pt") + f", {_DCELL} SELECT id, {R('weight', 'weight')} FROM wt")
def _(s, d):
    return compositing.decluster_cells(part_points(s, d), 5.0).select("id", "weight")


@register("weight_metrics", with_("pt") + f", {_DCELL}, m AS (SELECT sum(weight * value) / sum(weight) AS wm FROM wt) SELECT {R('min(weight)', 'min_weight')}, {R('max(weight)', 'max_weight')}, {R('avg(weight)', 'mean_weight')}, {R('stddev_pop(weight)', 'std_weight')}, {R('pow(sum(weight), 2) / sum(weight * weight)', 'effective_n')}, count(*) AS n, {R('max(wm)', 'weighted_mean')}, {R('avg(value)', 'original_mean')}, {R('sqrt(sum(weight * pow(value - wm, 2)) / sum(weight))', 'weighted_std')}, {R('stddev_samp(value)', 'original_std')}, {R('pow(sum(weight), 2) / sum(weight * weight) / count(*)', 'efficiency')}, {R('100 * (max(wm) - avg(value)) / avg(value)', 'mean_change')} FROM wt, m")
def _(s, d):
    return compositing.weight_metrics(compositing.decluster_cells(part_points(s, d), 5.0))


@register("decluster_distance", with_("em") + f", {KNN_SQL.format(k=5)}, t AS (SELECT qid AS id, 1 / (1 / (pow(avg(dist), 2) + 1e-10) + 1e-10) AS w FROM knn GROUP BY qid) SELECT id, {R('w * count(*) OVER () / sum(w) OVER ()', 'weight')} FROM t")
def _(s, d):
    return compositing.decluster_distance(vector_points(s, d), 5).select("id", "weight")


@register("decluster_polygons")
def _(s, d):
    return compositing.decluster_polygons(vector_points(s, d)).select("id", "weight")


# --- correlation -----------------------------------------------------------------------------------------------------

_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TWO = [(a, b) for i, a in enumerate(_VARS) for b in _VARS[i + 1 :]]
_PEARSON = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) AS n FROM {{t}}" for a, b in _TWO)


@register("pearson", f"SELECT var1, var2, {R('r', 'r')}, n FROM ({_PEARSON.format(t='lineitem')})")
def _(s, d):
    return correlation.pearson(table(s, d, "lineitem"), _VARS)


_RANKS = ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in _VARS)


@register("spearman", f"WITH k AS (SELECT {_RANKS} FROM lineitem) SELECT var1, var2, {R('r', 'r')}, n FROM ({_PEARSON.format(t='k')})")
def _(s, d):
    return correlation.spearman(table(s, d, "lineitem").select(*_VARS), _VARS)


@register("kendall", f"WITH g AS (SELECT l_quantity AS a, l_discount AS b, count(*) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b) * p.c * q.c) AS s FROM g p JOIN g q ON p.a < q.a), n AS (SELECT sum(c) AS n FROM g), ta AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT sum(c) AS c FROM g GROUP BY a)), tb AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT sum(c) AS c FROM g GROUP BY b)) SELECT {R('s / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t))', 'tau')}, CAST(n AS BIGINT) AS n FROM s, n, ta, tb")
def _(s, d):
    return correlation.kendall(table(s, d, "lineitem"), "l_quantity", "l_discount")


@register("partial_correlation", f"WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem) SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, {R('(ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc))', 'r')} FROM c UNION ALL SELECT 'l_quantity', 'l_discount', {R('(ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc))', 'r')} FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', {R('(bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac))', 'r')} FROM c")
def _(s, d):
    return correlation.partial(table(s, d, "lineitem"), _VARS[:3])


@register("correlation_summary", f"SELECT {R('avg(abs(r))', 'mean_abs')}, {R('max(abs(r))', 'max_abs')}, {R('min(abs(r))', 'min_abs')}, {R('stddev_pop(r)', 'std')}, count(*) FILTER (WHERE abs(r) > 0.7) AS strong, count(*) FILTER (WHERE abs(r) > 0.3 AND abs(r) <= 0.7) AS moderate, count(*) FILTER (WHERE abs(r) <= 0.3) AS weak FROM ({_PEARSON.format(t='lineitem')})")
def _(s, d):
    return correlation.summary(correlation.pearson(table(s, d, "lineitem"), _VARS))


@register("strongest_pairs", f"SELECT var1, var2, {R('r', 'r')}, n FROM ({_PEARSON.format(t='lineitem')}) ORDER BY abs(r) DESC, var1, var2 LIMIT 3")
def _(s, d):
    return correlation.strongest(correlation.pearson(table(s, d, "lineitem"), _VARS), 3)


@register("multicollinearity")
def _(s, d):
    return correlation.multicollinearity(table(s, d, "lineitem"), _VARS)


# --- data quality ----------------------------------------------------------------------------------------------------


@register("completeness", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, {R(f'(count(*) - count({c})) / count(*)', 'share')}, (count(*) - count({c})) / count(*) > 0.05 AS critical FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(s, d):
    return quality.completeness(table(s, d, "orders"))


@register("duplicates", with_("pt") + f"SELECT count(*) AS n, count(DISTINCT (x, y)) AS n_distinct, {R('(count(*) - count(DISTINCT (x, y))) / count(*)', 'duplicate_rate')} FROM pt")
def _(s, d):
    return quality.duplicates(part_points(s, d), ["x", "y"])


@register("contradictions", with_("pt") + "SELECT x, y, min(value) AS low, max(value) AS high, count(*) AS n FROM pt GROUP BY x, y HAVING min(value) < max(value)")
def _(s, d):
    return quality.contradictions(part_points(s, d), ["x", "y"], "value")


@register("ranges", f"SELECT 'l_quantity' AS \"column\", count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS n_out, {R('1 - count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) / count(l_quantity)', 'compliance')} FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (WHERE l_tax < 0 OR l_tax > 0.07), {R('1 - count(*) FILTER (WHERE l_tax < 0 OR l_tax > 0.07) / count(l_tax)', 'compliance')} FROM lineitem")
def _(s, d):
    return quality.ranges(table(s, d, "lineitem"), {"l_quantity": (5, 45), "l_tax": (0, 0.07)})


@register("temporal", "SELECT min(ts) AS first, max(ts) AS last, datediff('day', min(ts), max(ts)) AS days, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-03 00:00:00') AS n_future, count(*) FILTER (WHERE year(ts) < 1900) AS n_ancient FROM events")
def _(s, d):
    return quality.temporal(table(s, d, "events"), "ts", "2024-01-03 00:00:00")


@register("text_formats", f"SELECT {R('avg(length(p_name))', 'mean_length')}, {R('stddev_samp(length(p_name)) / avg(length(p_name))', 'length_cv')}, {R('''avg(CAST(regexp_matches(p_name, '[0-9]') AS INT))''', 'digits')}, {R('''avg(CAST(regexp_matches(p_name, '[A-Za-z]') AS INT))''', 'letters')}, {R('''avg(CAST(regexp_matches(p_name, '[^A-Za-z0-9 ]') AS INT))''', 'others')}, {R('''avg(CAST(p_name = upper(p_name) AND regexp_matches(p_name, '[A-Za-z]') AS INT))''', '\"upper\"')}, {R('''avg(CAST(p_name = lower(p_name) AND regexp_matches(p_name, '[A-Za-z]') AS INT))''', '\"lower\"')} FROM part")
def _(s, d):
    return quality.text_formats(table(s, d, "part"), "p_name")


@register("column_info")
def _(s, d):
    return quality.column_info(table(s, d, "orders"))


@register("suggested_types")
def _(s, d):
    return quality.suggested_types(table(s, d, "orders"))


@register("coordinate_report", with_("pt") + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(0 AS BIGINT) AS n_inf, min({c}) AS min, max({c}) AS max, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')}, max({c}) - min({c}) AS range FROM pt" for c in ("x", "y")))
def _(s, d):
    return clean.coordinate_report(part_points(s, d), ["x", "y"])


@register("validation_report")
def _(s, d):
    return clean.validate(part_points(s, d), "x", "y", "value")


# --- outliers --------------------------------------------------------------------------------------------------------

_FENCE = "b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM em), fl AS (SELECT id, 'iqr_1.5' AS method FROM em, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"
_ZED = "zs AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM em), fz AS (SELECT id, 'z_2' AS method FROM em, zs WHERE abs(value - m) > 2 * s)"
_MODZ = "md AS (SELECT quantile_cont(value, 0.5) AS med FROM em), ma AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM em, md), fm AS (SELECT id, 'modified_z_2.5' AS method FROM em, md, ma WHERE 0.6745 * abs(value - med) > 2.5 * mad)"


@register("outliers_fences", with_("em") + f", {_FENCE} SELECT * FROM fl")
def _(s, d):
    return outliers.fences(vector_points(s, d))


@register("outliers_z", with_("em") + f", {_ZED} SELECT * FROM fz")
def _(s, d):
    return outliers.z_scores(vector_points(s, d), 2.0)


@register("outliers_modified_z", with_("em") + f", {_MODZ} SELECT * FROM fm")
def _(s, d):
    return outliers.modified_z(vector_points(s, d), 2.5)


@register("outliers_votes", with_("em") + f", {_FENCE}, {_ZED}, {_MODZ} SELECT id, count(*) AS n_votes, count(*) * 2 > 3 AS majority, count(*) = 3 AS unanimous FROM (SELECT * FROM fl UNION SELECT * FROM fz UNION SELECT * FROM fm) GROUP BY id")
def _(s, d):
    p = vector_points(s, d)
    return outliers.votes([outliers.fences(p), outliers.z_scores(p, 2.0), outliers.modified_z(p, 2.5)])


@register("outliers_distance", with_("em") + f", {KNN_SQL.format(k=10)}, t AS (SELECT qid AS id, avg(dist) AS d FROM knn GROUP BY qid) SELECT id, 'distance' AS method FROM t WHERE d > (SELECT quantile_cont(d, 0.9) FROM t)")
def _(s, d):
    return outliers.distance(vector_points(s, d))


_LOF = "kd AS (SELECT qid, max(dist) AS kd FROM knn GROUP BY qid), lr AS (SELECT knn.qid, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM knn JOIN kd ON kd.qid = knn.nid GROUP BY knn.qid), lo AS (SELECT knn.qid AS id, avg(n.lrd) / max(o.lrd) AS lof FROM knn JOIN lr n ON n.qid = knn.nid JOIN lr o ON o.qid = knn.qid GROUP BY knn.qid)"


@register("outlier_factor", with_("em") + f", {KNN_SQL.format(k=20)}, {_LOF} SELECT id, {R('lof', 'lof')} FROM lo")
def _(s, d):
    return outliers.lof_scores(vector_points(s, d), 20)


@register("outliers_residual", with_("em") + f", {_TREND}, e AS (SELECT id, value - a - b * x - c * y AS e FROM em, tr) SELECT id, 'residual' AS method FROM e WHERE abs(e) > 2.5 * (SELECT stddev_pop(e) FROM e)")
def _(s, d):
    return outliers.residual(vector_points(s, d))


@register("outliers_mahalanobis", with_("em") + ", m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM em) SELECT id, 'mahalanobis' AS method FROM em, m WHERE (pow(x - mx, 2) * b - 2 * (x - mx) * (y - my) * c + pow(y - my, 2) * a) / (a * b - c * c) > -2 * ln(0.1)")
def _(s, d):
    return outliers.mahalanobis(vector_points(s, d), 0.1, ("x", "y"))


@register("outliers_grubbs", "SELECT p_partkey AS id, 'grubbs' AS method FROM part WHERE p_partkey % 500 = 0")
def _(s, d):
    """With values of which some are far out."""
    return outliers.grubbs(part_points(s, d).withColumn("value", F.when(F.col("id") % 500 == 0, F.col("value") * 50).otherwise(F.col("value"))))


@register("outliers_edge")
def _(s, d):
    return outliers.edge(vector_points(s, d))


@register("outliers_robust")
def _(s, d):
    return outliers.robust_distance(vector_points(s, d))


@register("outliers_isolation")
def _(s, d):
    return outliers.isolation(vector_points(s, d))


@register("outliers_one_class")
def _(s, d):
    return outliers.one_class(vector_points(s, d))


# --- validation ------------------------------------------------------------------------------------------------------

_EMS = Search(radius=0.1, max_points=12)
_LOO = "lv AS (SELECT em.id, em.value AS a, e.estimate AS p FROM em JOIN (SELECT qid, " + IDW_SQL + " AS estimate FROM near GROUP BY qid) e ON e.qid = em.id)"
_METRICS = ", mm AS (SELECT avg(a) AS am, avg(p) AS pm, stddev_pop(a) AS asd, stddev_pop(p) AS psd, corr(a, p) AS r FROM lv) SELECT {lead}count(*) AS n, " + ", ".join(
    R(e, n)
    for e, n in (
        ("avg(abs(p - a))", "mae"), ("avg(pow(p - a, 2))", "mse"), ("sqrt(avg(pow(p - a, 2)))", "rmse"), ("avg(p - a)", "bias"), ("100 * avg(CASE WHEN abs(a) > 1e-10 THEN abs((p - a) / a) END)", "mape"),
        ("sqrt(avg(pow(p - a, 2))) / abs(avg(a))", "nrmse"), ("sqrt(avg(pow(p - a, 2))) / (max(a) - min(a))", "rnrmse"), ("100 * sum(p - a) / sum(a)", "pbias"), ("min(p - a)", "min_error"), ("max(p - a)", "max_error"),
        ("stddev_samp(p - a)", "std_error"), ("1 - sum(pow(p - a, 2)) / sum(pow(a - am, 2))", "r2"), ("1 - sum(abs(p - a)) / sum(abs(a - am))", "modified_nse"),
        ("1 - sum(pow(p - a, 2)) / sum(pow(abs(p - am) + abs(a - am), 2))", "willmott"), ("1 - sum(abs(p - a)) / sum(abs(p - am) + abs(a - am))", "willmott_1"),
        ("1 - sqrt(pow(max(r) - 1, 2) + pow(max(psd) / max(asd) - 1, 2) + pow(max(pm) / max(am) - 1, 2))", "kge"), ("1 - sum(abs(p - a)) / sum(a)", "volumetric_efficiency"),
    )
) + " FROM lv, mm"


_EM_LOO = f", {NEAR_SQL.format(q='em', n='em', w='q.id <> n.id', r=0.1, k=12)}, {_LOO}"


@register("leave_one_out", with_("em") + f", {NEAR_SQL.format(q='em', n='em', w='q.id <> n.id', r=0.1, k=12)}, {_LOO}{_METRICS.format(lead='')}")
def _(s, d):
    return validation.leave_one_out(vector_points(s, d), _EMS)


@register("k_fold", with_("em") + f", {NEAR_SQL.format(q='em', n='em', w='q.id % 5 <> n.id % 5', r=0.1, k=12)}, {_LOO}{_METRICS.format(lead='')}")
def _(s, d):
    return validation.k_fold(vector_points(s, d).withColumn("fold", F.col("id") % 5), _EMS)


@register("error_distribution", with_("em") + f", {NEAR_SQL.format(q='em', n='em', w='q.id <> n.id', r=0.1, k=12)}, {_LOO}, e AS (SELECT p - a AS e FROM lv), r AS (SELECT sqrt(avg(e * e)) AS r, avg(e) AS m FROM e), c AS (SELECT avg(pow(e - m, 2)) AS m2, avg(pow(e - m, 3)) AS m3, avg(pow(e - m, 4)) AS m4 FROM e, r) SELECT {R('avg(e)', 'mean')}, {R('quantile_cont(e, 0.5)', 'median')}, {R('stddev_samp(e)', 'std')}, {R('max(m3 / pow(m2, 1.5))', 'skewness')}, {R('max(m4 / (m2 * m2) - 3)', 'kurtosis')}, {R('quantile_cont(e, 0.75) - quantile_cont(e, 0.25)', 'iqr')}, {R('avg(CAST(abs(e) <= 0.5 * r AS INT))', 'within_half')}, {R('avg(CAST(abs(e) <= r AS INT))', 'within_one')}, {R('avg(CAST(abs(e) <= 2 * r AS INT))', 'within_two')}, count(*) FILTER (WHERE abs(e) > 3 * r) AS beyond_three FROM e, r, c")
def _(s, d):
    return statistics.error_distribution(interpolate.idw_leave_one_out(vector_points(s, d), _EMS))


@register("stratified_folds")
def _(s, d):
    return validation.stratified_folds(vector_points(s, d)).select("id", "stratum", "fold")


@register("shuffled_folds")
def _(s, d):
    return validation.folds(vector_points(s, d)).select("id", "fold")


@register("spatial_folds")
def _(s, d):
    return validation.spatial_folds(vector_points(s, d)).select("id", "fold")


@register("buffered_fold", with_("em") + "SELECT id FROM em a WHERE EXISTS (SELECT 1 FROM em b WHERE b.id % 5 = 2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02)")
def _(s, d):
    return validation.buffered(vector_points(s, d).withColumn("fold", F.col("id") % 5), 2, 0.02).select("id")


@register("method_comparison")
def _(s, d):
    return validation.compare(vector_points(s, d), {"power 1": (_EMS, 1.0), "power 2": (_EMS, 2.0), "power 3": (_EMS, 3.0)})


@register("bootstrap")
def _(s, d):
    return validation.bootstrap_idw(vector_points(s, d), grid.regular(s, _NODES), search=_EMS)


@register("monte_carlo")
def _(s, d):
    return validation.monte_carlo_idw(vector_points(s, d), grid.regular(s, _NODES), 0.05, search=_EMS)


@register("distance_uncertainty")
def _(s, d):
    return validation.distance_uncertainty(vector_points(s, d), grid.regular(s, _NODES))


@register("recommendation")
def _(s, d):
    return recommend.recommend(vector_points(s, d))


# --- windows over time -----------------------------------------------------------------------------------------------


@register("time_windows", f"SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, {R('avg(value)', 'mean')}, {R('min(value)', 'min')}, {R('max(value)', 'max')} FROM events GROUP BY ALL")
def _(s, d):
    return windows.windowed(table(s, d, "events"), "ts", "value", "event_type", "1 hour")


@register("time_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM g GROUP BY user_id, k")
def _(s, d):
    return windows.sessions(table(s, d, "events"), "ts", "user_id", "30 minutes")
