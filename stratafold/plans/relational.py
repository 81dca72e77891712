"""Relational and ordered joins on the star schema: what an analytics user expects beside the spatial operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.operators import more, neighbours, spatial, statistics, validation
from stratafold.operators import interpolate as ip
from stratafold.plans.queries import _EM_LOO, _EMS, R, register
from stratafold.plans.tables import part_points, table, vector_points, with_


def as_of(left, right, key: str, time: str, value: str):
    """Each left row with the last right value of its key at or before its time: a union and a running last, no range join."""
    a = left.select(key, time, "row", F.lit(None).cast("double").alias(value), F.lit(1).alias("side"))
    b = right.select(key, time, F.lit(None).cast("long").alias("row"), value, F.lit(0).alias("side"))
    window = W.partitionBy(key).orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("as_of", F.last(value, ignorenulls=True).over(window)).where("side = 1").select("row", "as_of")


@register("as_of_join", "SELECT l.event_id AS row, r.value AS as_of FROM (SELECT * FROM events WHERE event_id % 3 = 0) l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(s, d):
    e = table(s, d, "events")
    left = e.where("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("row"))
    right = e.where("event_id % 3 <> 0").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(left, right, "user_id", "ts", "value")


@register("star_join", f"SELECT n_name, c_mktsegment, count(*) AS n, {R('sum(l_extendedprice * (1 - l_discount))', 'revenue', 1)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment", 1)
def _(s, d):
    li, o, c, n = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@register("rollup", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {R('avg(l_quantity)', 'mean')} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))


@register("semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n")).unionByName(c.join(o, "c_custkey", "left_anti").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


@register("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) UNION ALL SELECT 'first', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)")
def _(s, d):
    li = table(s, d, "lineitem")
    a, b = li.where("l_quantity > 45").select("l_suppkey"), li.where("l_discount > 0.09").select("l_suppkey")
    return a.intersect(b).agg(F.lit("both").alias("kind"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("first").alias("kind"), F.count("*").alias("n")))


_ERR = with_("em") + _EM_LOO


@register("gridded_errors", _ERR + f", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM em) SELECT least(CAST(floor((x - x0) / (x1 - x0) * 5) AS BIGINT), 4) AS ix, least(CAST(floor((y - y0) / (y1 - y0) * 5) AS BIGINT), 4) AS iy, {R('avg(p - a)', 'mean_error')}, count(*) AS n FROM lv JOIN em USING (id), b GROUP BY 1, 2")
def _(s, d):
    p = vector_points(s, d)
    return more.gridded_errors(ip.idw_leave_one_out(p, _EMS), p)


@register("error_gradient", _ERR + f", e AS (SELECT x, y, p - a AS e FROM lv JOIN em USING (id)), m AS (SELECT var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, e) AS sxe, covar_pop(y, e) AS sye FROM e), g AS (SELECT (sxe * syy - sye * sxy) / (sxx * syy - sxy * sxy) AS b, (sye * sxx - sxe * sxy) / (sxx * syy - sxy * sxy) AS c FROM m) SELECT {R('sqrt(b * b + c * c)', 'gradient')}, {R('degrees(atan2(c, b))', 'direction')} FROM g")
def _(s, d):
    p = vector_points(s, d)
    return more.error_gradient(ip.idw_leave_one_out(p, _EMS), p)


@register("error_autocorrelation")
def _(s, d):
    p = vector_points(s, d)
    e = ip.idw_leave_one_out(p, _EMS).where("predicted is not null").join(p.select("id", "x", "y"), "id")
    return spatial.moran(e.withColumn("value", F.col("predicted") - F.col("actual")), 0.1)


@register("nearest_grid")
def _(s, d):
    from stratafold.model import Grid
    from stratafold.operators import grid

    return more.nearest_grid(vector_points(s, d), grid.regular(s, Grid(bounds=(-0.3, 0.3, -0.3, 0.3), nx=20, ny=20)), 0.06)


@register("rbf_search")
def _(s, d):
    return more.rbf_search(vector_points(s, d))


@register("shapiro")
def _(s, d):
    w, p = more.shapiro(table(s, d, "nation").withColumn("value", F.col("n_nationkey") * F.col("n_nationkey")), "value")
    return s.createDataFrame([(w, p)], "w double, p double")


@register("best_power")
def _(s, d):
    return s.createDataFrame([(k, more.best_power(part_points(s, d), "value", k)) for k in ("box_cox", "yeo_johnson")], "kind string, lambda double")


@register("spatial_bootstrap")
def _(s, d):
    return more.spatial_bootstrap(vector_points(s, d), 0.05).groupBy("rep").agg(F.count("*").alias("n"))


@register("method_checks", "SELECT * FROM (VALUES ('error', 'few points for a variogram'), ('warning', 'a trend')) t(level, rule)")
def _(s, d):
    r = F.col("r_regionkey").cast("double")
    return more.method_checks(table(s, d, "region").select(r.alias("x"), (r * r).alias("y"), (2 * r).alias("value")), "kriging")


@register("fold_variability")
def _(s, d):
    return validation.fold_variability(ip.idw_folds(vector_points(s, d).withColumn("fold", F.col("id") % 5), "fold", _EMS))


@register("quality_class")
def _(s, d):
    return statistics.quality_class(validation.leave_one_out(vector_points(s, d), _EMS))


@register("nearest_with_fallback")
def _(s, d):
    p = vector_points(s, d)
    return neighbours.with_fallback(p, p, 4, 0.03, 3, keep=())
