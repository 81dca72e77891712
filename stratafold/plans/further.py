"""Queries of parameter searches, resampled scores and the tables behind drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.model import Variogram
from stratafold.operators import interpolate as ip
from stratafold.operators import outliers, panels, tuning, validation
from stratafold.plans.queries import _EM_LOO, _EMS, R, register
from stratafold.plans.tables import part_points, table, vector_points, with_

_MODELS = {"spherical": Variogram("spherical", 0.0, 0.01, 0.2), "exponential": Variogram("exponential", 0.002, 0.01, 0.1)}
_CURVES = "CASE WHEN h <= 0 THEN 0 WHEN m = 'spherical' THEN CASE WHEN h < 0.2 THEN 0.01 * (1.5 * h / 0.2 - 0.5 * pow(h / 0.2, 3)) ELSE 0.01 END ELSE 0.002 + 0.01 * (1 - exp(-h / 0.1)) END"
_LEFT = with_("em") + _EM_LOO + ", e AS (SELECT id, a AS actual, p AS predicted, p - a AS error FROM lv WHERE p IS NOT NULL)"
_VOTES = "v AS (SELECT p_partkey AS id, 'price' AS method FROM part WHERE p_retailprice > 1500 UNION SELECT p_partkey, 'size' FROM part WHERE p_size > 40 UNION SELECT p_partkey, 'key' FROM part WHERE p_retailprice < 950)"


def _flags(s, d):
    p = table(s, d, "part").withColumnRenamed("p_partkey", "id")
    tests = {"price": "p_retailprice > 1500", "size": "p_size > 40", "key": "p_retailprice < 950"}
    out = None
    for name, test in tests.items():
        part = p.where(test).select("id", F.lit(name).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out


@register("model_curves", f"SELECT m AS model, {R('h', 'h')}, {R(_CURVES, 'gamma')} FROM (SELECT m, i * CAST({0.5 / 99!r} AS DOUBLE) AS h FROM range(100) t(i), (VALUES ('spherical'), ('exponential')) k(m))")
def _(s, d):
    return panels.model_curves(s, _MODELS, 0.5)


@register("anisotropy_rose", f"SELECT {R('a', 'angle')}, {R('2 * sqrt(pow(cos(a - pi() / 6), 2) + 1.8 * pow(sin(a - pi() / 6), 2))', 'range')} FROM (SELECT i * 2 * pi() / 99 AS a FROM range(100) t(i))")
def _(s, d):
    return panels.rose(s, 2.0, 1.8, 30.0)


@register("residuals", _LEFT + f" SELECT id, {R('actual', 'actual')}, {R('predicted', 'predicted')}, {R('error', 'error')}, {R('(error - (SELECT avg(error) FROM e)) / (SELECT stddev_pop(error) FROM e)', 'z')} FROM e")
def _(s, d):
    return panels.residuals(ip.idw_leave_one_out(vector_points(s, d), _EMS))


@register("error_histogram", _LEFT + f", b AS (SELECT min(error) AS lo, max(error) AS hi FROM e), c AS (SELECT least(CAST(floor((error - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM e, b GROUP BY 1) SELECT i AS bin, {R('lo + i * ((hi - lo) / 30)', 'low')}, {R('lo + (i + 1) * ((hi - lo) / 30)', 'high')}, coalesce(n, 0) AS n FROM range(30) t(i) LEFT JOIN c ON c.bin = i, b")
def _(s, d):
    return panels.error_histogram(ip.idw_leave_one_out(vector_points(s, d), _EMS))


@register("training_summary", with_("em") + f"SELECT count(*) AS n, {', '.join(R(f'{f}({c})', f'{c}_{n}') for c in ('x', 'y') for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))}, {R('avg(value)', 'value_mean')}, {R('stddev_samp(value)', 'value_std')}, {R('min(value)', 'value_min')}, {R('max(value)', 'value_max')} FROM em")
def _(s, d):
    return panels.training_summary(vector_points(s, d))


@register("vote_summary", f"WITH {_VOTES}, c AS (SELECT id, count(*) AS v FROM v GROUP BY id) SELECT 3 AS methods, count(*) AS \"any\", count(*) FILTER (WHERE v * 2 > 3) AS majority, count(*) FILTER (WHERE v = 3) AS \"all\", {R('count(*) FILTER (WHERE v = 3) / count(*)', 'agreement')} FROM c")
def _(s, d):
    return panels.vote_summary(_flags(s, d), 3)


@register("top_votes", f"WITH {_VOTES}, c AS (SELECT p_partkey AS id, count(method) AS votes FROM part LEFT JOIN v ON v.id = p_partkey GROUP BY p_partkey) SELECT * FROM c WHERE votes >= (SELECT quantile_cont(votes, 0.9) FROM c)")
def _(s, d):
    return panels.top_votes(_flags(s, d), part_points(s, d))


@register("rbf_random")
def _(s, d):
    return tuning.rbf_random(vector_points(s, d))


@register("rbf_evolution")
def _(s, d):
    return tuning.rbf_evolution(vector_points(s, d))


@register("silhouettes")
def _(s, d):
    return tuning.silhouettes(vector_points(s, d), [2, 3, 4, 5])


@register("density_search")
def _(s, d):
    return tuning.density_search(vector_points(s, d))


@register("kriging_folds")
def _(s, d):
    return tuning.krige_folds(vector_points(s, d).withColumn("fold", F.col("id") % 5), "fold", _MODELS["spherical"], _EMS)


@register("variogram_model_scores")
def _(s, d):
    return tuning.model_scores(validation.folds(vector_points(s, d)), "fold", _MODELS, _EMS)


@register("bootstrap_metric")
def _(s, d):
    return tuning.bootstrap_metric(vector_points(s, d), search=_EMS)


@register("ensemble_summary")
def _(s, d):
    p = vector_points(s, d)
    flags = [outliers.fences(p), outliers.z_scores(p, 2.0), outliers.modified_z(p, 2.5)]
    return panels.vote_summary(flags[0].unionByName(flags[1]).unionByName(flags[2]), 3)
