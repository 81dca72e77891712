"""Cross-validation folds, bootstrap, Monte Carlo and sensitivity.

Random choices are hashes of (seed, replicate, id), so they do not depend on how
rows are dealt to tasks. Replicates are rows, not driver loops: a resample is a
Poisson(1) count per (replicate, point), which needs no collecting.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.model import Search
from stratafold.operators.interpolate import idw_folds, idw_leave_one_out
from stratafold.operators.neighbours import nearest_join, radius_join, radius_nearest
from stratafold.operators.ranks import numbered, quantile_strata
from stratafold.operators.statistics import error_metrics
from stratafold.session import settled


def uniform(*keys) -> Column:
    """Number in [0, 1) that depends only on the keys."""
    return (F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)


def normal(*keys) -> Column:
    """Standard normal number that depends only on the keys."""
    return F.sqrt(-2 * F.log(1 - uniform(*keys, 1))) * F.cos(6.283185307179586 * uniform(*keys, 2))


def folds(points: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Even folds of points shuffled by the MD5 of seed and id."""
    rows = numbered(points.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"))), ["_h", "id"], "_row")
    return rows.withColumn("fold", ((F.col("_row") - 1) % n).cast("long")).drop("_h", "_row")


def spatial_folds(points: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Folds of near points, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("_v", array_to_vector(F.array("x", "y")))
    model = KMeans(k=n, seed=seed, featuresCol="_v", predictionCol="fold").fit(rows)
    return model.transform(rows).drop("_v").withColumn("fold", F.col("fold").cast("long"))


def stratified_folds(points: DataFrame, n: int = 5, strata: int = 5, seed: int = 42) -> DataFrame:
    """Each stratum of values is dealt to the folds in turn."""
    rows = points.withColumn("stratum", quantile_strata(points, "value", strata).cast("long")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")))
    # numbered over ranges of (stratum, hash), less the rows of the strata before: no stratum is one task
    placed = numbered(rows, ["stratum", "_h", "id"], "_row")
    first = F.broadcast(placed.groupBy("stratum").agg(F.min("_row").alias("_first")))
    return placed.join(first, "stratum").withColumn("fold", ((F.col("_row") - F.col("_first")) % n).cast("long")).drop("_h", "_row", "_first")


def buffered(points: DataFrame, fold: int, distance: float) -> DataFrame:
    """Points of the fold and all within the distance of one of them: the test set of a buffered fold."""
    test = points.where(F.col("fold") == fold)
    near = radius_join(points, test, distance, keep=()).select(F.col("qid").alias("id")).distinct()
    return points.join(near, "id", "left_semi")


def leave_one_out(points: DataFrame, search: Search = Search(), power: float = 2.0) -> DataFrame:
    return error_metrics(idw_leave_one_out(points, search, power))


def k_fold(points: DataFrame, search: Search = Search(), power: float = 2.0) -> DataFrame:
    """Metrics over all folds of a table with a fold column."""
    return error_metrics(idw_folds(points, "fold", search, power))


def fold_variability(predictions: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds of their root mean squared and mean absolute errors."""
    e = F.col("predicted") - F.col("actual")
    per = predictions.where("predicted is not null").groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return per.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"))


def compare(points: DataFrame, methods: dict[str, tuple[Search, float]]) -> DataFrame:
    """(method, metrics) of several searches and powers, by leave one out; methods of one search share its neighbours."""
    out, found = None, {}
    for name, (search, power) in methods.items():
        if search not in found:
            found[search] = settled(radius_nearest(points, points, search.max_points, search.radius, other=True))
        part = error_metrics(idw_leave_one_out(points, search, power, found[search])).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def poisson_count(u: Column, most: int = 8) -> Column:
    """Poisson(1) count of a uniform number, cut at ``most`` (beyond it is less than 2e-6)."""
    total, term, out = 0.0, exp(-1), F.lit(most)
    bounds = []
    for k in range(most):
        total += term
        term /= k + 1
        bounds.append(total)
    for k in range(most - 1, -1, -1):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out


def bootstrap_idw(points: DataFrame, targets: DataFrame, replicates: int = 100, search: Search = Search(), power: float = 2.0, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(id, mean, std, low, high) of the estimates of resampled points. Neighbours are joined once, each replicate weights them by its counts."""
    near = radius_join(targets, points, search.radius, strict=True)
    rows = near.select("qid", "nid", "dist", "value", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("count", poisson_count(uniform(seed, F.col("rep"), F.col("nid")))).where("count > 0")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid", "rep").orderBy("dist", "nid"))).where(F.col("rank") <= search.max_points)
    w = F.col("count") / F.pow(F.greatest("dist", F.lit(1e-10)), F.lit(float(power)))
    each = rows.groupBy("qid", "rep").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("e"))
    q = F.percentile("e", F.array(F.lit(0.5 - level / 2), F.lit(0.5 + level / 2)))
    return each.groupBy(F.col("qid").alias("id")).agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), q[0].alias("low"), q[1].alias("high"))


def monte_carlo_idw(points: DataFrame, targets: DataFrame, sigma: float, simulations: int = 200, search: Search = Search(), power: float = 2.0, seed: int = 42) -> DataFrame:
    """(id, mean, std, low, high) of the estimates under normal noise of the values."""
    near = radius_join(targets, points, search.radius, strict=True)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "nid"))).where(F.col("rank") <= search.max_points)
    rows = near.select("qid", "nid", "dist", "value", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("rep"))
    w = 1 / F.pow(F.greatest("dist", F.lit(1e-10)), F.lit(float(power)))
    each = rows.groupBy("qid", "rep").agg((F.sum(w * (F.col("value") + sigma * normal(seed, F.col("rep"), F.col("nid")))) / F.sum(w)).alias("e"))
    q = F.percentile("e", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy(F.col("qid").alias("id")).agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), q[0].alias("low"), q[1].alias("high"))


def distance_uncertainty(points: DataFrame, targets: DataFrame, measurement: float = 0.0, k: int = 5, z: float = 1.96) -> DataFrame:
    """(id, uncertainty, half_width): the deviation of the values times the mean distance to k neighbours over the mean of that."""
    s = points.agg(F.stddev_pop("value")).first()[0] or 0.0
    d = nearest_join(targets, points, k, keep=()).groupBy(F.col("qid").alias("id")).agg(F.avg("dist").alias("d"))
    scale = F.broadcast(d.agg(F.avg("d").alias("m")))
    u = F.sqrt(F.lit(measurement * measurement) + F.pow(s * F.coalesce(F.try_divide(F.col("d"), F.col("m")), F.lit(0.0)), F.lit(2.0)))
    return d.crossJoin(scale).select("id", u.alias("uncertainty"), (z * u).alias("half_width"))


def morris(evaluate, ranges: dict[str, tuple[float, float]], trajectories: int = 10, delta: float = 0.1, seed: int = 42) -> dict[str, dict[str, float]]:
    """Elementary effects of parameters on a driver-side number; few evaluations by design."""
    import numpy as np

    rng = np.random.default_rng(seed)
    effects: dict[str, list[float]] = {k: [] for k in ranges}
    for _ in range(trajectories):
        at = {k: rng.uniform(lo, hi - delta * (hi - lo)) for k, (lo, hi) in ranges.items()}
        y = evaluate(at)
        for k in rng.permutation(list(ranges)):
            lo, hi = ranges[k]
            at = at | {k: at[k] + delta * (hi - lo)}
            new = evaluate(at)
            effects[k].append((new - y) / delta)
            y = new
    return {k: {"mean": float(np.mean(v)), "mean_abs": float(np.mean(np.abs(v))), "std": float(np.std(v))} for k, v in effects.items()}


def sobol(evaluate, ranges: dict[str, tuple[float, float]], n: int = 64, seed: int = 42) -> dict[str, dict[str, float]]:
    """First and total order indices by two sample matrices and their column swaps."""
    import numpy as np

    rng = np.random.default_rng(seed)
    names = list(ranges)
    low, high = np.array([ranges[k][0] for k in names]), np.array([ranges[k][1] for k in names])
    a, b = (low + rng.random((n, len(names))) * (high - low) for _ in range(2))
    run = lambda m: np.array([evaluate(dict(zip(names, row))) for row in m])
    ya, yb = run(a), run(b)
    var, middle = np.var(np.concatenate([ya, yb])) or 1.0, np.mean(np.concatenate([ya, yb]))
    out = {}
    for i, k in enumerate(names):
        m = a.copy()
        m[:, i] = b[:, i]
        y = run(m)
        out[k] = {"first": float(np.mean((yb - middle) * (y - ya)) / var), "total": float(np.mean((ya - y) ** 2) / (2 * var))}
    return out
