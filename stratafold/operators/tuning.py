"""Searches over parameters and resampled scores: radial bases, clusterings, variogram models, user-defined metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.model import Kriging, Search, Variogram
from stratafold.operators.interpolate import _krige, _local_batch, fold_nearest, global_rows, kernel_values
from stratafold.operators.neighbours import nearest_join, radius_join, radius_nearest
from stratafold.operators.spatial import dbscan
from stratafold.operators.statistics import error_metrics
from stratafold.operators.validation import poisson_count, uniform
from stratafold.session import reachable, settled

# The ranges that the searches draw from.
SEARCHED_KERNELS = ("gaussian", "multiquadric", "inverse_multiquadric", "thin_plate")
LOG_EPSILON, LOG_REGULARIZATION, DEGREES = (-2.0, 2.0), (-15.0, -8.0), (-1, 0, 1)
EPS_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5)


def left_out_rmse(gap: np.ndarray, rows: np.ndarray, kernel: str, epsilon: float, regularization: float, degree: int = -1) -> float:
    """Root mean squared leave-one-out error of a global system, in closed form; infinite where it has none."""
    n = len(rows)
    system, values = kernel_values(kernel, gap, epsilon) + regularization * np.eye(n), rows[:, 2]
    if degree >= 0:
        poly = np.column_stack([np.ones(n), rows[:, :2]])[:, : 1 + 2 * degree]
        m = poly.shape[1]
        system = np.block([[system, poly], [poly.T, np.zeros((m, m))]])
        values = np.concatenate([values, np.zeros(m)])
    inverse = np.linalg.pinv(system, rcond=1e-12, hermitian=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        error = float(np.sqrt(np.mean(((inverse @ values)[:n] / np.diag(inverse)[:n]) ** 2)))
    return error if np.isfinite(error) else float("inf")


def rbf_random(points: DataFrame, draws: int = 100, kernels: Sequence[str] = SEARCHED_KERNELS, seed: int = 42) -> DataFrame:
    """(draw, kernel, epsilon, regularization, degree, rmse) of randomly drawn parameters, each draw a task of its own; best first by rmse."""
    rows = global_rows(points)
    spark = points.sparkSession
    reachable(spark)
    rng = np.random.default_rng(seed)
    drawn = [(i, str(rng.choice(kernels)), float(10 ** rng.uniform(*LOG_EPSILON)), float(10 ** rng.uniform(*LOG_REGULARIZATION)), int(rng.choice(DEGREES))) for i in range(draws)]

    def errors(batches):
        gap = np.linalg.norm(rows[:, None, :2] - rows[None, :, :2], axis=2)
        for b in batches:
            found = [left_out_rmse(gap, rows, *given) for given in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "rmse"])

    schema = "draw int, kernel string, epsilon double, regularization double, degree int"
    return spark.createDataFrame(drawn, schema).repartition(max(draws, 1)).mapInArrow(errors, f"{schema}, rmse double")


def rbf_evolution(points: DataFrame, kernels: Sequence[str] = SEARCHED_KERNELS, generations: int = 15, population: int = 10, seed: int = 42) -> DataFrame:
    """(kernel, epsilon, regularization, rmse): per kernel, a task of its own, the best logarithms found by differential evolution (rand/1/bin)."""
    rows = global_rows(points)
    spark = points.sparkSession
    reachable(spark)

    def evolve(batches):
        gap = np.linalg.norm(rows[:, None, :2] - rows[None, :, :2], axis=2)
        low, high = np.array([LOG_EPSILON[0], LOG_REGULARIZATION[0]]), np.array([LOG_EPSILON[1], LOG_REGULARIZATION[1]])
        for b in batches:
            out = []
            for kernel in b.column(0).to_pylist():
                rng = np.random.default_rng(seed)
                cost = lambda at, kernel=kernel: left_out_rmse(gap, rows, kernel, *(10**at))
                pool = low + rng.random((population, 2)) * (high - low)
                score = np.array([cost(p) for p in pool])
                for _ in range(generations):
                    for i in range(population):
                        a, c, d = pool[rng.choice(np.delete(np.arange(population), i), 3, replace=False)]
                        cross = rng.random(2) < 0.7
                        cross[rng.integers(2)] = True
                        trial = np.where(cross, np.clip(a + 0.8 * (c - d), low, high), pool[i])
                        if (new := cost(trial)) <= score[i]:
                            pool[i], score[i] = trial, new
                best = int(score.argmin())
                out.append((kernel, *(10 ** pool[best]), score[best]))
            kinds = [pa.string()] + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], ["kernel", "epsilon", "regularization", "rmse"])

    return spark.createDataFrame([(k,) for k in kernels], "kernel string").repartition(len(kernels)).mapInArrow(evolve, "kernel string, epsilon double, regularization double, rmse double")


def rbf_advice(points: DataFrame, condition: float | None = None) -> dict:
    """Size class, search method, kernels, shape parameter and regularisation to start from."""
    s = points.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("wx"), (F.max("y") - F.min("y")).alias("wy"), (F.max("value") - F.min("value")).alias("span"), F.stddev_pop("value").alias("std")).first()
    width = ((s.wx or 0.0) + (s.wy or 0.0)) / 2
    area = (s.wx or 0.0) * (s.wy or 0.0)
    if s.n < 100:
        size, method, kernels = "small", "grid", ["multiquadric", "inverse_multiquadric"]
    elif s.n < 1000:
        size, method, kernels = "medium", "random", ["multiquadric", "gaussian", "thin_plate"]
    else:
        size, method, kernels = "large", "evolution", ["multiquadric", "gaussian"]
    ill = condition or 0.0
    return {"n": s.n, "size": size, "method": method, "kernels": kernels, "epsilon": 1 / width if width > 0 else 1.0, "regularization": 1e-8 if ill > 1e10 else 1e-10 if ill > 1e8 else 1e-12, "value_range": s.span, "value_std": s.std, "density": s.n / area if area > 0 else 0.0}


def silhouettes(points: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, best) of k-means on the places. Silhouettes use squared distances, so they need one pass and no pairs; best marks the largest second difference of inertias."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = settled(points.select(array_to_vector(F.array("x", "y")).alias("features")))
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(rows)
        found.append((int(k), float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(rows)))))
    bend = np.diff([f[1] for f in found], 2)
    best = ks[int(np.argmax(bend)) + 1] if len(bend) else ks[0]
    return points.sparkSession.createDataFrame([(*f, f[0] == best) for f in found], "k int, inertia double, silhouette double, best boolean")


def density_search(points: DataFrame, factors: Sequence[float] = EPS_FACTORS, leasts: Sequence[int] | None = None) -> DataFrame:
    """(eps, least, clusters, noise, score) of density clusterings around the 95th percentile of third-neighbour distances; score is clusters over 1 + noise share."""
    third = nearest_join(points, points, 3, other=True, keep=()).where("rank = 3")
    eps = third.agg(F.percentile("dist", 0.95)).first()[0] or 0.1
    n = points.count()
    spark = points.sparkSession
    out = []
    for factor in factors:
        for least in sorted(set(leasts or (3, 5, max(3, n // 20)))):
            if least < n:
                s = dbscan(points, eps * factor, least).agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("c"), F.count_if(F.col("cluster") < 0).alias("noise")).first()
                out.append((eps * factor, least, s.c, s.noise, s.c / (1 + s.noise / n)))
    return spark.createDataFrame(out, "eps double, least int, clusters long, noise long, score double")


def krige_folds(points: DataFrame, fold: str, model: Variogram, search: Search = Search(), k: Kriging = Kriging()) -> DataFrame:
    """(id, fold, actual, predicted, variance): each point estimated by local kriging from the neighbours in other folds, all folds in one job."""
    reachable(points.sparkSession)
    mean = k.mean if k.mean is not None else (points.agg(F.avg("value")).first()[0] or 0.0)
    found = fold_nearest(points, fold, search, ("x", "y", "value")).withColumnsRenamed({"x": "px", "y": "py"})
    near = found.groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "px", "py", "value"))).alias("near"))
    rows = points.select("id", F.col("x").alias("tx"), F.col("y").alias("ty")).join(near, "id", "left").select("id", "tx", "ty", "near.px", "near.py", F.col("near.value").alias("nv"))
    solve = lambda p, v, t: _krige(p, v, t, model, k, mean)
    estimates = rows.mapInArrow(lambda batches: (_local_batch(b, solve, mean, model.sill, model.nugget + model.sill) for b in batches), "id long, estimate double, variance double")
    return points.select("id", F.col(fold), F.col("value").alias("actual")).join(estimates.withColumnRenamed("estimate", "predicted"), "id")


def model_scores(points: DataFrame, fold: str, models: dict[str, Variogram], search: Search = Search()) -> DataFrame:
    """(model, n, rmse, mae, r2) of variogram models by cross-validated kriging."""
    out = None
    for name, model in models.items():
        part = error_metrics(krige_folds(points, fold, model, search)).select(F.lit(name).alias("model"), "n", "rmse", "mae", "r2")
        out = part if out is None else out.unionByName(part)
    return out


def root_mean_square(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((predicted - actual) * (predicted - actual)))


def bootstrap_metric(points: DataFrame, metric: Callable[[Column, Column], Column] = root_mean_square, replicates: int = 50, test_share: float = 0.2, search: Search = Search(), power: float = 2.0, seed: int = 42) -> DataFrame:
    """(rep, n, metric): a user's aggregate of (actual, predicted) over the test points of each replicate.

    ``metric`` builds an aggregate column, so it runs with partial aggregation and no replicate is gathered in one task.
    In each replicate ``test_share`` of the points are estimated by inverse distance from the others, which count by
    Poisson numbers as in a resample with replacement.
    """
    usable = (1 - test_share) * (1 - exp(-1))
    most = search.max_points
    # so many neighbours that nearly always enough of them are in a replicate; where they are not, all within the radius are used
    k = ceil((most + 6 * most**0.5 + 8) / max(usable, 1e-3))
    near = settled(radius_nearest(points, points, k, search.radius, other=True))
    tested = lambda c: uniform(seed, F.lit("test"), F.col("rep"), F.col(c)) < test_share
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")

    def estimates(near: DataFrame) -> DataFrame:
        """(qid, rep, n, predicted). Rows of a point stay in one task from here on."""
        rows = near.repartition("qid").select("qid", "nid", "dist", "value", reps).where(tested("qid") & ~tested("nid"))
        rows = rows.withColumn("count", poisson_count(uniform(seed, F.col("rep"), F.col("nid")))).where("count > 0")
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid", "rep").orderBy("dist", "nid"))).where(F.col("rank") <= most)
        w = F.col("count") / F.pow(F.greatest("dist", F.lit(1e-10)), F.lit(float(power)))
        return rows.groupBy("qid", "rep").agg(F.count("*").alias("n"), (F.sum(w * F.col("value")) / F.sum(w)).alias("predicted"))

    each = settled(estimates(near))
    full = near.groupBy("qid").count().where(F.col("count") >= k).select("qid")
    short = settled(full.select("qid", reps).where(tested("qid")).join(each.where(F.col("n") >= most), ["qid", "rep"], "left_anti"))
    if not short.isEmpty():
        again = points.join(short.select(F.col("qid").alias("id")).distinct(), "id", "left_semi")
        found = estimates(radius_join(again, points, search.radius, strict=True, other=True)).join(short, ["qid", "rep"], "left_semi")
        each = each.join(short, ["qid", "rep"], "left_anti").unionByName(found)
    known = each.join(points.select(F.col("id").alias("qid"), F.col("value").alias("actual")), "qid")
    return known.groupBy("rep").agg(F.count("*").alias("n"), metric(F.col("actual"), F.col("predicted")).alias("metric"))
