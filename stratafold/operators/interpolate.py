"""Inverse distance, kriging and radial basis interpolation.

Inverse distance is a join and an aggregation. Local kriging and local radial
bases gather at most ``max_points`` neighbours per target by the same join and
solve the small systems in Arrow batches, all systems of one size at once. The
global forms solve one system of all points: up to GLOBAL_LIMIT points in memory,
beyond that by a factor in a file of the driver, if the system is positive definite
once a constant is taken from it (kriging, the linear kernel).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.scalar import anisotropy, idw_weight
from stratafold.model import Kriging, Rbf, Search, Variogram
from stratafold.operators.dense import Factor
from stratafold.operators.iterated import Kernel, System
from stratafold.operators.neighbours import nearest_join, radius_nearest, sector_join, with_fallback
from stratafold.session import reachable

GLOBAL_LIMIT = 5000
#: Targets of a large global system that are estimated at once.
TARGETS = 256
#: Share of the sill up to which a regularization is there for the arithmetic only.
HELP = 1e-7
EXACT = 1e-10


def _turned(df: DataFrame, search: Search) -> DataFrame:
    if search.anisotropy_ratio == 1 and not search.anisotropy_angle:
        return df
    x, y = anisotropy(F.col("x"), F.col("y"), search.anisotropy_ratio, search.anisotropy_angle)
    return df.withColumns({"x": x, "y": y})


def idw_weighted(found: DataFrame, power: float = 2.0, smoothing: float = 0.0) -> DataFrame:
    """(id, estimate, n) of found neighbours: the mean of those at the place itself, else the weighted mean."""
    exact = F.col("dist") < EXACT
    w = F.when(~exact, idw_weight(F.col("dist"), power, smoothing))
    return found.groupBy(F.col("qid").alias("id")).agg(F.coalesce(F.avg(F.when(exact, F.col("value"))), F.sum(w * F.col("value")) / F.sum(w)).alias("estimate"), F.count("*").alias("n"))


def idw(points: DataFrame, targets: DataFrame, search: Search = Search(), power: float = 2.0, smoothing: float = 0.0, axes=("x", "y")) -> DataFrame:
    """(id, estimate, n) for every target; null without a neighbour closer than the radius."""
    p, t = _turned(points, search), _turned(targets, search)
    if search.sectors:
        found = sector_join(t, p, search.radius, search.sectors, search.max_per_sector)
        bare = t.join(found.select(F.col("qid").alias("id")).distinct(), "id", "left_anti")
        found = found.select("qid", "dist", "value").unionByName(nearest_join(bare, p, search.max_points).select("qid", "dist", "value"))
    else:
        found = radius_nearest(t, p, search.max_points, search.radius, axes)
    return targets.select("id").join(idw_weighted(found, power, smoothing), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def idw_leave_one_out(points: DataFrame, search: Search = Search(), power: float = 2.0, found: DataFrame | None = None) -> DataFrame:
    """(id, actual, predicted): each point estimated from the others; one self join instead of a fit per point. ``found``: the neighbours, where they are known."""
    if found is None:
        found = radius_nearest(points, points, search.max_points, search.radius, other=True)
    return points.select("id", F.col("value").alias("actual")).join(idw_weighted(found, power).select("id", F.col("estimate").alias("predicted")), "id", "left")


def idw_folds(points: DataFrame, fold: str, search: Search = Search(), power: float = 2.0) -> DataFrame:
    """(id, fold, actual, predicted): each point estimated from the other folds, all folds in one join."""
    found = fold_nearest(points, fold, search)
    return points.select("id", fold, F.col("value").alias("actual")).join(idw_weighted(found, power).select("id", F.col("estimate").alias("predicted")), "id", "left")


def fold_nearest(points: DataFrame, fold: str, search: Search, keep: Sequence[str] = ("value",)) -> DataFrame:
    """The nearest neighbours of each point in other folds."""
    return radius_nearest(points, points, search.max_points, search.radius, other=True, keep=keep, unlike=fold)


def global_rows(points: DataFrame, axes=("x", "y")) -> np.ndarray:
    """Places and value of all points, for one dense system; more than GLOBAL_LIMIT points are refused, never cut."""
    rows = points.select(*axes, "value").orderBy("id").limit(GLOBAL_LIMIT + 1).toPandas().to_numpy()
    if len(rows) > GLOBAL_LIMIT:
        raise ValueError(f"a global system takes at most {GLOBAL_LIMIT} points; give a search")
    return rows


def _large(points: DataFrame) -> bool:
    return points.limit(GLOBAL_LIMIT + 1).count() > GLOBAL_LIMIT


def _all_rows(points: DataFrame, axes) -> np.ndarray:
    """Places and value of all points by id: a few numbers a point, whatever their number."""
    return points.select(*axes, "value", "id").orderBy("id").toPandas()[[*axes, "value"]].to_numpy(dtype=float)


def _solved(spark, places: np.ndarray, model: Variogram | None, top: float, regularization: float, solve):
    """``solve`` of a system (n, solve, squares, added, top) of top - curve(gap) - regularization on the diagonal. Where copies or rounding leave it not positive definite the regularization is added instead, then a higher top is tried: it changes no result, as weights sum to what they have to.

    A regularization that is there for the arithmetic only is left out. Where conjugate gradients do not end, the factor in a file of the driver is used.
    """
    less = 0.0 if 0 < regularization <= HELP * top else -regularization
    for kind, tops in ((System, ((top, less), (top, abs(regularization)), (4 * top, abs(regularization)))), (_Factored, ((top, -regularization), (top, regularization), (4 * top, regularization), (16 * top, regularization)))):
        for t, r in tops:
            system = None
            try:
                system = kind(spark, places, Kernel(model, t, model_values), r)
                return solve(system)
            except np.linalg.LinAlgError:
                pass
            finally:
                if system is not None:
                    system.close()
    raise ValueError("the global system is not positive definite; give a search")


class _Factored:
    """A system by its factor; what helped the arithmetic of the factor is taken out again by turns of solving."""

    def __init__(self, spark, places: np.ndarray, kernel: Kernel, added: float) -> None:
        self.places, self.kernel, self.added = places, kernel, added
        entries = lambda i, j: kernel(places[i], places[j]) + added * np.eye(i.stop - i.start) if i == j else kernel(places[i], places[j])
        self.factor = Factor(len(places), entries)

    def close(self) -> None:
        self.factor.file.close()

    def solve(self, right: np.ndarray) -> np.ndarray:
        out = term = self.factor.backward(self.factor.forward(right))
        # copies of a place, which have it added, would not allow that
        for _ in range(2 if -HELP * self.kernel.top <= self.added < 0 else 0):
            term = self.factor.backward(self.factor.forward(self.added * term))
            out = out + term
        return out

    def squares(self, targets: np.ndarray) -> np.ndarray:
        parts = (self.factor.forward(self.kernel(self.places, targets[i : i + TARGETS])) for i in range(0, len(targets), TARGETS))
        return np.concatenate([np.zeros(0), *((g * g).sum(0) for g in parts)])


def _in_turn(batches, axes, estimate):
    """(id, estimate) batches, so many targets at once."""
    for b in batches:
        t = np.column_stack([b.column(1 + i).to_numpy() for i in range(len(axes))])
        est = np.concatenate([np.zeros(0), *(estimate(t[i : i + TARGETS]) for i in range(0, len(t), TARGETS))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(est)], ["id", "estimate"])


def _spread(targets: DataFrame, n: int) -> DataFrame:
    """Targets dealt to all cores, as each costs a pass over all points."""
    cores = targets.sparkSession.sparkContext.defaultParallelism
    return targets.repartition(4 * cores) if n > GLOBAL_LIMIT else targets


def _large_kriging(points: DataFrame, targets: DataFrame, model: Variogram, k: Kriging, mean: float, axes, variance: bool) -> DataFrame:
    """Kriging from more than GLOBAL_LIMIT points: the same system as covariances, its drift by a Schur complement. Estimates are made in Arrow batches from the weights of the values; variances are made on the driver, whose rows are few numbers a target."""
    rows = _all_rows(points, axes)
    places, values = rows[:, :-1], rows[:, -1]
    spark = points.sparkSession
    bounded = model.kind in ("spherical", "exponential", "gaussian", "nugget")
    sill = model.nugget + model.sill
    simple = k.kind == "simple"
    top = sill if bounded or simple else 2 * float(model_values(model, np.array([np.linalg.norm(np.ptp(places, axis=0))]))[0])
    drift = lambda t: np.zeros((len(t), 0)) if simple else np.ones((len(t), 1)) if k.kind == "ordinary" else np.column_stack([np.ones(len(t)), t])
    found = targets.select("id", *axes).toPandas() if variance else None

    def solve(system):
        if simple:
            alpha, half, beta = system.solve((values - mean)[:, None])[:, 0], np.zeros((len(places), 0)), np.zeros(0)
        else:
            both = system.solve(np.column_stack([values, drift(places)]))
            half = both[:, 1:]
            beta = np.linalg.solve(drift(places).T @ half, half.T @ values)
            alpha = both[:, 0] - half @ beta
        gram, kernel = drift(places).T @ half, system.kernel
        if not variance:
            return kernel, alpha, beta, None
        at = found[list(axes)].to_numpy(dtype=float)
        left = kernel.top - system.squares(at)
        if not simple:
            lack = drift(at).T - kernel.times(at, places, half).T
            left += (np.linalg.solve(gram, lack) * lack).sum(0)
        return kernel, alpha, beta, np.maximum(left, 0)

    kernel, alpha, beta, var = _solved(spark, places, model, top, -k.regularization if simple else k.regularization, solve)

    def estimate(t: np.ndarray) -> np.ndarray:
        near = kernel.times(t, places, alpha[:, None])[:, 0]
        return mean + near if simple else near + drift(t) @ beta

    if not variance:
        return _spread(targets.select("id", *axes), len(places)).mapInArrow(lambda batches: _in_turn(batches, axes, estimate), "id long, estimate double").withColumn("variance", F.lit(None).cast("double"))
    found = found.assign(estimate=estimate(found[list(axes)].to_numpy(dtype=float)), variance=var)[["id", "estimate", "variance"]]
    return spark.createDataFrame(pa.Table.from_pandas(found, preserve_index=False))


def _large_rbf(points: DataFrame, targets: DataFrame, p: Rbf, axes) -> DataFrame:
    """The linear kernel at more than GLOBAL_LIMIT points: a constant less the distances is positive definite, and the constant is taken out again."""
    rows = _all_rows(points, axes)
    places, values = rows[:, :-1], rows[:, -1:]
    poly = _terms(places, max(p.degree, 0))

    def solve(system):
        both = system.solve(np.column_stack([values, poly]))
        v, half = both[:, :1], both[:, 1:]
        if p.degree >= 0:
            beta = np.linalg.solve(poly.T @ half, poly.T @ v)
            return system.kernel, -(v - half @ beta), beta
        # distances w = values, distances = top - B: B w = top (sum of w) - values
        top = system.kernel.top
        total = -(poly.T @ v) / (1 - top * (poly.T @ half))
        return system.kernel, -(v - half * (top * total)), np.zeros((0, 1))

    _, w, beta = _solved(points.sparkSession, places, None, 2 * float(np.linalg.norm(np.ptp(places, axis=0))) or 1.0, p.regularization, solve)
    gap = Kernel(None, 0.0, model_values)

    def estimate(t: np.ndarray) -> np.ndarray:
        near = -gap.times(t, places, w)[:, 0]
        return near + _terms(t, p.degree) @ beta[:, 0] if p.degree >= 0 else near

    return _spread(targets.select("id", *axes), len(places)).mapInArrow(lambda batches: _in_turn(batches, axes, estimate), "id long, estimate double")


def model_values(model: Variogram, h: np.ndarray) -> np.ndarray:
    n, s, a = model.nugget, model.sill, model.range
    r = h / a
    out = {
        "spherical": lambda: np.where(h < a, n + s * (1.5 * r - 0.5 * r**3), n + s),
        "exponential": lambda: n + s * (1 - np.exp(-r)),
        "gaussian": lambda: n + s * (1 - np.exp(-(r**2))),
        "linear": lambda: n + s * h,
        "power": lambda: n + s * h**a,
        "nugget": lambda: np.full_like(h, n),
    }[model.kind]()
    return np.where(h > 0, out, 0.0)


def kernel_values(kind: str, r: np.ndarray, epsilon: float) -> np.ndarray:
    e = (epsilon * r) ** 2
    return {
        "gaussian": lambda: np.exp(-e),
        "multiquadric": lambda: np.sqrt(1 + e),
        "inverse_multiquadric": lambda: 1 / np.sqrt(1 + e),
        "thin_plate": lambda: np.where(r > 0, r**2 * np.log(r + 1e-15), 0.0),
        "linear": lambda: r,
        "cubic": lambda: r**3,
        "quintic": lambda: r**5,
    }[kind]()


def _krige(places: np.ndarray, values: np.ndarray, targets: np.ndarray, model: Variogram, k: Kriging, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances of a batch of systems: places (b, n, d), values (b, n), targets (b, d)."""
    b, n, d = places.shape
    gap = np.linalg.norm(places[:, :, None] - places[:, None], axis=3)
    near = np.linalg.norm(places - targets[:, None], axis=2)
    top = model.nugget + model.sill
    if k.kind == "simple":
        cov = top - model_values(model, gap) + k.regularization * np.eye(n)
        right = top - model_values(model, near)
        w = np.linalg.solve(cov, right[:, :, None])[:, :, 0]
        return mean + (w * (values - mean)).sum(1), np.maximum(top - (w * right).sum(1), 0)
    drift = np.ones((b, n, 1)) if k.kind == "ordinary" else np.concatenate([np.ones((b, n, 1)), places - targets[:, None]], axis=2)
    aim = np.ones((b, 1)) if k.kind == "ordinary" else np.concatenate([np.ones((b, 1)), np.zeros((b, d))], axis=1)
    m = drift.shape[2]
    system = np.zeros((b, n + m, n + m))
    system[:, :n, :n] = model_values(model, gap) + k.regularization * np.eye(n)
    system[:, :n, n:], system[:, n:, :n] = drift, drift.transpose(0, 2, 1)
    right = np.concatenate([model_values(model, near), aim], axis=1)
    w = np.linalg.solve(system, right[:, :, None])[:, :, 0]
    return (w[:, :n] * values).sum(1), np.maximum((w * right).sum(1), 0)


def _gathered(points: DataFrame, targets: DataFrame, search: Search, axes) -> DataFrame:
    """Each target's id and place, and lists of its neighbours' places and values, nearest first."""
    found = with_fallback(targets, points, search.max_points, search.radius, search.min_points, axes, keep=(*axes, "value"))
    near = found.groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", *axes, "value"))).alias("near"))
    lists = [F.col(f"near.{c}").alias(f"n{c}") for c in (*axes, "value")]
    return targets.select("id", *(F.col(c).alias(f"t{c}") for c in axes)).join(near, "id", "left").select("id", *(f"t{c}" for c in axes), *lists)


def kriging(points: DataFrame, targets: DataFrame, model: Variogram, k: Kriging = Kriging(), search: Search | None = None, axes=("x", "y"), variance: bool = True) -> DataFrame:
    """(id, estimate, variance) in two or three dimensions; where ``variance`` is not wanted, large global systems leave it null. With ``search`` local: a target without neighbours gets the mean and the sill. A singular system gives its nearest value and nugget plus sill."""
    mean = k.mean if k.mean is not None else (points.agg(F.avg("value")).first()[0] or 0.0)
    reachable(points.sparkSession)
    if search is None:
        if _large(points):
            return _large_kriging(points, targets, model, k, mean, axes, variance)
        rows = global_rows(points, axes)
        return targets.select("id", *axes).mapInArrow(lambda batches: (_global_batch(b, rows, model, k, mean) for b in batches), "id long, estimate double, variance double")
    rows = _gathered(points, targets, search, axes)
    return rows.mapInArrow(lambda batches: (_local_batch(b, lambda p, v, t: _krige(p, v, t, model, k, mean), mean, model.sill, model.nugget + model.sill) for b in batches), "id long, estimate double, variance double")


def _global_batch(batch: pa.RecordBatch, rows: np.ndarray, model: Variogram, k: Kriging, mean: float) -> pa.RecordBatch:
    places, values = rows[:, :-1], rows[:, -1]
    t = np.column_stack([batch.column(1 + i).to_numpy() for i in range(places.shape[1])])
    est, var = np.zeros(len(t)), np.zeros(len(t))
    n, d = places.shape
    top = model.nugget + model.sill
    gap = np.linalg.norm(places[:, None] - places[None], axis=2)
    near = np.linalg.norm(t[:, None] - places[None], axis=2)
    if k.kind == "simple":
        left, right = top - model_values(model, gap) + k.regularization * np.eye(n), top - model_values(model, near)
    else:
        drift = np.ones((n, 1)) if k.kind == "ordinary" else np.column_stack([np.ones(n), places])
        m = drift.shape[1]
        left = np.zeros((n + m, n + m))
        left[:n, :n] = model_values(model, gap) + k.regularization * np.eye(n)
        left[:n, n:], left[n:, :n] = drift, drift.T
        right = np.column_stack([model_values(model, near), np.ones(len(t)) if k.kind == "ordinary" else np.column_stack([np.ones(len(t)), t])])
    try:
        w = np.linalg.solve(left, right.T).T
        est = mean + w @ (values - mean) if k.kind == "simple" else w[:, :n] @ values
        var = np.maximum(top - (w * right).sum(1) if k.kind == "simple" else (w * right).sum(1), 0)
    except np.linalg.LinAlgError:
        est, var = values[near.argmin(1)], np.full(len(t), top)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(est), pa.array(var)], ["id", "estimate", "variance"])


def _local_batch(batch: pa.RecordBatch, solve, mean: float, empty: float, top: float) -> pa.RecordBatch:
    d = (batch.num_columns - 2) // 2
    t = np.column_stack([batch.column(1 + i).to_numpy() for i in range(d)])
    lists = [batch.column(c).to_pylist() for c in range(1 + d, 2 + 2 * d)]
    sizes = np.array([len(x) if x else 0 for x in lists[0]])
    est, var = np.full(len(t), mean), np.full(len(t), empty)
    for n in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == n)
        places = np.stack([np.array([lists[c][i] for i in own]) for c in range(d)], axis=2)
        values = np.array([lists[d][i] for i in own])
        try:
            est[own], var[own] = solve(places, values, t[own])
        except np.linalg.LinAlgError:
            for j, i in enumerate(own):
                try:
                    est[[i]], var[[i]] = solve(places[[j]], values[[j]], t[[i]])
                except np.linalg.LinAlgError:
                    est[i], var[i] = values[j, 0], top
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(est), pa.array(var)], ["id", "estimate", "variance"])


def _terms(places: np.ndarray, degree: int) -> np.ndarray:
    """Columns of the polynomial of the degree: 1, places, and their products."""
    out = [np.ones(len(places))]
    for k in range(1, degree + 1):
        out += [places[:, list(c)].prod(1) for c in combinations_with_replacement(range(places.shape[1]), k)]
    return np.column_stack(out)


def _rbf_solve(places: np.ndarray, values: np.ndarray, p: Rbf) -> np.ndarray:
    """Weights and, with a degree of 0 or more, polynomial terms of one system."""
    n = len(places)
    phi = kernel_values(p.kernel, np.linalg.norm(places[:, None] - places[None], axis=2), p.epsilon) + p.regularization * np.eye(n)
    if p.degree >= 0:
        poly = _terms(places, p.degree)
        m = poly.shape[1]
        phi = np.block([[phi, poly], [poly.T, np.zeros((m, m))]])
        values = np.concatenate([values, np.zeros(m)])
    try:
        return np.linalg.solve(phi, values)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(phi, rcond=1e-12) @ values


def rbf(points: DataFrame, targets: DataFrame, p: Rbf = Rbf(), search: Search | None = None, axes=("x", "y")) -> DataFrame:
    """(id, estimate) by a global system or, with ``search``, a small one per target (without polynomial), all of one size at once."""
    reachable(points.sparkSession)
    mean = points.agg(F.avg("value")).first()[0] or 0.0
    if search is None:
        if p.kernel == "linear" and _large(points):
            return _large_rbf(points, targets, p, axes)
        rows = global_rows(points, axes)
        places = rows[:, :-1]
        w = _rbf_solve(places, rows[:, -1], p)
        n = len(rows)

        def predict(batches):
            for b in batches:
                t = np.column_stack([b.column(1 + i).to_numpy() for i in range(len(axes))])
                est = kernel_values(p.kernel, np.linalg.norm(t[:, None] - places[None], axis=2), p.epsilon) @ w[:n]
                if p.degree >= 0:
                    est += _terms(t, p.degree) @ w[n:]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(est)], ["id", "estimate"])

        return targets.select("id", *axes).mapInArrow(predict, "id long, estimate double")

    def solve(places, values, targets):
        gap = np.linalg.norm(places[:, :, None] - places[:, None], axis=3)
        phi = kernel_values(p.kernel, gap, p.epsilon) + p.regularization * np.eye(places.shape[1])
        w = np.linalg.solve(phi, values[:, :, None])[:, :, 0]
        near = kernel_values(p.kernel, np.linalg.norm(places - targets[:, None], axis=2), p.epsilon)
        return (near * w).sum(1), np.zeros(len(w))

    rows = _gathered(points, targets, search, axes)
    return rows.mapInArrow(lambda batches: (_local_batch(b, solve, mean, 0.0, 0.0) for b in batches), "id long, estimate double, variance double").select("id", "estimate")


def rbf_shape(points: DataFrame, kernel: str = "multiquadric", regularization: float = 1e-12, candidates: int = 20) -> DataFrame:
    """(epsilon, rmse) of leave-one-out errors over a logarithmic row of shape parameters, by the closed form e_i = w_i / inverse_ii."""
    rows = global_rows(points)
    r = np.linalg.norm(rows[:, None, :2] - rows[None, :, :2], axis=2)
    out = []
    for e in np.logspace(-2, 2, candidates):
        inverse = np.linalg.pinv(kernel_values(kernel, r, e) + regularization * np.eye(len(rows)), rcond=1e-12, hermitian=True)
        error = inverse @ rows[:, 2] / np.diag(inverse)
        out.append((float(e), float(np.sqrt(np.mean(error**2)))))
    return points.sparkSession.createDataFrame(out, "epsilon double, rmse double")
