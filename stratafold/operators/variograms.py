"""Experimental variograms and fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.scalar import azimuth, in_direction
from stratafold.model import Variogram
from stratafold.operators.interpolate import model_values
from stratafold.operators import neighbours
from stratafold.operators.neighbours import pair_sums, pairs, slices

#: Steps of the tables that give a distance its bin and an angle its directions; only values in a step with a bound are compared with it.
STEPS = 4096


def _lagged(near: DataFrame, max_distance: float, lags: int, tolerance: float, *by: str) -> DataFrame:
    width = max_distance / lags
    spread = int(tolerance) + 1
    base = F.floor(F.col("dist") / width)
    lag = F.explode(F.array(*(base + k for k in range(-spread, spread + 1)))).alias("lag")
    rows = near.select(*by, "dist", ((F.col("value_i") - F.col("value_j")) ** 2 / 2).alias("g"), lag)
    inside = (F.col("lag") >= 0) & (F.col("lag") < lags) & (F.col("dist") >= F.col("lag") * width - tolerance * width) & (F.col("dist") < (F.col("lag") + 1) * width + tolerance * width)
    out = rows.where(inside).groupBy(*by, "lag").agg(F.avg("g").alias("gamma"), F.count("*").alias("n_pairs"))
    return out.select(F.col("lag").cast("long").alias("lag"), ((F.col("lag") + 0.5) * width).alias("h"), "gamma", "n_pairs", *by)


def _stepped(bounds: np.ndarray, width: float, kinds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The kind of each of STEPS steps of the width, -1 where a bound is in it or next to it."""
    out = kinds((np.arange(STEPS) + 0.5) * width).astype(np.int64)
    for b in bounds:
        at = b / width
        out[max(int(np.floor(at - 0.01)), 0) : max(int(np.floor(at + 0.01)) + 1, 0)] = -1
    return out


def _lag_sums(max_distance: float, lags: int, tolerance: float, directions: Sequence[float], direction_tolerance: float) -> Callable[..., pa.Table]:
    """(direction, lag, n, known, g) of the pairs of two blocks: their number, that of pairs with both values, and the sum of their half squared differences. Without directions there is one, of all pairs."""
    width = max_distance / lags
    low, high = (np.array([(k + j) * width + sign * tolerance * width for k in range(lags)]) for j, sign in ((0, -1), (1, 1)))
    edges = np.unique(np.concatenate([low, high]))
    bins, dirs = len(edges) + 1, max(len(directions), 1)
    # the last step holds all that is farther
    step = edges[-1] * (1 + 1e-6) / (STEPS - 1)
    binned = _stepped(edges, step, lambda d: np.searchsorted(edges, d, side="right"))
    angles = np.asarray(directions, dtype=float)

    def inside(azimuths: np.ndarray) -> np.ndarray:
        gap = np.abs(azimuths[:, None] - angles)
        return np.minimum(gap, np.abs(gap - 180)) <= direction_tolerance

    if len(directions):
        # the angle's stand-in rises from 0 to 2 with it and costs no arc tangent
        turned = lambda deg: 1 - np.cos(np.radians(deg)) / (np.abs(np.cos(np.radians(deg))) + np.abs(np.sin(np.radians(deg))))
        degrees = lambda t: np.degrees(np.arctan2(1 - np.abs(1 - t), 1 - t))
        ends = np.concatenate([(angles + direction_tolerance) % 180, (angles - direction_tolerance) % 180, [0.0, 180.0]])
        zones, kinds = np.unique(inside(degrees((np.arange(STEPS) + 0.5) * 2 / STEPS)), axis=0, return_inverse=True)
        zoned = _stepped(turned(ends), 2 / STEPS, lambda _: kinds.ravel())
    else:
        zones, zoned = np.ones((1, 1), bool), None

    def azimuths(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        a = np.degrees(np.arctan2(dy, dx))
        return np.where(a < 0, a + 180, np.where(a >= 180, a - 180, a))

    def fold(first: dict, second: dict, counts) -> pa.Table:
        n, known, g = (np.zeros((dirs, bins)) for _ in range(3))
        some = first["known"] is not None or second["known"] is not None
        every = lambda side: np.ones(len(side["id"]), bool) if side["known"] is None else side["known"]

        def add(into: np.ndarray, at: np.ndarray, rows: np.ndarray, weights=None) -> None:
            into[at] += np.bincount(rows, weights, minlength=bins)[:bins]

        for s in slices(first, second):
            dx, dy = (second[c][None] - first[c][s, None] for c in ("x", "y"))
            half = second["value"][None] - first["value"][s, None]
            both = every(first)[s, None] & every(second)[None] if some else None
            at = None
            if counts is not None:
                own = counts(s)
                at = np.flatnonzero(own)
                dx, dy, half = dx[own], dy[own], half[own]
                both = both[own] if some else None
            dx, dy, half = dx.ravel(), dy.ravel(), half.ravel()
            both = both.ravel() if some else None
            dist = np.sqrt(dx * dx + dy * dy)
            near = np.flatnonzero(dist < edges[-1])
            if len(near) < 0.9 * len(dist):
                dx, dy, half, dist = dx[near], dy[near], half[near], dist[near]
                at = near if at is None else at[near]
                both = both[near] if some else None
            half *= half
            if some:
                half[~both] = 0.0
            bin_ = binned[np.minimum(dist / step, STEPS - 1).astype(np.int64)]
            unsure = np.flatnonzero(bin_ < 0)
            bin_[unsure] = np.searchsorted(edges, dist[unsure], side="right")
            if zoned is None:
                add(n, 0, bin_)
                add(g, 0, bin_, half)
                if some:
                    add(known, 0, bin_[both])
                continue
            reach = np.abs(dx) + np.abs(dy)
            with np.errstate(invalid="ignore", divide="ignore"):
                t = 1 - np.copysign(dx, dx * np.where(dy < 0, -1.0, 1.0)) / reach
            place = np.minimum(np.where(reach > 0, t, 0.0) * (STEPS / 2), STEPS - 1).astype(np.int64)
            zone = zoned[place]
            sure = zone >= 0
            joint = np.where(sure, zone, len(zones)) * bins + bin_
            size = (len(zones) + 1) * bins
            shaped = lambda weights=None: np.bincount(joint, weights, minlength=size)[: len(zones) * bins].reshape(len(zones), bins)  # noqa: B023, E731
            n += zones.T.astype(float) @ shaped()
            g += zones.T.astype(float) @ shaped(half)
            if some:
                known += zones.T.astype(float) @ shaped(both.astype(float))
            rest = np.flatnonzero(~sure)
            if len(rest):
                # from the smaller id to the larger one, as the rounding of an angle on the bound may depend on it
                i, j = np.divmod(rest if at is None else at[rest], len(second["id"]))
                turn = np.where(first["id"][s][i] > second["id"][j], -1.0, 1.0)
                among = inside(azimuths(dx[rest] * turn, dy[rest] * turn))
                for k in range(dirs):
                    own = rest[among[:, k]]
                    add(n, k, bin_[own])
                    add(g, k, bin_[own], half[own])
                    if some:
                        add(known, k, bin_[own][both[own]])
        if not some:
            known = n
        out = []
        for k in range(lags):
            held = slice(int(np.searchsorted(edges, low[k])) + 1, int(np.searchsorted(edges, high[k])) + 1)
            out += [(i, k, *(float(x[i, held].sum()) for x in (n, known, g))) for i in range(dirs) if n[i, held].sum()]
        kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds_)], ["_direction", "lag", "n", "known", "g"])

    return fold


def _by_blocks(points: DataFrame, most: float, max_distance: float, lags: int, tolerance: float, directions: Sequence[float] = (), direction_tolerance: float = 0.0) -> DataFrame:
    """(lag, h, gamma, n_pairs, _direction) where no pair becomes a row."""
    fold = _lag_sums(max_distance, lags, tolerance, tuple(directions), direction_tolerance)
    rows = pair_sums(points, most, ("x", "y"), "value", fold, "_direction long, lag long, n double, known double, g double")
    # a pair with an unknown value counts, but is in no mean
    s = rows.groupBy("_direction", "lag").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("g").alias("g"))
    h = (F.col("lag") + 0.5) * (max_distance / lags)
    return s.select("lag", h.alias("h"), F.try_divide(F.col("g") / 2, F.col("known")).alias("gamma"), F.col("n").cast("long").alias("n_pairs"), "_direction")


def experimental(points: DataFrame, max_distance: float, lags: int = 15, tolerance: float = 0.5, direction: float | None = None, direction_tolerance: float = 22.5) -> DataFrame:
    """(lag, h, gamma, n_pairs). Lag i takes distances in [i L - t L, (i+1) L + t L), so neighbouring lags overlap; its h is the middle; empty lags are left out.

    Pairs come from a cell join up to the last lag's end or, where points crowd, from blocks of points; only their sums per lag are shuffled.
    """
    most = max_distance + tolerance * max_distance / lags
    if neighbours.densest(points, ("x", "y"), most) > neighbours.DENSE:
        return _by_blocks(points, most, max_distance, lags, tolerance, () if direction is None else (direction,), direction_tolerance).drop("_direction")
    near = pairs(points, most=most)
    if direction is not None:
        near = near.where(in_direction(azimuth(F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")), direction, direction_tolerance))
    return _lagged(near, max_distance, lags, tolerance)


def directional(points: DataFrame, max_distance: float, lags: int = 15, directions: int = 4, tolerance: float = 0.5, direction_tolerance: float = 22.5) -> DataFrame:
    """The experimental variogram of equally spaced directions in [0, 180); pairs are joined once for all of them."""
    most = max_distance + tolerance * max_distance / lags
    spaced = [180.0 * i / directions for i in range(directions)]
    if neighbours.densest(points, ("x", "y"), most) > neighbours.DENSE:
        found = _by_blocks(points, most, max_distance, lags, tolerance, spaced, direction_tolerance)
        return found.withColumn("direction", F.element_at(F.array(*map(F.lit, spaced)), (F.col("_direction") + 1).cast("int"))).drop("_direction")
    near = pairs(points, most=most).withColumn("_a", azimuth(F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")))
    angles = F.array(*(F.lit(a) for a in spaced))
    near = near.withColumn("direction", F.explode(F.filter(angles, lambda a: in_direction(F.col("_a"), a, direction_tolerance))))
    return _lagged(near, max_distance, lags, tolerance, "direction")


def default_distance(points: DataFrame, share: float = 0.75) -> float:
    """Quantile of all pair distances (a sketch; the pairs are not kept)."""
    return pairs(points, keep=()).agg(F.percentile_approx("dist", share, 10000)).first()[0]


def fit(h: np.ndarray, gamma: np.ndarray, weights: np.ndarray, kind: str) -> tuple[Variogram, dict]:
    """Weighted least squares: for each range the best non-negative nugget and sill in closed form, the range by a grid and golden section."""
    def linear(a: float) -> tuple[float, float, float]:
        f = model_values(Variogram("spherical" if kind == "nugget" else kind, 0.0, 1.0, a), h) if kind != "linear" else h / a
        best = None
        w = weights / weights.sum()
        fm, gm = (w * f).sum(), (w * gamma).sum()
        sxx = (w * (f - fm) ** 2).sum()
        s = (w * (f - fm) * (gamma - gm)).sum() / sxx if sxx > 0 else 0.0
        for n, s in ((gm - s * fm, s), (0.0, (w * f * gamma).sum() / max((w * f * f).sum(), 1e-300)), (gm, 0.0)):
            if n >= -1e-12 and s >= 0:
                loss = (w * (n + s * f - gamma) ** 2).sum()
                if best is None or loss < best[2]:
                    best = (max(n, 0.0), s, loss)
        return best

    top = h.max()
    grid = np.geomspace(top / 100, 2 * top, 80)
    at = int(np.argmin([linear(a)[2] for a in grid]))
    lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    ratio = (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if linear(a)[2] <= linear(b)[2] else (a, hi)
    a = (lo + hi) / 2
    n, s, _ = linear(a)
    model = Variogram(kind, n, s, a)
    got = n + s * (h / a) if kind == "linear" else model_values(model, h)
    ssr = ((gamma - got) ** 2).sum()
    sst = ((gamma - gamma.mean()) ** 2).sum()
    return model, {"r2": 1 - ssr / sst if sst > 0 else 0.0, "rmse": float(np.sqrt(ssr / len(h))), "aic": len(h) * np.log(max(ssr, 1e-300)) - len(h) * np.log(len(h)) + 6}


def fit_all(variogram: DataFrame, kinds=("spherical", "exponential", "gaussian", "linear")) -> DataFrame:
    """A row for each model with its fit, by rising AIC. The lags are a handful of rows, whatever the points."""
    rows = variogram.orderBy("lag").select("h", "gamma", "n_pairs").toPandas()
    out = []
    for kind in kinds:
        m, q = fit(rows.h.to_numpy(), rows.gamma.to_numpy(), np.sqrt(rows.n_pairs.to_numpy(dtype=float)), kind)
        out.append((kind, *map(float, (m.nugget, m.sill, m.range, q["r2"], q["rmse"], q["aic"]))))
    return variogram.sparkSession.createDataFrame(sorted(out, key=lambda r: r[6]), "model string, nugget double, sill double, range double, r2 double, rmse double, aic double")


def best(fitted: DataFrame) -> Variogram:
    """Of models with r2 over 0.5 that with the best mean of r2, relative AIC and relative error; else the first by AIC."""
    rows = fitted.orderBy("aic").collect()
    good = [r for r in rows if r.r2 > 0.5]
    if good:
        aic, rmse = min(abs(r.aic) for r in good) or 1.0, min(r.rmse for r in good) or 1.0
        rows = sorted(good, key=lambda r: -(r.r2 + 1 / (1 + r.aic / aic if r.aic / aic > -1 else 1) + 1 / (1 + r.rmse / rmse)) / 3)
    r = rows[0]
    return Variogram(r.model, r.nugget, r.sill, r.range)


def anisotropy(points: DataFrame, max_distance: float, lags: int = 15, directions: int = 4) -> DataFrame:
    """(direction, range) of spherical fits; a ratio of the largest to the smallest over 1.5 is anisotropic."""
    rows = directional(points, max_distance, lags, directions).toPandas()
    out = []
    for angle, part in rows.groupby("direction"):
        if len(part) >= 3:
            part = part.sort_values("lag")
            out.append((float(angle), fit(part.h.to_numpy(), part.gamma.to_numpy(), np.sqrt(part.n_pairs.to_numpy(dtype=float)), "spherical")[0].range.item()))
    return points.sparkSession.createDataFrame(out, "direction double, range double")
