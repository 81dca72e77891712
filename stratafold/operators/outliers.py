"""Outlier detection; each method gives (id, method) of what it flags, and votes are a union and a count."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.neighbours import nearest_join
from stratafold.operators.ranks import order_quantiles
from stratafold.operators.spatial import hull, trend
from stratafold.operators.statistics import chi2_critical, t_critical
from stratafold.session import reachable, settled


def _flag(df: DataFrame, test, method: str) -> DataFrame:
    return df.where(test).select("id", F.lit(method).alias("method"))


def _over(scores: DataFrame, column: str, share: float, method: str) -> DataFrame:
    """Rows whose score is above its quantile; scores are settled, as finding an order statistic reads them several times."""
    scores = settled(scores)
    q = order_quantiles(scores, column, (share,))[0]
    return _flag(scores, F.col(column) > F.lit(q).cast("double"), method)


def fences(points: DataFrame, factor: float = 1.5) -> DataFrame:
    """Values beyond so many interquartile ranges from the quartiles."""
    q1, q3 = order_quantiles(points, "value", (0.25, 0.75))
    r = factor * ((q3 or 0.0) - (q1 or 0.0))
    return _flag(points, (F.col("value") < (q1 or 0.0) - r) | (F.col("value") > (q3 or 0.0) + r), f"iqr_{factor:g}")


def z_scores(points: DataFrame, limit: float = 3.0) -> DataFrame:
    s = F.broadcast(points.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")))
    return _flag(points.crossJoin(s), (F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) > limit * F.col("s")), f"z_{limit:g}")


def modified_z(points: DataFrame, limit: float = 3.5) -> DataFrame:
    """By median and median absolute deviation; none if that is 0."""
    median = order_quantiles(points, "value", (0.5,))[0] or 0.0
    away = F.abs(F.col("value") - median)
    mad = order_quantiles(points.select(away.alias("away")), "away", (0.5,))[0] or 0.0
    return _flag(points, F.lit(mad > 0) & (0.6745 * away > limit * mad), f"modified_z_{limit:g}")


def grubbs(points: DataFrame, alpha: float = 0.05, block: int = 1000) -> DataFrame:
    """The farthest value again and again until Grubbs' test no longer rejects it; of equal ones that of the smallest id.

    What is rejected is at an end of the sorted values, so only the ends come to the driver, ``block`` values of each;
    if one is used up, four times as many are taken. Moments are merged from the middle outwards, so that far values
    do not swallow the digits of the others.
    """
    spark = points.sparkSession
    rows = points.select("id", F.col("value").cast("double").alias("value")).where("value is not null")
    n = rows.count()
    while True:
        if n <= 2 * block:
            (low, high), middle = _halves([(r.value, r.id) for r in rows.collect()]), (0, 0.0, 0.0)
        else:
            low = [(r.value, r.id) for r in rows.orderBy("value", "id").limit(block).collect()]
            high = [(r.value, r.id) for r in rows.orderBy(F.desc("value"), "id").limit(block).collect()]
            (lv, li), (hv, hi) = low[-1], high[-1]
            v, i = F.col("value"), F.col("id")
            inner = rows.where(((v > lv) | (v == lv) & (i > li)) & ((v < hv) | (v == hv) & (i > hi)))
            s = inner.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).first()
            middle = (s.n, s.m or 0.0, (s.v or 0.0) * s.n)
            if len(low) + len(high) + s.n != n:  # both ends are of one value
                block *= 4
                continue
        found, at_end = [], False
        while True:
            more, a, b, at_end = _peel(spark, low, high, middle, alpha)
            found += more
            if not at_end or middle[0]:
                break
            low, high = _halves(low[a:] + high[b:])
        if not at_end:
            return spark.createDataFrame([(i, "grubbs") for i in found], "id long, method string")
        block *= 4


def _halves(rows: list[tuple[float, int]]) -> tuple[list, list]:
    """The lower and the upper half, each from its end inwards."""
    rows = sorted(rows)
    return rows[: len(rows) // 2], sorted(rows[len(rows) // 2 :], key=lambda r: (-r[0], r[1]))


def _merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and squared deviations of two groups together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _peel(spark, low: list, high: list, middle: tuple[int, float, float], alpha: float) -> tuple[list[int], int, int, bool]:
    """Rejected ids, how many of each end they are, and whether an end was used up before the test stopped."""

    def inwards(rows: list) -> list[tuple[int, float, float]]:
        out = [(0, 0.0, 0.0)]
        for v, _ in reversed(rows):
            out.append(_merged(out[-1], (1, v, 0.0)))
        return out[::-1]

    lows, highs = inwards(low), inwards(high)
    found, a, b = [], 0, 0
    while True:
        n, m, squares = _merged(_merged(middle, lows[a]), highs[b])
        if n < 3 or squares <= 0:
            return found, a, b, False
        if a == len(low) or b == len(high):
            return found, a, b, True
        s = (squares / (n - 1)) ** 0.5
        one, two = (m - low[a][0], -low[a][1]), (high[b][0] - m, -high[b][1])
        t = t_critical(spark, 1 - alpha / (2 * n), n - 2)
        if max(one, two)[0] / s <= (n - 1) / n**0.5 * (t * t / (n - 2 + t * t)) ** 0.5:
            return found, a, b, False
        if one > two:
            found.append(low[a][1])
            a += 1
        else:
            found.append(high[b][1])
            b += 1


def distance(points: DataFrame, contamination: float = 0.1, k: int = 10) -> DataFrame:
    """Mean distance to the k nearest others above its 1 - contamination quantile."""
    d = settled(nearest_join(points, points, k, other=True, keep=()).groupBy(F.col("qid").alias("id")).agg(F.avg("dist").alias("d")))
    return _over(d, "d", 1 - contamination, "distance")


def lof_scores(points: DataFrame, k: int = 20, axes=("x", "y")) -> DataFrame:
    """(id, lof): local outlier factor with the k nearest others."""
    near = settled(nearest_join(points, points, k, axes, other=True, keep=()))
    reach = near.groupBy(F.col("qid").alias("nid")).agg(F.max("dist").alias("kd"))
    density = settled(near.join(reach, "nid").groupBy("qid").agg((1 / (F.avg(F.greatest("dist", "kd")) + 1e-10)).alias("lrd")))
    both = near.join(density.select(F.col("qid").alias("nid"), F.col("lrd").alias("nlrd")), "nid").groupBy("qid").agg(F.avg("nlrd").alias("m"))
    return both.join(density, "qid").select(F.col("qid").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))


def local_factor(points: DataFrame, contamination: float = 0.1, k: int = 20, axes=("x", "y")) -> DataFrame:
    s = settled(lof_scores(points, k, axes))
    return _over(s, "lof", 1 - contamination, "lof")


def residual(points: DataFrame, limit: float = 2.5) -> DataFrame:
    """Residuals of the trend plane beyond so many deviations."""
    rows = points.crossJoin(F.broadcast(trend(points))).withColumn("e", F.col("value") - F.col("a") - F.col("b") * F.col("x") - F.col("c") * F.col("y"))
    return _flag(rows.crossJoin(F.broadcast(rows.agg(F.stddev_pop("e").alias("s")))), F.abs("e") > limit * F.col("s"), "residual")


def edge(points: DataFrame) -> DataFrame:
    """Corners of the convex hull, and points farther from the centroid than the 95th percentile."""
    c = F.broadcast(points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    rows = points.crossJoin(c).withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    far = _over(rows, "d", 0.95, "edge").select("id")
    return far.union(points.join(hull(points).select("x", "y"), ["x", "y"], "left_semi").select("id")).distinct().withColumn("method", F.lit("edge"))


def _moments(points: DataFrame, axes) -> tuple[np.ndarray, np.ndarray]:
    two = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    s = points.agg(*(F.avg(c).alias(c) for c in axes), *(F.covar_samp(a, b).alias(f"{a}*{b}") for a, b in two)).first()
    cov = np.zeros((len(axes), len(axes)))
    for a, b in two:
        cov[axes.index(a), axes.index(b)] = cov[axes.index(b), axes.index(a)] = s[f"{a}*{b}"] or 0.0
    return np.array([s[c] for c in axes], dtype=float), cov


def _squared(points: DataFrame, mean: np.ndarray, cov: np.ndarray, axes) -> DataFrame:
    """(id, d2): squared Mahalanobis distance as a column expression."""
    inverse = np.linalg.pinv(cov)
    gap = [F.col(c) - float(m) for c, m in zip(axes, mean)]
    total = F.lit(0.0)
    for i in range(len(axes)):
        for j in range(len(axes)):
            total = total + gap[i] * gap[j] * float(inverse[i, j])
    return points.select("id", *axes, total.alias("d2"))


def mahalanobis(points: DataFrame, contamination: float = 0.1, axes=("x", "y", "value")) -> DataFrame:
    axes = list(axes)
    limit = chi2_critical(points.sparkSession, 1 - contamination, len(axes))
    return _flag(_squared(points, *_moments(points, axes), axes), F.col("d2") > limit, "mahalanobis")


def robust_distance(points: DataFrame, contamination: float = 0.1, axes=("x", "y", "value"), rounds: int = 10) -> DataFrame:
    """Minimum covariance determinant by concentration steps from the plain moments: the half nearest by distance gives the next moments."""
    axes = list(axes)
    mean, cov = _moments(points, axes)
    for _ in range(rounds):
        d = settled(_squared(points, mean, cov, axes))
        half = d.agg(F.percentile("d2", 0.5)).first()[0]
        new_mean, new_cov = _moments(d.where(F.col("d2") <= half), axes)
        done = np.allclose(new_cov, cov, rtol=1e-6) and np.allclose(new_mean, mean, rtol=1e-6)
        mean, cov = new_mean, new_cov
        if done:
            break
    d = settled(_squared(points, mean, cov, axes))
    return _over(d, "d2", 1 - contamination, "robust_distance")


def isolation(points: DataFrame, contamination: float = 0.1, axes=("x", "y", "value"), trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: trees grow on a bounded sample (a parameter of the method) on the driver, every point is scored in Arrow batches."""
    axes = list(axes)
    rng = np.random.default_rng(seed)
    rows = points.select(*axes).dropna().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample * trees).toPandas().to_numpy() if len(axes) else None
    depth = int(np.ceil(np.log2(max(min(sample, len(rows)), 2))))

    def grow(x: np.ndarray, level: int):
        spans = np.ptp(x, axis=0) if len(x) else np.zeros(len(axes))
        if level >= depth or len(x) <= 1 or not spans.any():
            return len(x)
        f = int(rng.choice(np.flatnonzero(spans)))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        return f, cut, grow(x[x[:, f] < cut], level + 1), grow(x[x[:, f] >= cut], level + 1)

    def c(n: float) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)

    forest = [grow(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], 0) for _ in range(trees)]
    unit = c(min(sample, len(rows))) or 1.0

    def walk(tree, x: np.ndarray, at: np.ndarray, out: np.ndarray, level: int) -> None:
        if not isinstance(tree, tuple):
            out[at] += level + c(tree)
            return
        left = x[at, tree[0]] < tree[1]
        walk(tree[2], x, at[left], out, level + 1)
        walk(tree[3], x, at[~left], out, level + 1)

    def scored(batches):
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(axes))])
            out = np.zeros(len(x))
            for t in forest:
                walk(t, x, np.arange(len(x)), out, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(2.0 ** (-out / len(forest) / unit))], ["id", "s"])

    reachable(points.sparkSession)
    s = settled(points.select("id", *(F.col(a).cast("double").alias(a) for a in axes)).mapInArrow(scored, "id long, s double"))
    return _over(s, "s", 1 - contamination, "isolation")


def one_class(points: DataFrame, contamination: float = 0.1, axes=("x", "y", "value"), most: int = 100_000) -> DataFrame:
    """One-class support vectors with a Gaussian kernel on standardised axes.

    The dual is solved over all points by pairwise steps on the driver, kernel rows made as needed; more than ``most``
    points are refused. Every point is scored in Arrow batches.
    """
    axes = list(axes)
    n = points.count()
    if n > most:
        raise ValueError(f"one-class support vectors are fitted on all points; {n} are more than {most}")
    s = points.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in axes for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([s[f"{c}_avg"] for c in axes], dtype=float)
    scale = np.array([s[f"{c}_stddev_pop"] or 1.0 for c in axes], dtype=float)
    x = (points.select(*axes).orderBy(F.xxhash64("id"), "id").toPandas().to_numpy(dtype=float) - mean) / scale
    gamma = 1 / (len(axes) * (x.var() or 1.0))
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    row = lru_cache(max(2, (256 << 20) // (8 * max(n, 1))))(lambda i: kernel(x[i : i + 1], x)[0])
    top = 1 / (contamination * n) if n else 1.0
    alpha = np.clip(1 - top * np.arange(n), 0, top)
    slope = np.zeros(n)
    for i in np.flatnonzero(alpha):
        slope += alpha[i] * row(int(i))
    for _ in range(1000 * n):
        up, down = np.where(alpha < top - 1e-12, slope, np.inf), np.where(alpha > 1e-12, slope, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < 1e-5:
            break
        one, two = row(i), row(j)
        step = min((slope[j] - slope[i]) / max(2 - 2 * one[j], 1e-12), top - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        slope += step * (one - two)
    else:
        if n:
            raise RuntimeError("the dual of the one-class support vectors did not converge")
    free = (alpha > 1e-9) & (alpha < top - 1e-9)
    held = alpha > 1e-9
    rho = float(slope[free].mean() if free.any() else slope[held].mean() if n else 0.0)
    x, alpha = x[alpha > 0], alpha[alpha > 0]

    def scored(batches):
        for b in batches:
            at = (np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(axes))]) - mean) / scale
            score = np.concatenate([kernel(at[i : i + 1000], x) @ alpha for i in range(0, len(at), 1000)]) if len(at) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["id", "s"])

    reachable(points.sparkSession)
    rows = points.select("id", *(F.col(a).cast("double").alias(a) for a in axes)).mapInArrow(scored, "id long, s double")
    return _flag(rows, F.col("s") < rho, "one_class")


def votes(flags: list[DataFrame]) -> DataFrame:
    """(id, n_votes, any, majority, all) over the methods' flags."""
    union = flags[0]
    for f in flags[1:]:
        union = union.unionByName(f)
    n = len(flags)
    v = union.distinct().groupBy("id").agg(F.count("*").alias("n_votes"))
    return v.select("id", "n_votes", (F.col("n_votes") * 2 > n).alias("majority"), (F.col("n_votes") == n).alias("unanimous"))
