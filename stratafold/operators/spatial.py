"""Spatial statistics of a point table (id, x, y, value)."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.scalar import azimuth, in_direction
from stratafold.operators import neighbours
from stratafold.operators.neighbours import nearest_join, pair_sums, pairs, radius_join, slices
from stratafold.session import reachable, settled


def bounds(points: DataFrame) -> DataFrame:
    """Box, its area, and the density of points in it (0 for no area)."""
    s = points.agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return s.withColumn("area", area).withColumn("density", F.when(area > 0, F.col("n") / area).otherwise(0.0))


def centre(points: DataFrame) -> DataFrame:
    """Centroid, and mean and deviation of the distance to it."""
    c = F.broadcast(points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return points.crossJoin(c).groupBy("cx", "cy").agg(F.avg(d).alias("mean_distance"), F.stddev_pop(d).alias("std_distance"), F.max(d).alias("max_distance"))


def nearest_neighbours(points: DataFrame) -> DataFrame:
    """Mean, deviation and extremes of the distance to the nearest other point, the Clark-Evans index over the box, regularity and clustering."""
    d = nearest_join(points, points, 1, other=True, keep=())
    s = d.agg(F.count("*").alias("n"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), F.min("dist").alias("min"), F.max("dist").alias("max")).crossJoin(F.broadcast(bounds(points).select("density")))
    expected = 0.5 / F.sqrt("density")
    return s.select(
        "n", "mean", "std", "min", "max", (F.col("mean") / expected).alias("clark_evans"),
        F.when(F.col("mean") > 0, 1 / (1 + F.col("std") / F.col("mean"))).otherwise(0.0).alias("regularity"),
        F.when(F.col("n") < 10, 0.5).when(F.col("mean") > 0, 1 - 1 / (1 + expected / F.col("mean"))).otherwise(1.0).alias("clustering"),
    )


def local_density(points: DataFrame, k: int) -> DataFrame:
    """(id, density): k over the area of the circle that reaches the k-th other point."""
    found = nearest_join(points, points, k, other=True, keep=())
    return found.groupBy(F.col("qid").alias("id")).agg(F.max("dist").alias("r")).select("id", F.when(F.col("r") > 0, k / (pi * F.col("r") * F.col("r"))).alias("density"))


def cells(points: DataFrame, bins: int) -> DataFrame:
    """(ix, iy, n) of occupied cells of a square division of the box."""
    b = F.broadcast(bounds(points))
    place = lambda c: F.when(F.col(f"{c}_max") > F.col(f"{c}_min"), F.least(F.floor((F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min")) * bins), F.lit(bins - 1))).otherwise(0).cast("long")
    return points.crossJoin(b.drop("n")).groupBy(place("x").alias("ix"), place("y").alias("iy")).agg(F.count("*").alias("n"))


def density_variation(points: DataFrame, bins: int) -> DataFrame:
    """Occupied cells, their share, mean, deviation, largest, coefficient of variation, and uniformity 1/(1+cv)."""
    s = cells(points, bins).agg(F.count("*").alias("occupied"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.max("n").alias("max"))
    cv = F.col("std") / F.col("mean")
    return s.select("occupied", (F.col("occupied") / (bins * bins)).alias("occupancy"), "mean", "std", "max", cv.alias("cv"), (1 / (1 + cv)).alias("uniformity"))


def quadrats(points: DataFrame, bins: int) -> DataFrame:
    """Mean, population variance and their ratio over all cells, empty ones included."""
    s = cells(points, bins).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("tt"))
    m = F.col("t") / (bins * bins)
    v = F.col("tt") / (bins * bins) - m * m
    return s.select(m.alias("mean"), v.alias("variance"), (v / m).alias("vmr"))


def ripley_k(points: DataFrame, distances: list[float], area: float | None = None) -> DataFrame:
    """(d, k): pairs within d over n and the density of the area (the box's by default); no edge correction."""
    b = bounds(points).first()
    near = pairs(points, keep=(), most=max(distances))
    steps = F.explode(F.array(*map(F.lit, map(float, distances)))).alias("d")
    counts = near.select("dist", steps).where("dist <= d").groupBy("d").agg(F.count("*").alias("c"))
    every = points.sparkSession.createDataFrame([(float(d),) for d in distances], "d double")
    scale = float(b.n) * (b.n / (area or b.area or 1.0))
    return every.join(F.broadcast(counts), "d", "left").select("d", (F.coalesce("c", F.lit(0)) / scale).alias("k"))


def moran(points: DataFrame, radius: float) -> DataFrame:
    """Moran's I with weights 1/d for pairs up to the radius; pairs of one place have none."""
    m = points.agg(F.avg("value").alias("m")).first().m or 0.0
    if neighbours.densest(points, ("x", "y"), radius) > neighbours.DENSE:
        s = pair_sums(points, radius, ("x", "y"), "value", _weighted(radius, m), "w double, c double").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    else:
        near = pairs(points, most=radius).where("dist > 0")
        z = lambda c: F.col(f"value_{c}") - m
        s = near.agg(F.sum(2 / F.col("dist")).alias("w"), F.sum(2 / F.col("dist") * z("i") * z("j")).alias("c"))
    d = points.agg(F.count("*").alias("n"), F.sum((F.col("value") - m) ** 2).alias("v"))
    return s.crossJoin(d).select(F.coalesce(F.try_divide(F.col("n") * F.col("c"), F.col("w") * F.col("v")), F.lit(0.0)).alias("moran_i"))


def _weighted(radius: float, mean: float):
    """Sums over the pairs of two blocks: weights 2/d up to the radius, and these times the products of the values' departures from the mean."""

    def fold(first: dict, second: dict, counts) -> pa.Table:
        w = c = 0.0
        left, right = (np.where(True if side["known"] is None else side["known"], side["value"] - mean, 0.0) for side in (first, second))
        for s in slices(first, second):
            gaps = [second[a][None] - first[a][s, None] for a in ("x", "y")]
            dist = np.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1])
            near = (dist > 0) & (dist <= radius)
            if counts is not None:
                near &= counts(s)
            with np.errstate(divide="ignore"):
                weight = np.where(near, 2 / dist, 0.0)
            w += float(weight.sum())
            c += float(left[s] @ (weight @ right))
        return pa.table([pa.array([w]), pa.array([c])], ["w", "c"])

    return fold


def directional_extent(points: DataFrame, directions: int = 8) -> DataFrame:
    """(angle, extent): range of the projections on equally spaced directions."""
    angle = F.explode(F.array(*(F.lit(180.0 * i / directions) for i in range(directions)))).alias("angle")
    p = F.col("x") * F.cos(F.radians("angle")) + F.col("y") * F.sin(F.radians("angle"))
    return points.select("x", "y", angle).groupBy("angle").agg((F.max(p) - F.min(p)).alias("extent"))


def ellipse(points: DataFrame) -> DataFrame:
    """Axes, orientation in degrees, eccentricity and ratio of the covariance ellipse."""
    s = points.agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    mid, half = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    big, small = mid + half, F.greatest(mid - half, F.lit(0.0))
    return s.select((2 * F.sqrt(big)).alias("major"), (2 * F.sqrt(small)).alias("minor"), (F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2).alias("orientation"), F.sqrt(1 - small / big).alias("eccentricity"), F.sqrt(small / big).alias("ratio"))


def trend(points: DataFrame) -> DataFrame:
    """Least-squares plane value = a + b x + c y by normal equations, and its R2 (null for collinear points)."""
    s = points.agg(F.avg("value").alias("mv"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "x").alias("sxx"), F.covar_pop("y", "y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), F.covar_pop("x", "value").alias("sxv"), F.covar_pop("y", "value").alias("syv"), F.var_pop("value").alias("svv"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    b = F.try_divide(F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy"), det)
    c = F.try_divide(F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy"), det)
    return s.select((F.col("mv") - b * F.col("mx") - c * F.col("my")).alias("a"), b.alias("b"), c.alias("c"), F.try_divide(b * F.col("sxv") + c * F.col("syv"), F.col("svv")).alias("r2"))


def density_kernel(points: DataFrame, bandwidth: float) -> DataFrame:
    """(id, log_density) of a Gaussian kernel estimate at the points; kernels are cut at eight bandwidths, beyond which they are below 1e-13."""
    n = points.count()
    near = radius_join(points, points, 8 * bandwidth, keep=())
    total = F.sum(F.exp(-F.col("dist") * F.col("dist") / (2 * bandwidth * bandwidth)))
    return near.groupBy(F.col("qid").alias("id")).agg((F.log(total) - F.log(F.lit(n * 2 * pi * bandwidth * bandwidth))).alias("log_density"))


def hull(points: DataFrame) -> DataFrame:
    """Corners (place, x, y) of the convex hull, anticlockwise. Each partition keeps its own hull's corners, the last step sees only those."""

    def corners(xy: np.ndarray) -> np.ndarray:
        xy = np.unique(xy, axis=0)
        if len(xy) < 3:
            return xy

        def half(rows: np.ndarray) -> list:
            out: list = []
            for p in rows:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return np.array(half(xy) + half(xy[::-1]))

    def part(batches):
        kept = np.zeros((0, 2))
        for b in batches:
            kept = corners(np.vstack([kept, np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kept))), pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["place", "x", "y"])

    reachable(points.sparkSession)
    first = points.select("x", "y").dropna().mapInArrow(part, "place long, x double, y double")
    return first.select("x", "y").repartition(1).mapInArrow(part, "place long, x double, y double")


def hull_measures(points: DataFrame) -> DataFrame:
    """Area, perimeter and compactness 4 pi A / P**2 of the convex hull, 0 if it is degenerate."""
    from pyspark.sql import Window as W

    h = hull(points)
    ring = W.orderBy("place")
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    edges = h.select("x", "y", nxt("x").alias("x2"), nxt("y").alias("y2"))
    s = edges.agg(F.coalesce(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2, F.lit(0.0)).alias("area"), F.coalesce(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))), F.lit(0.0)).alias("perimeter"))
    return s.withColumn("compactness", F.when(F.col("perimeter") > 0, 4 * pi * F.col("area") / F.col("perimeter") ** 2).otherwise(0.0))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster): density clusters numbered by their smallest core id, -1 for noise; a border point joins its nearest core's cluster."""
    near = settled(radius_join(points, points, eps, keep=()))
    core = settled(near.groupBy("qid").count().where(F.col("count") >= least).select("qid"))
    links = settled(near.join(core, "qid", "left_semi").join(core.withColumnRenamed("qid", "nid"), "nid", "left_semi").select("qid", "nid"))
    label = settled(core.select("qid", F.col("qid").alias("c")))
    while True:
        least_c = links.join(label.withColumnRenamed("qid", "nid"), "nid").groupBy("qid").agg(F.min("c").alias("c"))
        jumped = least_c.join(label.select(F.col("qid").alias("c"), F.col("c").alias("cc")), "c").select("qid", F.least("c", "cc").alias("c"))
        new = settled(jumped)
        if new.join(label, ["qid", "c"], "left_anti").isEmpty():
            break
        label = new
    border = near.join(label.select(F.col("qid").alias("nid"), "c"), "nid").groupBy("qid").agg(F.min(F.struct("dist", "nid", "c")).alias("m")).select("qid", F.col("m.c").alias("c"))
    own = border.join(label.withColumnRenamed("c", "own"), "qid", "left").select(F.col("qid").alias("id"), F.coalesce("own", "c").alias("cluster"))
    return points.select("id").join(own, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def kmeans(points: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia) of k-means on the places; the best k is where the second difference of inertia is largest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = settled(points.select(array_to_vector(F.array("x", "y")).alias("features")))
    found = [(k, float(KMeans(k=k, seed=seed).fit(rows).summary.trainingCost)) for k in ks]
    return points.sparkSession.createDataFrame(found, "k int, inertia double")


def directional_pairs(points: DataFrame, direction: float, tolerance: float = 22.5, most: float | None = None) -> DataFrame:
    return pairs(points, most=most).where(in_direction(azimuth(F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")), direction, tolerance))
