"""Compositing of intervals, places and domains, and declustering weights."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.operators.neighbours import nearest_join, ranked
from stratafold.session import reachable, settled


def composite_intervals(df: DataFrame, hole: str, start: str, end: str, values: Sequence[str], length: float, weighted: bool = True, min_recovery: float = 0.5) -> DataFrame:
    """(hole, from, to, values, recovery, n_intervals): windows of one length from the hole's top, kept if enough of them is covered.

    Each interval is exploded into just the windows that it touches, so there is no join of intervals with windows.
    """
    rows = df.select(F.col(hole).alias("hole"), F.col(start).cast("double").alias("f"), F.col(end).cast("double").alias("t"), *values)
    top = rows.groupBy("hole").agg(F.min("f").alias("top"), F.max("t").alias("bottom"))
    windows = F.ceil((F.col("bottom") - F.col("top")) / length) - 1
    first, last = F.greatest(F.floor((F.col("f") - F.col("top")) / length), F.lit(0)), F.least(F.ceil((F.col("t") - F.col("top")) / length) - 1, windows)
    cut = rows.join(top, "hole").where("t > f").withColumns({"first": first, "last": last}).where("last >= first").withColumn("window", F.explode(F.sequence("first", "last")))
    low = F.col("top") + F.col("window") * length
    overlap = F.least("t", low + length) - F.greatest("f", low)
    cut = cut.withColumn("overlap", overlap).where("overlap > 0")
    mean = lambda v: F.try_divide(F.sum(F.col(v) * F.col("overlap")), F.sum(F.when(F.col(v).isNotNull(), F.col("overlap")))) if weighted else F.avg(v)
    out = cut.groupBy("hole", "top", "window").agg((F.sum("overlap") / length).alias("recovery"), F.count("*").alias("n_intervals"), *(mean(v).alias(v) for v in values))
    low = F.col("top") + F.col("window") * length
    return out.where(F.col("recovery") >= min_recovery).select("hole", low.alias("from"), (low + length).alias("to"), *values, "recovery", "n_intervals")


def composite_domains(df: DataFrame, domain: str, values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of each value per domain, and the domain's rows."""
    return df.groupBy(domain).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))), F.count("*").alias("domain_sample_count"))


def composite_places(points: DataFrame, radius: float, method: str = "inverse_distance", power: float = 2.0, min_samples: int = 2, max_samples: int = 10) -> DataFrame:
    """(x, y, value, n_samples, quality) at nodes half a radius apart with enough points in the closed circle.

    Only nodes that a point can reach are made: each point proposes the nodes around it.
    """
    s = radius / 2
    low = F.broadcast(points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")))
    reach = [F.lit(k) for k in range(-3, 4)]
    near = points.crossJoin(low).select("*", F.explode(F.array(*reach)).alias("dx"), F.floor((F.col("x") - F.col("x0")) / s).alias("cx"), F.floor((F.col("y") - F.col("y0")) / s).alias("cy"))
    near = near.select("*", F.explode(F.array(*reach)).alias("dy")).select("id", "x", "y", "value", "x0", "y0", "x1", "y1", (F.col("cx") + F.col("dx")).alias("ix"), (F.col("cy") + F.col("dy")).alias("iy"))
    near = near.where((F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < F.ceil((F.col("x1") - F.col("x0") + s) / s)) & (F.col("iy") < F.ceil((F.col("y1") - F.col("y0") + s) / s)))
    nx, ny = F.col("x0") + F.col("ix") * s, F.col("y0") + F.col("iy") * s
    near = near.withColumns({"nx": nx, "ny": ny}).withColumn("dist", F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)).where(F.col("dist") <= radius)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("ix", "iy").orderBy("dist", "id"))).where(F.col("rank") <= max_samples)
    w = 1 / F.pow(F.col("dist") + 1e-10, F.lit(float(power)))
    value = {"inverse_distance": F.sum(w * F.col("value")) / F.sum(w), "mean": F.avg("value"), "median": F.percentile("value", 0.5)}[method]
    out = near.groupBy("nx", "ny").agg(value.alias("value"), F.count("*").alias("n_samples")).where(F.col("n_samples") >= min_samples)
    return out.select(F.col("nx").alias("x"), F.col("ny").alias("y"), "value", "n_samples", F.least(F.lit(1.0), F.col("n_samples") / max_samples).alias("quality"))


def _normalised(rows: DataFrame) -> DataFrame:
    """Weights with the number of rows as sum."""
    total = F.broadcast(rows.agg(F.sum("w").alias("_s"), F.count("*").alias("_n")))
    return rows.crossJoin(total).withColumn("weight", F.col("w") * F.col("_n") / F.col("_s")).drop("w", "_s", "_n")


def decluster_cells(points: DataFrame, cell: float, max_cells: int = 1000) -> DataFrame:
    """Points with a weight that falls with the number of points in the cell of a box padded by one percent."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    px, py = 0.01 * (b[1] - b[0]), 0.01 * (b[3] - b[2])
    wide, high = (b[1] - b[0] + 2 * px), (b[3] - b[2] + 2 * py)
    nx, ny = max(10, ceil(wide / cell)), max(10, ceil(high / cell))
    if nx * ny > max_cells:
        scale = sqrt(max_cells / (nx * ny))
        nx, ny = max(1, int(nx * scale)), max(1, int(ny * scale))
    at = lambda c, low, size, n: F.least(F.greatest(F.floor((F.col(c) - low) / (size / n if size else 1.0)), F.lit(0)), F.lit(n - 1))
    rows = points.withColumn("_cell", at("y", b[2] - py, high, ny) * nx + at("x", b[0] - px, wide, nx))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_c"))
    return _normalised(rows.join(F.broadcast(counts), "_cell").withColumn("w", 1 / F.col("_c")).drop("_cell", "_c"))


def decluster_distance(points: DataFrame, k: int = 5, power: float = 2.0) -> DataFrame:
    """Points with a weight that rises with the mean distance to the k nearest others; all 1 if there are too few."""
    if points.limit(k + 1).count() <= k:
        return points.withColumn("weight", F.lit(1.0))
    mean = nearest_join(points, points, k, other=True, keep=()).groupBy(F.col("qid").alias("id")).agg(F.avg("dist").alias("_d"))
    density = 1 / (F.pow("_d", F.lit(float(power))) + 1e-10)
    return _normalised(points.join(mean, "id").withColumn("w", 1 / (density + 1e-10)).drop("_d"))


#: Cells that are left after a round and whose cutting points are then looked for among all places; with more, further neighbours are fetched.
SCANNED_CELLS = 1000


def decluster_polygons(points: DataFrame) -> DataFrame:
    """Points weighted by the area of their Voronoi cell; open cells take the median closed area, copies of a place the area of its cell.

    Cells are cut by the bisectors of the places around, the nearest first. A cell is final when its farthest corner is
    at most half as far as the neighbours fetched reach. For the others further neighbours are fetched in rounds; when
    few are left, all places that are nearer to one of their corners are found by a scan, until none is.
    """
    points = points.where("x is not null and y is not null")
    places = settled(points.groupBy("x", "y").agg(F.min("id").cast("long").alias("id")))
    n = places.count()
    if n < 3:
        return points.withColumn("weight", F.lit(1.0))
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    reachable(points.sparkSession)
    span = max(b[1] - b[0], b[3] - b[2], 1e-9)
    boxes = [(b[0] - pad, b[1] + pad, b[2] - pad, b[3] + pad) for pad in (2 * span, 1e6 * span)]

    def cells(batches):
        for batch in batches:
            rows = []
            for i, x, y, nx, ny, reach, before in zip(*(c.to_pylist() for c in batch.columns)):
                for box in boxes:
                    poly = _cell(x, y, nx, ny, box)
                    if not _open(poly, box):
                        break
                far = max((np.hypot(px - x, py - y) for px, py in poly), default=0.0)
                area = None if _open(poly, box) else _area(poly)
                same = before is not None and len(before) == len(poly) and np.allclose(before, [px for px, _ in poly], rtol=0, atol=1e-12 * far)
                rows.append((i, x, y, nx, ny, reach, [px for px, _ in poly], [py for _, py in poly], float(far), area, same or 2 * far <= reach or len(nx) >= n - 1))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([(c, t) for c, t in zip(names, types)]))

    many = pa.list_(pa.float64())
    names = ("id", "px", "py", "nx", "ny", "reach", "vx", "vy", "far", "area", "done")
    types = (pa.int64(), pa.float64(), pa.float64(), many, many, pa.float64(), many, many, pa.float64(), pa.float64(), pa.bool_())
    schema = "id long, px double, py double, nx array<double>, ny array<double>, reach double, vx array<double>, vy array<double>, far double, area double, done boolean"
    own = lambda rows: rows.select("id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    left, k, out = places, 48, None
    while True:
        near = nearest_join(left, places, k, other=True, keep=("x", "y"))
        lists = near.groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("n"), F.max("dist").alias("reach"))
        rows = lists.join(own(left), "id").select("id", "px", "py", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), "reach", F.lit(None).cast("array<double>").alias("before"))
        found = settled(rows.mapInArrow(cells, schema))
        done = found.where("done").select("id", "area")
        out = done if out is None else out.unionByName(done)
        open_ = found.where("not done")
        if open_.count() <= SCANNED_CELLS:
            break
        left, k = places.join(open_.select("id"), "id", "left_semi"), 4 * k
    while not open_.isEmpty():
        q = F.broadcast(open_.select("id", "px", "py", "reach", "far", F.arrays_zip("vx", "vy").alias("corners")))
        gap = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        square = lambda c, x, y: (c["vx"] - F.col(x)) * (c["vx"] - F.col(x)) + (c["vy"] - F.col(y)) * (c["vy"] - F.col(y))
        nearer = F.exists("corners", lambda c: square(c, "x", "y") < square(c, "px", "py") * (1 - 1e-12))
        cut = places.select(F.col("id").alias("nid"), "x", "y").crossJoin(q).where((gap > F.col("reach")) & (gap < 2 * F.col("far")) & nearer)
        cut = ranked(cut.select(F.col("id").alias("qid"), "nid", "x", "y", gap.alias("dist")), 48)
        more = cut.groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("n"))
        rows = open_.join(more, "id", "left")
        out = out.unionByName(rows.where("n is null").select("id", "area"))
        rows = rows.where("n is not null").select("id", "px", "py", F.concat("nx", "n.x").alias("nx"), F.concat("ny", "n.y").alias("ny"), "reach", F.col("vx").alias("before"))
        found = settled(rows.mapInArrow(cells, schema))
        out = out.unionByName(found.where("done").select("id", "area"))
        open_ = found.where("not done")
    areas = out.join(places, "id").select("x", "y", "area")
    rows = settled(points.join(areas, ["x", "y"]))
    middle = F.broadcast(rows.agg(F.percentile("area", 0.5).alias("m")))
    return _normalised(rows.crossJoin(middle).withColumn("w", F.coalesce("area", "m", F.lit(1.0))).select(*points.columns, "w"))


def _cell(x: float, y: float, nx: list[float], ny: list[float], box) -> list[tuple[float, float]]:
    """Corners of the cell of (x, y) within the box."""
    poly = [(box[0], box[2]), (box[1], box[2]), (box[1], box[3]), (box[0], box[3])]
    for a, c in zip(nx, ny):
        mx, my, dx, dy = (x + a) / 2, (y + c) / 2, a - x, c - y
        if dx == 0 and dy == 0:
            continue
        side = [(px - mx) * dx + (py - my) * dy for px, py in poly]
        new = []
        for i, p in enumerate(poly):
            q, s, t = poly[i - 1], side[i], side[i - 1]
            if (s > 0) != (t > 0):
                f = t / (t - s)
                new.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s <= 0:
                new.append(p)
        poly = new
    return poly


def _open(poly: list[tuple[float, float]], box) -> bool:
    return any(px <= box[0] or px >= box[1] or py <= box[2] or py >= box[3] for px, py in poly)


def _area(poly: list[tuple[float, float]]) -> float:
    if not poly:
        return 0.0
    p = np.array(poly) - np.array(poly[0])
    return float(abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2)


def _cell_area(x: float, y: float, nx: list[float], ny: list[float], box) -> float | None:
    """Area of the cell of (x, y), None if it reaches the box."""
    poly = _cell(x, y, nx, ny, box)
    return None if _open(poly, box) else _area(poly)


def weight_metrics(points: DataFrame) -> DataFrame:
    """Spread of weights, effective number of points, and weighted against plain mean and deviation (population)."""
    m = F.broadcast(points.agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("wm")))
    s = points.crossJoin(m).agg(
        F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight"),
        (F.sum("weight") ** 2 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"), F.count("*").alias("n"), F.max("wm").alias("weighted_mean"), F.avg("value").alias("original_mean"),
        F.sqrt(F.sum(F.col("weight") * (F.col("value") - F.col("wm")) ** 2) / F.sum("weight")).alias("weighted_std"), F.stddev_samp("value").alias("original_std"),
    )
    return s.withColumns({"efficiency": F.col("effective_n") / F.col("n"), "mean_change": 100 * F.try_divide(F.col("weighted_mean") - F.col("original_mean"), F.col("original_mean"))})


