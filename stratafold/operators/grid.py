"""Regular grids as long tables (ix, iy, id, x, y), x fastest."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.model import Grid

MOST_NODES, MANY_NODES = 1_000_000, 100_000


class GridError(ValueError):
    """Bounds or dimensions that make no grid."""


def dimensions(grid: Grid, bounds: tuple[float, float, float, float]) -> tuple[int, int]:
    """nx, ny: given ones first, then by cell size, then 50, 100 or 200 by extent."""
    x0, x1, y0, y1 = bounds
    if not all(map(lambda v: v == v and abs(v) != float("inf"), bounds)) or x1 < x0 or y1 < y0:
        raise GridError(f"bounds {bounds} are not finite and rising")
    if grid.nx and grid.ny:
        nx, ny = grid.nx, grid.ny
    elif grid.cell_size:
        if grid.cell_size <= 0:
            raise GridError("the cell size has to be positive")
        nx, ny = max(1, ceil((x1 - x0) / grid.cell_size)), max(1, ceil((y1 - y0) / grid.cell_size))
    else:
        extent = max(x1 - x0, y1 - y0)
        nx = ny = 50 if extent < 1000 else 100 if extent < 10000 else 200
    if nx * ny > MOST_NODES:
        raise GridError(f"{nx} x {ny} nodes; at most {MOST_NODES} are allowed")
    return nx, ny


def grid_bounds(grid: Grid, points: DataFrame | None) -> tuple[float, float, float, float]:
    """Given bounds, else the points' box; a buffer below 1 is a share of each extent, otherwise a distance."""
    b = grid.bounds
    if b is None:
        if points is None:
            raise GridError("neither bounds nor points are given")
        r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if r[0] is None:
            raise GridError("no points")
        b = tuple(map(float, r))
    dx, dy = (grid.buffer * (b[1] - b[0]), grid.buffer * (b[3] - b[2])) if grid.buffer < 1 else (grid.buffer, grid.buffer)
    return b[0] - dx, b[1] + dx, b[2] - dy, b[3] + dy


def regular(spark: SparkSession, grid: Grid, points: DataFrame | None = None) -> DataFrame:
    """Nodes at equal steps from bound to bound; one node in a direction stands at the lower bound."""
    b = grid_bounds(grid, points)
    nx, ny = dimensions(grid, b)
    sx = (b[1] - b[0]) / (nx - 1) if nx > 1 else 0.0
    sy = (b[3] - b[2]) / (ny - 1) if ny > 1 else 0.0
    i = F.col("id")
    nodes = spark.range(nx * ny).select("id", (i % nx).alias("ix"), F.floor(i / nx).alias("iy"))
    return nodes.select("id", "ix", "iy", (F.lit(b[0]) + F.col("ix") * sx).alias("x"), (F.lit(b[2]) + F.col("iy") * sy).alias("y"))


def info(grid: Grid, points: DataFrame | None = None) -> dict:
    """Bounds, dimensions, spacing, nodes and bytes; or the error."""
    try:
        b = grid_bounds(grid, points)
        nx, ny = dimensions(grid, b)
    except GridError as e:
        return {"error": str(e)}
    return {"bounds": b, "nx": nx, "ny": ny, "dx": (b[1] - b[0]) / (nx - 1) if nx > 1 else 0.0, "dy": (b[3] - b[2]) / (ny - 1) if ny > 1 else 0.0, "nodes": nx * ny, "bytes": nx * ny * 16, "many": nx * ny > MANY_NODES}


def rasterise(points: DataFrame, cell: float, buffer: float = 0.1) -> DataFrame:
    """(ix, iy, value): each point at its nearest node of a buffered grid; of several points that with the largest id."""
    b = F.broadcast(points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    at = lambda c: F.round((F.col(c) - F.col(f"{c}0") + buffer * (F.col(f"{c}1") - F.col(f"{c}0"))) / cell).cast("long")
    return points.crossJoin(b).groupBy(at("x").alias("ix"), at("y").alias("iy")).agg(F.max_by("value", "id").alias("value"))


def contour_crossings(grid: DataFrame, levels: list[float]) -> DataFrame:
    """(level, x, y): where levels cut the edges between neighbouring nodes of a gridded value (marching squares' points)."""
    a = grid.select("ix", "iy", "x", "y", "value")
    out = None
    for dx, dy in ((1, 0), (0, 1)):
        b = a.select((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("value").alias("v2"))
        edge = a.join(b, ["ix", "iy"]).select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
        edge = edge.where(((F.col("value") < F.col("level")) & (F.col("v2") >= F.col("level"))) | ((F.col("value") >= F.col("level")) & (F.col("v2") < F.col("level"))))
        t = (F.col("level") - F.col("value")) / (F.col("v2") - F.col("value"))
        part = edge.select("level", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def color_index(grid: DataFrame) -> DataFrame:
    """Colour number 1..255 of each value; the middle one if all are equal."""
    s = F.broadcast(grid.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    share = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 254) + 1
    return grid.crossJoin(s).withColumn("color", F.when(F.col("hi") > F.col("lo"), share).otherwise(128).cast("long")).drop("lo", "hi")
