"""Rule-based choice of method and parameters from the characteristics of a point table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.outliers import fences
from stratafold.operators.spatial import bounds, density_variation, directional_extent, nearest_neighbours, trend


def characteristics(points: DataFrame) -> dict:
    """Counts, box, density, statistics (population deviation), uniformity, trend, anisotropy, clustering and outliers; a few one-row jobs."""
    b = bounds(points).first()
    v = points.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.skewness("value").alias("skew")).first()
    n = b.n
    bins = max(3, min(20, int((n / 5) ** 0.5)))
    nn = nearest_neighbours(points).first()
    extents = [r.extent for r in directional_extent(points).collect()]
    plane = trend(points).first().r2 or 0.0
    return {
        "n": n, "area": b.area, "density": b.density, "bounds": (b.x_min, b.x_max, b.y_min, b.y_max), "mean": v.mean, "std": v.std, "cv": abs(v.std / v.mean) if v.mean else 0.0, "range": v.hi - v.lo, "skew": v.skew,
        "uniformity": density_variation(points, bins).first().uniformity, "trend": plane > 0.1, "anisotropy": min(extents) / max(extents) if n >= 30 and max(extents) else 1.0, "clustering": nn.clustering, "nn_mean": nn["mean"],
        "outliers": fences(points).count() / n if n else 0.0,
    }


def _clip(x: float) -> float:
    return max(0.0, min(100.0, x))


def scores(c: dict, speed: bool = False, uncertainty: bool = False, smooth: bool = False, three_d: bool = False) -> dict[str, float]:
    """Points of each method from 50 up and down, within 0 to 100."""
    n, uni, out = c["n"], c["uniformity"], c["outliers"]
    idw = 50 + (10 if c["density"] > 0.1 else -5) + (15 if uni > 0.7 else -10 if uni < 0.3 else 0) + (-15 if c["trend"] else 5) - (10 if out > 0.1 else 0) + (5 if c["anisotropy"] < 0.7 else 0) + 10 * speed + (5 if n < 50 else -5 if n > 10000 else 0)
    krige = 50 + (10 if uni < 0.5 else 0) - (5 if c["trend"] else 0) - (5 if out > 0.05 else 0) - 15 * speed + 20 * uncertainty + (-20 if n < 30 else 10 if n > 100 else 0) + (15 if c["clustering"] > 0.6 else 0) + (5 if c["cv"] > 1 else 0)
    even = c["range"] > 0 and c["std"] / c["range"] < 0.2
    rbf = 50 + (10 if uni > 0.7 else 0) - (15 if out > 0.05 else 0) + 20 * smooth + (-10 if n < 20 else -15 if n > 1000 else 10) + (10 if even else 0) - 5 * three_d
    return {"idw": _clip(idw), "kriging": _clip(krige), "rbf": _clip(rbf)}


def parameters(c: dict, method: str, three_d: bool = False) -> dict:
    """Radius, power, counts and sectors for inverse distance; model for kriging; kernel for radial bases."""
    x0, x1, y0, y1 = c["bounds"]
    extent, n = max(x1 - x0, y1 - y0), c["n"]
    if method == "idw":
        factor = 5 if c["uniformity"] > 0.7 else 8 if c["uniformity"] > 0.4 else 12
        power = 2 + (0.5 if c["cv"] > 1 else -0.5 if c["cv"] < 0.3 else 0) + 0.5 * (c["clustering"] > 0.7) + 0.5 * (c["outliers"] > 0.05)
        least, most = (2, min(n // 2, 20)) if n < 50 else (3, 15) if n < 500 else (4, 12)
        most = max(most, least + 2)
        sectors = (8 if three_d else 4) if c["clustering"] > 0.6 or c["anisotropy"] < 0.8 or c["uniformity"] < 0.5 else 0
        out = {"radius": min(max(c["nn_mean"] * factor, 0.1 * extent), 0.5 * extent), "power": min(max(power, 1.0), 4.0), "min_points": least, "max_points": most, "sectors": sectors}
        return out | ({"min_per_sector": max(1, least // sectors), "max_per_sector": most // sectors + 1} if sectors else {})
    if method == "kriging":
        var = c["std"] ** 2
        return {"model": "exponential" if c["cv"] > 1 else "spherical", "range": 0.3 * ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5, "sill": var, "nugget": (0.2 if c["outliers"] > 0.05 else 0.1) * var, "max_points": min(30, n // 3)}
    return {"kernel": "thin_plate" if c["cv"] < 0.5 else "multiquadric", "regularization": 0.1 if c["outliers"] > 0.05 else 0.0, "epsilon": 1 / c["nn_mean"] if c["nn_mean"] else 1.0}


def warnings(c: dict) -> list[str]:
    n = c["n"]
    rules = ((n < 10, "very few points"), (10 <= n < 30, "few points"), (c["uniformity"] < 0.3, "uneven spread"), (c["outliers"] > 0.1, "many outliers"), (c["cv"] > 2, "very variable values"), (c["trend"], "a trend"), (c["anisotropy"] < 0.7, "anisotropy"))
    return [text for test, text in rules if test]


def recommend(points: DataFrame, **preferences) -> DataFrame:
    """(method, score, parameters, warnings) by falling score; ties go to inverse distance, kriging, radial bases."""
    c = characteristics(points)
    rows = [(m, float(s), {k: str(v) for k, v in parameters(c, m).items()}, warnings(c)) for m, s in sorted(scores(c, **preferences).items(), key=lambda x: -x[1])]
    return points.sparkSession.createDataFrame(rows, "method string, score double, parameters map<string,string>, warnings array<string>")
