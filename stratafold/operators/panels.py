"""Tables behind drawings and reports: curves, residuals, summaries of points, votes and composites."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.scalar import variogram
from stratafold.model import Variogram
from stratafold.operators.statistics import histogram

# Parts of curve names that point to coal.
COAL = ("coal", "ash", "sulfur", "moisture", "btu", "calorific", "carbon", "volatile", "fixed", "gc", "density", "resistivity")


def coal_curves(columns: list[str]) -> list[str]:
    return [c for c in columns if any(word in c.lower() for word in COAL)]


def model_curves(spark: SparkSession, models: dict[str, Variogram], most: float, steps: int = 100) -> DataFrame:
    """(model, h, gamma) at evenly spaced distances from 0 to ``most``."""
    h = spark.range(steps).select((F.col("id") * (most / max(steps - 1, 1))).alias("h"))
    out = None
    for name, m in models.items():
        part = h.select(F.lit(name).alias("model"), "h", variogram(m.kind, F.col("h"), m.nugget, m.sill, m.range).alias("gamma"))
        out = part if out is None else out.unionByName(part)
    return out


def rose(spark: SparkSession, minor: float, ratio: float, direction: float, steps: int = 100) -> DataFrame:
    """(angle, range): the range in each direction, angles in radians from 0 to a full turn."""
    at = spark.range(steps).select((F.col("id") * (2 * pi / max(steps - 1, 1))).alias("angle"))
    turn = F.col("angle") - direction * pi / 180
    return at.select("angle", (minor * F.sqrt(F.cos(turn) ** 2 + ratio * F.sin(turn) ** 2)).alias("range"))


def residuals(predictions: DataFrame) -> DataFrame:
    """(id, actual, predicted, error, z): z is the error over the deviation of all errors, null if that is 0."""
    rows = predictions.where("predicted is not null and actual is not null").select("id", "actual", "predicted", (F.col("predicted") - F.col("actual")).alias("error"))
    s = F.broadcast(rows.agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("s")))
    return rows.crossJoin(s).select("id", "actual", "predicted", "error", F.try_divide(F.col("error") - F.col("m"), F.col("s")).alias("z"))


def error_histogram(predictions: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(residuals(predictions), "error", bins)


def training_summary(points: DataFrame) -> DataFrame:
    """One row: number, ranges and means of the places, statistics of the values with sample deviation."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return points.agg(F.count("*").alias("n"), *ends, F.avg("value").alias("value_mean"), F.stddev_samp("value").alias("value_std"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))


def vote_summary(flags: DataFrame, methods: int | None = None) -> DataFrame:
    """One row from flags (id, method): methods, ids flagged by any, by more than half and by all of them, and agreement as all over any.

    Give the number of methods where some may have flagged nothing; otherwise those with a flag count.
    """
    own = flags.select("id", "method").distinct()
    n = F.broadcast(own.agg(F.count_distinct("method").alias("methods") if methods is None else F.lit(methods).cast("long").alias("methods")))
    votes = own.groupBy("id").agg(F.count("*").alias("v")).crossJoin(n)
    s = votes.agg(F.count("*").alias("any"), F.count_if(F.col("v") * 2 > F.col("methods")).alias("majority"), F.count_if(F.col("v") == F.col("methods")).alias("all"))
    return s.crossJoin(n).select("methods", "any", "majority", "all", F.coalesce(F.try_divide(F.col("all"), F.col("any")), F.lit(0.0)).alias("agreement"))


def top_votes(flags: DataFrame, points: DataFrame, contamination: float = 0.1) -> DataFrame:
    """(id, votes) of the points with at least as many votes as the quantile of 1 - contamination over all points, unflagged ones included."""
    votes = flags.select("id", "method").distinct().groupBy("id").agg(F.count("*").alias("votes"))
    all_ = points.select("id").join(votes, "id", "left").select("id", F.coalesce("votes", F.lit(0)).alias("votes"))
    cut = F.broadcast(all_.agg(F.percentile("votes", 1 - contamination).alias("cut")))
    return all_.crossJoin(cut).where("votes >= cut").select("id", "votes")


def composite_quality(n_before: int, n_after: int, rejection: float | None = None, recovery: float | None = None, samples: float | None = None) -> dict:
    """Score, grade and issues of a compositing: reduction for all, rejection and recovery for intervals, samples for places."""
    kept = n_after / n_before if n_before else 0.0
    issues = [text for test, text in (
        (kept > 0.8, "little reduction: longer composites may help"),
        (kept < 0.1, "strong reduction: shorter composites keep more detail"),
        (rejection is not None and rejection > 0.3, "many composites are rejected"),
        (recovery is not None and recovery < 0.7, "low mean recovery"),
        (samples is not None and samples < 3, "few samples in a composite"),
    ) if test]
    score = 0.4 if 0.2 <= kept <= 0.7 else 0.2 if 0.1 <= kept <= 0.8 else 0.0
    score += 0 if rejection is None else 0.3 if rejection < 0.2 else 0.15 if rejection < 0.4 else 0
    score += 0 if recovery is None else 0.3 if recovery > 0.8 else 0.15 if recovery > 0.6 else 0
    grade = next((g for least, g in ((0.8, "excellent"), (0.6, "good"), (0.4, "fair")) if score >= least - 1e-12), "poor")
    return {"score": score, "grade": grade, "issues": issues}
