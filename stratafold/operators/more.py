"""Further operators: Shapiro's test, chosen transforms, parameter search, gridded errors, method checks, catalogue."""

from __future__ import annotations

from math import erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.interpolate import GLOBAL_LIMIT, global_rows, kernel_values
from stratafold.operators.neighbours import nearest_join, radius_join
from stratafold.operators.spatial import bounds, trend
from stratafold.operators.validation import uniform
from stratafold.session import reachable

SHAPIRO_LIMIT = 5000


def _quantile(p: float) -> float:
    """Standard normal quantile by bisection of the distribution function."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + erf(mid / sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def shapiro(df: DataFrame, value: str) -> tuple[float, float]:
    """W and p of Shapiro and Wilk by Royston's approximation, which holds for at most SHAPIRO_LIMIT values: more are refused, never cut."""
    x = np.sort(np.array([r[0] for r in df.select(F.col(value).cast("double")).dropna().limit(SHAPIRO_LIMIT + 1).collect()]))
    n = len(x)
    if n > SHAPIRO_LIMIT:
        raise ValueError(f"the test takes at most {SHAPIRO_LIMIT} values; normality has others")
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / sqrt(n)
    a = m / sqrt(mm)
    if n == 3:
        a = np.array([-sqrt(0.5), 0.0, sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            scale = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / sqrt(scale)
            a[[0, 1, -2, -1]] = -last, -second, second, last
        else:
            a = m / sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a[[0, -1]] = -last, last
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        return w, max(0.0, 6 / pi * (np.arcsin(sqrt(w)) - np.arcsin(sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-log(max(g - log(max(1 - w, 1e-19)), 1e-19)) - mean) / sd
    else:
        l = log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], l), exp(np.polyval([0.0030302, -0.082676, -0.4803], l))
        z = (log(max(1 - w, 1e-19)) - mean) / sd
    return w, 0.5 * (1 - erf(z / sqrt(2)))


def best_power(df: DataFrame, value: str, kind: str = "yeo_johnson", steps: int = 81) -> float:
    """Parameter of Box-Cox or Yeo-Johnson with the largest likelihood, of a row from -2 to 2; all candidates in one pass."""
    from stratafold.functions.scalar import box_cox, yeo_johnson

    v = F.col("v")
    rows = df.select(F.col(value).cast("double").alias("v")).dropna()
    rows = rows.where(v > 0) if kind == "box_cox" else rows
    grid = [round(-2 + 4 * i / (steps - 1), 6) for i in range(steps)]
    jacobian = F.sum(F.log(v)) if kind == "box_cox" else F.sum(F.signum(v) * F.log1p(F.abs(v)))
    s = rows.agg(F.count("*").alias("n"), jacobian.alias("j"), *(F.var_pop((box_cox if kind == "box_cox" else yeo_johnson)(v, g)).alias(f"p{i}") for i, g in enumerate(grid))).first()
    score = {g: -s.n / 2 * log(max(s[f"p{i}"] or 0.0, 1e-300)) + (g - 1) * (s.j or 0.0) for i, g in enumerate(grid)}
    return max(score, key=score.get)


def rbf_search(points: DataFrame, kernels=("gaussian", "multiquadric", "inverse_multiquadric", "thin_plate"), candidates: int = 6, regularizations=(1e-10, 1e-6, 1e-2)) -> DataFrame:
    """(kernel, epsilon, regularization, rmse) of leave-one-out errors, a row for each combination, each combination a task of its own."""
    rows = global_rows(points)
    spark = points.sparkSession
    reachable(spark)
    grid = [(k, float(e), float(r)) for k in kernels for e in (np.logspace(-1, 2, candidates) if k != "thin_plate" else [1.0]) for r in regularizations]

    def errors(batches):
        gap = np.linalg.norm(rows[:, None, :2] - rows[None, :, :2], axis=2)
        for b in batches:
            out = []
            for k, e, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                inverse = np.linalg.pinv(kernel_values(k, gap, e) + r * np.eye(len(rows)), rcond=1e-12, hermitian=True)
                out.append(float(np.sqrt(np.mean((inverse @ rows[:, 2] / np.diag(inverse)) ** 2))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out)], ["kernel", "epsilon", "regularization", "rmse"])

    return spark.createDataFrame(grid, "kernel string, epsilon double, regularization double").repartition(len(grid)).mapInArrow(errors, "kernel string, epsilon double, regularization double, rmse double")


def gridded_errors(predictions: DataFrame, points: DataFrame, bins: int = 5) -> DataFrame:
    """(ix, iy, mean_error, n) of predictions (id, actual, predicted) over a division of the points' box."""
    b = F.broadcast(bounds(points).drop("n", "area", "density"))
    at = lambda c: F.when(F.col(f"{c}_max") > F.col(f"{c}_min"), F.least(F.floor((F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min")) * bins), F.lit(bins - 1))).otherwise(0).cast("long")
    rows = predictions.where("predicted is not null").join(points.select("id", "x", "y"), "id").crossJoin(b)
    return rows.groupBy(at("x").alias("ix"), at("y").alias("iy")).agg(F.avg(F.col("predicted") - F.col("actual")).alias("mean_error"), F.count("*").alias("n"))


def error_gradient(predictions: DataFrame, points: DataFrame) -> DataFrame:
    """Size and direction in degrees of the plane fitted to the errors."""
    rows = predictions.where("predicted is not null").join(points.select("id", "x", "y"), "id").withColumn("value", F.col("predicted") - F.col("actual"))
    return trend(rows).select(F.hypot("b", "c").alias("gradient"), F.degrees(F.atan2("c", "b")).alias("direction"))


def spatial_bootstrap(points: DataFrame, block: float, replicates: int = 20, seed: int = 42) -> DataFrame:
    """(rep, id): blocks of points around randomly chosen points, about as many rows as points in each replicate."""
    n = points.count()
    near = radius_join(points, points, block, keep=())
    size = near.count() / max(n, 1)
    centres = near.select("qid", "nid", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    return centres.where(uniform(seed, F.col("rep"), F.col("qid")) < 1 / max(size, 1.0)).select("rep", F.col("nid").alias("id"))


def nearest_grid(points: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """(id, value): each node takes its nearest point's value if that is closer than the tolerance."""
    near = nearest_join(nodes, points, 1).where(F.col("dist") < tolerance).select(F.col("qid").alias("id"), "value")
    return nodes.select("id").join(near, "id", "left")


def method_checks(points: DataFrame, method: str) -> DataFrame:
    """(level, rule) that speak against a method for these points."""
    s = points.agg(F.count("*").alias("n"), F.abs(F.corr("x", "value")).alias("rx"), F.abs(F.corr("y", "value")).alias("ry"), F.stddev_pop("value").alias("sd")).first()
    rules = {
        "kriging": [(s.n < 20, "error" if s.n < 10 else "warning", "few points for a variogram"), (max(s.rx or 0, s.ry or 0) > 0.7, "warning", "a trend")],
        "idw": [(s.n < 5, "warning", "few points")],
        "rbf": [(s.n < 10, "warning", "few points"), (s.n > GLOBAL_LIMIT, "error", "too many points for a global system")],
    }[method] + [(not s.sd, "warning", "constant values")]
    return points.sparkSession.createDataFrame([(level, text) for test, level, text in rules if test], "level string, rule string")


def tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current database, by name."""
    return spark.createDataFrame([(t.name, t.tableType) for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)], "name string, kind string")


def table_info(df: DataFrame) -> DataFrame:
    """(column, type, nullable) and the number of rows."""
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(fields, "column string, type string, nullable boolean").crossJoin(df.agg(F.count("*").alias("n_rows")))


def create_table_sql(name: str, columns: dict[str, str], geometry: str = "geom", kind: str = "POINT", srid: int = 4326) -> list[str]:
    """Statements of a spatial table for a database."""
    body = ", ".join(f"{c} {t}" for c, t in columns.items())
    return [f"CREATE TABLE IF NOT EXISTS {name} ({body})", f"SELECT AddGeometryColumn('{name}', '{geometry}', {srid}, '{kind}', 2)"]


def translate(df: DataFrame, message: str, table: DataFrame, context: str | None = None) -> DataFrame:
    """Texts by a table (key, text): context and key first, then the key, else the message itself."""
    known = table.groupBy("key").agg(F.first("text").alias("text"))
    plain = df.join(known.withColumnsRenamed({"key": message, "text": "_plain"}), message, "left")
    if context:
        near = known.select(F.col("key").alias("_key"), F.col("text").alias("_near"))
        plain = plain.withColumn("_key", F.concat(F.lit(f"{context}|"), F.col(message))).join(near, "_key", "left").drop("_key")
        return plain.withColumn("translated", F.coalesce("_near", "_plain", message)).drop("_near", "_plain")
    return plain.withColumn("translated", F.coalesce("_plain", message)).drop("_plain")
