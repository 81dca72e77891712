"""Correlation of several columns, from one pass of sums; matrices are as small as the number of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import atanh, erf, sqrt, tanh

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ranks import average_ranks_of


def _tidy(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    two = list(combinations(columns, 2))
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), value(a, b).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n")) for a, b in two)).alias("all"))
    return row.select(F.explode("all").alias("one")).select("one.*")


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with more than one value; a minimum and a maximum each are enough to tell."""
    s = df.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max))).first()
    return [c for c in columns if s[f"{c}_min"] is not None and s[f"{c}_min"] != s[f"{c}_max"]]


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var1, var2, r, n) over pairwise complete rows."""
    return _tidy(df, columns, F.corr)


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of average ranks, over rows complete in all columns."""
    rows = df.dropna(subset=list(columns))
    known = average_ranks_of(rows, columns)
    for c in columns:
        own = known.where(F.col("_column") == c).select(F.col("_value").alias(c), F.col("_rank").alias(f"_rank_{c}"))
        rows = rows.withColumn(c, F.col(c).cast("double")).join(own, c)
    return _tidy(rows.select(*(F.col(f"_rank_{c}").alias(c) for c in columns)), columns, F.corr)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b of two columns over the counts of their distinct pairs, so rows with equal values are joined once."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("c"))
    p, q = rows.alias("p"), rows.alias("q")
    sign = F.signum(F.col("p.a") - F.col("q.a")) * F.signum(F.col("p.b") - F.col("q.b"))
    s = p.join(q, F.col("p.a") < F.col("q.a")).agg(F.sum(sign * F.col("p.c") * F.col("q.c")).alias("s"))
    ties = lambda *by: rows.groupBy(*by).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(f"t{''.join(by)}"))
    n = rows.agg(F.sum("c").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return s.crossJoin(n).crossJoin(ties("a")).crossJoin(ties("b")).select(F.try_divide(F.col("s"), F.sqrt((pairs - F.col("ta")) * (pairs - F.col("tb")))).alias("tau"), "n")


def significance(spark, r: float, n: int, level: float = 0.95) -> dict:
    """Two-sided p of a correlation by Student's t, and the Fisher interval."""
    if n < 4 or abs(r) >= 1:
        return {"p": 0.0 if n > 2 else 1.0, "low": r, "high": r}
    t = abs(r) * sqrt((n - 2) / (1 - r * r))
    p = 2 * (1 - spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 2)).cumulativeProbability(t))
    z = spark._jvm.org.apache.commons.math3.distribution.NormalDistribution().inverseCumulativeProbability(0.5 + level / 2)
    half = z / sqrt(n - 3)
    return {"p": p, "low": tanh(atanh(r) - half), "high": tanh(atanh(r) + half)}


def matrix(tidy: DataFrame, columns: Sequence[str]) -> np.ndarray:
    out = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for row in tidy.collect():
        out[at[row.var1], at[row.var2]] = out[at[row.var2], at[row.var1]] = np.nan if row.r is None else row.r
    return out


def partial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var1, var2, r): correlation given all the other columns, from the inverse of the correlation matrix."""
    p = np.linalg.inv(matrix(pearson(df.dropna(subset=list(columns)), columns), columns))
    rows = [(a, b, float(-p[i, j] / sqrt(p[i, i] * p[j, j]))) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, r double")


def summary(tidy: DataFrame) -> DataFrame:
    """Mean, extremes and classes of |r|."""
    a = F.abs("r")
    return tidy.agg(F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"), F.min(a).alias("min_abs"), F.stddev_pop("r").alias("std"), F.count_if(a > 0.7).alias("strong"), F.count_if((a > 0.3) & (a <= 0.7)).alias("moderate"), F.count_if(a <= 0.3).alias("weak"))


def strongest(tidy: DataFrame, k: int = 10) -> DataFrame:
    return tidy.orderBy(F.desc(F.abs("r")), "var1", "var2").limit(k)


def multicollinearity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Determinant, condition number and pairs over 0.8; high risk if there is such a pair or the condition is over 30."""
    m = matrix(pearson(df, columns), columns)
    values = np.linalg.eigvalsh(m)
    pairs = int((np.abs(np.triu(m, 1)) > 0.8).sum())
    condition = float(values.max() / max(values.min(), 1e-300))
    return df.sparkSession.createDataFrame([(float(np.linalg.det(m)), condition, pairs, bool(pairs or condition > 30))], "determinant double, condition double, n_pairs int, high_risk boolean")


def clusters(m: np.ndarray, n: int) -> list[int]:
    """Ward clusters of variables by 1 - |r|, cut into n; variables are few."""
    d = 1 - np.abs(m)
    groups = {i: [i] for i in range(len(m))}
    dist = {(i, j): float(d[i, j]) for i in groups for j in groups if i < j}
    new = len(m)
    while len(groups) > n:
        i, j = min(dist, key=lambda k: (dist[k], k))
        a, b, gap = len(groups[i]), len(groups[j]), dist[i, j]
        for k in groups:
            if k not in (i, j):
                c, x, y = len(groups[k]), dist[min(i, k), max(i, k)], dist[min(j, k), max(j, k)]
                dist[k, new] = sqrt(max(((a + c) * x * x + (b + c) * y * y - c * gap * gap) / (a + b + c), 0))
        groups[new] = groups.pop(i) + groups.pop(j)
        dist = {k: v for k, v in dist.items() if i not in k and j not in k}
        new += 1
    out = [0] * len(m)
    for label, members in enumerate(sorted(groups.values(), key=min)):
        for i in members:
            out[i] = label
    return out


def normal_p(z: float) -> float:
    return 2 * (1 - 0.5 * (1 + erf(abs(z) / sqrt(2))))
