"""Descriptive statistics of one value column, each operator a one-row or tidy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.scalar import normal_cdf
from stratafold.operators.ranks import numbered, order_quantiles, running_total
from stratafold.session import settled

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def quantiles(value: str | Column, probabilities: Sequence[float], accuracy: int | None = None) -> Column:
    """Array of quantiles: exact with linear interpolation, or, with an accuracy, from a bounded sketch."""
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    return F.percentile(value, wanted) if accuracy is None else F.percentile_approx(value, list(probabilities), accuracy).cast("array<double>")


def _clean(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")


def descriptive(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, median, smallest mode, sample deviation and variance, extremes, MAD, harmonic and geometric mean."""
    v = _clean(df, value)
    median = order_quantiles(v, "v", (0.5,))[0]
    mad = order_quantiles(v.select(F.abs(F.col("v") - F.lit(median)).alias("d")), "d", (0.5,))[0]
    positive = F.min("v") > 0
    return v.agg(
        F.count("*").alias("count"),
        F.avg("v").alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.mode("v", True).alias("mode"),
        F.stddev_samp("v").alias("std"),
        F.var_samp("v").alias("variance"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.max("v") - F.min("v")).alias("range"),
        F.sum("v").alias("sum"),
        F.lit(mad).cast("double").alias("mad"),
        F.when(positive, F.count("*") / F.sum(F.when(F.col("v") > 0, 1 / F.col("v")))).alias("harmonic_mean"),
        F.when(positive, F.exp(F.avg(F.when(F.col("v") > 0, F.log("v"))))).alias("geometric_mean"),
    )


def trimmed_mean(df: DataFrame, value: str, share: float) -> DataFrame:
    """Mean without the int(share * n) smallest and largest rows; ties are split by weight, so no row order is needed."""
    counts = _clean(df, value).groupBy("v").agg(F.count("*").alias("c"))
    total = running_total(counts, ["v"], "c", "hi").withColumn("lo", F.col("hi") - F.col("c"))
    n = F.broadcast(counts.agg(F.sum("c").alias("n")))
    cut = F.floor(F.col("n") * share)
    kept = F.greatest(F.least("hi", F.col("n") - cut) - F.greatest("lo", cut), F.lit(0))
    return total.crossJoin(n).agg((F.sum(kept * F.col("v")) / F.sum(kept)).alias("trimmed_mean"))


def shape(df: DataFrame, value: str) -> DataFrame:
    """Population skewness and excess kurtosis with labels at 0.5."""
    s = _clean(df, value).agg(F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    skew = F.when(F.col("skewness") > 0.5, "right").when(F.col("skewness") < -0.5, "left").otherwise("symmetric")
    kurt = F.when(F.col("kurtosis") > 0.5, "heavy").when(F.col("kurtosis") < -0.5, "light").otherwise("normal")
    return s.withColumns({"skew_label": skew, "kurtosis_label": kurt})


def bias_corrected_shape(df: DataFrame, value: str) -> DataFrame:
    """Adjusted skewness G1 and kurtosis G2 of a sample."""
    s = _clean(df, value).agg(F.count("*").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    n = F.col("n").cast("double")
    return s.select("n", (F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).alias("skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def quantile_table(df: DataFrame, value: str) -> DataFrame:
    """(percent, quantile) of the standard percents, deciles and quintiles."""
    percents = sorted({*PERCENTS, *range(10, 100, 10), 20, 40, 60, 80})
    found = order_quantiles(df, value, [p / 100 for p in percents])
    return df.sparkSession.createDataFrame(list(zip(percents, found)), "percent long, quantile double")


def variability(df: DataFrame, value: str) -> DataFrame:
    """Coefficients of variation and dispersion."""
    v = _clean(df, value)
    q1, median, q3 = order_quantiles(v, "v", (0.25, 0.5, 0.75))
    mad = order_quantiles(v.select(F.abs(F.col("v") - F.lit(median)).alias("d")), "d", (0.5,))[0]
    number = lambda x: F.lit(x).cast("double")
    first = v.agg(F.avg("v").alias("m"), number(median).alias("med"), number(q1).alias("q1"), number(q3).alias("q3"))
    both = v.crossJoin(F.broadcast(first))
    s = both.agg(
        F.stddev_samp("v").alias("sd"), F.max("m").alias("m"), F.max("med").alias("med"), F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.avg(F.abs(F.col("v") - F.col("m"))).alias("mean_abs_deviation"), number(mad).alias("mad"),
    )
    part = lambda a, b: F.try_divide(a, b)
    return s.select(
        part(F.col("sd"), F.col("m")).alias("cv"),
        (F.col("q3") - F.col("q1")).alias("iqr"),
        ((F.col("q3") - F.col("q1")) / 2).alias("quartile_deviation"),
        part(F.col("q3") - F.col("q1"), F.col("q3") + F.col("q1")).alias("quartile_coefficient"),
        "mean_abs_deviation",
        "mad",
        part(F.col("hi") - F.col("lo"), F.col("hi") + F.col("lo")).alias("range_coefficient"),
        part(F.col("mad"), F.col("med")).alias("robust_cv"),
    )


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of the values shifted to be positive. Ties need no order: equal values have equal sums of ranks."""
    v = _clean(df, value)
    rows = numbered(v, ["v"], "i").crossJoin(F.broadcast(v.agg(F.min("v").alias("lo"), F.count("*").alias("n"))))
    x = F.col("v") - F.col("lo") + 1e-10
    return rows.agg((2 * F.sum(F.col("i") * x) / (F.max("n") * F.sum(x)) - (F.max("n") + 1) / F.max("n")).alias("gini"))


def extremes(df: DataFrame, value: str, k: int = 5) -> DataFrame:
    """(side, rank, value): k smallest and k largest."""
    v = _clean(df, value)
    low = v.orderBy("v").limit(k).withColumn("side", F.lit("low"))
    high = v.orderBy(F.desc("v")).limit(k).withColumn("side", F.lit("high"))
    return low.unionByName(high).withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy("v")).cast("long")).select("side", "rank", F.col("v").alias("value"))


def outlier_counts(df: DataFrame, value: str) -> DataFrame:
    """Counts by 1.5 and 3 interquartile ranges, by |z| over 2 and 3 (population deviation), and the largest |z|."""
    v = _clean(df, value)
    q1, q3 = order_quantiles(v, "v", (0.25, 0.75))
    s = v.agg(F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = F.abs(F.try_divide(F.col("v") - F.col("m"), F.col("sd")))
    iqr = F.col("q3") - F.col("q1")
    out = lambda f: F.count_if((F.col("v") < F.col("q1") - f * iqr) | (F.col("v") > F.col("q3") + f * iqr))
    return v.crossJoin(F.broadcast(s)).agg(out(1.5).alias("iqr_1_5"), out(3.0).alias("iqr_3"), F.count_if(z > 2).alias("z_2"), F.count_if(z > 3).alias("z_3"), F.max(z).alias("max_z"))


def t_critical(spark, p: float, df: float) -> float:
    """Quantile of Student's t distribution, by the library on Spark's own class path."""
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df)).inverseCumulativeProbability(p)


def chi2_critical(spark, p: float, df: float) -> float:
    return spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df)).inverseCumulativeProbability(p)


def confidence_intervals(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """(statistic, estimate, low, high) of the mean (t) and the deviation (chi-squared)."""
    spark = df.sparkSession
    s = _clean(df, value).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    if s.n < 2:
        return spark.createDataFrame([], "statistic string, estimate double, low double, high double")
    half = t_critical(spark, 0.5 + level / 2, s.n - 1) * s.s / sqrt(s.n)
    low, high = (s.s * sqrt((s.n - 1) / chi2_critical(spark, q, s.n - 1)) for q in (0.5 + level / 2, 0.5 - level / 2))
    return spark.createDataFrame([("mean", s.m, s.m - half, s.m + half), ("std", s.s, low, high)], "statistic string, estimate double, low double, high double")


def normality(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """(test, statistic, p_value, normal): K-squared of D'Agostino, Kolmogorov-Smirnov (asymptotic) and Anderson-Darling (5 % critical value)."""
    v = _clean(df, value)
    s = v.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.stddev_samp("v").alias("s1"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")).first()
    n, rows = s.n, []
    if n >= 20 and s.sd:
        y = s.g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + sqrt(2 * (b2 - 1))
        from math import asinh, exp, log

        z1 = asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * log(w2))
        mean = 3.0 * (n - 1) / (n + 1)
        var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        x = (s.g2 + 3 - mean) / sqrt(var)
        b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6.0 + 8.0 / b1 * (2.0 / b1 + sqrt(1 + 4.0 / b1**2))
        t = (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))
        z2 = ((1 - 2 / (9 * a)) - (abs(t) ** (1 / 3) * (1 if t > 0 else -1))) / sqrt(2 / (9 * a))
        k2 = z1 * z1 + z2 * z2
        rows.append(("dagostino", k2, exp(-k2 / 2)))
    if n >= 8 and s.sd:
        ranked = numbered(v, ["v"], "i")
        z, z1s = (F.col("v") - s.m) / s.sd, (F.col("v") - s.m) / s.s1
        p = normal_cdf(z)
        q = F.greatest(F.least(normal_cdf(z1s), F.lit(1 - 1e-16)), F.lit(1e-300))
        d = ranked.agg(F.max(F.greatest(F.col("i") / n - p, p - (F.col("i") - 1) / n)).alias("d"), F.sum((2 * F.col("i") - 1) * F.log(q) + (2 * n + 1 - 2 * F.col("i")) * F.log(1 - q)).alias("a")).first()
        from math import exp

        lam = (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d.d
        ks = 1.0 if lam < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * lam * lam) for k in range(1, 101))))
        rows.append(("kolmogorov-smirnov", d.d, ks))
        ad = -n - d.a / n
        critical = 0.787 / (1 + 4 / n - 25 / n**2)
        rows.append(("anderson-darling", ad, 1.0 if ad < critical else 0.0))
    return df.sparkSession.createDataFrame([(*r, bool(r[2] > alpha)) for r in rows], "test string, statistic double, p_value double, normal boolean")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal bins over the range, empty ones included; the last is closed."""
    v = _clean(df, value)
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = v.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("long"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    v = _clean(df, value)
    q = df.sparkSession.createDataFrame([tuple(order_quantiles(v, "v", (0.25, 0.5, 0.75)))], "q1 double, median double, q3 double")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    return v.crossJoin(F.broadcast(q)).groupBy("q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def error_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row of errors of predictions: absolute, squared, relative, and agreement measures."""
    v = df.select(F.col(actual).cast("double").alias("a"), F.col(predicted).cast("double").alias("p")).where("a is not null and p is not null").withColumn("e", F.col("p") - F.col("a"))
    m = F.broadcast(v.agg(F.avg("a").alias("am"), F.avg("p").alias("pm"), F.stddev_pop("a").alias("asd"), F.stddev_pop("p").alias("psd"), F.corr("a", "p").alias("r")))
    e, a, p, am = F.col("e"), F.col("a"), F.col("p"), F.col("am")
    sse, sst = F.sum(e * e), F.sum((a - am) * (a - am))
    sae, sat = F.sum(F.abs(e)), F.sum(F.abs(a - am))
    wide = F.abs(p - am) + F.abs(a - am)
    r, alpha, beta = F.max("r"), F.try_divide(F.max("psd"), F.max("asd")), F.try_divide(F.max("pm"), F.max("am"))
    rmse = F.sqrt(F.avg(e * e))
    return v.crossJoin(m).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        rmse.alias("rmse"),
        F.avg(e).alias("bias"),
        (100 * F.avg(F.when(F.abs(a) > 1e-10, F.abs(e / a)))).alias("mape"),
        F.try_divide(rmse, F.abs(F.avg(a))).alias("nrmse"),
        F.try_divide(rmse, F.max(a) - F.min(a)).alias("rnrmse"),
        (100 * F.try_divide(F.sum(e), F.sum(a))).alias("pbias"),
        F.min(e).alias("min_error"),
        F.max(e).alias("max_error"),
        F.stddev_samp(e).alias("std_error"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        (1 - F.try_divide(sae, sat)).alias("modified_nse"),
        (1 - F.try_divide(sse, F.sum(wide * wide))).alias("willmott"),
        (1 - F.try_divide(sae, F.sum(wide))).alias("willmott_1"),
        (1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))).alias("kge"),
        (1 - F.try_divide(sae, F.sum(a))).alias("volumetric_efficiency"),
    )


def error_distribution(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Centre, spread and tails of the errors, with shares within half, one and two root mean squares."""
    e = df.select((F.col(predicted) - F.col(actual)).alias("e")).where("e is not null")
    e = settled(e)
    q1, median, q3 = order_quantiles(e, "e", (0.25, 0.5, 0.75))
    size = F.broadcast(e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("r")))
    within = lambda k: F.avg((F.abs("e") <= k * F.col("r")).cast("double"))
    return e.crossJoin(size).agg(
        F.avg("e").alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_samp("e").alias("std"), F.skewness("e").alias("skewness"), F.kurtosis("e").alias("kurtosis"),
        (F.lit(q3).cast("double") - F.lit(q1).cast("double")).alias("iqr"), within(0.5).alias("within_half"), within(1.0).alias("within_one"), within(2.0).alias("within_two"), F.count_if(F.abs("e") > 3 * F.col("r")).alias("beyond_three"),
    )


def quality_class(metrics: DataFrame) -> DataFrame:
    """Score of a metrics row: mean of R2, scaled efficiency, Willmott's d and 1-MAPE, and its class."""
    r2 = F.greatest(F.lit(0.0), F.col("r2"))
    parts = (r2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("r2") + 1) / 2)), F.greatest(F.lit(0.0), F.col("willmott")), F.greatest(F.lit(0.0), 1 - F.col("mape") / 100))
    score = sum(parts[1:], parts[0]) / 4
    label = F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "fair").when(score >= 0.6, "poor").otherwise("bad")
    return metrics.select(score.alias("score"), label.alias("label"))
