"""Data quality of a table: completeness, consistency, accuracy, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(df: DataFrame, structs) -> DataFrame:
    return df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def completeness(df: DataFrame) -> DataFrame:
    """(column, n_null, share, critical) of every column in one pass; more than 5 % missing is critical."""
    n = F.count("*")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()), n), F.lit(0.0))
    return _rows(df, [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), share(c).alias("share"), (share(c) > 0.05).alias("critical")) for c in df.columns])


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, different rows and the share of repeats."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("c"))
    s = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    return s.withColumn("duplicate_rate", F.coalesce(F.try_divide(F.col("n") - F.col("n_distinct"), F.col("n")), F.lit(0.0)))


def contradictions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one different value: least below greatest tells, without a set per key."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).where("low < high")


def ranges(df: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n_out, compliance) against closed intervals."""
    out = lambda c, lo, hi: F.count_if((F.col(c) < lo) | (F.col(c) > hi))
    return _rows(df, [F.struct(F.lit(c).alias("column"), out(c, lo, hi).alias("n_out"), (1 - F.coalesce(F.try_divide(out(c, lo, hi), F.count(c)), F.lit(0.0))).alias("compliance")) for c, (lo, hi) in expected.items()])


def business_rules(df: DataFrame) -> DataFrame:
    """(rule, column, n): heights outside -500..9000 and negative amounts, by the columns' names."""
    rules = []
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            name = f.name.lower()
            if any(w in name for w in ("elev", "height", "alt")):
                rules.append(("height", f.name, (F.col(f.name) < -500) | (F.col(f.name) > 9000)))
            if any(w in name for w in ("concentration", "content", "grade", "ppm", "percent")):
                rules.append(("negative", f.name, F.col(f.name) < 0))
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, n long")
    return _rows(df, [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.count_if(bad).alias("n")) for r, c, bad in rules])


def temporal(df: DataFrame, column: str, now: str) -> DataFrame:
    """First and last time, days between, and times after now or before 1900."""
    t = F.col(column)
    return df.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.datediff(F.max(t), F.min(t)).cast("long").alias("days"), F.count_if(t > F.lit(now).cast("timestamp")).alias("n_future"), F.count_if(F.year(t) < 1900).alias("n_ancient"))


def text_formats(df: DataFrame, column: str) -> DataFrame:
    """Length and its variation, and shares of texts with digits, letters, other signs, and by case."""
    c = F.col(column)
    share = lambda test: F.avg(test.cast("double"))
    return df.where(c.isNotNull()).agg(
        F.avg(F.char_length(c)).alias("mean_length"), F.try_divide(F.stddev_samp(F.char_length(c)), F.avg(F.char_length(c))).alias("length_cv"), share(c.rlike("[0-9]")).alias("digits"), share(c.rlike("[A-Za-z]")).alias("letters"),
        share(c.rlike("[^A-Za-z0-9 \\t\\n\\r]")).alias("others"), share((c == F.upper(c)) & c.rlike("[A-Za-z]")).alias("upper"), share((c == F.lower(c)) & c.rlike("[A-Za-z]")).alias("lower"),
    )


def suggested_types(df: DataFrame) -> DataFrame:
    """(column, suggestion): floats without fractions could be integers, texts with few different values categories."""
    tests = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            tests.append(F.struct(F.lit(f.name).alias("column"), F.when((F.count_if(c != F.floor(c)) == 0) & (F.count(c) > 0), "integer").alias("suggestion")))
        elif isinstance(f.dataType, T.StringType):
            tests.append(F.struct(F.lit(f.name).alias("column"), F.when(F.approx_count_distinct(c) < 0.5 * F.count(c), "category").alias("suggestion")))
    if not tests:
        return df.sparkSession.createDataFrame([], "column string, suggestion string")
    return _rows(df, tests).where("suggestion is not null")


def column_info(df: DataFrame) -> DataFrame:
    """(column, type, non_null, n_null, min, max, mean, std), numbers only for numeric columns."""
    out = []
    for f in df.schema:
        num = isinstance(f.dataType, T.NumericType)
        c = F.col(f.name)
        value = lambda e: e.cast("double") if num else F.lit(None).cast("double")  # noqa: B023, E731
        out.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(c).alias("non_null"), F.count_if(c.isNull()).alias("n_null"), value(F.min(c)).alias("min"), value(F.max(c)).alias("max"), value(F.avg(c) if num else F.min(c)).alias("mean"), value(F.stddev_samp(c) if num else F.min(c)).alias("std")))
    return _rows(df, out)


def score(completeness_share: float, duplicate_rate: float, outlier_share: float) -> tuple[float, str]:
    """100 less twice the missing, one and a half times the repeated and half the outlying percent; level by 90, 75, 60 and 40."""
    s = max(0.0, 100 - 2 * (100 - 100 * completeness_share) - 150 * duplicate_rate - 50 * outlier_share)
    return s, next(name for limit, name in ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"), (-1, "unusable")) if s >= limit)
