"""Loading rules: roles of columns, casts, null tokens, cleaning and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens read as missing, and substrings that name a coordinate.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "nan", "NaN", "-")
ROLE_PATTERNS = {"x": ("x", "east", "lon"), "y": ("y", "north", "lat"), "z": ("z", "elev", "depth", "height", "alt")}


def canonical(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column; infinities stay."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def number(column: str) -> Column:
    """Text as a number, null tokens and anything else null."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(text.isin(*NULL_TOKENS), None).otherwise(text.try_cast("double"))


def roles(columns: Sequence[str]) -> dict[str, str]:
    """First column whose lower-case name holds a pattern of x, y or z; each column takes one role."""
    out: dict[str, str] = {}
    for c in columns:
        for role, patterns in ROLE_PATTERNS.items():
            if any(p in c.lower() for p in patterns):
                out.setdefault(role, c)
                break
    return out


def value_columns(df: DataFrame) -> list[str]:
    taken = set(roles(df.columns).values())
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in taken]


def training_points(df: DataFrame, x: str, y: str, value: str, z: str | None = None, id_: str = "id", min_points: int = 1) -> DataFrame:
    """Numeric complete rows, the first (smallest id) of each place. Fewer than max(3, min_points) complete rows raise ValueError."""
    wanted = {"x": x, "y": y, **({"z": z} if z else {}), "value": value}
    rows = df.select(F.col(id_).alias("id"), *(number(c).alias(k) for k, c in wanted.items()))
    rows = rows.where(" and ".join(f"{k} is not null and not isnan({k})" for k in wanted))
    n = rows.limit(max(3, min_points)).count()
    if n < max(3, min_points):
        raise ValueError(f"{n} complete rows; at least {max(3, min_points)} are needed")
    return first_per_place(rows, ["x", "y", *(["z"] if z else [])])


def first_per_place(df: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """One row for each place, that with the smallest id; map-side combined, no window."""
    rest = [c for c in df.columns if c not in axes]
    picked = df.groupBy(*axes).agg(F.min(F.struct("id", *(c for c in rest if c != "id"))).alias("_first"))
    return picked.select(*(F.col(c) if c in axes else F.col(f"_first.{c}").alias(c) for c in df.columns))


def load_settings(df: DataFrame, x: str, y: str, values: Sequence[str], order: str, drop_missing: bool = True, drop_duplicates: bool = True, fill: bool = False) -> DataFrame:
    """Project and rename to X, Y and the values; then optional rules in this order."""
    out = df.select(F.col(order), F.col(x).alias("X"), F.col(y).alias("Y"), *values)
    if drop_missing:
        out = out.dropna(subset=["X", "Y"])
    if drop_duplicates:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("X", "Y").orderBy(order))).where("_n = 1").drop("_n")
    if fill:
        window = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in ("X", "Y", *values)})
    return out


def coordinate_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each coordinate: missing, infinite, count, extremes, mean and deviation."""
    parts = [
        df.agg(
            F.lit(c).alias("column"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.count_if(F.abs(F.col(c)) == float("inf")).alias("n_inf"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
        )
        for c in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumn("range", F.col("max") - F.col("min"))


def validate(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(level, rule, n) of the rules that fail: structure, types, missing and infinite coordinates, duplicates, few rows."""
    missing = [c for c in (x, y, value) if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([("error", f"column {c} is missing", 0) for c in missing], "level string, rule string, n long")
    bad = lambda c: F.count_if(F.col(c).isNotNull() & number(c).isNull() & ~F.trim(F.col(c).cast("string")).isin(*NULL_TOKENS))
    s = df.agg(
        F.count("*").alias("n"),
        *(F.count_if(number(c).isNull()).alias(f"null_{i}") for i, c in enumerate((x, y, value))),
        *(bad(c).alias(f"bad_{i}") for i, c in enumerate((x, y, value))),
        *(F.count_if(F.abs(number(c)) == float("inf")).alias(f"inf_{i}") for i, c in enumerate((x, y, value))),
        (F.count("*") - F.count_distinct(F.struct(x, y))).alias("dup"),
    )
    n = F.col("n")
    rules = [("error", "too few rows", F.when(n < 3, n)), ("warning", "few rows", F.when((n >= 3) & (n < 10), n)), ("warning", "duplicate places", F.when(F.col("dup") > 0, F.col("dup")))]
    for i, (c, limit) in enumerate(((x, 0.1), (y, 0.1), (value, 0.2))):
        rules += [
            ("error", f"{c}: not numeric", F.when(F.col(f"bad_{i}") > 0, F.col(f"bad_{i}"))),
            ("error", f"{c}: infinite", F.when(F.col(f"inf_{i}") > 0, F.col(f"inf_{i}"))),
            ("error", f"{c}: too many missing", F.when(F.col(f"null_{i}") > limit * n, F.col(f"null_{i}"))),
            ("warning", f"{c}: missing", F.when((F.col(f"null_{i}") > 0) & (F.col(f"null_{i}") <= limit * n), F.col(f"null_{i}"))),
        ]
    listed = F.array(*(F.struct(F.lit(a).alias("level"), F.lit(b).alias("rule"), c.cast("long").alias("n")) for a, b, c in rules))
    return s.select(F.explode(listed).alias("r")).select("r.*").where("n is not null")
