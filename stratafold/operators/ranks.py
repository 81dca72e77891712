"""Ordered operators without a one-partition window.

Rows are dealt by range, numbered within each partition, and lifted by the sizes of
the partitions before, of which there are only as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.session import settled


def numbered(df: DataFrame, order: Sequence[str], name: str = "row", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 1 on in the given order, which has to be total for a defined result."""
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    placed = settled(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of the value over all rows up to each one, by partition totals in front of partition-wise sums."""
    dealt = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sizes = dealt.groupBy("_part").agg(F.sum(value).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1 on, ties sharing their mean rank; nulls have none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    total = running_total(counts, [column], "_c", "_cum")
    return df.join(total.select(column, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(name)), column, "left")


def average_ranks_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_column, _value, _rank): mean ranks of the different values of several columns, all by one range sort of their counts."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")
    counts = df.select(stacked).where("s.v is not null").groupBy(F.col("s.c").alias("_column"), F.col("s.v").alias("_value")).agg(F.count("*").alias("_c"))
    total = settled(running_total(counts, ["_column", "_value"], "_c", "_cum"))
    first = F.broadcast(total.groupBy("_column").agg(F.min(F.col("_cum") - F.col("_c")).alias("_first")))
    return total.join(first, "_column").select("_column", "_value", (F.col("_cum") - F.col("_first") - (F.col("_c") - 1) / 2).alias("_rank"))


def forward_fill(df: DataFrame, columns: Sequence[str], order: str, by: Sequence[str] = ()) -> DataFrame:
    """Nulls take the last value before them in the order."""
    window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})


def running(df: DataFrame, value: str, by: Sequence[str], order: str) -> DataFrame:
    """Mean and sample deviation of all rows so far, per group."""
    window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"running_mean": F.avg(value).over(window), "running_std": F.stddev_samp(value).over(window)})


def quantile_strata(df: DataFrame, value: str, n: int) -> Column:
    """Stratum 0..n-1 of each value by the inner quantile bounds."""
    out = F.lit(0)
    for b in order_quantiles(df, value, [i / n for i in range(1, n)]):
        out = out + (F.col(value) >= b).cast("int")
    return out


#: Accuracy of the sketch that brackets an order statistic before it is found exactly.
SKETCH = 10_000


def order_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, without a buffer of all values.

    A sketch brackets each one; only values within brackets are counted, sorted by range and numbered, from the exact
    number of values below the bracket on. Should a bracket miss its place, all values are numbered.
    """
    v = df.select(F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    near = [min(max(p + e, 0.0), 1.0) for p in probabilities for e in (-2 / SKETCH, 2 / SKETCH)]
    n, sketch = v.agg(F.count("*"), F.percentile_approx("_v", near, SKETCH)).first()
    if not n:
        return [None] * len(probabilities)
    brackets = [(float("-inf") if near[2 * i] <= 0 else sketch[2 * i], float("inf") if near[2 * i + 1] >= 1 else sketch[2 * i + 1]) for i in range(len(probabilities))]
    out = _selected(v, n, probabilities, brackets)
    return out or _selected(v, n, probabilities, [(float("-inf"), float("inf"))] * len(probabilities))


def _selected(v: DataFrame, n: int, probabilities: Sequence[float], brackets: list[tuple[float, float]]) -> list[float] | None:
    """The quantiles if each one's places lie within its bracket."""
    at = F.col("_v")
    inside = F.lit(False)
    for lo, hi in set(brackets):
        inside = inside | at.between(lo, hi)
    below = v.agg(*(F.count_if(at < lo) for lo, _ in brackets)).first()
    total = running_total(v.where(inside).groupBy("_v").agg(F.count("*").alias("_c")), ["_v"], "_c", "_cum")
    gaps = total.agg(*(F.coalesce(F.sum(F.when(at < lo, F.col("_c"))), F.lit(0)) for lo, _ in brackets)).first()
    wanted = []
    for p, under, less in zip(probabilities, below, gaps):
        k = int((n - 1) * p)
        wanted += [(k, under, less), (min(k + 1, n - 1), under, less)]
    # a value's place among all is its place among the bracketed ones, less those below its bracket, plus all below it
    picks = [F.min(F.when(F.col("_cum") - less + under > k, F.struct(at, F.col("_cum") - F.col("_c") - less + under))) for k, under, less in wanted]
    found = total.agg(*(c.alias(str(i)) for i, c in enumerate(picks))).first()
    values = []
    for (k, under, _), (lo, hi), r in zip(wanted, [b for b in brackets for _ in range(2)], found):
        if r is None or r[1] > k or not lo <= r[0] <= hi or k < under:
            return None
        values.append(r[0])
    return [values[2 * i] + ((n - 1) * p - int((n - 1) * p)) * (values[2 * i + 1] - values[2 * i]) for i, p in enumerate(probabilities)]
