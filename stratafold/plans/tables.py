"""The relations that the registered queries run on, derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.operators.clean import first_per_place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice points with many shared places."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("value"), F.col("p_brand").alias("domain"))


def place_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each place."""
    return first_per_place(part_points(spark, sf_dir))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in general position."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("value"), "label")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stretches of a hole: quantities laid end to end."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("l_quantity").over(order)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), (end - F.col("l_quantity")).alias("from"), end.alias("to"), "l_discount", "l_tax")


# The same relations for the SQL side.
SQL = {
    "pt": "pt AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS value, p_brand AS domain FROM part)",
    "up": "up AS (SELECT id, x, y, value, domain FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY id) AS rn FROM pt) WHERE rn = 1)",
    "em": "em AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS value, label FROM embeddings)",
    "iv": 'iv AS (SELECT l_orderkey AS hole, e - l_quantity AS "from", e AS "to", l_discount, l_tax FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem))',
}


def with_(*names: str) -> str:
    """WITH clause of the named relations."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, for comparison; negative zero becomes zero."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
