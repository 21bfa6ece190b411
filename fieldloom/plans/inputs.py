"""The driver's tables, with the integer geometry that queries derive from their keys. The same formulas stand in SQL below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Grid
from ..operators.spatial import Boxes, points

GRID = Grid(64, 64, 0.0, 64.0, 1.0, 1.0)

#: The derived tables as common table expressions.
SQL = {
    "cust": "cust AS (SELECT *, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1000 AS DOUBLE) AS y FROM customer)",
    "supp": "supp AS (SELECT *, CAST((s_suppkey * 6151) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 3571) % 1000 AS DOUBLE) AS y FROM supplier)",
    "zone": "zone AS (SELECT n_nationkey, 200.0::DOUBLE * (n_nationkey % 5) AS xmin, 200.0::DOUBLE * (n_nationkey // 5) AS ymin, 200.0::DOUBLE * (n_nationkey % 5) + 200 AS xmax, 200.0::DOUBLE * (n_nationkey // 5) + 200 AS ymax, 100.0::DOUBLE + n_nationkey AS total FROM nation)",
    "box": "box AS (SELECT *, CAST((p_partkey * 37) % 980 AS DOUBLE) AS xmin, CAST((p_partkey * 53) % 980 AS DOUBLE) AS ymin, CAST((p_partkey * 37) % 980 + 1 + p_size % 20 AS DOUBLE) AS xmax, CAST((p_partkey * 53) % 980 + 1 + p_partkey % 20 AS DOUBLE) AS ymax FROM part)",
    "inner": "inner_ AS (SELECT n_nationkey, 10.0::DOUBLE + 200 * (n_nationkey % 5) AS xmin, 10.0::DOUBLE + 200 * (n_nationkey // 5) AS ymin, 150.0::DOUBLE + 200 * (n_nationkey % 5) AS xmax, 110.0::DOUBLE + 200 * (n_nationkey // 5) AS ymax FROM nation)",
    "cell": "cell AS (SELECT CAST(l_orderkey % 64 AS INTEGER) AS \"row\", CAST(l_partkey % 64 AS INTEGER) AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)",
    "edge": "edge AS (SELECT c_custkey AS id, c_nationkey AS u, CAST(c_custkey % 25 AS INTEGER) AS v, CAST(1 + c_custkey % 97 AS DOUBLE) AS cost, c_acctbal >= 0 AS known FROM customer)",
}


def sql(body: str, *names: str) -> str:
    return f"WITH {', '.join(SQL[n] for n in names)} {body}" if names else body


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(c, factor: int, base: int):
    return ((F.col(c) * factor) % base).cast("double")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").withColumns({"x": _number("c_custkey", 7919, 1000), "y": _number("c_custkey", 104729, 1000)})


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").withColumns({"x": _number("s_suppkey", 6151, 1000), "y": _number("s_suppkey", 3571, 1000)})


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = (n % 5 * 200).cast("double"), (F.floor(n / 5) * 200).cast("double")
    return load(spark, sf_dir, "nation").select("n_nationkey", x.alias("xmin"), y.alias("ymin"), (x + 200).alias("xmax"), (y + 200).alias("ymax"), (n + 100).cast("double").alias("total"))


def inner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 140 by 100 in each zone."""
    x, y = F.col("xmin"), F.col("ymin")
    return zones(spark, sf_dir).select("n_nationkey", (x + 10).alias("xmin"), (y + 10).alias("ymin"), (x + 150).alias("xmax"), (y + 110).alias("ymax"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("p_partkey") * 37) % 980, (F.col("p_partkey") * 53) % 980
    return load(spark, sf_dir, "part").withColumns({"xmin": x.cast("double"), "ymin": y.cast("double"), "xmax": (x + 1 + F.col("p_size") % 20).cast("double"), "ymax": (y + 1 + F.col("p_partkey") % 20).cast("double")})


def cells(spark: SparkSession, sf_dir: str, where: str = "true", value: str = "cast(l_quantity as bigint)") -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem").where(where).groupBy((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"))
        .agg(F.sum(F.expr(value)).cast("double").alias("value"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("u"), (F.col("c_custkey") % 25).cast("int").alias("v"), (F.col("c_custkey") % 97 + 1).cast("double").alias("cost"), (F.col("c_acctbal") >= 0).alias("known"))


def customer_points(spark: SparkSession, sf_dir: str) -> Boxes:
    return points(customers(spark, sf_dir), "c_custkey")


def supplier_points(spark: SparkSession, sf_dir: str) -> Boxes:
    return points(suppliers(spark, sf_dir), "s_suppkey")


def zone_boxes(spark: SparkSession, sf_dir: str) -> Boxes:
    return Boxes(zones(spark, sf_dir), "n_nationkey")


def parts(spark: SparkSession, sf_dir: str) -> Boxes:
    return Boxes(part_boxes(spark, sf_dir), "p_partkey")
