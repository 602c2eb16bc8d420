"""Cubes over the star-schema tables, in Spark and as SQL. Means are quotients of whole cents, so both engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The SQL of the cubes, to be used behind WITH.
SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS time, 10.0::DOUBLE * (n_regionkey + 1) AS lat, 15.0::DOUBLE * (n_nationkey // 5) AS lon,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
GRID = """grid AS (
  SELECT CAST(l_linenumber AS INT) AS i, CAST(l_quantity AS INT) AS j, 10.0::DOUBLE * CAST(l_linenumber AS INT) AS lat, 5.0::DOUBLE * CAST(l_quantity AS INT) AS lon,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS f,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS g FROM lineitem GROUP BY 1, 2)"""
DAILY = """daily AS (
  SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS x FROM lineitem GROUP BY 1)"""
MONTHLY = f"""{SALES}, monthly AS (
  SELECT CAST(date_trunc('month', time) AS DATE) AS time, lat, lon, avg(x) AS x FROM sales GROUP BY 1, 2, 3)"""
YEARLY = f"""{SALES}, yearly AS (
  SELECT CAST(year(time) AS INT) AS year, lat, lon, avg(x) AS x FROM sales WHERE month(time) IN (6, 7, 8) GROUP BY 1, 2, 3)"""
CUBE = """cube AS (
  SELECT CAST(l_linenumber AS INT) AS lev, 10.0::DOUBLE * (1 + CAST(l_quantity AS INT) % 5) AS lat, 15.0::DOUBLE * (CAST(l_quantity AS INT) // 5 % 8) AS lon, CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 / 100 AS t,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS u, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"""



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / F.count("*")


def sales_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, lat, lon, x): mean order price by day, region and block of nations; many cells are missing."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("time"), "o_totalprice")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("time", (F.lit(10.0) * (F.col("n_regionkey") + 1)).alias("lat"), (F.lit(15.0) * F.expr("n_nationkey DIV 5")).alias("lon")).agg((cents("o_totalprice") / 100).alias("x"))


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, lat, lon, f, g): a dense 7 x 50 field of mean price and mean discount."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("i"), F.col("l_quantity").cast("int").alias("j")).agg((cents("l_extendedprice") / 100).alias("f"), (cents("l_discount") / 100).alias("g"))
    return rows.select("i", "j", (F.lit(10.0) * F.col("i")).alias("lat"), (F.lit(5.0) * F.col("j")).alias("lon"), "f", "g")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, x): mean price by shipping day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg((cents("l_extendedprice") / 100).alias("x"))


def monthly_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_cube(spark, sf_dir).groupBy(F.trunc("time", "month").alias("time"), "lat", "lon").agg(F.avg("x").alias("x"))


def yearly_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summer means by year."""
    from fieldlab.operators import reduce, select

    return reduce.yearly_mean(select.months(sales_cube(spark, sf_dir), "time", [6, 7, 8]), "time", ["lat", "lon"], ["x"])


def level_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, lev, lat, lon, t, u, v): all months of a field with levels."""
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    keys = [F.col("l_linenumber").cast("int").alias("lev"), (F.lit(10.0) * (1 + q % 5)).alias("lat"), (F.lit(15.0) * (F.floor(q / 5) % 8)).alias("lon"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("time")]
    return rows.groupBy(*keys).agg((cents("l_extendedprice") / 100 / 100).alias("t"), cents("l_discount").alias("u"), cents("l_tax").alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, features): vectors to cluster."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
