"""Joins of cubes by label, and the explicit form of joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.operators.select import numbered

#: Rows of a table that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both with equal labels; arithmetic on them is label-aligned."""
    return a.join(b, on, "inner")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(scalars))


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], by: list[str] | None = None) -> DataFrame:
    """Join by position: the n-th row of each; a row without a partner stays, so that counts can be compared."""
    place = lambda df, order: df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else numbered(df, order)
    return place(a, order_a).join(place(b, order_b), [*(by or []), "_place"], "full_outer").drop("_place")


def season_year(time: Column, first: int = 12) -> Column:
    """Year of a season that begins in month `first` of the year before."""
    return F.year(time) + (F.month(time) >= first).cast("int")


def of_years(df: DataFrame, years: DataFrame, year: str = "year") -> DataFrame:
    return df.join(years.select(year).distinct(), year, "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: list[str], value: str, default) -> DataFrame:
    return df.join(table.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer product of two axes; the smaller one is sent if it's small enough."""
    small = b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return a.crossJoin(F.broadcast(b) if small else b)


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether both have the same distinct keys, and how many only one has."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    n = F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1))
    return left.join(right, key, "full_outer").agg(n.alias("unmatched"), (n == 0).alias("equal"))
