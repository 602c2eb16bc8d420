"""Indices and diagnostics of climate fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.scalar import evaporation_energy, flux, three_way
from fieldlab.operators import joins, reduce, select, window


def winter_index(df: DataFrame, time: str, value: str) -> DataFrame:
    """(year, index): mean of December of the year before, January and February, one value each; full winters only."""
    rows = select.months(df, time, [12, 1, 2]).withColumn("year", joins.season_year(F.col(time)))
    return rows.groupBy("year").agg((F.sum(value) / 3).alias("index"), F.count(value).alias("n")).where("n = 3").drop("n")


def winter_class(index: Column) -> Column:
    return three_way(index, 0.5)


def anomaly_index(df: DataFrame, time: str, value: str, wanted: list[int], base: tuple[int, int]) -> DataFrame:
    """(year, raw, anomaly, residual, sigma, z): area mean, yearly mean of months, minus base mean, detrended, with base spread.

    The order matters: the area mean comes before the yearly mean, the trend is that of all years.
    """
    daily = reduce.area_mean(select.months(df, time, wanted), [time], [value])
    yearly = daily.groupBy(F.year(time).alias("year")).agg(F.avg(value).alias("raw"))
    clim = yearly.where(F.col("year").between(*base)).agg(F.avg("raw").alias("_clim"))
    yearly = joins.with_scalars(yearly, clim).withColumn("anomaly", F.col("raw") - F.col("_clim")).drop("_clim")
    yearly = window.detrended(yearly, [], "year", "anomaly")
    sigma = yearly.where(F.col("year").between(*base)).agg(F.stddev_pop("residual").alias("sigma"))
    return joins.with_scalars(yearly, sigma).withColumn("z", F.try_divide("residual", "sigma"))


def plot_offset(df: DataFrame, value: str, share: float = 0.03, least: float = 0.05) -> DataFrame:
    """One row: a share of the range of values, or `least` if there is none."""
    x = share * (F.max(value) - F.min(value))
    return df.agg(F.when(x == 0, least).otherwise(x).alias("offset"))


def net_radiation(short: Column, long: Column) -> Column:
    return short + long


def sensible_heat(short: Column, long: Column, evaporation: Column) -> Column:
    """Net radiation plus the energy of evaporation."""
    return short + long + evaporation_energy(evaporation)


def coupling_index(df: DataFrame, index: DataFrame, by: list[str], h: str = "h", hp: str = "hp", t: str = "t", year: str = "year") -> DataFrame:
    """pi = (h' - hp') t' for each cell, x' the slope of x on the standardised index by the spread of x."""
    k = window.standardised(index.select(year, "k"), [], "k", "z").select(year, "z")
    rows = df.join(k, year)
    part = lambda x: F.try_divide(reduce.slope(x, "z"), F.stddev_pop(x))
    out = rows.groupBy(*by).agg(part(h).alias("h1"), part(hp).alias("hp1"), part(t).alias("t1"))
    return out.withColumn("pi", (F.col("h1") - F.col("hp1")) * F.col("t1"))


def energy_budget(df: DataFrame, index: DataFrame, mask: DataFrame, fluxes: list[str], year: str = "year") -> DataFrame:
    """One row: mean slopes of accumulated fluxes on an index over the cells of a mask, in W/m2, and net radiation."""
    rows = df.join(index.select(year, "k"), year).join(mask.select("lat", "lon"), ["lat", "lon"], "left_semi")
    slopes = rows.groupBy("lat", "lon").agg(*[flux(reduce.slope(x, "k")).alias(x) for x in fluxes])
    out = slopes.agg(*[F.avg(x).alias(x) for x in fluxes])
    return out.withColumn("net", F.col(fluxes[0]) + F.col(fluxes[1]))


def extreme_events(df: DataFrame, value: str, q: float = 0.8, share: float = 0.2, year: str = "year", day: str = "dos", threshold: DataFrame | None = None) -> DataFrame:
    """The days on which a share of the cells exceeds the quantile of all values, with that fraction and the key year * 100 + day.

    The key tells days apart only where they are below 100, as in a summer; others are told by year and day.
    """
    threshold = threshold or reduce.quantile(df, value, q)
    cells = select.present(df, value).select("lat", "lon").distinct().agg(F.count("*").alias("n"))
    flags = joins.with_scalars(df, threshold).withColumn("flag", F.when(F.col(value).isNotNull(), (F.col(value) > F.col("q")).cast("int")))
    daily = reduce.area_fraction(flags, [year, day], "flag", cells)
    return daily.where(F.col("fraction") >= share).withColumn("key", F.col(year) * 100 + F.col(day))


def event_samples(df: DataFrame, events: DataFrame, value: str, threshold: DataFrame, year: str = "year", day: str = "dos") -> DataFrame:
    """Flags of all cells on event days, cells without any value left out: the rows that are clustered."""
    rows = df.join(events.select(year, day, "key"), [year, day])
    rows = joins.with_scalars(rows, threshold).withColumn("flag", F.when(F.col(value).isNotNull(), (F.col(value) > F.col("q")).cast("double")))
    return select.drop_empty(rows, ["lat", "lon"], "flag").select(year, day, "key", "lat", "lon", "flag")
