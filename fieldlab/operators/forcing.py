"""Idealised forcing: vertical and horizontal profiles and their product."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions.scalar import DAY, level_of
from fieldlab.operators.regrid import interpolate

# The 20 sigma levels of the model (single precision) and the 20 pressure levels in hPa.
SIGMA = [0.99500, 0.97999, 0.94995, 0.89988, 0.82977, 0.74468, 0.64954, 0.54946, 0.45447, 0.36948, 0.29450, 0.22953, 0.17457, 0.12440, 0.0846830, 0.0598005, 0.0449337, 0.0349146, 0.0248800, 0.00829901]
PRESSURE = [1000, 950, 900, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30, 20, 10, 7, 5]
N_LON, N_LAT = 128, 64
VARIABLES = ("v", "d", "t", "p")


def gauss_latitudes(n: int = N_LAT) -> list[float]:
    """Degrees, north first: the nodes of Gauss-Legendre quadrature."""
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0]))[::-1].tolist()


def vertical_value(sigma: Column, kind: int, amp: float = 8.0, decay: float = 20.0, centre: float = 0.45) -> Column:
    """1: half a sine; 2: a bell about a centre; 3: constant."""
    if kind not in (1, 2, 3):
        raise ValueError("kind of vertical profile is 1, 2 or 3")
    return {1: amp * F.sin(math.pi * sigma), 2: amp * F.exp(-decay * (sigma - centre) * (sigma - centre)), 3: F.lit(amp) + 0 * sigma}[kind]


def horizontal_value(lon: Column, lat: Column, kind: int, amp: float = 0.25, rx: float = 23.0, ry: float = 6.5, centre: tuple[float, float] = (77.0, -1.5), wrap: bool = False) -> Column:
    """1: a cone over an ellipse; 2: a box; 0 outside. wrap takes the shorter way around."""
    if kind not in (1, 2):
        raise ValueError("kind of horizontal profile is 1 or 2")
    if not (-90 <= centre[1] <= 90 and rx > 0 and ry > 0):
        raise ValueError("centre or radii out of range")
    dx = F.pmod(lon - centre[0] + 180.0, F.lit(360.0)) - 180.0 if wrap else lon - centre[0]
    dy = lat - centre[1]
    if kind == 2:
        return F.when((F.abs(dx) <= rx) & (F.abs(dy) <= ry), amp).otherwise(0.0)
    d = dx * dx / (rx * rx) + dy * dy / (ry * ry)
    return F.when(d > 1, 0.0).otherwise(amp * (1 - F.sqrt(d)))


def levels(spark: SparkSession, sigma: list[float] = SIGMA) -> DataFrame:
    single = [float(x) for x in np.float32(sigma)]
    return spark.createDataFrame(list(enumerate(single, 1)), "lev int, sigma double").withColumn("level", level_of(F.col("sigma")))


def model_grid(spark: SparkSession, n_lon: int = N_LON, n_lat: int = N_LAT) -> DataFrame:
    lats = spark.createDataFrame([(x,) for x in gauss_latitudes(n_lat)], "lat double")
    return lats.crossJoin(spark.range(n_lon).select((F.col("id") * (360.0 / n_lon)).alias("lon")))


def forcing(horizontal: DataFrame, vertical: DataFrame, switches: dict[str, float]) -> DataFrame:
    """(lev, lat, lon, v, d, t, p): the product by a day, times each variable's switch; 0 where it's off."""
    if not set(switches) <= set(VARIABLES) | {"q"}:
        raise ValueError("unknown variable")
    rows = horizontal.crossJoin(F.broadcast(vertical))
    shape = F.col("hor") * F.col("ver") / DAY
    return rows.select("lev", "lat", "lon", *[(shape * float(switches.get(v, 0.0))).cast("float").alias(v) for v in (*VARIABLES, *(["q"] if "q" in switches else []))])


def on_axes(df: DataFrame, keys: list[str], axes: dict[str, DataFrame], switches: dict[str, float] | None = None) -> DataFrame:
    """(keys, axes..., v, d, t, p): forcing interpolated linearly to other axes (sigma or pressure labels, latitudes,
    longitudes), 0 outside them; variables that df hasn't, or that are switched off, are 0 everywhere."""
    on = [v for v in VARIABLES if v in df.columns and (switches or {}).get(v, 1.0)]
    every = None
    for label in axes.values():
        every = label.distinct() if every is None else every.crossJoin(label.distinct())
    out = df.select(*keys).distinct().crossJoin(every) if keys else every
    for v in on:
        out = out.join(interpolate(df, keys, v, axes, missing=0.0), [*keys, *axes])
    return out.select(*keys, *axes, *[F.col(v) if v in on else F.lit(0.0).alias(v) for v in VARIABLES])


def vertical_structure(df: DataFrame, value: str, lev: str = "lev") -> DataFrame:
    """Mean over the horizontal of what isn't zero."""
    return df.groupBy(lev).agg(F.avg(F.nullif(F.col(value), F.lit(0.0))).alias(value))
