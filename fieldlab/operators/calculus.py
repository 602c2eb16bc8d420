"""Finite differences on the sphere, wave-activity flux and the temperature budget, all as window expressions.

Fields are long: keys, lat, lon and values. Along a latitude the axis is lon, along a meridian lat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.scalar import CP_DRY, EARTH_RADIUS, FLUX_RADIUS, MEAN_RADIUS, R_DRY, coriolis, month_seconds
from fieldlab.operators import select, window


def lat_radians() -> Column:
    return F.radians(F.col("lat"))


def dx(keys: list[str], radius: float = EARTH_RADIUS) -> Column:
    """Signed zonal distance of neighbours, in m."""
    return radius * F.cos(lat_radians()) * F.radians(window.index_gradient("lon", [*keys, "lat"], "lon"))


def dy(keys: list[str], radius: float = EARTH_RADIUS) -> Column:
    """Signed meridional distance of neighbours; negative if latitudes descend along the axis."""
    return radius * F.radians(window.index_gradient("lat", [*keys, "lon"], "lat"))


def along_lon(x: str | Column, keys: list[str]) -> Column:
    return window.index_gradient(x, [*keys, "lat"], "lon")


def along_lat(x: str | Column, keys: list[str]) -> Column:
    return window.index_gradient(x, [*keys, "lon"], "lat")


def gradient(df: DataFrame, keys: list[str], x: str, to: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    return df.withColumns({to[0]: F.try_divide(along_lon(x, keys), dx(keys)), to[1]: F.try_divide(along_lat(x, keys), dy(keys))})


def divergence(df: DataFrame, keys: list[str], u: str = "u", v: str = "v", to: str = "div") -> DataFrame:
    """With the metric term; NULL at the poles."""
    d = F.try_divide(along_lon(u, keys), dx(keys)) + F.try_divide(along_lat(v, keys), dy(keys)) - F.col(v) * F.tan(lat_radians()) / EARTH_RADIUS
    return df.withColumn(to, select.null_poles(F.col("lat"), d))


def vorticity(df: DataFrame, keys: list[str], u: str = "u", v: str = "v", to: str = "vor", metric_term: bool = False) -> DataFrame:
    """Without the metric term unless asked for."""
    z = F.try_divide(along_lon(v, keys), dx(keys)) - F.try_divide(along_lat(u, keys), dy(keys))
    return df.withColumn(to, z + F.col(u) * F.tan(lat_radians()) / EARTH_RADIUS if metric_term else z)


def vorticity_fixed_step(df: DataFrame, keys: list[str], u: str = "u", v: str = "v", to: str = "vor", step: float = 5.0) -> DataFrame:
    """Differences over two cells by the distance of one step of fixed degrees; interior only, latitudes north first."""
    d = EARTH_RADIUS * F.radians(F.lit(step))
    zonal = window.centred_difference(v, [*keys, "lat"], "lon") / (d * F.cos(lat_radians()))
    return df.withColumn(to, zonal - window.centred_difference(u, [*keys, "lon"], "lat") / d)


def qg_streamfunction(phi: Column, mean: Column, lat: Column) -> Column:
    """Geopotential anomaly by the Coriolis parameter; NULL at the equator."""
    return F.try_divide(phi - mean, coriolis(lat))


def wave_activity_flux(df: DataFrame, keys: list[str], pressure: float, u: str = "u", v: str = "v", psi: str = "psi", mode: int = 2) -> DataFrame:
    """Horizontal wave-activity flux fx, fy of a stream-function perturbation in a mean flow.

    Mode 2 uses index gradients and leaves out |lat| < 20 and the first and last row. Mode 1 uses coordinate
    gradients, another earth radius, and leaves out |lat| <= 20 and the poles.
    """
    if mode not in (1, 2):
        raise ValueError("mode is 1 or 2")
    lon, lat = F.radians(F.col("lon")), F.radians(F.col("lat"))

    def d(x, axis):
        by, order, along = ([*keys, "lat"], "lon", lon) if axis == "lon" else ([*keys, "lon"], "lat", lat)
        return window.derivative(x, along, by, order) if mode == 2 else window.coordinate_gradient(x, along, by, order)

    df = df.withColumns({"_x": d(psi, "lon"), "_y": d(psi, "lat")})
    df = df.withColumns({"_xx": d("_x", "lon"), "_yy": d("_y", "lat"), "_xy": d("_y", "lon") if mode == 2 else d("_x", "lat")})
    s, x, y, xx, yy, xy = (F.col(c) for c in (psi, "_x", "_y", "_xx", "_yy", "_xy"))
    cos, radius = F.cos(lat), FLUX_RADIUS if mode == 2 else MEAN_RADIUS
    c = F.try_divide(F.lit(pressure / 1000.0) * cos, 2 * radius * radius * F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v)))
    mixed = x * y - s * xy
    fx = c * (F.try_divide(F.col(u), cos * cos) * (x * x - s * xx) + F.try_divide(F.col(v), cos) * mixed)
    fy = c * (F.try_divide(F.col(u), cos) * mixed + F.col(v) * (y * y - s * yy))
    df = df.withColumns({"fx": fx, "fy": fy}).drop("_x", "_y", "_xx", "_yy", "_xy")
    if mode == 2:
        df = select.null_ring(df, keys, ["fx", "fy"], "lat", None)
    hide = (lambda f: select.null_band(F.col("lat"), f)) if mode == 2 else (lambda f: select.null_poles(F.col("lat"), select.null_band(F.col("lat"), f, inclusive=True)))
    return df.withColumns({"fx": hide(F.col("fx")), "fy": hide(F.col("fy"))})


def advection(df: DataFrame, keys: list[str], x: str = "t", u: str = "u", v: str = "v", to: str = "adv") -> DataFrame:
    """-(u dx/dx + v dx/dy) with coordinate gradients, on a sphere."""
    gx = window.coordinate_gradient(x, F.radians(F.col("lon")) * EARTH_RADIUS, [*keys, "lat"], "lon")
    gy = window.coordinate_gradient(x, F.radians(F.col("lat")) * EARTH_RADIUS, [*keys, "lon"], "lat")
    return df.withColumn(to, -(F.col(u) * F.try_divide(gx, F.cos(lat_radians())) + F.col(v) * gy))


def static_stability(t: str, level: str, keys: list[str]) -> Column:
    """R T / (cp p) minus the ratio of gradients of T and p along the levels; p in hPa."""
    return R_DRY * F.col(t) / (CP_DRY * F.col(level)) - window.derivative(t, level, keys, level)


def temperature_budget(df: DataFrame, time: str = "time", level: str = "level") -> DataFrame:
    """dTdt (per step), adv_T, ver and the residual heating Q of t, u, v, w (Pa/s)."""
    df = advection(df, [time, level], to="adv_T")
    df = df.withColumn("ver", F.col("w") / 100.0 * static_stability("t", level, [time, "lat", "lon"]))
    df = df.withColumn("dTdt", window.tendency("t", [level, "lat", "lon"], time))
    step = month_seconds(F.month(time))
    return df.withColumn("Q", (F.col("dTdt") - F.col("adv_T") * step - F.col("ver") * step) * CP_DRY / step)


