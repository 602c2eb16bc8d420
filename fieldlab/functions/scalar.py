"""Column expressions: dates, keys, classes, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a day; earth radii in m; rotation in 1/s; dry-air constants in J/kg/K; latent heat in J/kg; water in kg/m3.
DAY = 86400.0
EARTH_RADIUS, FLUX_RADIUS, MEAN_RADIUS = 6371e3, 6.371004e6, 6371008.7714
OMEGA, R_DRY, CP_DRY = 7.292e-5, 287.05, 1004.7
LATENT_HEAT, WATER = 2.45e6, 1000.0
# Mean days of the months, January first.
MONTH_DAYS = [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def day_of(number: Column) -> Column:
    """yyyymmdd as a date."""
    return F.to_date(number.cast("string"), "yyyyMMdd")


def month_seconds(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(d)) for d in MONTH_DAYS]), month) * DAY


def season_key(year: Column, day: Column) -> Column:
    """year and the 0-based day of a season, two digits, as one number."""
    return F.concat(year.cast("string"), F.lpad(day.cast("string"), 2, "0")).cast("int")


def key_year(key: Column) -> Column:
    return F.substring(key.cast("string"), 1, 4).cast("int")


def whole_text(x: Column) -> Column:
    """A float as the text of its whole part."""
    return x.cast("int").cast("string")


def char_count(text: Column, letter: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(letter), F.lit("")))


def branch(text: Column, cases: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in reversed(cases.items()):
        out = F.when(text == k, v).otherwise(out)
    return out


def three_way(x: Column, limit: float = 0.5) -> Column:
    """1 above the limit, -1 below its negative, else 0 (also for NULL)."""
    return F.when(x > limit, 1).when(x < -limit, -1).otherwise(0)


def sign_label(x: Column, above: str = "red", other: str = "blue") -> Column:
    return F.when(x > 0, above).otherwise(other)


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def flux(accumulated: Column) -> Column:
    """J/m2 a day as W/m2."""
    return accumulated / DAY


def per_second(per_day: Column) -> Column:
    return per_day / DAY


def evaporation_energy(depth: Column) -> Column:
    """Depth of evaporated water (m) as energy."""
    return depth * (LATENT_HEAT * WATER)


def hecto(pascal: Column) -> Column:
    return pascal / 100.0


def level_of(sigma: Column) -> Column:
    """Pressure-like level of a sigma level."""
    return sigma * (1000.0 - 1.0) + 1.0


def line(x: Column, slope: Column, intercept: Column) -> Column:
    return intercept + slope * x


def longitude(x: Column, signed: bool = False) -> Column:
    """Degrees in 0..360, or -180..180."""
    round_ = F.pmod(x, F.lit(360.0))
    return F.when(round_ >= 180, round_ - 360).otherwise(round_) if signed else round_


def grid_axis(start: float, step: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * step)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)
