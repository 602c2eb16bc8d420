"""Cubes as DataFrames: one row per cell (long), one array per 2-D field (slab) or per cell's history (series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(df: DataFrame, names: dict[str, str] | None = None, time: str | None = "time", time_format: str | None = None) -> DataFrame:
    """Renamed columns, time as a date (from yyyymmdd numbers if time_format is given), NaN as NULL."""
    df = df.withColumnsRenamed(names or {})
    if time and time_format:
        df = df.withColumn(time, F.to_date(F.col(time).cast("string"), time_format))
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL: reductions skip it, and comparisons with it aren't true."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_slab(df: DataFrame, keys: list[str], value: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, lat, lon, data): axes ascending, data row-major with NULL where a cell has none."""
    axis = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    rows = df.groupBy(*keys).agg(axis(lat), axis(lon), F.collect_list(F.struct(F.col(lat).alias("y"), F.col(lon).alias("x"), F.col(value).alias("v"))).alias("_cells"))
    # Each cell at its place, and behind it an empty one for every place; of a place's cells the first one counts.
    entry = lambda place, blank, v: F.struct(place.cast("int").alias("p"), F.lit(blank).alias("o"), v.alias("v"))
    own = F.transform("_cells", lambda c: entry((F.array_position(lat, c["y"]) - 1) * F.size(lon) + F.array_position(lon, c["x"]) - 1, 0, c["v"]))
    blank = F.transform(F.sequence(F.lit(0), F.size(lat) * F.size(lon) - 1), lambda p: entry(p, 1, F.lit(None).cast(dict(df.dtypes)[value])))
    rows = rows.withColumn("_all", F.sort_array(F.concat(own, blank)))
    data = F.transform(F.filter("_all", lambda e, i: (i == 0) | (F.get("_all", i - 1)["p"] != e["p"])), lambda e: e["v"])
    return rows.select(*keys, lat, lon, data.alias("data"))


def from_slab(slabs: DataFrame, keys: list[str], value: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The long layout of slabs."""
    rows = slabs.select(*keys, lat, lon, F.posexplode("data").alias("_at", value))
    return rows.select(*keys, F.get(lat, F.floor(F.col("_at") / F.size(lon)).cast("int")).alias(lat), F.get(lon, F.col("_at") % F.size(lon)).alias(lon), value)


def to_series(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, series): each cell's (t, v) in time order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))).alias("series"))


def from_series(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    return series.select(*keys, F.explode("series").alias("_p")).select(*keys, F.col("_p.t").alias(time), F.col("_p.v").alias(value))
