"""All queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions import scalar, stats
from fieldlab.model import from_slab, normalise, to_series, to_slab
from fieldlab.operators import calculus, climate, elliptic, forcing, joins, modes, reduce, regrid, select, spatial, spectral, window
from fieldlab.plans.proxies import CUBE, DAILY, GRID, MONTHLY, SALES, YEARLY, daily_series, level_cube, monthly_cube, price_grid, sales_cube, samples, table, yearly_cube
from fieldlab.sources import files, netcdf, pieces, shapefile, vectors
from fieldlab.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
BASE = (1996, 2000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = steady_sql(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: steady(F.col(n), digits) for n in names})


def texted(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, which both engines write alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def nudge(digits: int) -> float:
    """Added before rounding, so that no value of few decimals is halfway between two."""
    return 0.013 * 10.0**-digits


def steady(x, digits: int):
    return F.round((F.col(x) if isinstance(x, str) else x) + nudge(digits), digits)


def steady_sql(sql: str) -> str:
    """SQL whose round(x, n) add the same; round(x) stays."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, cut, i = 0, None, at + 5
        while True:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                cut = i
            if depth == 0:
                break
            i += 1
        if cut is not None and sql[cut + 1 : i].strip().isdigit():
            body = f"{sql[at + 6 : cut]} + {nudge(int(sql[cut + 1 : i]))!r}::DOUBLE"
            sql = sql[: at + 6] + body + sql[cut:]
        at += 6
    return sql


def w3(x: str, part: str, order: str) -> str:
    """SQL of the index gradient."""
    w, p = f"(PARTITION BY {part} ORDER BY {order})", f"(PARTITION BY {part})"
    return f"(CASE WHEN count(*) OVER {p} < 2 THEN NULL WHEN row_number() OVER {w} = 1 THEN lead({x}) OVER {w} - {x} WHEN row_number() OVER {w} = count(*) OVER {p} THEN {x} - lag({x}) OVER {w} ELSE (lead({x}) OVER {w} - lag({x}) OVER {w}) / 2 END)"


def w4(x: str, c: str, part: str, order: str) -> str:
    """SQL of the coordinate gradient."""
    w, p = f"(PARTITION BY {part} ORDER BY {order})", f"(PARTITION BY {part})"
    hs, hd, xa, xb = f"({c} - lag({c}) OVER {w})", f"(lead({c}) OVER {w} - {c})", f"lead({x}) OVER {w}", f"lag({x}) OVER {w}"
    inside = f"({hs}*{hs}*{xa} + ({hd}*{hd} - {hs}*{hs})*{x} - {hd}*{hd}*{xb}) / nullif({hs}*{hd}*({hs}+{hd}), 0)"
    return f"(CASE WHEN count(*) OVER {p} < 2 THEN NULL WHEN row_number() OVER {w} = 1 THEN ({xa} - {x}) / nullif({hd}, 0) WHEN row_number() OVER {w} = count(*) OVER {p} THEN ({x} - {xb}) / nullif({hs}, 0) ELSE {inside} END)"


RE = repr(scalar.EARTH_RADIUS)
DX = f"({RE} * cos(radians(lat)) * radians({w3('lon', 'lat', 'lon')}))"
DY = f"({RE} * radians({w3('lat', 'lon', 'lat')}))"


# --- indices -----------------------------------------------------------------------------------------------


@query(f"""WITH {SALES}, d AS (SELECT time, avg(x) AS x FROM sales WHERE month(time) IN (6, 7, 8) GROUP BY 1),
y AS (SELECT CAST(year(time) AS INT) AS year, avg(x) AS raw FROM d GROUP BY 1),
a AS (SELECT *, raw - (SELECT avg(raw) FROM y WHERE year BETWEEN 1996 AND 2000) AS anomaly FROM y),
r AS (SELECT *, anomaly - (SELECT regr_intercept(anomaly, year) FROM a) - (SELECT regr_slope(anomaly, year) FROM a) * year AS residual FROM a),
s AS (SELECT *, (SELECT stddev_pop(residual) FROM r WHERE year BETWEEN 1996 AND 2000) AS sigma FROM r)
SELECT year, round(raw, 4) AS raw, round(anomaly, 4) AS anomaly, round(residual, 4) AS residual, round(sigma, 4) AS sigma,
CAST(CASE WHEN residual / sigma > 0.5 THEN 1 WHEN residual / sigma < -0.5 THEN -1 ELSE 0 END AS INT) AS class FROM s""")
def jja_anomaly_index(spark, d):
    out = climate.anomaly_index(sales_cube(spark, d), "time", "x", [6, 7, 8], BASE)
    out = out.withColumn("class", scalar.three_way(F.col("z")))
    return rounded(out, 4, "raw", "anomaly", "residual", "sigma").select("year", "raw", "anomaly", "residual", "sigma", "class")


@query(f"WITH {YEARLY} SELECT lat, lon, round(avg(x), 4) AS x_clim FROM yearly WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2")
def base_climatology(spark, d):
    return rounded(reduce.climatology(yearly_cube(spark, d), *BASE, ["lat", "lon"], ["x"]), 4, "x_clim")


@query(f"WITH {YEARLY} SELECT lat, lon, round(stddev_pop(x), 4) AS x_std FROM yearly WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2")
def base_spread(spark, d):
    return rounded(reduce.spread(yearly_cube(spark, d), *BASE, ["lat", "lon"], ["x"]), 4, "x_std")


@query(f"""WITH {YEARLY}, fit AS (SELECT lat, lon, regr_slope(x, year) AS b, regr_intercept(x, year) AS a FROM yearly GROUP BY 1, 2)
SELECT year, lat, lon, round(x - (a + b * year), 3) AS residual FROM yearly JOIN fit USING (lat, lon)""")
def detrended_anomaly(spark, d):
    return rounded(window.detrended(yearly_cube(spark, d), ["lat", "lon"], "year", "x"), 3, "residual").select("year", "lat", "lon", "residual")


@query(f"""WITH {YEARLY}, m AS (SELECT year, avg(x) AS x FROM yearly GROUP BY 1)
SELECT year, round((x - (SELECT avg(x) FROM m)) / (SELECT stddev_pop(x) FROM m), 6) AS z FROM m""")
def zscore_index(spark, d):
    return rounded(window.standardised(reduce.area_mean(yearly_cube(spark, d), ["year"], ["x"]), [], "x"), 6, "z").select("year", "z")


WINTER = f"""{MONTHLY}, m AS (SELECT time, avg(x) AS x FROM monthly GROUP BY 1),
winter AS (SELECT CAST(year(time) + CASE WHEN month(time) = 12 THEN 1 ELSE 0 END AS INT) AS year, sum(x) / 3 AS idx FROM m WHERE month(time) IN (12, 1, 2) GROUP BY 1 HAVING count(x) = 3)"""


def winters(spark, d) -> DataFrame:
    return climate.winter_index(reduce.area_mean(monthly_cube(spark, d), ["time"], ["x"]), "time", "x")


@query(f"WITH {WINTER} SELECT year, round(idx, 4) AS index FROM winter")
def djf_style_season(spark, d):
    return rounded(winters(spark, d), 4, "index")


@query(f"""WITH {WINTER}, z AS (SELECT year, (idx - (SELECT avg(idx) FROM winter)) / (SELECT stddev_pop(idx) FROM winter) AS z FROM winter)
SELECT year, CAST(CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END AS INT) AS class, CASE WHEN z > 0 THEN 'red' ELSE 'blue' END AS colour FROM z""")
def enso_class(spark, d):
    z = window.standardised(winters(spark, d), [], "index")
    return z.select("year", climate.winter_class(F.col("z")).alias("class"), scalar.sign_label(F.col("z")).alias("colour"))


@query(f"WITH {WINTER} SELECT round(CASE WHEN max(idx) = min(idx) THEN 0.05 ELSE 0.03 * (max(idx) - min(idx)) END, 5) AS \"offset\" FROM winter")
def plot_offset(spark, d):
    return rounded(climate.plot_offset(winters(spark, d), "index"), 5, "offset")


# --- reductions --------------------------------------------------------------------------------------------


@query(f"WITH {SALES} SELECT CAST(time AS VARCHAR) AS time, round(avg(x), 4) AS x FROM sales GROUP BY 1")
def area_mean(spark, d):
    return texted(rounded(reduce.area_mean(sales_cube(spark, d), ["time"], ["x"]), 4, "x"), "time")


@query(f"WITH {SALES} SELECT CAST(time AS VARCHAR) AS time, round(sum(cos(radians(lat)) * x) / sum(cos(radians(lat))), 4) AS x FROM sales GROUP BY 1")
def area_mean_cos(spark, d):
    return texted(rounded(reduce.area_mean(sales_cube(spark, d), ["time"], ["x"], cos_weight=True), 4, "x"), "time")


@query(f"WITH {YEARLY} SELECT year, lat, lon, round(x, 4) AS x FROM yearly")
def yearly_season_mean(spark, d):
    return rounded(yearly_cube(spark, d), 4, "x")


@query(f"WITH {SALES} SELECT CAST(year(time) AS INT) AS year, lat, lon, round(coalesce(sum(x), 0), 4) AS x FROM sales WHERE month(time) IN (6, 7, 8, 9) GROUP BY 1, 2, 3")
def yearly_season_sum(spark, d):
    out = reduce.yearly_sum(select.months(sales_cube(spark, d), "time", [6, 7, 8, 9]), "time", ["lat", "lon"], ["x"])
    return rounded(out, 4, "x")


@query(f"WITH {SALES} SELECT round(quantile_cont(x, 0.8), 4) AS q FROM sales")
def quantile80_threshold(spark, d):
    return rounded(reduce.quantile(sales_cube(spark, d), "x", 0.8), 4, "q")


FLAGS = f"{SALES}, flags AS (SELECT *, CAST(x > (SELECT quantile_cont(x, 0.8) FROM sales) AS INT) AS flag FROM sales)"


@query(f"WITH {FLAGS} SELECT CAST(time AS VARCHAR) AS time, lat, lon, flag FROM flags")
def exceedance_binary(spark, d):
    return texted(flags(spark, d), "time")


def flags(spark, d, cube: DataFrame | None = None) -> DataFrame:
    cube = cube or files.stored(sales_cube(spark, d))
    return joins.with_scalars(cube, reduce.quantile(cube, "x", 0.8)).select("time", "lat", "lon", (F.col("x") > F.col("q")).cast("int").alias("flag"))


FRACTION = f"{FLAGS}, frac AS (SELECT time, sum(flag) AS hits, CAST(sum(flag) AS DOUBLE) / (SELECT count(*) FROM (SELECT DISTINCT lat, lon FROM sales)) AS fraction FROM flags GROUP BY 1)"


@query(f"WITH {FRACTION} SELECT CAST(time AS VARCHAR) AS time, CAST(hits AS BIGINT) AS hits, round(fraction, 6) AS fraction FROM frac")
def area_fraction(spark, d):
    cube = files.stored(sales_cube(spark, d))
    cells = cube.select("lat", "lon").distinct().agg(F.count("*").alias("n"))
    return texted(rounded(reduce.area_fraction(flags(spark, d, cube), ["time"], "flag", cells), 6, "fraction"), "time")


def dated(spark, d) -> DataFrame:
    return files.stored(sales_cube(spark, d)).withColumn("year", F.year("time")).withColumn("dos", F.dayofyear("time") - 1)


@query(f"""WITH {FRACTION} SELECT CAST(year(time) AS INT) AS year, CAST(dayofyear(time) - 1 AS INT) AS dos, CAST(hits AS BIGINT) AS hits, round(fraction, 6) AS fraction,
CAST(year(time) * 100 + dayofyear(time) - 1 AS INT) AS key FROM frac WHERE fraction >= 0.2""")
def event_days(spark, d):
    return rounded(climate.extreme_events(dated(spark, d), "x"), 6, "fraction")


@query("""WITH e AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey % 4 AS INT) AS type FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT year, count(*) FILTER (WHERE type = 0) AS "0", count(*) FILTER (WHERE type = 1) AS "1", count(*) FILTER (WHERE type = 2) AS "2", count(*) FILTER (WHERE type = 3) AS "3" FROM e WHERE year BETWEEN 1995 AND 2001 GROUP BY 1""")
def event_year_type_pivot(spark, d):
    events = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 4).cast("int").alias("type"))
    counts = reduce.event_counts(events, list(range(1995, 2002)), [0, 1, 2, 3])
    out = reduce.pivot_sum(counts, "year", "type", [0, 1, 2, 3], "n")
    return out.where(F.col("0") + F.col("1") + F.col("2") + F.col("3") > 0)


@query(f"WITH {MONTHLY} SELECT CAST(month(time) AS INT) AS month, lat, lon, CASE WHEN count(x) = count(*) THEN round(avg(x), 4) END AS x FROM (SELECT time, lat, lon, CASE WHEN x > 100000 THEN x END AS x FROM monthly) GROUP BY 1, 2, 3")
def composite_mean(spark, d):
    cube = monthly_cube(spark, d).withColumn("x", select.null_unless(F.col("x") > 100000, F.col("x"))).withColumn("month", F.month("time"))
    return rounded(reduce.composite(cube, ["month", "lat", "lon"], "x"), 4, "x")


@query(f"WITH {GRID} SELECT i, round(max(f), 4) AS highest, round(min(f), 4) AS lowest, round(max(abs(f)), 4) AS largest FROM grid GROUP BY 1")
def extremes(spark, d):
    return rounded(reduce.extremes(price_grid(spark, d), ["i"], "f"), 4, "highest", "lowest", "largest")


@query("SELECT p_brand, round(2 * sqrt(sum(pow(CAST(p_size AS DOUBLE) / 2, 2))), 6) AS diameter FROM part GROUP BY 1")
def equivalent_diameter(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(steady(reduce.equivalent_diameter(F.col("p_size").cast("double")), 6).alias("diameter"))


@query(f"WITH {GRID} SELECT i, count(CASE WHEN f > 25000 THEN 1 END) AS n FROM grid GROUP BY 1")
def valid_count(spark, d):
    return reduce.valid_count(price_grid(spark, d).withColumn("f", select.null_unless(F.col("f") > 25000, F.col("f"))), ["i"], "f")


@query(f"WITH {GRID} SELECT i, round(avg(nullif(CASE WHEN f > 25000 THEN f ELSE 0.0 END, 0.0)), 4) AS f FROM grid GROUP BY 1")
def profile_mean(spark, d):
    return rounded(reduce.profile_mean(price_grid(spark, d).withColumn("f", select.keep_above(F.col("f"), 25000.0)), ["i"], "f"), 4, "f")


K = f"{YEARLY}, m AS (SELECT year, avg(x) AS x FROM yearly GROUP BY 1), kk AS (SELECT year, x AS k FROM m)"


def indexed(spark, d) -> tuple[DataFrame, DataFrame]:
    cube = yearly_cube(spark, d)
    return cube, reduce.area_mean(cube, ["year"], ["x"]).withColumnRenamed("x", "k")


@query(f"WITH {K} SELECT lat, lon, round(CASE WHEN count(*) > 1 THEN regr_slope(x, k) END, 5) AS slope, round(CASE WHEN count(*) > 1 THEN regr_intercept(x, k) END, 2) AS intercept, count(*) AS n FROM yearly JOIN kk USING (year) GROUP BY 1, 2")
def regress_map(spark, d):
    cube, k = indexed(spark, d)
    return rounded(rounded(reduce.regression(joins.align(cube, k, ["year"]), ["lat", "lon"], "x", "k"), 5, "slope"), 2, "intercept")


@query(f"WITH {K} SELECT lat, lon, round(corr(x, k), 6) AS r, count(*) AS n FROM yearly JOIN kk USING (year) GROUP BY 1, 2")
def corr_map(spark, d):
    cube, k = indexed(spark, d)
    return rounded(reduce.correlation(joins.align(cube, k, ["year"]), ["lat", "lon"], "x", "k"), 6, "r")


R_CRIT = " ".join(f"WHEN {n} THEN {stats.r_crit(n)!r}" for n in range(3, 61))


@query(f"WITH {K}, c AS (SELECT lat, lon, corr(x, k) AS r, count(*) AS n FROM yearly JOIN kk USING (year) GROUP BY 1, 2) SELECT lat, lon, CASE WHEN abs(r) >= CASE n {R_CRIT} END THEN 0.0::DOUBLE END AS mark FROM c")
def sig_mask(spark, d):
    cube, k = indexed(spark, d)
    r = reduce.correlation(joins.align(cube, k, ["year"]), ["lat", "lon"], "x", "k")
    return reduce.significance(r).select("lat", "lon", "mark")


# --- windows and differences -------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, w AS (SELECT d, CAST(year(d) AS INT) AS year, avg(x) OVER p AS m, count(x) OVER p AS n, row_number() OVER (PARTITION BY year(d) ORDER BY d) AS place, count(*) OVER (PARTITION BY year(d)) AS total FROM daily
WINDOW p AS (PARTITION BY year(d) ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT CAST(d AS VARCHAR) AS d, year, CAST(place - 2 AS INT) AS day, CASE WHEN n = 5 THEN round(m, 4) END AS x FROM w WHERE place > 2 AND place <= total - 2""")
def moving_avg5_valid(spark, d):
    series = daily_series(spark, d).withColumn("year", F.year("d"))
    return texted(rounded(window.moving_average(series, ["year"], "d", "x"), 4, "x").select("d", "year", "day", "x"), "d")


@query(f"WITH {MONTHLY} SELECT CAST(time AS VARCHAR) AS time, lat, lon, round(lag(x) OVER (PARTITION BY lat, lon ORDER BY time), 4) AS before FROM monthly")
def time_shift(spark, d):
    return texted(monthly_cube(spark, d).select("time", "lat", "lon", steady(window.shifted("x", ["lat", "lon"], "time"), 4).alias("before")), "time")


@query(f"WITH {MONTHLY} SELECT CAST(time AS VARCHAR) AS time, lat, lon, round({w3('x', 'lat, lon', 'time')}, 4) AS tendency FROM monthly")
def tendency(spark, d):
    return texted(monthly_cube(spark, d).select("time", "lat", "lon", steady(window.tendency("x", ["lat", "lon"], "time"), 4).alias("tendency")), "time")


@query(f"WITH {GRID} SELECT i, j, round({w3('f', 'i', 'j')}, 4) AS gj, round({w3('f', 'j', 'i')}, 4) AS gi FROM grid")
def grad_index(spark, d):
    return price_grid(spark, d).select("i", "j", steady(window.index_gradient("f", ["i"], "j"), 4).alias("gj"), steady(window.index_gradient("f", ["j"], "i"), 4).alias("gi"))


@query(f"WITH {GRID}, c AS (SELECT *, CAST(j * j AS DOUBLE) AS c FROM grid) SELECT i, j, round({w4('f', 'c', 'i', 'j')}, 4) AS g FROM c")
def grad_coord(spark, d):
    rows = price_grid(spark, d).withColumn("c", (F.col("j") * F.col("j")).cast("double"))
    return rows.select("i", "j", steady(window.coordinate_gradient("f", "c", ["i"], "j"), 4).alias("g"))


@query(f"WITH {GRID} SELECT i, j, round(lead(f) OVER (PARTITION BY i ORDER BY j) - lag(f) OVER (PARTITION BY i ORDER BY j), 4) AS diff FROM grid")
def centred_difference(spark, d):
    return price_grid(spark, d).select("i", "j", steady(window.centred_difference("f", ["i"], "j"), 4).alias("diff"))


@query(f"WITH {GRID} SELECT lat, lon, round(1e6 * ({w3('f', 'lat', 'lon')} / {DX} + {w3('g', 'lon', 'lat')} / {DY} - g * tan(radians(lat)) / {RE}), 5) AS div FROM grid")
def divergence(spark, d):
    out = calculus.divergence(price_grid(spark, d), [], "f", "g")
    return out.select("lat", "lon", steady(1e6 * F.col("div"), 5).alias("div"))


@query(f"WITH {GRID} SELECT lat, lon, round(1e6 * ({w3('g', 'lat', 'lon')} / {DX} - {w3('f', 'lon', 'lat')} / {DY}), 5) AS vor FROM grid")
def vorticity(spark, d):
    return calculus.vorticity(price_grid(spark, d), [], "f", "g").select("lat", "lon", steady(1e6 * F.col("vor"), 5).alias("vor"))


STEP = f"({RE} * radians(5.0))"


@query(f"""WITH {GRID} SELECT lat, lon, round(1e6 * ((lead(g) OVER (PARTITION BY lat ORDER BY lon) - lag(g) OVER (PARTITION BY lat ORDER BY lon)) / ({STEP} * cos(radians(lat)))
- (lead(f) OVER (PARTITION BY lon ORDER BY lat) - lag(f) OVER (PARTITION BY lon ORDER BY lat)) / {STEP}), 5) AS vor FROM grid""")
def vorticity_fixed_step(spark, d):
    return calculus.vorticity_fixed_step(price_grid(spark, d), [], "f", "g").select("lat", "lon", steady(1e6 * F.col("vor"), 5).alias("vor"))


@query(f"WITH {GRID} SELECT lat, lon, round(1e6 * {w3('f', 'lat', 'lon')} / {DX}, 4) AS gx, round(1e6 * {w3('f', 'lon', 'lat')} / {DY}, 4) AS gy FROM grid")
def scalar_gradient(spark, d):
    out = calculus.gradient(price_grid(spark, d), [], "f")
    return out.select("lat", "lon", steady(1e6 * F.col("gx"), 4).alias("gx"), steady(1e6 * F.col("gy"), 4).alias("gy"))


@query(f"WITH {GRID} SELECT i, j, round(sqrt(f * f + g * g), 4) AS speed FROM grid")
def wind_speed(spark, d):
    return price_grid(spark, d).select("i", "j", steady(scalar.wind_speed(F.col("f"), F.col("g")), 4).alias("speed"))


@query(f"WITH {GRID} SELECT DISTINCT lat, round(1e6 * 2 * 7.292e-5 * sin(radians(lat)), 6) AS f FROM grid")
def coriolis(spark, d):
    return price_grid(spark, d).select("lat", steady(1e6 * scalar.coriolis(F.col("lat")), 6).alias("f")).distinct()


@query(f"WITH {GRID} SELECT lat, lon, round((f - (SELECT avg(f) FROM grid)) / nullif(2 * 7.292e-5 * sin(radians(lat)), 0) / 1e6, 4) AS psi FROM grid")
def qg_streamfunction(spark, d):
    grid = price_grid(spark, d)
    rows = joins.with_scalars(grid, grid.agg(F.avg("f").alias("mean")))
    return rows.select("lat", "lon", steady(calculus.qg_streamfunction(F.col("f"), F.col("mean"), F.col("lat")) / 1e6, 4).alias("psi"))


def flux_sql(mode: int) -> str:
    lon, lat = "radians(lon)", "radians(lat)"
    if mode == 2:
        by = lambda x, axis: f"{w3(x, 'lat', 'lon')} / {w3(lon, 'lat', 'lon')}" if axis == "lon" else f"{w3(x, 'lon', 'lat')} / {w3(lat, 'lon', 'lat')}"
    else:
        by = lambda x, axis: w4(x, lon, "lat", "lon") if axis == "lon" else w4(x, lat, "lon", "lat")
    radius = scalar.FLUX_RADIUS if mode == 2 else scalar.MEAN_RADIUS
    mixed = by("y", "lon") if mode == 2 else by("x", "lat")
    seen = "abs(lat) >= 20 AND lat > (SELECT min(lat) FROM grid) AND lat < (SELECT max(lat) FROM grid)" if mode == 2 else "abs(lat) > 20 AND abs(lat) < 90"
    return f"""WITH {GRID}, a AS (SELECT lat, lon, f / 1000 AS u, g AS v, f AS s FROM grid),
b AS (SELECT *, {by('s', 'lon')} AS x, {by('s', 'lat')} AS y FROM a),
c AS (SELECT *, {by('x', 'lon')} AS xx, {by('y', 'lat')} AS yy, {mixed} AS xy FROM b),
e AS (SELECT *, 0.25 * cos({lat}) / (2::DOUBLE * {radius!r}::DOUBLE * {radius!r}::DOUBLE * sqrt(u * u + v * v)) AS c FROM c)
SELECT lat, lon, CASE WHEN {seen} THEN round(1e6 * c * (u / (cos({lat}) * cos({lat})) * (x * x - s * xx) + v / cos({lat}) * (x * y - s * xy)), 3) END AS fx,
CASE WHEN {seen} THEN round(1e6 * c * (u / cos({lat}) * (x * y - s * xy) + v * (y * y - s * yy)), 3) END AS fy FROM e"""


def flux(spark, d, mode: int) -> DataFrame:
    rows = price_grid(spark, d).select("lat", "lon", (F.col("f") / 1000).alias("u"), F.col("g").alias("v"), F.col("f").alias("psi"))
    out = calculus.wave_activity_flux(rows, [], 250.0, mode=mode)
    return out.select("lat", "lon", steady(1e6 * F.col("fx"), 3).alias("fx"), steady(1e6 * F.col("fy"), 3).alias("fy"))


@query(flux_sql(2))
def waf_mode2(spark, d):
    return flux(spark, d, 2)


@query(flux_sql(1))
def waf_mode1(spark, d):
    return flux(spark, d, 1)


ADV = f"(-(u * {w4('t', f'radians(lon) * {RE}', 'time, lev, lat', 'lon')} / cos(radians(lat)) + v * {w4('t', f'radians(lat) * {RE}', 'time, lev, lon', 'lat')}))"
STABILITY = f"({scalar.R_DRY} * t / ({scalar.CP_DRY} * lev) - {w3('t', 'time, lat, lon', 'lev')} / {w3('lev', 'time, lat, lon', 'lev')})"


@query(f"WITH {CUBE} SELECT CAST(time AS VARCHAR) AS time, lev, lat, lon, round(1e6 * {ADV}, 4) AS adv FROM cube")
def temperature_advection(spark, d):
    out = calculus.advection(level_cube(spark, d), ["time", "lev"])
    return texted(out.select("time", "lev", "lat", "lon", steady(1e6 * F.col("adv"), 4).alias("adv")), "time")


@query(f"WITH {CUBE} SELECT CAST(time AS VARCHAR) AS time, lev, lat, lon, round({STABILITY}, 4) AS sigma FROM cube")
def static_stability(spark, d):
    return texted(level_cube(spark, d).select("time", "lev", "lat", "lon", steady(calculus.static_stability("t", "lev", ["time", "lat", "lon"]), 4).alias("sigma")), "time")


SECONDS = "(list_value(" + ", ".join(str(float(x)) for x in scalar.MONTH_DAYS) + ")[month(time)] * 86400.0::DOUBLE)"


@query(f"""WITH {CUBE}, b AS (SELECT *, {ADV} AS a, u / 1000 / 100.0 * {STABILITY} AS ver, {w3('t', 'lev, lat, lon', 'time')} AS dt FROM cube)
SELECT CAST(time AS VARCHAR) AS time, lev, lat, lon, round(dt, 4) AS "dTdt", round(1e6 * a, 4) AS "adv_T", round(1e6 * ver, 4) AS ver, round((dt - a * {SECONDS} - ver * {SECONDS}) * {scalar.CP_DRY} / {SECONDS}, 4) AS "Q" FROM b""")
def temperature_budget(spark, d):
    rows = level_cube(spark, d).withColumn("w", F.col("u") / 1000)
    out = calculus.temperature_budget(rows, "time", "lev")
    return texted(out.select("time", "lev", "lat", "lon", steady("dTdt", 4).alias("dTdt"), steady(1e6 * F.col("adv_T"), 4).alias("adv_T"), steady(1e6 * F.col("ver"), 4).alias("ver"), steady("Q", 4).alias("Q")), "time")


for _name in ("temperature_advection", "static_stability", "temperature_budget"):  # earlier names of the same
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]


# --- energy ------------------------------------------------------------------------------------------------


@query(f"WITH {GRID} SELECT i, j, round(f + g, 4) AS net, round(f + g + 2.45e9 * (g / 1e6), 3) AS heat FROM grid")
def net_radiation(spark, d):
    return price_grid(spark, d).select("i", "j", steady(climate.net_radiation(F.col("f"), F.col("g")), 4).alias("net"), steady(climate.sensible_heat(F.col("f"), F.col("g"), F.col("g") / 1e6), 3).alias("heat"))


@query(f"""WITH {K}, z AS (SELECT year, (k - (SELECT avg(k) FROM kk)) / (SELECT stddev_pop(k) FROM kk) AS z FROM kk),
p AS (SELECT lat, lon, CASE WHEN count(*) > 1 THEN regr_slope(x, z) / nullif(stddev_pop(x), 0) END AS h, CASE WHEN count(*) > 1 THEN regr_slope(sqrt(x), z) / nullif(stddev_pop(sqrt(x)), 0) END AS hp, CASE WHEN count(*) > 1 THEN regr_slope(x * x / 1e6, z) / nullif(stddev_pop(x * x / 1e6), 0) END AS t FROM yearly JOIN z USING (year) GROUP BY 1, 2)
SELECT lat, lon, round(h, 5) AS h1, round(hp, 5) AS hp1, round(t, 5) AS t1, round((h - hp) * t, 5) AS pi FROM p""")
def pi_index(spark, d):
    cube, k = indexed(spark, d)
    rows = cube.select("year", "lat", "lon", F.col("x").alias("h"), F.sqrt("x").alias("hp"), (F.col("x") * F.col("x") / 1e6).alias("t"))
    return rounded(climate.coupling_index(rows, k, ["lat", "lon"]), 5, "h1", "hp1", "t1", "pi")


@query(f"""WITH {K}, s AS (SELECT lat, lon, CASE WHEN count(*) > 1 THEN regr_slope(x, k) END / 86400.0::DOUBLE AS a, CASE WHEN count(*) > 1 THEN regr_slope(sqrt(x), k) END / 86400.0::DOUBLE AS b FROM yearly JOIN kk USING (year) WHERE lat BETWEEN 20 AND 40 GROUP BY 1, 2)
SELECT round(1e6 * avg(a), 4) AS ssr, round(1e9 * avg(b), 4) AS str, round(1e6 * (avg(a) + avg(b)), 4) AS net FROM s""")
def energy_budget(spark, d):
    cube, k = indexed(spark, d)
    mask = cube.where("lat BETWEEN 20 AND 40").select("lat", "lon").distinct()
    out = climate.energy_budget(cube.withColumn("ssr", F.col("x")).withColumn("str", F.sqrt("x")), k, mask, ["ssr", "str"])
    return out.select(steady(1e6 * F.col("ssr"), 4).alias("ssr"), steady(1e9 * F.col("str"), 4).alias("str"), steady(1e6 * F.col("net"), 4).alias("net"))


# --- selection and joins -----------------------------------------------------------------------------------

TRIANGLE = [(12.0, 15.0), (148.0, 22.0), (61.0, 68.0)]
SQUARE = [(160.0, 25.0), (240.0, 25.0), (240.0, 55.0), (160.0, 55.0)]


def edges_sql(*rings) -> str:
    rows = [f"({g}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for g, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1], strict=True)]
    return f"edges(geom, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


@query(f"""WITH {GRID}, {edges_sql(TRIANGLE, SQUARE)}, hits AS (SELECT lat, lon, geom FROM grid, edges WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
inside AS (SELECT DISTINCT lat, lon, true AS yes FROM hits) SELECT lat, lon, CASE WHEN yes THEN round(f, 4) END AS f FROM grid LEFT JOIN inside USING (lat, lon)""")
def polygon_mask(spark, d):
    shapes = spatial.polygons(spark, [TRIANGLE], 0).unionByName(spatial.polygons(spark, [SQUARE], 1))
    return rounded(spatial.masked(price_grid(spark, d), spatial.edge_table(shapes), ["f"]), 4, "f").select("lat", "lon", "f")


@query(f"WITH {GRID} SELECT lat, lon, round(f, 4) AS f FROM grid WHERE lon BETWEEN 60 AND 160 AND lat BETWEEN 0 AND 60")
def bbox(spark, d):
    return rounded(select.bbox(price_grid(spark, d), 60, 0, 160, 60), 4, "f").select("lat", "lon", "f")


@query(f"WITH {GRID} SELECT lat, lon, round(f, 4) AS f FROM grid UNION ALL SELECT lat, lon + 360, round(f, 4) FROM grid WHERE lon = (SELECT min(lon) FROM grid)")
def cyclic_pad(spark, d):
    return rounded(select.cyclic_pad(price_grid(spark, d).select("lat", "lon", "f")), 4, "f")


@query(f"WITH {SALES} SELECT CAST(time AS VARCHAR) AS time, lat, lon, round(x, 4) AS x FROM sales")
def concat_union(spark, d):
    cube = sales_cube(spark, d)
    return texted(rounded(select.between(cube, "time", "1900-01-01", "1998-12-31").unionByName(select.between(cube, "time", "1999-01-01", "2999-12-31")), 4, "x"), "time")


@query(f"WITH {YEARLY} SELECT year, lat, lon, round(x, 4) AS x FROM yearly WHERE year IN (SELECT year(o_orderdate) FROM orders WHERE o_totalprice > 400000 AND o_orderpriority = '1-URGENT')")
def semi_join_years(spark, d):
    years = table(spark, d, "orders").where("o_totalprice > 400000 AND o_orderpriority = '1-URGENT'").select(F.year("o_orderdate").alias("year"))
    return rounded(joins.of_years(yearly_cube(spark, d), years), 4, "x")


@query(f"WITH {WINTER} SELECT year, round(coalesce(idx, 0), 4) AS index FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) LEFT JOIN winter USING (year)")
def left_lookup_default(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return rounded(joins.lookup(years, winters(spark, d), ["year"], "index", 0.0), 4, "index")


@query(f"""WITH {GRID}, a AS (SELECT lat, lon, f, row_number() OVER (ORDER BY lat, lon) AS p FROM grid), b AS (SELECT g, row_number() OVER (ORDER BY lon, lat) AS p FROM grid)
SELECT lat, lon, round(f + g, 4) AS total FROM a FULL JOIN b USING (p)""")
def zip_join(spark, d):
    grid = price_grid(spark, d)
    rows = joins.zipped(grid.select("lat", "lon", "f"), grid.select(F.col("lon").alias("y"), F.col("lat").alias("x"), "g"), ["lat", "lon"], ["y", "x"])
    return rows.select("lat", "lon", steady(F.col("f") + F.col("g"), 4).alias("total"))


@query(f"WITH {WINTER}, y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT count(*) FILTER (WHERE w.year IS NULL OR y.year IS NULL) AS unmatched, count(*) FILTER (WHERE w.year IS NULL OR y.year IS NULL) = 0 AS equal FROM y FULL JOIN winter w ON y.year = w.year")
def keys_equal(spark, d):
    return joins.same_keys(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), winters(spark, d), "year")


@query(f"WITH {GRID} SELECT lat, lon, CASE WHEN abs(lat) >= 20 THEN round(f, 4) END AS band, CASE WHEN lat > 10 AND lat < 70 AND lon > 5 AND lon < 250 THEN round(f, 4) END AS ring FROM grid")
def null_masks(spark, d):
    rows = price_grid(spark, d).withColumn("band", select.null_band(F.col("lat"), F.col("f"))).withColumn("ring", F.col("f"))
    return rounded(select.null_ring(rows, [], ["ring"]), 4, "band", "ring").select("lat", "lon", "band", "ring")


@query(f"WITH {GRID} SELECT 30.0::DOUBLE * (i - 4) AS lat, lon, CASE WHEN i NOT IN (1, 7) THEN round(f, 4) END AS f, CASE WHEN i NOT IN (1, 7) THEN round({RE} * cos(radians(30.0::DOUBLE * (i - 4))) * radians(5.0), 3) END AS width FROM grid")
def poles(spark, d):
    """Rows of the grid from pole to pole: no values there, and no distances to divide by."""
    rows = price_grid(spark, d).withColumn("lat", F.lit(30.0) * (F.col("i") - 4))
    out = rows.withColumn("f", select.null_poles(F.col("lat"), F.col("f"))).withColumn("width", select.null_poles(F.col("lat"), calculus.dx([])))
    return rounded(rounded(out, 4, "f"), 3, "width").select("lat", "lon", "f", "width")


@query(f"WITH {GRID} SELECT lat, lon, round(f, 4) AS f FROM grid WHERE lat > 10 AND lat < 70 AND lon > 5 AND lon < 250")
def interior(spark, d):
    return rounded(select.interior(price_grid(spark, d), []), 4, "f").select("lat", "lon", "f")


@query(f"WITH {GRID}, m AS (SELECT i, j, CASE WHEN f > 40000 THEN f END AS f FROM grid) SELECT i, j, round(f, 4) AS f FROM m WHERE j IN (SELECT j FROM m WHERE f IS NOT NULL)")
def dropna_all_rows(spark, d):
    rows = price_grid(spark, d).withColumn("f", select.null_unless(F.col("f") > 40000, F.col("f")))
    return rounded(select.drop_empty(rows, ["j"], "f"), 4, "f").select("i", "j", "f")


@query(f"WITH {GRID}, m AS (SELECT i, j, CASE WHEN f > 51000 THEN f END AS f FROM grid) SELECT i, j, round(f, 4) AS f FROM m WHERE i IN (SELECT i FROM m WHERE f IS NOT NULL)")
def dropna_all_cols(spark, d):
    rows = price_grid(spark, d).withColumn("f", select.null_unless(F.col("f") > 51000, F.col("f")))
    return rounded(select.drop_empty(rows, ["i"], "f"), 4, "f").select("i", "j", "f")


@query(f"WITH {MONTHLY}, t AS (SELECT time, row_number() OVER (ORDER BY time) AS p FROM (SELECT DISTINCT time FROM monthly)) SELECT CAST(m.time AS VARCHAR) AS time, lat, lon, round(x, 4) AS x FROM monthly m JOIN t ON m.time = t.time WHERE p % 5 = 1")
def strided_sample(spark, d):
    return texted(rounded(select.strided(monthly_cube(spark, d), "time", 5), 4, "x"), "time")


@query(f"WITH {MONTHLY}, t AS (SELECT time, row_number() OVER (ORDER BY time) AS p FROM (SELECT DISTINCT time FROM monthly)) SELECT lat, lon, round(avg(x), 4) AS x FROM monthly m JOIN t ON m.time = t.time WHERE p BETWEEN 20 AND 25 GROUP BY 1, 2")
def positional_slice(spark, d):
    return rounded(reduce.area_mean(select.positions(monthly_cube(spark, d), "time", 19, 25), ["lat", "lon"], ["x"]), 4, "x")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderpriority = '3-MEDIUM' ORDER BY o_orderkey LIMIT 1")
def first_match_lookup(spark, d):
    return rounded(select.first_match(table(spark, d, "orders"), "o_orderpriority", "3-MEDIUM", "o_orderkey"), 2, "o_totalprice").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INT) AS n, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE 'other' END AS label FROM part")
def char_count(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.char_count(F.col("p_name"), "a").alias("n"), scalar.branch(F.col("p_brand"), {"Brand#11": "first", "Brand#12": "second"}, "other").alias("label"))


@query("SELECT DISTINCT CAST(month(o_orderdate) AS INT) AS month, list_value(" + ", ".join(str(float(x)) for x in scalar.MONTH_DAYS) + ")[month(o_orderdate)]::DOUBLE * 86400 AS seconds FROM orders")
def month_seconds(spark, d):
    return table(spark, d, "orders").select(F.month("o_orderdate").alias("month")).distinct().withColumn("seconds", scalar.month_seconds(F.col("month")))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 100 + day(o_orderdate) - 1 AS INT) AS key, CAST(year(o_orderdate) - 1961 AS INT) AS age, CAST(trunc(o_totalprice) AS INT)::VARCHAR AS whole FROM orders")
def season_keys(spark, d):
    key = scalar.season_key(F.year("o_orderdate"), F.dayofmonth("o_orderdate") - 1)
    return table(spark, d, "orders").select("o_orderkey", key.alias("key"), (scalar.key_year(key) - 1961).alias("age"), scalar.whole_text(F.col("o_totalprice")).alias("whole"))


@query(f"""WITH {GRID} SELECT i, j, round(f - 273.15, 4) AS celsius, round(f / 86400, 6) AS flux, round(f / 100, 4) AS hecto, round(g * 999 + 1, 4) AS level,
round(CASE WHEN (lon * 3) % 360 >= 180 THEN (lon * 3) % 360 - 360 ELSE (lon * 3) % 360 END, 4) AS west FROM grid""")
def unit_conversions(spark, d):
    r4 = lambda x, n, k=4: steady(x, k).alias(n)
    f, g = F.col("f"), F.col("g")
    return price_grid(spark, d).select("i", "j", r4(scalar.celsius(f), "celsius"), r4(scalar.flux(f), "flux", 6), r4(scalar.hecto(f), "hecto"), r4(scalar.level_of(g), "level"), r4(scalar.longitude(F.col("lon") * 3, signed=True), "west"))


# --- profiles, forcing, interpolation ----------------------------------------------------------------------

LEVELS = "lv AS (SELECT CAST(lev AS INT) AS lev, sigma FROM (VALUES " + ", ".join(f"({i}, {float(np.float32(s))!r}::DOUBLE)" for i, s in enumerate(forcing.SIGMA, 1)) + ") t(lev, sigma))"


def profile_sql(kind: int) -> str:
    return {1: f"8 * sin({math.pi!r} * sigma)", 2: "8 * exp(-20.0::DOUBLE * (sigma - 0.45::DOUBLE) * (sigma - 0.45::DOUBLE))", 3: "8.0::DOUBLE"}[kind]


def profile(kind: int):
    """The profile at a level for each cell, and its heating of the cell's price."""

    def run(spark, d):
        ver = forcing.vertical_value(F.col("j") / 50.0, kind)
        return price_grid(spark, d).select("i", "j", steady(ver, 6).alias("ver"), steady(ver * F.col("f") / 86400, 6).alias("heat"))

    return run


for _kind in (1, 2, 3):
    QUERIES[f"vertical_profile_{_kind}"] = profile(_kind)
    SQL[f"vertical_profile_{_kind}"] = steady_sql(f"WITH {GRID}, p AS (SELECT *, j / 50.0::DOUBLE AS sigma FROM grid) SELECT i, j, round({profile_sql(_kind)}, 6) AS ver, round({profile_sql(_kind)} * f / 86400, 6) AS heat FROM p")

CENTRE = "(lon - 77.0::DOUBLE)", "(lat - 31.5::DOUBLE)"
ELLIPSE = f"({CENTRE[0]} * {CENTRE[0]} / 529.0::DOUBLE + {CENTRE[1]} * {CENTRE[1]} / 420.25::DOUBLE)"
HORIZONTAL = {
    1: f"CASE WHEN {ELLIPSE} > 1 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * (1 - sqrt({ELLIPSE})) END",
    2: f"CASE WHEN abs({CENTRE[0]}) <= 23 AND abs({CENTRE[1]}) <= 20.5 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END",
}


def spread_of(kind: int):
    def run(spark, d):
        value = forcing.horizontal_value(F.col("lon"), F.col("lat"), kind, ry=20.5, centre=(77.0, 31.5))
        return price_grid(spark, d).select("lat", "lon", steady(value, 6).alias("hor"))

    return run


for _kind in (1, 2):
    QUERIES[f"horizontal_profile_{_kind}"] = spread_of(_kind)
    SQL[f"horizontal_profile_{_kind}"] = steady_sql(f"WITH {GRID} SELECT lat, lon, round({HORIZONTAL[_kind]}, 6) AS hor FROM grid")


@query(f"""WITH {GRID}, {LEVELS} SELECT lev, lat, lon, round(CAST(CAST(({HORIZONTAL[1]}) * ({profile_sql(2)}) / 86400 * 0.0::DOUBLE AS FLOAT) AS DOUBLE), 12) AS v, round(CAST(CAST(({HORIZONTAL[1]}) * ({profile_sql(2)}) / 86400 * 1.0::DOUBLE AS FLOAT) AS DOUBLE), 12) AS t FROM grid, lv""")
def outer_product_forcing(spark, d):
    hor = price_grid(spark, d).select("lat", "lon", forcing.horizontal_value(F.col("lon"), F.col("lat"), 1, ry=20.5, centre=(77.0, 31.5)).alias("hor"))
    ver = forcing.levels(spark).select("lev", forcing.vertical_value(F.col("sigma"), 2).alias("ver"))
    out = forcing.forcing(hor, ver, {"t": 1.0})
    return out.select("lev", "lat", "lon", steady(F.col("v").cast("double"), 12).alias("v"), steady(F.col("t").cast("double"), 12).alias("t"))


AROUND = "((CASE WHEN abs(lon - 355.0::DOUBLE) > 180 THEN lon + 5.0::DOUBLE ELSE lon - 355.0::DOUBLE END))"


@query(f"WITH {GRID} SELECT lat, lon, round(CASE WHEN e > 1 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * (1 - sqrt(e)) END, 6) AS hor FROM (SELECT lat, lon, {AROUND} * {AROUND} / 2500.0::DOUBLE + (lat - 31.5::DOUBLE) * (lat - 31.5::DOUBLE) / 420.25::DOUBLE AS e FROM grid)")
def horizontal_profile_wrap(spark, d):
    """A cone about 355 degrees east, which reaches over the meridian of 0."""
    value = forcing.horizontal_value(F.col("lon"), F.col("lat"), 1, rx=50.0, ry=20.5, centre=(355.0, 31.5), wrap=True)
    return price_grid(spark, d).select("lat", "lon", steady(value, 6).alias("hor"))


def hat(x: str, dim: str, step: float) -> str:
    """SQL of the linear weight of a node of an even axis."""
    return f"greatest(0.0::DOUBLE, 1 - abs({x} - {dim}) / {step})"


TARGET_LON, TARGET_LAT = [2.0, 5.0, 7.5, 33.3, 101.0, 250.0, 251.0], [10.0, 14.0, 33.0, 70.0, 71.0]


def axis(spark, name: str, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def values_sql(name: str, values: list[float]) -> str:
    return f"t_{name}(t{name}) AS (VALUES {', '.join(f'({v}::DOUBLE)' for v in values)})"


@query(f"""WITH {GRID}, {values_sql('lon', TARGET_LON)} SELECT lat, tlon AS lon, CASE WHEN tlon BETWEEN 5 AND 250 THEN round(sum({hat('tlon', 'lon', 5.0)} * f), 4) END AS f FROM grid, t_lon GROUP BY 1, 2""")
def interp1d(spark, d):
    return rounded(regrid.interpolate(files.stored(price_grid(spark, d)), ["lat"], "f", {"lon": axis(spark, "lon", TARGET_LON)}), 4, "f").select("lat", "lon", "f")


@query(f"""WITH {GRID}, {values_sql('lon', TARGET_LON)}, {values_sql('lat', TARGET_LAT)} SELECT tlat AS lat, tlon AS lon, CASE WHEN tlon BETWEEN 5 AND 250 AND tlat BETWEEN 10 AND 70 THEN round(sum({hat('tlon', 'lon', 5.0)} * {hat('tlat', 'lat', 10.0)} * f), 4) ELSE 0 END AS f FROM grid, t_lon, t_lat GROUP BY 1, 2""")
def interp2d(spark, d):
    out = regrid.interpolate(files.stored(price_grid(spark, d)), [], "f", {"lon": axis(spark, "lon", TARGET_LON), "lat": axis(spark, "lat", TARGET_LAT)}, missing=0.0)
    return rounded(out, 4, "f").select("lat", "lon", "f")


STACK = "stack AS (SELECT k AS lev, lat, lon, f * k AS f FROM grid, (VALUES (100.0::DOUBLE), (200.0::DOUBLE), (300.0::DOUBLE)) t(k))"


@query(f"""WITH {GRID}, {STACK}, {values_sql('lon', [7.5, 101.0])}, {values_sql('lat', [14.0, 33.0])}, {values_sql('lev', [100.0, 150.0, 300.0])}
SELECT tlev AS lev, tlat AS lat, tlon AS lon, round(sum({hat('tlon', 'lon', 5.0)} * {hat('tlat', 'lat', 10.0)} * {hat('tlev', 'lev', 100.0)} * f), 2) AS f FROM stack, t_lon, t_lat, t_lev GROUP BY 1, 2, 3""")
def interp3d(spark, d):
    stack = files.stored(price_grid(spark, d)).crossJoin(axis(spark, "lev", [100.0, 200.0, 300.0])).withColumn("f", F.col("f") * F.col("lev"))
    out = regrid.interpolate(stack, [], "f", {"lev": axis(spark, "lev", [100.0, 150.0, 300.0]), "lat": axis(spark, "lat", [14.0, 33.0]), "lon": axis(spark, "lon", [7.5, 101.0])}, outside="error")
    return rounded(out, 2, "f").select("lev", "lat", "lon", "f")



# --- one long history, by chunks ---------------------------------------------------------------------------

WHOLE = "(ORDER BY d)"


@query(f"""WITH {DAILY}, w AS (SELECT d, row_number() OVER {WHOLE} AS p, count(*) OVER () AS n, avg(x) OVER (ORDER BY d ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS x FROM daily)
SELECT CAST(d AS VARCHAR) AS d, CAST(p - 15 AS INT) AS day, round(x, 4) AS x FROM w WHERE p > 15 AND p <= n - 15""")
def moving_avg31_series(spark, d):
    out = window.moving_average(files.stored(daily_series(spark, d)), [], "d", "x", 31, by_chunks=True)
    return texted(rounded(out, 4, "x"), "d").select("d", "day", "x")


@query(f"""WITH {DAILY}, e AS (SELECT d, x, CAST(d - DATE '1990-01-01' AS DOUBLE) AS t FROM daily)
SELECT CAST(d AS VARCHAR) AS d, round({w3('x', '1', 'd')}, 4) AS change, round({w4('x', 't', '1', 'd')}, 4) AS slope, round(lead(x) OVER {WHOLE} - lag(x) OVER {WHOLE}, 4) AS centred, round(lag(x, 3) OVER {WHOLE}, 4) AS shifted FROM e""")
def tendency_series(spark, d):
    def work(rows, keys):
        away = F.datediff("d", F.lit("1990-01-01")).cast("double")
        return rows.withColumns({"change": window.tendency("x", keys, "d"), "slope": window.coordinate_gradient("x", away, keys, "d"), "centred": window.centred_difference("x", keys, "d"), "shifted": window.shifted("x", keys, "d", 3)})

    out = window.chunked(files.stored(daily_series(spark, d)), [], "d", 3, work)
    return texted(rounded(out, 4, "change", "slope", "centred", "shifted"), "d").select("d", "change", "slope", "centred", "shifted")


# --- files ---------------------------------------------------------------------------------------------------


@query(f"WITH {MONTHLY} SELECT CAST(time AS VARCHAR) AS time, lat, lon, round(x, 4) AS x FROM monthly WHERE time >= DATE '1995-01-01' AND lat BETWEEN 20 AND 40")
def netcdf_scan(spark, d):
    """The monthly cube, written as NetCDF files; a range of its times and latitudes is read."""
    path = files.shared_folder(spark)
    netcdf.write_netcdf(monthly_cube(spark, d), path, ["time", "lat", "lon"], ["x"], steps=24)
    cells = netcdf.scan(spark, path).where("time >= timestamp'1995-01-01' AND lat BETWEEN 20 AND 40")
    return texted(rounded(select.present(cells, "x").withColumn("time", F.to_date("time")), 4, "x"), "time").select("time", "lat", "lon", "x")


@query(f"WITH {DAILY} SELECT row_number() OVER (ORDER BY d) - 1 AS \"at\", round(x, 4) AS value FROM daily")
def npy_vector(spark, d):
    """The daily series, written as one npy file and read again."""
    path = files.shared_folder(spark)
    pieces.write_vector(daily_series(spark, d), path, ["d"], "x", npy=True)
    return rounded(files.read_npy(spark, path), 4, "value").select("at", "value")


@query(f"""WITH {CUBE}, placed AS (SELECT *, CAST(dense_rank() OVER (ORDER BY time) - 1 AS INT) AS step FROM cube)
SELECT step AS time, CAST(lev AS DOUBLE) AS lev, lat, lon, round(CAST(CAST(t AS REAL) AS DOUBLE), 2) AS t FROM placed WHERE step >= 12 AND lev BETWEEN 2 AND 4""")
def grads_scan(spark, d):
    """The cube with levels, written as a GrADS binary; some times and levels of one variable are read."""
    path = files.shared_folder(spark)
    ctl = files.write_grads(level_cube(spark, d), path, ["t", "u"], start="00z01jan1992", every="1mo")
    cells = files.read_grads(spark, path, ctl).where("time >= 12 AND variable = 't' AND lev BETWEEN 2 AND 4 AND value IS NOT NULL")
    return rounded(cells.withColumnRenamed("value", "t"), 2, "t").select("time", "lev", "lat", "lon", "t")


@query("""SELECT CAST(row_number() OVER (ORDER BY c_nationkey) AS INT) AS geom_id, round((max(c_custkey) - min(c_custkey)) * (max(c_acctbal) - min(c_acctbal)), 2) AS area FROM customer GROUP BY c_nationkey""")
def shapefile_areas(spark, d):
    """Boxes of the customers of each nation, written as a shapefile; their areas from the edges of what is read."""
    path = files.shared_folder(spark)
    span = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("x1"), F.max("c_custkey").alias("x2"), F.min("c_acctbal").alias("y1"), F.max("c_acctbal").alias("y2"))
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    boxes = span.select(F.col("c_nationkey").alias("geom_id"), F.lit(0).alias("ring_id"), F.array(corner("x1", "y1"), corner("x1", "y2"), corner("x2", "y2"), corner("x2", "y1")).alias("vertices"))
    shapefile.write_shapefile(boxes, path)
    edges = spatial.edge_table(files.read_shapefile(spark, path))
    return rounded(edges.groupBy("geom_id").agg(F.abs(F.sum((F.col("x1") + F.col("x2")) / 2 * (F.col("y2") - F.col("y1")))).alias("area")), 2, "area")


@query(f"""WITH {GRID}, waves AS (SELECT j % 5 AS m, j // 5 % 4 AS l, j // 20 % 2 AS row, i AS k, 1 + (j // 40 + 2) % 3 AS block, f AS coef FROM grid)
SELECT row_number() OVER (ORDER BY m, block, l, row, k) - 1 AS "at", round(coef, 4) AS value FROM waves""")
def raw_dump(spark, d):
    """Packed coefficients, written as one raw file and read by ranges."""
    path = files.shared_folder(spark)
    spectral.dump(spectral.packed(coefficients(spark, d), ["vor", "div", "t"]), path)
    return rounded(vectors.scan(spark, path, "<f8"), 4, "value").select("at", "value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(month(o_orderdate) <= 6 AS INT) AS VARCHAR) AS half FROM orders")
def delimited_records(spark, d):
    """Orders, appended as delimited text by halves of the year and read again."""
    path = files.shared_folder(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), (F.month("o_orderdate") <= 6).cast("int").alias("half"))
    for half in (0, 1):
        files.append_records(rows.where(F.col("half") == half), path)
    return files.read_records(spark, path, rows.columns)


@query(f"WITH {SALES} SELECT CAST(year(time) AS INT) AS year, CAST(time AS VARCHAR) AS time, lat, lon, round(x, 4) AS x FROM sales WHERE year(time) IN (1993, 1995)")
def cached_cube(spark, d):
    """The sales cube, computed once and kept by years; the second call reads what the first has written."""
    path = files.shared_folder(spark)
    named = lambda: normalise(sales_cube(spark, d).withColumnRenamed("time", "valid_time"), {"valid_time": "time"}).withColumn("year", F.year("time"))
    files.write_cube(files.cached(spark, f"{path}/cube", named), f"{path}/years")
    cube = files.read_cube(spark, f"{path}/years", "x", dims=("year", "time", "lat", "lon")).where("year IN (1993, 1995)")
    return texted(rounded(cube, 4, "x"), "time").select("year", "time", "lat", "lon", "x")


# --- streams -----------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS start, event_type, count(value) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return rounded(windows.tumbling(table(spark, d, "events"), "1 day", ["event_type"], "value"), 2, "total").select(F.to_date("start").cast("string").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "6 hours", ["user_id"]).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "user_id", "n")


# --- beyond SQL --------------------------------------------------------------------------------------------


def flow(spark, d) -> DataFrame:
    """A wind field over the whole grid."""
    return price_grid(spark, d).select("lat", "lon", (F.col("f") / 1000).alias("u"), (F.col("g") * 100).alias("v"), F.lit(1).alias("k"))


@query()
def poisson_sor(spark, d):
    rows = calculus.vorticity(flow(spark, d), ["k"], to="rhs").select("k", "lat", "lon", "rhs")
    return elliptic.poisson(rows, ["k"], "rhs", "psi", method="sor", omega=1.5, tol=1e-3, max_iter=2000)


# Sines along the 48 inner longitudes, elimination along the 5 inner latitudes, and sines back; the ring is 0.
ACROSS, ALONG = f"pow({RE} * cos(radians(10.0 * i)), 2)", f"pow({RE} * radians(10.0::DOUBLE), 2)"
VORTICITY, DIVERGENCE = f"{w3('v', 'lat', 'lon')} / {DX} - {w3('u', 'lon', 'lat')} / {DY}", f"{w3('u', 'lat', 'lon')} / {DX} + {w3('v', 'lon', 'lat')} / {DY} - v * tan(radians(lat)) / {RE}"
POISSON = f"""flow AS (SELECT i, j, lat, lon, f / 1000 AS u, g * 100 AS v FROM grid),
rhs AS (SELECT i, j, {VORTICITY} AS r FROM flow),
k AS (SELECT k, -4 * pow(sin({math.pi!r} * k / 98), 2) / pow(radians(5.0::DOUBLE), 2) AS e FROM range(1, 49) t(k)),
wave AS (SELECT i, k, e / {ACROSS} - 2 / {ALONG} AS b, sum(r * sin({math.pi!r} * (j - 1) * k / 49)) AS f FROM rhs, k WHERE i BETWEEN 2 AND 6 AND j BETWEEN 2 AND 49 GROUP BY i, k, e),
up AS (
  SELECT i, k, 1 / {ALONG} / b AS c, f / b AS d FROM wave WHERE i = 2
  UNION ALL SELECT w.i, w.k, 1 / {ALONG} / (b - c / {ALONG}), (f - d / {ALONG}) / (b - c / {ALONG}) FROM up JOIN wave w ON w.k = up.k AND w.i = up.i + 1),
down AS (SELECT i, k, d AS x FROM up WHERE i = 6 UNION ALL SELECT up.i, up.k, up.d - up.c * x FROM down JOIN up ON up.k = down.k AND up.i = down.i - 1),
psi AS (SELECT i, j, 2.0::DOUBLE / 49 * sum(x * sin({math.pi!r} * (j - 1) * k / 49)) AS psi FROM down, range(2, 50) t(j) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {GRID}, {POISSON} SELECT lat, lon, round(coalesce(psi, 0), 2) AS psi FROM grid LEFT JOIN psi USING (i, j)")
def poisson_separated(spark, d):
    rows = calculus.vorticity(flow(spark, d), ["k"], to="rhs").select("k", "lat", "lon", "rhs")
    return rounded(elliptic.poisson(files.stored(rows), ["k"], "rhs", "psi", method="separated"), 2, "psi").select("lat", "lon", "psi")


def potential_sql(poisson: str, name: str, u: str, v: str) -> str:
    """SQL of a potential, the solution with the other sign, and its wind; nothing on the ring."""
    inner = lambda x, digits: f"CASE WHEN i BETWEEN 2 AND 6 AND j BETWEEN 2 AND 49 THEN round({x}, {digits}) END"
    return f"""WITH RECURSIVE {GRID}, {poisson}, p AS (SELECT i, j, lat, lon, -coalesce(psi, 0) AS p FROM grid LEFT JOIN psi USING (i, j)),
g AS (SELECT *, {w3('p', 'lat', 'lon')} / {DX} AS gx, {w3('p', 'lon', 'lat')} / {DY} AS gy FROM p)
SELECT lat, lon, {inner('p', 2)} AS {name}, {inner(u, 6)} AS u_{name}, {inner(v, 6)} AS v_{name} FROM g"""


@query(potential_sql(POISSON, "psi", "-gy", "gx"))
def stream_function(spark, d):
    out = elliptic.stream_function(flow(spark, d), ["k"])
    return rounded(rounded(out, 2, "psi"), 6, "u_psi", "v_psi").select("lat", "lon", "psi", "u_psi", "v_psi")


@query(potential_sql(POISSON.replace(VORTICITY, DIVERGENCE), "chi", "gx", "gy"))
def velocity_potential(spark, d):
    out = elliptic.velocity_potential(flow(spark, d), ["k"])
    return rounded(rounded(out, 2, "chi"), 6, "u_chi", "v_chi").select("lat", "lon", "chi", "u_chi", "v_chi")


@query()
def prototype_stream_function(spark, d):
    return elliptic.prototype_stream_function(flow(spark, d), ["k"])


KERNEL = "k AS (SELECT CAST(d AS INT) AS d, w FROM (VALUES " + ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in enumerate(window.gaussian_kernel(1.0).tolist(), -4)) + ") t(d, w))"


def mirrored(c: str, last: int) -> str:
    """SQL of a place beyond an axis, mirrored into it."""
    return f"CASE WHEN g.{c} + k.d < 1 THEN 1 - (g.{c} + k.d) WHEN g.{c} + k.d > {last} THEN {2 * last + 1} - (g.{c} + k.d) ELSE g.{c} + k.d END"


@query(f"""WITH {GRID}, {KERNEL}, a AS (SELECT g.i, g.j, g.lat, g.lon, sum(k.w * s.f) AS f FROM grid g, k, grid s WHERE s.j = g.j AND s.i = {mirrored('i', 7)} GROUP BY 1, 2, 3, 4)
SELECT 1 AS k, g.lat, g.lon, round(sum(k.w * s.f), 4) AS f FROM a g, k, a s WHERE s.i = g.i AND s.j = {mirrored('j', 50)} GROUP BY 1, 2, 3""")
def gaussian_filter(spark, d):
    return rounded(from_slab(window.gaussian_filter(to_slab(price_grid(spark, d).withColumn("k", F.lit(1)), ["k"], "f")), ["k"], "f"), 4, "f")


def full_cells(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("time"), F.col("l_linenumber").alias("lat"), (F.col("l_quantity").cast("int") % 10).alias("lon")).agg(F.avg("l_extendedprice").alias("x"))


@query()
def eof(spark, d):
    return modes.eof(full_cells(spark, d), "time", ["lat", "lon"], "x")[0]


@query()
def pcs(spark, d):
    return modes.eof(full_cells(spark, d), "time", ["lat", "lon"], "x")[1]


@query()
def variance_fraction(spark, d):
    return modes.eof(full_cells(spark, d), "time", ["lat", "lon"], "x")[2]


@query()
def kmeans(spark, d):
    return modes.kmeans(samples(spark, d), 4).select("sample", "type")


@query()
def cluster_curve(spark, d):
    return modes.cluster_curve(samples(spark, d))


@query()
def eemd(spark, d):
    monthly = daily_series(spark, d).groupBy(F.trunc("d", "month").alias("t")).agg(F.avg("x").alias("x")).withColumn("name", F.lit("price"))
    return modes.eemd(to_series(monthly, ["name"], "t", "x"), ["name"], trials=200)


def model_slab(spark, d) -> DataFrame:
    """Prices stretched over the model grid."""
    values = price_grid(spark, d).select("i", "j", "f")
    grid = forcing.model_grid(spark).withColumn("i", (1 + F.floor((F.col("lat") + 90) / 180 * 6.999)).cast("int")).withColumn("j", (1 + F.floor(F.col("lon") / 360 * 49.999)).cast("int"))
    return to_slab(grid.join(values, ["i", "j"]).withColumn("k", F.lit(1)), ["k"], "f")


@query()
def sht_forward(spark, d):
    return spectral.to_waves(model_slab(spark, d), ["k"])


@query()
def sht_inverse(spark, d):
    return spectral.to_grid(sht_forward(spark, d), ["k"]).select("k", F.posexplode("data").alias("at", "value"))


@query()
def sht_gradient_x(spark, d):
    return spectral.to_waves(model_slab(spark, d), ["k"], gradient="X")


@query()
def sht_gradient_y(spark, d):
    return spectral.to_waves(model_slab(spark, d), ["k"], gradient="Y")


@query()
def sht_gradient_grid(spark, d):
    return spectral.to_grid(sht_forward(spark, d), ["k"], gradient="X").select("k", F.posexplode("data").alias("at", "value"))


# --- further selections, keys and forcing ------------------------------------------------------------------


@query(f"WITH {GRID} SELECT lat, lon, round(f, 4) AS f FROM grid WHERE i = 3 AND j = 7")
def exact_labels(spark, d):
    return rounded(select.at(price_grid(spark, d), i=3, j=7), 4, "f").select("lat", "lon", "f")


@query(f"WITH {GRID} SELECT i, j, CAST(CASE WHEN (CASE WHEN f > 51000 THEN f ELSE 0 END) = 0 THEN 0 ELSE 1 END AS INT) AS flag FROM grid")
def binarised(spark, d):
    return price_grid(spark, d).select("i", "j", select.binary(select.keep_above(F.col("f"), 51000.0)).alias("flag"))


@query(f"WITH {GRID} SELECT i, j, round(f, 4) AS f FROM grid WHERE f > 51000")
def present_cells(spark, d):
    rows = price_grid(spark, d).withColumn("f", select.null_unless(F.col("f") > 51000, F.col("f")))
    return rounded(select.present(rows, "f"), 4, "f").select("i", "j", "f")


@query(f"WITH {MONTHLY} SELECT CAST(time AS VARCHAR) AS time, CAST(row_number() OVER (PARTITION BY time ORDER BY lat, lon) - 1 AS INT) AS at, round(x, 4) AS x FROM monthly")
def flattened_space(spark, d):
    flat = select.flatten(monthly_cube(spark, d), ["time"], ["lat", "lon"], "x")
    return texted(rounded(flat.select("time", F.posexplode("features").alias("at", "x")), 4, "x"), "time")


@query(f"WITH {GRID} SELECT lat, lon, 0 AS time, 500.0::DOUBLE AS lev, round(f, 4) AS f FROM grid")
def constant_dims(spark, d):
    return rounded(select.with_constants(price_grid(spark, d).select("lat", "lon", "f"), time=0, lev=500.0), 4, "f").select("lat", "lon", "time", "lev", "f")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS date, 'order ' || o_orderkey || ' of ' || o_custkey AS label, least(o_orderkey, o_custkey) AS low, greatest(o_orderkey, o_custkey) AS high,
round(o_totalprice / 86400, 6) AS rate, round(3 + 0.5 * o_totalprice, 2) AS line FROM orders""")
def scalar_helpers(spark, d):
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    label = F.format_string("order %d of %d", "o_orderkey", "o_custkey")
    values = (steady(scalar.per_second(F.col("o_totalprice")), 6).alias("rate"), steady(scalar.line(F.col("o_totalprice"), F.lit(0.5), F.lit(3.0)), 2).alias("line"))
    return table(spark, d, "orders").select("o_orderkey", scalar.day_of(number).cast("string").alias("date"), label.alias("label"), F.least("o_orderkey", "o_custkey").alias("low"), F.greatest("o_orderkey", "o_custkey").alias("high"), *values)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(k AS INT) AS \"at\", 10 + 2.5::DOUBLE * k AS x, 0.0::DOUBLE AS zero, 1961 + k AS year FROM nation, range(0, 4) t(k)")
def generated_axes(spark, d):
    axes = F.arrays_zip(scalar.grid_axis(10.0, 2.5, 4).alias("x"), scalar.zeros(4).alias("zero"), F.sequence(F.lit(1961).cast("long"), F.lit(1964).cast("long")).alias("year"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.posexplode(axes).alias("at", "v")).select("n_nationkey", "at", "v.x", "v.zero", "v.year")


@query(f"""WITH {FRACTION}, e AS (SELECT time, CAST(year(time) * 100 + dayofyear(time) - 1 AS INT) AS key FROM frac WHERE fraction >= 0.2)
SELECT CAST(key % 4 AS INT) AS type, lat, lon, count(*) AS n, CAST(sum(flag) AS DOUBLE) AS hits FROM flags JOIN e USING (time) GROUP BY 1, 2, 3""")
def event_members(spark, d):
    """Cells of event days by the type of the day, as a clustering of the days would give it."""
    cube = dated(spark, d)
    threshold = reduce.quantile(cube, "x", 0.8)
    events = climate.extreme_events(cube, "x", threshold=threshold)
    types = events.select("year", "dos", (F.col("key") % 4).cast("int").alias("type"))
    rows = joins.align(climate.event_samples(cube, events, "x", threshold), types, ["year", "dos"])
    return rows.groupBy("type", "lat", "lon").agg(F.count("*").alias("n"), F.sum("flag").alias("hits"))


@query()
def event_clusters(spark, d):
    """Event days by the cluster of their flags, and the mean flag of each cell over a cluster's days."""
    cube = dated(spark, d)
    threshold = reduce.quantile(cube, "x", 0.8)
    members = files.stored(climate.event_samples(cube, climate.extreme_events(cube, "x", threshold=threshold), "x", threshold))
    cells = members.select("lat", "lon").distinct()
    full = members.select("year", "dos").distinct().crossJoin(F.broadcast(cells)).join(members, ["year", "dos", "lat", "lon"], "left").withColumn("flag", F.coalesce("flag", F.lit(0.0)))
    types = modes.kmeans(select.flatten(full, ["year", "dos"], ["lat", "lon"], "flag"), 4).select("year", "dos", "type")
    return members.join(types, ["year", "dos"]).groupBy("type", "lat", "lon").agg(F.count("*").alias("n"), F.avg("flag").alias("mean"))


@query(f"""WITH {GRID}, {STACK}, {values_sql('lon', [7.5, 101.0, 300.0])}, {values_sql('lat', [14.0, 33.0])}, {values_sql('lev', [100.0, 150.0])},
f AS (SELECT tlev AS lev, tlat AS lat, tlon AS lon, sum({hat('tlon', 'lon', 5.0)} * {hat('tlat', 'lat', 10.0)} * {hat('tlev', 'lev', 100.0)} * f) AS f FROM stack, t_lon, t_lat, t_lev GROUP BY 1, 2, 3)
SELECT lev, lat, lon, round(CASE WHEN lon <= 250 THEN f ELSE 0 END, 2) AS v, 0.0::DOUBLE AS d, round(CASE WHEN lon <= 250 THEN -f ELSE 0 END, 2) AS t, 0.0::DOUBLE AS p FROM f""")
def forcing_on_axes(spark, d):
    stack = files.stored(price_grid(spark, d)).crossJoin(axis(spark, "lev", [100.0, 200.0, 300.0])).withColumn("v", F.col("f") * F.col("lev")).withColumn("t", -F.col("v")).withColumn("p", F.col("v"))
    axes = {"lev": axis(spark, "lev", [100.0, 150.0]), "lat": axis(spark, "lat", [14.0, 33.0]), "lon": axis(spark, "lon", [7.5, 101.0, 300.0])}
    return rounded(forcing.on_axes(stack, [], axes, {"p": 0.0}), 2, "v", "t").select("lev", "lat", "lon", "v", "d", "t", "p")


WAVES = "waves AS (SELECT j % 5 AS m, j // 5 % 4 AS l, CASE WHEN j // 20 % 2 = 0 THEN 're' ELSE 'im' END AS part, i AS k, ['t', 'vor', 'div'][1 + (j // 40) % 3] AS var, f AS coef FROM grid)"


def coefficients(spark, d) -> DataFrame:
    """Prices as if they were coefficients of three variables."""
    whole = lambda n: F.floor(F.col("j") / n)
    var = F.element_at(F.array(*map(F.lit, ("t", "vor", "div"))), (1 + whole(40) % 3).cast("int"))
    return price_grid(spark, d).select((F.col("j") % 5).alias("m"), (whole(5) % 4).cast("int").alias("l"), F.when(whole(20) % 2 == 0, "re").otherwise("im").alias("part"), F.col("i").alias("k"), var.alias("var"), F.col("f").alias("coef"))


@query(f"""WITH {GRID}, {WAVES}, b AS (SELECT *, CASE var WHEN 'vor' THEN 1 WHEN 'div' THEN 2 ELSE 3 END AS block, CASE part WHEN 're' THEN 0 ELSE 1 END AS row FROM waves)
SELECT CAST(row_number() OVER (ORDER BY m, block, l, row, k, coef) AS INT) AS at, CAST(m AS INT) AS m, CAST(block AS INT) AS block, CAST(l AS INT) AS l, CAST(row AS INT) AS row, CAST(k AS INT) AS k, round(coef, 4) AS coef FROM b""")
def packed_forcing(spark, d):
    rows = select.numbered(spectral.packed(coefficients(spark, d), ["vor", "div", "t"]), ["m", "block", "l", "row", "k", "coef"])
    return rounded(rows.withColumn("at", (F.col("_place") + 1).cast("int")), 4, "coef").select("at", "m", "block", "l", "row", "k", "coef")


@query(f"""WITH {GRID}, {WAVES}, p AS (SELECT m, l, row_number() OVER (ORDER BY l, m) AS n FROM range(0, 43) a(m), range(0, 43) b(l) WHERE m <= 42 - l)
SELECT CAST(m AS INT) AS m, CAST(l AS INT) AS l, part, k, var, CAST(CASE part WHEN 're' THEN 2 * n - 1 ELSE 2 * n END AS INT) AS "at", round(coef, 4) AS coef FROM waves JOIN p USING (m, l)""")
def nmo_index(spark, d):
    """Where each coefficient stands in the model's array."""
    places = spectral.index_map(spark)
    rows = coefficients(spark, d).join(F.broadcast(places), ["m", "l"])
    at = F.when(F.col("part") == "re", F.col("re_index")).otherwise(F.col("im_index"))
    return rows.select("m", "l", "part", "k", "var", at.alias("at"), steady("coef", 4).alias("coef"))


@query(f"WITH {GRID} SELECT i, j, round(-j * g, 6) AS re, round(j * f, 4) AS im FROM grid")
def zonal_derivative(spark, d):
    re, im = spectral.zonal_derivative(F.col("j"), F.col("f"), F.col("g"))
    return price_grid(spark, d).select("i", "j", steady(re, 6).alias("re"), steady(im, 4).alias("im"))


@query("""SELECT CAST(epoch_us(s) AS BIGINT) AS start, event_type, count(value) AS n, round(sum(value), 2) AS total FROM (
  SELECT date_trunc('day', ts) - k * INTERVAL 12 HOUR + INTERVAL 12 HOUR AS s, ts, event_type, value FROM events, range(0, 3) t(k)) WHERE ts >= s AND ts < s + INTERVAL 24 HOUR GROUP BY 1, 2""")
def event_sliding(spark, d):
    out = windows.sliding(table(spark, d, "events"), "24 hours", "12 hours", ["event_type"], "value")
    return rounded(out, 2, "total").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", "total")
