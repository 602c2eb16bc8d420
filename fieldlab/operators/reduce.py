"""Reductions of long cubes. Missing values are skipped unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions import stats
from fieldlab.operators import select

#: Accuracy of the approximate quantiles that bound an exact one.
ACCURACY = 10_000
#: Values that are put in order by one task.
FEW = 1 << 18


def area_mean(df: DataFrame, by: list[str], values: list[str], cos_weight: bool = False, lat: str = "lat") -> DataFrame:
    """Mean over cells; by default every cell counts alike."""
    if not cos_weight:
        return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
    w = F.cos(F.radians(lat))
    return df.groupBy(*by).agg(*[F.try_divide(F.sum(w * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values])


def yearly_mean(df: DataFrame, time: str, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(F.year(time).alias("year"), *by).agg(*[F.avg(v).alias(v) for v in values])


def yearly_sum(df: DataFrame, time: str, by: list[str], values: list[str]) -> DataFrame:
    """All missing gives 0."""
    return df.groupBy(F.year(time).alias("year"), *by).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def climatology(df: DataFrame, first: int, last: int, by: list[str], values: list[str], year: str = "year") -> DataFrame:
    """Mean over a base period, both ends included."""
    return df.where(F.col(year).between(first, last)).groupBy(*by).agg(*[F.avg(v).alias(f"{v}_clim") for v in values])


def spread(df: DataFrame, first: int, last: int, by: list[str], values: list[str], year: str = "year") -> DataFrame:
    """Population standard deviation over a base period."""
    return df.where(F.col(year).between(first, last)).groupBy(*by).agg(*[F.stddev_pop(v).alias(f"{v}_std") for v in values])


def quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Exact quantile with linear interpolation.

    Over the whole table, rounds of approximate quantiles narrow the band about the wanted rank until at most FEW values
    are strictly inside; only these and the band's ends, added up by value, are put in order by one task.
    """
    if by:
        return df.groupBy(*by).agg(F.percentile(value, q).alias("q"))
    some = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    near = lambda share: [min(1.0, max(0.0, share + d / ACCURACY)) for d in (-3, 3)]
    r = some.agg(F.percentile_approx("v", near(q), ACCURACY).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    if r.n == 0:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("q"))
    at, low, high, below, inside, bounds = q * (r.n - 1), r.lo, r.hi, 0, r.n, r.b
    while inside > FEW:
        low = bounds[0] if near((at - below) / inside)[0] > 0 else low
        high = bounds[1] if near((at - below) / inside)[1] < 1 else high
        counts = some.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if((F.col("v") > low) & (F.col("v") < high)).alias("inside")).first()
        if counts.inside >= inside:  # can't be narrowed any more
            break
        below, inside = counts.below, counts.inside
        if inside > FEW:
            band = some.where(F.col("v").between(low, high))
            n = band.count()
            bounds, inside = band.agg(F.percentile_approx("v", near((at - below) / n), ACCURACY)).first()[0], n
    counted = some.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v")) + below
    ranked = counted.select("v", upto.alias("end"), (upto - F.col("n")).alias("start"))
    value_at = lambda place: F.max(F.when((F.col("start") <= place) & (place < F.col("end")), F.col("v")))
    ends = ranked.agg(value_at(math.floor(at)).alias("a"), value_at(math.ceil(at)).alias("b"))
    return ends.select((F.col("a") + (at - math.floor(at)) * (F.col("b") - F.col("a"))).alias("q"))


def valid_count(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"))


def area_fraction(df: DataFrame, by: list[str], flag: str, cells: DataFrame) -> DataFrame:
    """Sum of flags by the number of cells, a one-row table with n."""
    return df.groupBy(*by).agg(F.sum(flag).alias("hits")).crossJoin(F.broadcast(cells.select("n"))).withColumn("fraction", F.try_divide("hits", "n")).drop("n")


def composite(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over members; NULL where a member is missing."""
    return df.groupBy(*by).agg(F.when(F.count(value) == F.count(F.lit(1)), F.avg(value)).alias(value))


def event_counts(events: DataFrame, years: list[int], types: list[int]) -> DataFrame:
    """(year, type, n), 0 where there's none."""
    spark = events.sparkSession
    every = spark.createDataFrame([(y, t) for y in years for t in types], "year int, type int")
    n = events.groupBy("year", "type").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(n, ["year", "type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def pivot_sum(df: DataFrame, row: str, column: str, labels: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, labels).agg(F.sum(value))


def extremes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias("highest"), F.min(value).alias("lowest"), F.max(F.abs(value)).alias("largest"))


def equivalent_diameter(d: Column) -> Column:
    """Aggregate: diameter of the circle with the area of all circles."""
    return 2 * F.sqrt(F.sum(F.pow(d / 2, F.lit(2.0))))


def slope(y: str, x: str) -> Column:
    """Aggregate: least-squares slope of y on x; NULL for fewer than two pairs or constant x."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    return F.when(F.count(F.when(both, 1)) > 1, F.regr_slope(y, x))


def regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x for each cell."""
    both = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1))
    return df.groupBy(*by).agg(slope(y, x).alias("slope"), F.when(both > 1, F.regr_intercept(y, x)).alias("intercept"), both.alias("n"))


def correlation(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    n = F.count(F.when(both, 1))
    r = F.try_divide(F.covar_pop(y, x), F.stddev_pop(F.when(both, F.col(y))) * F.stddev_pop(F.when(both, F.col(x))))
    return df.groupBy(*by).agg(F.when(n > 1, r).alias("r"), n.alias("n"))


def significance(df: DataFrame, alpha: float = 0.05, r: str = "r", n: str = "n") -> DataFrame:
    """df with mark: 0 where |r| is significant for the cell's own number of pairs n, else NULL (always under 3 pairs)."""

    def limit(frames):
        for frame in frames:  # distinct numbers of times
            yield frame.assign(_limit=[stats.r_crit(int(c), alpha) for c in frame[n]])

    limits = df.select(F.col(n).cast("long").alias(n)).where(F.col(n) > 2).distinct().mapInPandas(limit, f"{n} long, _limit double")
    return df.join(limits, n, "left").withColumn("mark", select.significant(F.col(r), F.col("_limit"))).drop("_limit")


def profile_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over the horizontal, zeros taken as missing."""
    return df.groupBy(*by).agg(F.avg(F.nullif(F.col(value), F.lit(0.0))).alias(value))
