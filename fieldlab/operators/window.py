"""Neighbourhood operators along an axis, as window expressions over (keys, order)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.operators import select


def axis(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def shifted(x: str, keys: list[str], order: str, by: int = 1) -> Column:
    return F.lag(x, by).over(axis(keys, order))


#: Rows of a chunk of a long history.
CHUNK = 100_000


def chunked(df: DataFrame, keys: list[str], order: str, reach: int, work: Callable[[DataFrame, list[str]], DataFrame], size: int | None = None) -> DataFrame:
    """work(rows, keys) of an operator whose values need at most reach rows before and behind, by chunks of each history.

    For histories that are too long for a task each, or one without keys: rows are numbered along (keys, order), and a
    chunk is size of them, with reach rows of the chunks beside it, which are dropped from the result. What work returns
    keeps the columns _chunk and _own.
    """
    size = max(size or CHUNK, reach, 1)
    rows = select.numbered(df, [*keys, order])
    at, chunk = F.col("_place") % size, F.expr(f"_place DIV {size}")
    beside = F.array_compact(F.array(chunk, F.when(at < reach, chunk - 1), F.when(at >= size - reach, chunk + 1)))
    rows = rows.withColumn("_chunk", F.explode(beside)).withColumn("_own", F.col("_chunk") == chunk)
    return work(rows, [*keys, "_chunk"]).where("_own").drop("_own", "_chunk", "_place")


def edges(w, reach: int = 1) -> tuple[Column, Column]:
    """Whether a row has fewer than reach rows before it, and behind it."""
    return F.lag(F.lit(1), reach).over(w).isNull(), F.lead(F.lit(1), reach).over(w).isNull()


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int = 5, by_chunks: bool = False) -> DataFrame:
    """Centred mean of full windows without a missing value; days are numbered anew from 1. by_chunks: see chunked."""
    half = width // 2

    def run(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = axis(keys, order)
        near = w.rowsBetween(-half, half)
        early, late = edges(w, half) if half else (F.lit(False), F.lit(False))
        rows = rows.withColumns({"_n": F.count(value).over(near), "_mean": F.avg(value).over(near), "_short": early | late})
        return rows.where("NOT _short").withColumn(value, F.when(F.col("_n") == width, F.col("_mean"))).drop("_n", "_mean", "_short")

    if not by_chunks:
        rows = run(df.withColumn("_at", F.row_number().over(axis(keys, order))), keys)
        return rows.withColumn("day", (F.col("_at") - half).cast("int")).drop("_at")
    out = chunked(df, keys, order, half, lambda rows, own: run(rows, own).withColumn("_at", F.col("_place")))
    first = out.groupBy(*keys).agg(F.min("_at").alias("_first"))
    out = out.join(first, keys) if keys else out.crossJoin(F.broadcast(first))
    return out.withColumn("day", (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first")


def index_gradient(x: str | Column, keys: list[str], order: str) -> Column:
    """Centred difference by 2 inside, one-sided at the ends; edges are told by place, not by missing values."""
    x, w = F.col(x) if isinstance(x, str) else x, axis(keys, order)
    (first, last), before, after = edges(w), F.lag(x).over(w), F.lead(x).over(w)
    return F.when(first & last, None).when(first, after - x).when(last, x - before).otherwise((after - before) / 2)


def derivative(x: str | Column, along: str | Column, keys: list[str], order: str) -> Column:
    """Ratio of two index gradients."""
    return F.try_divide(index_gradient(x, keys, order), index_gradient(along, keys, order))


def coordinate_gradient(x: str | Column, along: str | Column, keys: list[str], order: str) -> Column:
    """Second-order derivative on an uneven axis, one-sided at the ends."""
    x, c = (F.col(a) if isinstance(a, str) else a for a in (x, along))
    w = axis(keys, order)
    first, last = edges(w)
    xb, xa, hs, hd = F.lag(x).over(w), F.lead(x).over(w), c - F.lag(c).over(w), F.lead(c).over(w) - c
    inside = F.try_divide(hs * hs * xa + (hd * hd - hs * hs) * x - hd * hd * xb, hs * hd * (hs + hd))
    return F.when(first & last, None).when(first, F.try_divide(xa - x, hd)).when(last, F.try_divide(x - xb, hs)).otherwise(inside)


def tendency(x: str, keys: list[str], time: str) -> Column:
    """Change per time step: forward, centred, backward."""
    return index_gradient(x, keys, time)


def centred_difference(x: str, keys: list[str], order: str) -> Column:
    """Next minus previous value; NULL at the ends."""
    w = axis(keys, order)
    return F.lead(x).over(w) - F.lag(x).over(w)


def detrended(df: DataFrame, keys: list[str], x: str, y: str, to: str = "residual") -> DataFrame:
    """y minus its least-squares line over x."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    rows = df.join(fit, keys) if keys else df.crossJoin(F.broadcast(fit))
    return rows.withColumn(to, F.col(y) - (F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


def standardised(df: DataFrame, keys: list[str], x: str, to: str = "z") -> DataFrame:
    """z-scores with the population standard deviation."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    rows = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return rows.withColumn(to, F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def smoothed(field: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    k = gaussian_kernel(sigma)
    reach = len(k) // 2
    for a in (0, 1):
        padded = np.pad(field, [(reach, reach) if d == a else (0, 0) for d in (0, 1)], mode="symmetric")
        field = np.apply_along_axis(np.convolve, a, padded, k, mode="valid")
    return field


def gaussian_filter(slabs: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Smoothed slabs; each is one row, so fields are filtered in parallel."""

    def run(frames):
        for frame in frames:
            frame["data"] = [smoothed(np.array(d, float).reshape(len(y), len(x)), sigma).ravel() for y, x, d in zip(frame["lat"], frame["lon"], frame["data"], strict=True)]
            yield frame

    return slabs.mapInPandas(run, slabs.schema)
