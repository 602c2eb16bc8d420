"""Selection, slicing and masking of long cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variables(df: DataFrame, dims: list[str], *names: str) -> DataFrame:
    """Only these variables of a dataset."""
    return df.select(*dims, *names)


def at(df: DataFrame, **labels) -> DataFrame:
    """Exact labels; pushed to the scan."""
    for name, label in labels.items():
        df = df.where(F.col(name) == F.lit(label))
    return df


def between(df: DataFrame, dim: str, low, high) -> DataFrame:
    """Label range, both ends included."""
    return df.where(F.col(dim).between(low, high))


def months(df: DataFrame, time: str, wanted: list[int]) -> DataFrame:
    if not wanted or not set(wanted) <= set(range(1, 13)):
        raise ValueError("months are 1 to 12")
    return df.where(F.month(time).isin(wanted))


def bbox(df: DataFrame, west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    if south > north or west > east:
        raise ValueError("corners are lower left, upper right")
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def keep_above(x: Column, limit: float = 0.0, other: float = 0.0) -> Column:
    """Values above a limit; what isn't, or is missing, becomes `other`."""
    return F.when(x > limit, x).otherwise(F.lit(other))


def binary(x: Column) -> Column:
    """0 where 0, else 1 (missing too)."""
    return F.when(x == 0, 0).otherwise(1)


def null_unless(condition: Column, x: Column) -> Column:
    return F.when(condition, x)


def null_band(lat: Column, x: Column, within: float = 20.0, inclusive: bool = False) -> Column:
    """NULL in a latitude band about the equator."""
    return F.when(F.abs(lat) > within if inclusive else F.abs(lat) >= within, x)


def null_poles(lat: Column, x: Column) -> Column:
    return F.when(F.abs(lat) < 90, x)


def with_ring(df: DataFrame, keys: list[str], rows: str = "lat", columns: str | None = "lon") -> DataFrame:
    """df with _ring: whether a cell is on the outer ring (or in the first and last row) of its field."""
    axes = (rows, *([columns] if columns else []))
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{k}_{c}") for c in axes for k, f in (("lo", F.min), ("hi", F.max))])
    df = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # without keys ends is one row
    ring = F.lit(False)
    for c in axes:
        ring = ring | (F.col(c) == F.col(f"_lo_{c}")) | (F.col(c) == F.col(f"_hi_{c}"))
    return df.withColumn("_ring", ring).drop(*ends.drop(*keys).columns)


def null_ring(df: DataFrame, keys: list[str], values: list[str], rows: str = "lat", columns: str | None = "lon") -> DataFrame:
    df = with_ring(df, keys, rows, columns)
    return df.withColumns({v: F.when(~F.col("_ring"), F.col(v)) for v in values}).drop("_ring")


def interior(df: DataFrame, keys: list[str], rows: str = "lat", columns: str = "lon") -> DataFrame:
    """Without the outer ring."""
    return with_ring(df, keys, rows, columns).where("NOT _ring").drop("_ring")


def drop_empty(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Without the samples (or cells) all of whose values are missing."""
    some = df.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0").select(*by)
    return df.join(some, by, "left_semi")


def present(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull())


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def null_to_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def significant(r: Column, limit: float | Column) -> Column:
    """0 where |r| reaches the limit, else NULL."""
    return F.when(F.abs(r) >= limit, 0.0)


def first_match(df: DataFrame, key: str, wanted, order: str) -> DataFrame:
    """The first row with a key."""
    return df.where(F.col(key) == F.lit(wanted)).orderBy(order).limit(1)


#: Parts that a large table is cut into to order its rows, rows that one part may have, and rows sampled for each part.
PARTS, PART_ROWS, SAMPLED = 196, 100_000, 200


def ordered_key(df: DataFrame, order: list[str]) -> Column:
    """The whole order, and a hash of the other columns that tells rows with equal keys apart."""
    others = [c for c in df.columns if c not in order]
    return F.struct(*order, *([F.xxhash64(*others).alias("_tie")] if others else []))


def cuts_of(df: DataFrame, order: list[str]) -> list[Column]:
    """Keys that cut df along an order into parts of about PART_ROWS rows (at most PARTS parts), from a sample of bounded size."""
    n = df.count()
    parts = min(PARTS, n // PART_ROWS + 1)
    if parts == 1:
        return []
    sample = df.select(ordered_key(df, order).alias("k")).sample(min(1.0, 1.1 * SAMPLED * parts / n), seed=1).orderBy("k")
    keys, kind = [r.k for r in sample.collect()], sample.schema["k"].dataType
    cuts = list(dict.fromkeys(keys[len(keys) * i // parts] for i in range(1, parts))) if keys else []
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind, strict=True)]) for c in cuts]


def parted(df: DataFrame, order: list[str], cuts: list[Column]) -> DataFrame:
    """df with _part, which never falls along an order, for tasks that each order one part.

    Only rows that are wholly equal can't be parted. A key is compared in two steps with about the root of the number of
    cuts each.
    """
    if not cuts:
        return df.withColumn("_part", F.lit(0))
    wide = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    upto = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("_key")))
    coarse = upto(F.array(*[g[0] for g in groups[1:]])) if len(groups) > 1 else F.lit(0)
    fine = upto(F.get(F.array(*[F.array(*g) for g in groups]), F.col("_coarse")))
    return df.withColumn("_key", ordered_key(df, order)).withColumn("_coarse", coarse).withColumn("_part", F.col("_coarse") * wide + fine).drop("_key", "_coarse")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _place, its rows' places from 0 in an order.

    A row's place is its place in its part plus the rows of the parts before, so no task sorts them all.
    """
    cuts, key = cuts_of(df, order), ordered_key(df, order)
    if not cuts:
        return df.withColumn("_place", F.row_number().over(Window.orderBy(key)) - 1)
    rows = parted(df, order, cuts)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # at most PARTS rows
    return rows.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1).drop("_part", "_start")


def positions(df: DataFrame, dim: str, first: int, end: int) -> DataFrame:
    """Rows whose label is at places first..end-1 (from 0) of the distinct labels."""
    labels = df.select(dim).distinct().orderBy(dim).offset(first).limit(max(0, end - first))
    return df.join(labels, dim, "left_semi")


def strided(df: DataFrame, dim: str, step: int) -> DataFrame:
    """Every step-th label, from the first on."""
    labels = numbered(df.select(dim).distinct(), [dim]).where(F.col("_place") % step == 0)
    return df.join(labels.select(dim), dim, "left_semi")


def cyclic_pad(df: DataFrame, lon: str = "lon", period: float = 360.0) -> DataFrame:
    """The first column once more, a period further east."""
    first = df.agg(F.min(lon).alias("_first"))
    again = df.join(F.broadcast(first), F.col(lon) == F.col("_first")).drop("_first").withColumn(lon, F.col(lon) + period)
    return df.unionByName(again)


def with_constants(df: DataFrame, **values) -> DataFrame:
    """New dimensions of one label."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def flatten(df: DataFrame, sample: list[str], cell: list[str], value: str) -> DataFrame:
    """(sample, features): each sample's values in the order of its cells, NULL for missing ones."""
    row = F.array_sort(F.collect_list(F.struct(*cell, F.col(value).alias("v"))))
    return df.groupBy(*sample).agg(F.transform(row, lambda x: x["v"]).alias("features"))
