"""Linear interpolation: each target meets the cell of the axis that holds it, and weights multiply over axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.operators import select


def brackets(source: DataFrame, targets: DataFrame, dim: str, outside: str = "null") -> DataFrame:
    """(target, dim, weight): the one or two source labels of each target, with weights that add to 1.

    Targets outside the axis have no row; if outside is "error", the query fails on them. Only axes, not fields, are
    looked at, by a merge: labels and targets are put in order together, part by part, and each target takes the last
    label up to it and the first one after it, from its part or carried over from the parts before and behind.
    """
    labels = source.select(F.col(dim).cast("double").alias("x")).distinct().where("x IS NOT NULL").withColumn("label", F.col("x"))
    wanted = targets.select(F.col(dim).cast("double").alias("x")).distinct().where("x IS NOT NULL").withColumn("label", F.lit(None).cast("double"))
    rows = labels.unionByName(wanted)
    cuts = select.cuts_of(rows, ["x"])
    rows = select.parted(rows, ["x"], cuts)
    ends = rows.groupBy("_part").agg(F.max("label").alias("last"), F.min("label").alias("first"))  # at most select.PARTS rows
    before, behind = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_part", F.max("last").over(before).alias("_before"), F.min("first").over(behind).alias("_behind"))
    own = Window.partitionBy("_part").orderBy("x", F.asc_nulls_last("label"))
    low = F.last("label", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("label", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    merged = rows.withColumn("_low", low).withColumn("_high", high).where("label IS NULL")
    merged = merged.join(F.broadcast(carried), "_part") if cuts else merged.withColumns({"_before": F.lit(None), "_behind": F.lit(None)})
    found = merged.select(F.col("x").alias("target"), F.coalesce("_low", "_before").alias("_lo"), F.coalesce("_high", "_behind").alias("_hi"))
    held = (F.col("target") == F.col("_lo")) | (F.col("target").between(F.col("_lo"), F.col("_hi")))
    if outside == "error":
        found = found.withColumn("target", F.when(held, F.col("target")).otherwise(F.raise_error(F.lit(f"targets outside {dim}")).cast("double")))
    else:
        found = found.where(held)
    w = F.when(F.col("target") == F.col("_lo"), 0.0).otherwise((F.col("target") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    pair = F.array(F.struct(F.col("_lo").alias(dim), (1 - w).alias("weight")), F.struct(F.col("_hi").alias(dim), w.alias("weight")))
    out = found.select("target", F.explode(pair).alias("e")).select("target", F.col(f"e.{dim}").alias(dim), F.col("e.weight").alias("weight"))
    return out.where(F.col("weight") > 0)


def interpolate(df: DataFrame, keys: list[str], value: str, targets: dict[str, DataFrame], outside: str = "null", missing: float | None = None) -> DataFrame:
    """df on the target axes ({dim: one-column table}), linear in each; outside the hull or beside a missing value it's missing."""
    out, weight, corners = df, F.lit(1.0), 1
    every = None
    for dim, wanted in targets.items():
        axis = brackets(df, wanted, dim, outside)
        axis = axis.withColumnsRenamed({"target": f"_{dim}", "weight": f"_w_{dim}"}).withColumn(f"_n_{dim}", F.count("*").over(Window.partitionBy(f"_{dim}")))
        out = out.withColumn(dim, F.col(dim).cast("double")).join(axis, dim)
        weight, corners = weight * F.col(f"_w_{dim}"), corners * F.col(f"_n_{dim}")
        label = wanted.select(F.col(dim).cast("double").alias(dim)).distinct()
        every = label if every is None else every.crossJoin(label)
    dims = [f"_{d}" for d in targets]
    got = out.groupBy(*keys, *dims).agg(F.when(F.count(value) == F.max(corners), F.sum(weight * F.col(value))).alias(value)).withColumnsRenamed({f"_{d}": d for d in targets})
    every = df.select(*keys).distinct().crossJoin(every) if keys else every
    full = every.join(got, [*keys, *targets], "left")
    return full.withColumn(value, F.coalesce(value, F.lit(missing))) if missing is not None else full
