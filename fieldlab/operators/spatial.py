"""Polygon masks: an edge table and the crossing rule, evaluated once for each distinct grid point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_table(geometries: DataFrame, geom: str = "geom_id", ring: str = "ring_id", vertices: str = "vertices") -> DataFrame:
    """(geom, x1, y1, x2, y2): the edges of closed rings of (x, y) vertices."""
    v = F.col(vertices)
    pairs = F.arrays_zip(v.alias("a"), F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1)).alias("b"))
    rows = geometries.select(geom, ring, F.explode(pairs).alias("e"))
    return rows.select(geom, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("y1 <> y2")


def polygons(spark: SparkSession, rings: list[list[tuple[float, float]]], geom: int = 0) -> DataFrame:
    rows = [(geom, i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "geom_id int, ring_id int, vertices array<struct<x:double,y:double>>")


#: Heights of latitude bands, as powers of two: an edge is in the (at most two) bands of about its own height that it crosses.
LEVELS = (-8, 12)


def crossings(lats: DataFrame, edges: DataFrame, lat: str, geom: str) -> DataFrame:
    """(lat, geom, xs): where each geometry's edges cross each of these latitudes.

    An equi-join by level and band: a latitude meets the edges of one band of each level, not all edges. Lower edges
    than the lowest level belong to it, higher ones than the highest have one band for each part of their height.
    """
    low, high = LEVELS
    height = F.abs(F.col("y2") - F.col("y1"))
    level = F.greatest(F.least(F.ceil(F.log2(height)), F.lit(high)), F.lit(low)).cast("int")
    band = lambda y, level: F.floor(y / F.pow(F.lit(2.0), level))
    spans = edges.withColumn("_level", level)
    spans = spans.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2"), F.col("_level")), band(F.greatest("y1", "y2"), F.col("_level")))))
    wanted = lats.select(lat, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_level")).withColumn("_band", band(F.col(lat), F.col("_level")))
    y = F.col(lat)
    met = wanted.join(spans, ["_level", "_band"]).where((F.col("y1") > y) != (F.col("y2") > y))
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return met.groupBy(lat, geom).agg(F.collect_list(x).alias("_xs"))


def inside(points: DataFrame, edges: DataFrame, lat: str = "lat", lon: str = "lon", geom: str = "geom_id") -> DataFrame:
    """The distinct points in the union of the geometries: an odd number of a geometry's edges is crossed going east.

    Crossings are found once for each distinct latitude; a point then counts those to the east of it.
    """
    grid = points.select(lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    found = crossings(grid.select(lat).distinct(), edges, lat, geom)
    hits = grid.join(found, lat).where(F.size(F.filter("_xs", lambda x: F.col(lon) < x)) % 2 == 1)
    return hits.select(lat, lon).distinct()


def masked(df: DataFrame, edges: DataFrame, values: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Values outside become missing; cells stay."""
    kept = inside(df, edges, lat, lon).withColumn("_in", F.lit(True))
    rows = df.join(kept, [lat, lon], "left")
    return rows.withColumns({v: F.when(F.col("_in"), F.col(v)) for v in values}).drop("_in")


def geojson(geometries: DataFrame, geom: str = "geom_id", ring: str = "ring_id", vertices: str = "vertices") -> DataFrame:
    """One feature (JSON text) for each geometry; write with the text sink."""
    closed = F.concat(F.transform(vertices, lambda p: F.array(p["x"], p["y"])), F.transform(F.slice(vertices, 1, 1), lambda p: F.array(p["x"], p["y"])))
    rings = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ring), closed.alias("c")))), lambda r: r["c"])
    shape = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return geometries.groupBy(geom).agg(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.first(geom).alias(geom)).alias("properties"), shape.alias("geometry"))).alias("value"))
