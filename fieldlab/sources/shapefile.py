"""ESRI shapefiles of polygons, written by many tasks at known offsets: .shp, .shx and .dbf beside each other.

A record's length follows from the numbers of its rings and vertices, so running sums over blocks of records tell where
each one stands before any of them is made. The format holds 4 GB, which bounds the number of blocks.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.operators.select import numbered
from fieldlab.sources import pieces
from fieldlab.sources.files import stored

#: Records of a block.
BLOCK = 1024
#: Bytes of a file's head, of a record without rings, of an index entry, of the table's head and of its records.
HEAD, EMPTY, ENTRY, TABLE_HEAD, TABLE_RECORD = 100, 52, 8, 65, 19
#: Lengths are counted in 16-bit words by signed 32-bit numbers.
MOST = 2 * (2**31 - 1)
POLYGON = 5


def head(size: int, box: tuple[float, float, float, float]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, POLYGON) + struct.pack("<8d", *box, 0, 0, 0, 0)


def table_head(n: int, column: str) -> bytes:
    field = column.encode()[:10].ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([TABLE_RECORD - 1, 0]) + b"\0" * 14
    return struct.pack("<4BIHH20x", 3, 70, 1, 1, n, TABLE_HEAD, TABLE_RECORD) + field + b"\r"


def record(number: int, rings: list[np.ndarray]) -> bytes:
    """A polygon; its rings are closed."""
    closed = [np.vstack([r, r[:1]]) for r in rings]
    xy = np.vstack(closed)
    starts = np.cumsum([0, *map(len, closed[:-1])])
    body = struct.pack("<i4d2i", POLYGON, *xy.min(0), *xy.max(0), len(closed), len(xy)) + starts.astype("<i4").tobytes() + xy.astype("<f8").tobytes()
    return struct.pack(">2i", number, len(body) // 2) + body


def write_shapefile(geometries: DataFrame, path: str, name: str = "shapes", geom: str = "geom_id", ring: str = "ring_id", vertices: str = "vertices") -> int:
    """Polygons (geom, ring, vertices of x and y) as a folder of name.shp, .shx and .dbf; how many there are.

    Records are in the order of the ids, which the table keeps (whole numbers). Rings keep their order and direction:
    the format wants outer ones clockwise. Rings without vertices aren't written, nor polygons without rings; null ids
    neither. The target has to be in a file system that all machines share and that can be written at offsets.
    """
    rows = geometries.select(F.col(geom).cast("long").alias("id"), F.col(ring).alias("ring"), F.col(vertices).alias("points")).where("id IS NOT NULL AND size(points) > 0")
    polygons = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    length = F.aggregate("rings", F.lit(EMPTY).cast("long"), lambda n, r: n + 4 + 16 * (F.size(r) + 1))
    polygons = stored(numbered(polygons.withColumn("bytes", length), ["id"]).withColumn("block", F.expr(f"_place DIV {BLOCK}")))
    x, y = (F.expr(f"flatten(transform(rings, r -> r.{c}))") for c in "xy")
    n, size, *box = polygons.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.min(F.array_min(x)), F.min(F.array_min(y)), F.max(F.array_max(x)), F.max(F.array_max(y))).first()
    if HEAD + size > MOST:
        raise ValueError(f"{HEAD + size} bytes are more than a shapefile holds")
    # At most MOST / EMPTY / BLOCK rows, so one task may order them and all may have them.
    sums = polygons.groupBy("block").agg(F.sum("bytes").alias("own"))
    starts = sums.select("block", (F.sum("own").over(Window.orderBy("block")) - F.col("own")).alias("start"))
    inside = Window.partitionBy("block").orderBy("_place")
    placed = polygons.join(F.broadcast(starts), "block").select("id", "rings", "_place", (HEAD + F.col("start") + F.sum("bytes").over(inside) - F.col("bytes")).alias("at"))

    def run(batches):
        for batch in batches:
            ids, places, ats, rings = (batch.column(c).to_pylist() for c in ("id", "_place", "at", "rings"))
            for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(places) != 1) + 1):
                if not len(own):
                    continue
                first, last = int(own[0]), int(own[-1])
                made = [record(places[i] + 1, [np.array([(p["x"], p["y"]) for p in r], float) for r in rings[i]]) for i in own]
                entries = b"".join(struct.pack(">2i", ats[i] // 2, (len(m) - 8) // 2) for i, m in zip(own, made, strict=True))
                lines = b"".join(b" %18d" % ids[i] for i in own) + (b"\x1a" if places[last] == n - 1 else b"")
                for kind, at, content in ((".shp", ats[first], b"".join(made)), (".shx", HEAD + ENTRY * places[first], entries), (".dbf", TABLE_HEAD + TABLE_RECORD * places[first], lines)):
                    yield pa.RecordBatch.from_pylist([{"file": name + kind, "at": at, "content": content}], pieces.ARROW)

    box = tuple(box) if n else (0.0,) * 4
    sizes = {f"{name}.shp": HEAD + size, f"{name}.shx": HEAD + ENTRY * n, f"{name}.dbf": TABLE_HEAD + TABLE_RECORD * n + 1}
    heads = {f"{name}.shp": head(HEAD + size, box), f"{name}.shx": head(HEAD + ENTRY * n, box), f"{name}.dbf": table_head(n, geom) + (b"" if n else b"\x1a")}
    pieces.write(placed.mapInArrow(run, pieces.SCHEMA), path, heads, sizes)
    return n
