"""Reading and writing: parquet cubes, GrADS and npy binaries, shapefiles, delimited records, yearly downloads."""

from __future__ import annotations

import io
import os
import struct
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from fieldlab.sources import netcdf, pieces, vectors

SEPARATOR = "◇"


def read_cube(spark: SparkSession, path: str, *names: str, dims: tuple[str, ...] = ("time", "lat", "lon")) -> DataFrame:
    """A parquet cube, or some of its variables."""
    df = spark.read.parquet(path)
    return df.select(*[d for d in dims if d in df.columns], *names) if names else df


def write_cube(df: DataFrame, path: str, partition: str | None = "year", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local Spark may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read from there by all that is derived from it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The cube at path; computed and written first if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(where, "_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_netcdf(spark: SparkSession, path: str, *variables: str, dims: tuple[str, ...] = ("time", "lat", "lon")) -> DataFrame:
    """(path, dims..., variable, value) of NetCDF files whose variables all have these dimensions; missing is NULL.

    Files of the classic formats are read by parts (see netcdf.scan, which also decodes times). Files of the HDF5-based
    kind need the netCDF4 library on executors; these, and files in a store that only Spark can open, are read whole.
    """
    try:
        with netcdf.located(path)[0].open_input_file(netcdf.located(netcdf.files_of(path)[0][0])[1]) as f:
            split = f.read(3) == b"CDF"
    except (OSError, ValueError):
        split = False
    if split:
        cells = netcdf.scan(spark, path, *variables, decodeTimes="false")
        if sorted(cells.columns[1 : -len(variables)]) != sorted(dims):
            raise ValueError(f"the dimensions are {cells.columns[1 : -len(variables)]}")
        return cells.unpivot(["path", *dims], list(variables), "variable", "value")

    def steps(content: bytes, v: str):
        if content[:3] == b"CDF":
            c = netcdf.Classic(io.BytesIO(content), len(content))
            own = c.variables[v]
            return own.dims, [c.axis(d) for d in own.dims], (own.decoded(c.raw(own, i)) for i in range(own.shape[0]))
        import netCDF4

        f = netCDF4.Dataset("memory", memory=content)
        return list(f[v].dimensions), [np.asarray(f[d][:], float) for d in f[v].dimensions], (np.ma.filled(f[v][i].astype(float), np.nan).ravel() for i in range(f[v].shape[0]))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                for v in variables:
                    names, axes, fields = steps(bytes(content), v)
                    if sorted(names) != sorted(dims):
                        raise ValueError(f"{v} has dimensions {names}")
                    inner = [g.ravel() for g in np.meshgrid(*axes[1:], indexing="ij")]
                    for label, values in zip(axes[0], fields, strict=True):
                        own = {names[0]: label} | dict(zip(names[1:], inner, strict=True))
                        yield pd.DataFrame({"path": p} | {d: own[d] for d in dims} | {"variable": v, "value": values}, index=range(len(values)))

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    out = rows.mapInPandas(run, "path string, " + "".join(f"{d} double, " for d in dims) + "variable string, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value) of arrays saved as npy, read by ranges; files in a store that only Spark can open are read whole."""
    try:
        netcdf.located(path)
    except (OSError, ValueError):
        return read_npy_whole(spark, path)
    return vectors.scan(spark, path)


def read_npy_whole(spark: SparkSession, path: str) -> DataFrame:
    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                v = np.load(io.BytesIO(bytes(content)), allow_pickle=False).ravel().astype(float)
                yield pd.DataFrame({"path": p, "at": np.arange(len(v)), "value": v})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, at long, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def grads_header(text: str) -> dict:
    """Axes, variables and options of a GrADS descriptor with linear or listed axes."""
    out, lines = {"vars": [], "undef": None, "big": True}, iter(text.splitlines())
    for line in lines:
        w = line.split()
        if not w:
            continue
        key = w[0].lower()
        if key in ("xdef", "ydef", "zdef"):
            n, kind, rest = int(w[1]), w[2].lower(), w[3:]
            while kind == "levels" and len(rest) < n:
                rest += next(lines).split()
            out[key] = [float(rest[0]) + i * float(rest[1]) for i in range(n)] if kind == "linear" else [float(x) for x in rest[:n]]
        elif key == "tdef":
            out["tdef"] = int(w[1])
        elif key == "undef":
            out["undef"] = float(w[1])
        elif key == "options":
            out["big"] = "little_endian" not in line.lower()
        elif key == "vars":
            for _ in range(int(w[1])):
                name, levels, *_ = next(lines).split()
                out["vars"].append((name, max(1, int(levels))))
    return out


def read_grads(spark: SparkSession, path: str, ctl: str, **options) -> DataFrame:
    """(time, lev, lat, lon, variable, value) of a GrADS binary and the text of its descriptor; time counts from 0."""
    spark.dataSource.register(Grads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("grads").option("ctl", ctl).options(**options).load(path)


@dataclass
class Fields(InputPartition):
    path: str
    numbers: list[int]


class Grads(DataSource):
    """A GrADS binary: fields of one length, in the order of times, variables and levels; a partition is some of them."""

    @classmethod
    def name(cls) -> str:
        return "grads"

    def schema(self) -> str:
        return "time int, lev double, lat double, lon double, variable string, value double"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("partitionBytes") or self.options.get("partitionbytes") or netcdf.PARTITION_BYTES
        return GradsReader(self.options["path"], grads_header(self.options["ctl"]), int(most))


class GradsReader(DataSourceReader):
    def __init__(self, path: str, head: dict, most: int):
        self.path, self.head, self.most, self.asked = path, head, most, []
        self.layers = [(name, float(head["zdef"][k])) for name, n in head["vars"] for k in range(n)]
        self.cells = len(head["ydef"]) * len(head["xdef"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of time, variable and level choose the fields that are read; Spark applies all of them again."""
        self.asked = netcdf.comparisons(filters, ["time", "variable", "lev"])
        return iter(filters)

    def partitions(self) -> list[Fields]:
        times = np.flatnonzero(netcdf.matching(self.asked, "time", np.arange(self.head["tdef"])))
        names, levels = (np.array([x[i] for x in self.layers]) for i in (0, 1))
        layers = np.flatnonzero(netcdf.matching(self.asked, "variable", names) & netcdf.matching(self.asked, "lev", levels))
        numbers = (times[:, None] * len(self.layers) + layers).ravel()
        per = max(1, self.most // (4 * self.cells))
        return [Fields(path, numbers[i : i + per].tolist()) for path, _ in netcdf.files_of(self.path) for i in range(0, len(numbers), per)]

    def read(self, part: Fields | None):
        import pyarrow as pa

        if part is None:  # no field is left
            return
        head, (system, inner) = self.head, netcdf.located(part.path)
        lat, lon = np.repeat(head["ydef"], len(head["xdef"])).astype(float), np.tile(head["xdef"], len(head["ydef"])).astype(float)
        with system.open_input_file(inner) as f:
            for number in part.numbers:
                f.seek(4 * self.cells * number)
                raw = f.read(4 * self.cells)
                if len(raw) < 4 * self.cells:
                    raise ValueError(f"{part.path} ends before field {number}")
                value = np.frombuffer(raw, ">f4" if head["big"] else "<f4").astype(float)
                name, lev = self.layers[number % len(self.layers)]
                empty = np.isnan(value) if head["undef"] is None else np.isnan(value) | (value == np.float32(head["undef"]))
                same = np.zeros(self.cells, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(same + number // len(self.layers)), pa.array(same + lev), pa.array(lat), pa.array(lon), pa.array([name]).take(pa.array(same)), pa.array(value, mask=empty)], ["time", "lev", "lat", "lon", "variable", "value"])


def write_grads(df: DataFrame, path: str, variables: list[str], levels: bool = True, undef: float = -9.99e8, start: str = "00z01jan2000", every: str = "1dy") -> str:
    """A cube of one row for each cell (time, lev if it has levels, lat, lon) as one GrADS binary; its descriptor.

    Tasks write whole times at their offsets. Only the labels of the axes come to the driver. Cells without a row are
    undefined, rows with a null label aren't written, of several rows for a cell one is. The descriptor counts times
    from `start` by `every`, as the format has only even ones.
    """
    dims = ["time", *(["lev"] if levels else []), "lat", "lon"]
    rows = df.select("time", *[F.col(c).cast("double").alias(c) for c in (*dims[1:], *variables)]).dropna(subset=dims)
    times = sorted(r[0] for r in rows.select("time").distinct().collect())
    axes = {d: np.array(sorted(r[0] for r in rows.select(d).distinct().collect()), float) for d in dims[1:]} | {"time": np.arange(len(times))}
    size = 4 * len(variables) * int(np.prod([len(axes[d]) for d in dims[1:]], dtype=int))
    places = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(times)], f"time {dict(df.dtypes)['time']}, _step int")
    run = max(1, netcdf.PARTITION_BYTES // max(1, size))
    dealt = rows.join(places, "time").withColumn("_run", F.expr(f"_step DIV {run}")).repartition("_run").sortWithinPartitions("_run", "_step").drop("time")

    def records(batches):
        import pyarrow as pa

        for step, data in netcdf.dense_steps(batches, dims, axes, variables, undef):
            yield pa.RecordBatch.from_pylist([{"file": "", "at": step * size, "content": b"".join(x.astype(">f4").tobytes() for x in data)}], pieces.ARROW)

    pieces.write(dealt.mapInArrow(records, pieces.SCHEMA), path, {"": b""}, {"": len(times) * size})
    listed = lambda name, labels: f"{name} {len(labels)} LEVELS {' '.join(map(repr, map(float, labels)))}"
    own = [f"{v} {len(axes['lev']) if levels else 0} 99 {v}" for v in variables]
    lines = [f"DSET ^{os.path.basename(path)}", f"UNDEF {undef!r}", "OPTIONS big_endian", listed("XDEF", axes["lon"]), listed("YDEF", axes["lat"]), listed("ZDEF", axes["lev"] if levels else [0.0]), f"TDEF {len(times)} LINEAR {start} {every}"]
    return "\n".join([*lines, f"VARS {len(variables)}", *own, "ENDVARS"])


def shapes(content: bytes):
    """(number, rings) of the polygon records of an ESRI shapefile."""
    at = 100
    while at + 12 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
        rings = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        yield number, [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(geom_id, ring_id, vertices) of the polygons of a file, or of the .shp files of a folder; ids count a file's records."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                rows = [(g, i, [{"x": float(x), "y": float(y)} for x, y in r]) for g, rings in shapes(bytes(content)) for i, r in enumerate(rings)]
                yield pd.DataFrame(rows, columns=["geom_id", "ring_id", "vertices"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][hH][pP]").load(path).select("content").mapInPandas(run, "geom_id int, ring_id int, vertices array<struct<x:double,y:double>>")


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Delimited text records."""
    return spark.read.option("sep", SEPARATOR).schema(", ".join(f"{n} string" for n in names)).csv(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", SEPARATOR).csv(path)


def download_years(years: list[int], fetch: Callable[[int, str], None], folder: str, retries: int = 3, wait: float = 1.0) -> list[str]:
    """A file for each year, skipped if it's there; fetch(year, path) takes its credentials from the environment."""
    out = []
    for year in years:
        path = os.path.join(folder, f"{year}.nc")
        for attempt in range(retries):
            if os.path.exists(path):
                break
            try:
                fetch(year, f"{path}.part")
                os.replace(f"{path}.part", path)
            except OSError:
                if attempt + 1 == retries:
                    raise
                time.sleep(wait * 2**attempt)
        out.append(path)
    return out
