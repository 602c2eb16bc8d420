"""NetCDF of the classic formats as a Spark data source, read and written by parts.

spark.read.format("netcdf").load(path) reads files, a folder or a pattern; partitions are ranges of steps of the
variables' first dimension, so a large file is read by many tasks, each opening only its bytes. A row is a cell: path,
a column for each dimension, a column for each variable. Options: variables (names, comma separated; by default all
that share the dimensions of the first one that has several), partitionBytes, decodeTimes (labels with units like
"hours since 1900-01-01" become timestamps; true by default). Filters that compare a dimension with constants choose
the steps, and the rows within a step, before anything else is read.

write_netcdf writes a cube as a folder of files, or as one file in a shared file system that allows writing at offsets.

Missing values (_FillValue, missing_value, or the format's own fill value) are NULL, packed values are unpacked. Files
are opened through Arrow's file systems (local, hdfs, s3, gs). Formats: CDF-1, CDF-2 (large offsets), CDF-5 (large data).
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import posixpath
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from fieldlab.sources import pieces

# The classic format's types by number, and what it fills unwritten values with.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 8: 65535, 9: 4294967295, 10: -9223372036854775806, 11: 18446744073709551614}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12

PARTITION_BYTES = 128 << 20
#: Values of a batch that a task holds at once, about.
BATCH_VALUES = 1 << 20
EPOCH = dt.datetime(1970, 1, 1)
SINCE = re.compile(r"(second|minute|hour|day)s? since (\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+))?)?")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    kind: int
    begin: int
    step: int  # bytes from a step of the first dimension to the next
    attributes: dict = field(default_factory=dict)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(KINDS[self.kind])

    @property
    def inner(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    def decoded(self, raw: np.ndarray) -> np.ndarray:
        """Values as doubles, NaN for missing ones, unpacked."""
        data, a = raw.astype(float), self.attributes
        marks = [a[n][0] for n in ("_FillValue", "missing_value") if n in a and len(a[n])]
        for mark in marks or [FILLS[self.kind]] if marks or self.kind in FILLS else []:
            data[raw == np.asarray(mark).astype(raw.dtype)] = np.nan
        for name, apply in (("scale_factor", np.multiply), ("add_offset", np.add)):
            if name in a:
                data = apply(data, float(a[name][0]))
        return data


class Classic:
    """Header of a classic file: read once, piece by piece; values are read when asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.seen = file, size, 0, b""
        magic = self.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF file of a classic format")
        self.wide, self.far = magic[3] == 5, magic[3] in (2, 5)
        records, self.streaming = self.count(), False
        if records == (1 << (64 if self.wide else 32)) - 1:
            records, self.streaming = 0, True
        self.dims = dict(self.items(DIMENSION, lambda: (self.text(), self.count())))
        self.attributes = dict(self.items(ATTRIBUTE, self.attribute))
        order = list(self.dims)
        found = self.items(VARIABLE, self.variable)
        recorded = [v for v in found if v[1] and self.dims[order[v[1][0]]] == 0]
        raw = lambda v: int(np.prod([self.dims[order[i]] for i in v[1][1:]], dtype=np.int64)) * np.dtype(KINDS[v[3]]).itemsize
        record = raw(recorded[0]) if len(recorded) == 1 else sum(-(-raw(v) // 4) * 4 for v in recorded)
        if self.streaming and recorded:
            records = (size - min(v[4] for v in recorded)) // max(1, record)
        self.records, self.variables = records, {}
        for v in found:
            name, ids, attributes, kind, begin = v
            dims = [order[i] for i in ids]
            shape = [self.dims[d] or records for d in dims]
            self.variables[name] = Variable(dims, shape, kind, begin, record if v in recorded else raw(v), dict(attributes))

    def take(self, n: int) -> bytes:
        while len(self.seen) < self.at + n:
            more = self.file.read(max(1 << 16, self.at + n - len(self.seen)))
            if not more:
                raise ValueError("the header ends too early")
            self.seen += more
        self.at += n
        return self.seen[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def count(self) -> int:
        return self.number(">Q" if self.wide else ">I")

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]

    def text(self) -> str:
        return self.padded(self.count()).decode()

    def items(self, tag: int, read: Callable) -> list:
        found, n = self.number(">I"), self.count()
        if n and found != tag:
            raise ValueError(f"{found} where {tag} was expected")
        return [read() for _ in range(n)]

    def attribute(self) -> tuple:
        name, kind, n = self.text(), self.number(">I"), self.count()
        raw = self.padded(n * np.dtype(KINDS[kind]).itemsize)
        return name, raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, KINDS[kind])

    def variable(self) -> tuple:
        name, dims = self.text(), [self.count() for _ in range(self.count())]
        attributes, kind = self.items(ATTRIBUTE, self.attribute), self.number(">I")
        self.count()  # the size is told by the shape
        return name, dims, attributes, kind, self.number(">Q" if self.far else ">I")

    def raw(self, v: Variable, step: int, first: int = 0, n: int | None = None) -> np.ndarray:
        """n values of a step, from the first-th on."""
        n = v.inner - first if n is None else n
        self.file.seek(v.begin + step * v.step + first * v.dtype.itemsize)
        data = self.file.read(n * v.dtype.itemsize)
        if len(data) < n * v.dtype.itemsize:
            raise ValueError("the file ends too early")
        return np.frombuffer(data, v.dtype)

    def values(self, name: str) -> np.ndarray:
        """A small variable whole, as doubles."""
        v = self.variables[name]
        if not v.dims:
            return v.decoded(self.raw(v, 0, 0, 1))
        return np.concatenate([v.decoded(self.raw(v, i)) for i in range(v.shape[0])]) if v.shape[0] else np.zeros(0)

    def axis(self, dim: str) -> np.ndarray:
        """A dimension's labels: its variable, or places."""
        own = self.variables.get(dim)
        return self.values(dim) if own and own.dims == [dim] else np.arange(float(self.dims[dim] or self.records))

    def units(self, dim: str) -> str:
        found = self.variables[dim].attributes.get("units", "") if dim in self.variables else ""
        return found if isinstance(found, str) else ""

    def chosen(self, names: list[str]) -> list[str]:
        """The variables that are read: those named, or all with the dimensions of the first that has several."""
        fields = {n: v for n, v in self.variables.items() if len(v.dims) > 1 and v.kind != 2}
        out = names or [n for n, v in fields.items() if v.dims == next(iter(fields.values())).dims]
        missing = [n for n in out if n not in self.variables]
        if missing or not out:
            raise ValueError(f"no variable {missing}" if missing else "no variable has two dimensions")
        if len({tuple(self.variables[n].dims) for n in out}) > 1 or not self.variables[out[0]].dims:
            raise ValueError(f"{out} don't share their dimensions")
        return out


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, of the files of a folder, or of those that a pattern names."""
    system, inner = located(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (inner, "*") if info.type == arrow_fs.FileType.Directory else posixpath.split(inner)
    found = system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    own = sorted((head + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")
    if not own:
        raise FileNotFoundError(path)
    return own


def opened(path: str) -> tuple[Classic, io.IOBase]:
    system, inner = located(path)
    file = system.open_input_file(inner)
    return Classic(file, file.size()), file


def clock(units: str) -> tuple[float, float] | None:
    """(seconds of a unit, seconds from 1970 to its origin), if units tell a time."""
    m = SINCE.match(units.strip())
    if not m:
        return None
    origin = dt.datetime(*(int(x or 0) for x in m.groups()[1:]))
    return float(SECONDS[m[1]]), (origin - EPOCH).total_seconds()


def stamp(value):
    """A constant to compare labels with; times as microseconds since 1970."""
    if not isinstance(value, dt.datetime):
        return value
    away = value - (EPOCH if value.tzinfo is None else EPOCH.replace(tzinfo=dt.timezone.utc))
    return float(away // dt.timedelta(microseconds=1))


def comparisons(filters: list[Filter], names: list[str]) -> list[tuple[str, type, list]]:
    """The filters that compare one of these columns with constants."""
    kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)
    own = [(f.attribute[0], type(f), list(f.value) if isinstance(f, In) else [f.value]) for f in filters if isinstance(f, kinds) and len(f.attribute) == 1]
    return [(name, kind, [stamp(v) for v in values]) for name, kind, values in own if name in names and all(isinstance(v, (int, float, str, dt.datetime)) for v in values)]


def matching(asked: list[tuple[str, type, list]], name: str, labels: np.ndarray) -> np.ndarray:
    """Which labels of a column the comparisons leave."""
    tests = {EqualTo: lambda v: labels == v[0], GreaterThan: lambda v: labels > v[0], GreaterThanOrEqual: lambda v: labels >= v[0], LessThan: lambda v: labels < v[0], LessThanOrEqual: lambda v: labels <= v[0], In: lambda v: np.isin(labels, v)}
    ok = np.ones(len(labels), bool)
    for own, kind, values in asked:
        if own == name:
            ok &= tests[kind](values)
    return ok


@dataclass
class Steps(InputPartition):
    path: str
    first: int
    end: int


class Netcdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def setting(self, name: str, default: str) -> str:
        return self.options.get(name) or self.options.get(name.lower()) or default

    def wanted(self) -> list[str]:
        return [n.strip() for n in self.setting("variables", "").split(",") if n.strip()]

    def timed(self) -> bool:
        return self.setting("decodeTimes", "true").lower() == "true"

    def schema(self) -> T.StructType:
        classic, file = opened(files_of(self.options["path"])[0][0])
        with file:
            names = classic.chosen(self.wanted())
            kind = lambda d: T.TimestampType() if self.timed() and clock(classic.units(d)) else T.DoubleType()
            dims = [T.StructField(d, kind(d)) for d in classic.variables[names[0]].dims]
        return T.StructType([T.StructField("path", T.StringType()), *dims, *[T.StructField(n, T.DoubleType()) for n in names]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        names = [f.name for f in schema]
        classic, file = opened(files_of(self.options["path"])[0][0])
        with file:
            dims = classic.variables[classic.chosen(self.wanted())[0]].dims
        return NetcdfReader(self.options["path"], dims, names[1 + len(dims) :], [isinstance(schema[d].dataType, T.TimestampType) for d in dims], int(self.setting("partitionBytes", str(PARTITION_BYTES))))


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, dims: list[str], names: list[str], timed: list[bool], most: int):
        self.path, self.dims, self.names, self.timed, self.most = path, dims, names, timed, most
        self.asked: list[tuple[str, type, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a dimension with constants are kept for pruning; Spark applies all of them again."""
        self.asked = comparisons(filters, self.dims)
        return iter(filters)

    def kept(self, dim: str, labels: np.ndarray) -> np.ndarray:
        """Places of the labels that the filters leave."""
        return np.flatnonzero(matching(self.asked, dim, labels))

    def labels(self, classic: Classic, at: int) -> np.ndarray:
        """A dimension's labels; times as microseconds since 1970."""
        labels = classic.axis(self.dims[at])
        if not self.timed[at]:
            return labels
        unit, origin = clock(classic.units(self.dims[at]))
        return np.rint((labels * unit + origin) * 1e6)

    def partitions(self) -> list[Steps]:
        out = []
        for path, _ in files_of(self.path):
            classic, file = opened(path)
            with file:
                fields = [classic.variables[n] for n in self.names]
                if any(v.dims != self.dims for v in fields):
                    raise ValueError(f"{path} has other dimensions")
                steps = self.kept(self.dims[0], self.labels(classic, 0))
                per = max(1, self.most // max(1, sum(v.inner * v.dtype.itemsize for v in fields)))
                # Runs of steps that follow each other, cut into ranges of about partitionBytes.
                for run in np.split(steps, np.flatnonzero(np.diff(steps) > 1) + 1) if len(steps) else []:
                    out += [Steps(path, int(run[i]), int(run[min(i + per, len(run)) - 1]) + 1) for i in range(0, len(run), per)]
        return out

    def read(self, part: Steps | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no step is left
            return
        classic, file = opened(part.path)
        with file:
            fields = [classic.variables[n] for n in self.names]
            axes = [self.labels(classic, i) for i in range(len(self.dims))]
            inner = [self.kept(d, a) for d, a in zip(self.dims[1:], axes[1:], strict=True)]
            if any(len(i) == 0 for i in inner):
                return
            # Rows of the second dimension: those from the first to the last that is kept are read, a batch at a time.
            rows, wide = inner[0] if inner else np.zeros(1, int), int(np.prod(fields[0].shape[2:], dtype=np.int64))
            rest = np.ravel_multi_index(np.meshgrid(*inner[1:], indexing="ij"), fields[0].shape[2:]).ravel() if len(inner) > 1 else np.zeros(1, int)
            each = max(1, BATCH_VALUES // max(1, wide))
            for step in range(part.first, part.end):
                for i in range(0, len(rows), each):
                    own = rows[i : i + each]
                    yield self.batch(classic, part.path, fields, axes, step, own, inner[1:], rest, wide)

    def batch(self, classic: Classic, path: str, fields: list[Variable], axes: list[np.ndarray], step: int, rows: np.ndarray, inner: list[np.ndarray], rest: np.ndarray, wide: int) -> pa.RecordBatch:
        n, first = len(rows) * len(rest), int(rows[0])
        columns = [pa.array([path]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, axes[0][step]))]
        if len(axes) > 1:
            grid = np.meshgrid(axes[1][rows], *[a[i] for a, i in zip(axes[2:], inner, strict=True)], indexing="ij")
            columns += [pa.array(g.ravel()) for g in grid]
        columns = [c.cast(pa.int64()).cast(pa.timestamp("us", "UTC")) if i and self.timed[i - 1] else c for i, c in enumerate(columns)]
        for v in fields:
            raw = classic.raw(v, step, first * wide, (int(rows[-1]) + 1 - first) * wide).reshape(-1, wide)
            data = v.decoded(raw[rows - first][:, rest].ravel())
            columns.append(pa.array(data, mask=np.isnan(data)))
        return pa.RecordBatch.from_arrays(columns, ["path", *self.dims, *self.names])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(Netcdf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, *variables: str, **options) -> DataFrame:
    """Cells of NetCDF files: (path, dimensions..., variables...)."""
    register(spark)
    reader = spark.read.format("netcdf").options(**options)
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


# --- writing -------------------------------------------------------------------------------------------------


def header(axes: dict[str, np.ndarray], units: dict[str, str], names: list[str], records: int) -> tuple[bytes, int, int]:
    """(bytes before the records, bytes of a record, values of a field in it) of a CDF-5 file with double variables.

    The first axis is the record dimension: a record has its label, then each variable's field.
    """
    dims, number = list(axes), lambda n: struct.pack(">Q", n)
    text = lambda s: number(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    listed = lambda tag, items: struct.pack(">I", tag if items else 0) + number(len(items)) + b"".join(items)
    unit = lambda d: listed(ATTRIBUTE, [text("units") + struct.pack(">I", 2) + text(units[d])] if d in units else [])
    fill = listed(ATTRIBUTE, [text("_FillValue") + struct.pack(">I", 6) + number(1) + struct.pack(">d", FILLS[6])])
    cells = int(np.prod([len(axes[d]) for d in dims[1:]], dtype=np.int64))
    specs = [(d, [i], unit(d), len(axes[d])) for i, d in enumerate(dims[1:], 1)] + [(dims[0], [0], unit(dims[0]), 1)] + [(n, list(range(len(dims))), fill, cells) for n in names]

    def build(begins: list[int]) -> bytes:
        size = [text(d) + number(len(axes[d]) if i else 0) for i, d in enumerate(dims)]
        every = [text(n) + number(len(ids)) + b"".join(map(number, ids)) + a + struct.pack(">I", 6) + number(8 * m) + number(at) for (n, ids, a, m), at in zip(specs, begins, strict=True)]
        return b"CDF\x05" + number(records) + listed(DIMENSION, size) + listed(ATTRIBUTE, []) + listed(VARIABLE, every)

    at = len(build([0] * len(specs)))
    begins = [at + 8 * sum(s[3] for s in specs[:i]) for i in range(len(specs))]
    fixed = b"".join(np.asarray(axes[d], ">f8").tobytes() for d in dims[1:])
    return build(begins) + fixed, 8 * (1 + cells * len(names)), cells


def dense_steps(batches: Iterator[pa.RecordBatch], dims: list[str], axes: dict[str, np.ndarray], variables: list[str], fill: float) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(step, one field for each variable) of rows in the order of _step; places without a value have the fill."""
    now, data, cells = None, [], int(np.prod([len(axes[d]) for d in dims[1:]], dtype=int))
    for batch in batches:
        steps_of = batch.column("_step").to_numpy()
        inner = [np.searchsorted(axes[d], batch.column(d).to_numpy()) for d in dims[1:]]
        place = np.ravel_multi_index(inner, [len(axes[d]) for d in dims[1:]]) if inner else np.zeros(len(steps_of), int)
        values = [batch.column(v).to_numpy(zero_copy_only=False) for v in variables]
        for part in np.split(np.arange(len(steps_of)), np.flatnonzero(np.diff(steps_of)) + 1):
            if not len(part):
                continue
            if steps_of[part[0]] != now:
                if now is not None:
                    yield now, data
                now, data = int(steps_of[part[0]]), [np.full(cells, fill) for _ in variables]
            for own, v in zip(data, values, strict=True):
                own[place[part]] = np.where(np.isnan(v[part].astype(float)), fill, v[part].astype(float))
    if now is not None:
        yield now, data


def write_netcdf(df: DataFrame, path: str, dims: list[str], variables: list[str], steps: int | None = None, single: bool = False) -> None:
    """A cube of one row for each cell as NetCDF, by records of its first dimension; cells without a row are missing.

    As a folder of files of so many steps each (by default of about PARTITION_BYTES), or as a single file that all tasks
    write at their offsets; this needs a file system that all machines share and that can do so. Only the labels of the
    axes come to the driver. Timestamps become seconds since 1970. Rows with a null label aren't written, of several
    rows for a cell one is.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    units = {d: "seconds since 1970-01-01 00:00:00" for d in dims if kinds[d] in ("timestamp", "timestamp_ntz", "date")}
    label = lambda d: (F.unix_micros(F.col(d).cast("timestamp")) / 1e6 if d in units else F.col(d)).cast("double").alias(d)
    rows = df.select(*[label(d) for d in dims], *[F.col(v).cast("double").alias(v) for v in variables]).dropna(subset=dims)
    axes = {d: np.array(sorted(r[0] for r in rows.select(d).distinct().collect()), float) for d in dims}
    size = header(axes, units, variables, 0)[1]
    n = len(axes[dims[0]])
    per = n if single else steps or max(1, PARTITION_BYTES // size)
    # Work is dealt out by runs of steps; in a single file a run is what a task writes at once.
    run = max(1, min(per, PARTITION_BYTES // size))
    places = spark.createDataFrame([(float(x), i, i // run) for i, x in enumerate(axes[dims[0]])] or [(None, 0, 0)], f"{dims[0]} double, _step int, _run int")
    dealt = rows.join(places, dims[0]).repartition("_run").sortWithinPartitions("_run", "_step")

    def records(batches):
        for step, data in dense_steps(batches, dims, axes, variables, FILLS[6]):
            body = b"".join(np.asarray(x, ">f8").tobytes() for x in (axes[dims[0]][step : step + 1], *data))
            start = len(header(axes, units, variables, min(per, n - step // per * per))[0])
            yield {"file": "" if single else f"part-{step // per:05d}.nc", "at": start + step % per * size, "content": body}

    def run_batches(batches):
        for r in records(batches):
            yield pa.RecordBatch.from_pylist([r], pieces.ARROW)

    heads = {"": n} if single else {f"part-{p:05d}.nc": min(per, n - p * per) for p in range(-(-n // per))}
    starts = {name: header(axes, units, variables, records)[0] for name, records in heads.items()} or {"" if single else "part-00000.nc": header(axes, units, variables, 0)[0]}
    pieces.write(dealt.mapInArrow(run_batches, pieces.SCHEMA), path, starts, {name: len(starts[name]) + heads.get(name, 0) * size for name in starts})
