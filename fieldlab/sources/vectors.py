"""Vectors of numbers as a data source: raw files, and npy files of any shape, read by ranges of places."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldlab.sources import netcdf

MAGIC = b"\x93NUMPY"
#: Values of a batch.
BATCH = 1 << 16


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    start: int
    first: int
    end: int
    #: The shape of an array that is stored by columns.
    columns: tuple[int, ...] | None


class Vector(DataSource):
    """(path, at, value); at is a value's place in the order of rows, whatever the order of the file."""

    @classmethod
    def name(cls) -> str:
        return "vector"

    def schema(self) -> str:
        return "path string, at long, value double"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("partitionBytes") or self.options.get("partitionbytes") or netcdf.PARTITION_BYTES
        return VectorReader(self.options["path"], self.options.get("kind"), int(most))


class VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None, most: int):
        self.path, self.kind, self.most = path, kind, most

    def layout(self, path: str, size: int) -> Range:
        """All of a file as one range; only the head of an npy file is read."""
        if self.kind:
            width = np.dtype(self.kind).itemsize
            if size % width:
                raise ValueError(f"{path} has {size} bytes, no multiple of {width}")
            return Range(path, self.kind, 0, 0, size // width, None)
        system, inner = netcdf.located(path)
        with system.open_input_file(inner) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{path} is no npy file; kind names the numbers of a raw one")
            f.seek(0)
            version = np.lib.format.read_magic(f)
            shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if kind.kind not in "biuf":
                raise ValueError(f"{path} holds {kind}, not numbers")
            n = int(np.prod(shape, dtype=np.int64))
            if size < f.tell() + n * kind.itemsize:
                raise ValueError(f"{path} ends before its last value")
            return Range(path, kind.str, f.tell(), 0, n, tuple(shape) if by_columns and len(shape) > 1 else None)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in netcdf.files_of(self.path):
            whole = self.layout(path, size)
            per = max(1, self.most // np.dtype(whole.kind).itemsize)
            out += [Range(path, whole.kind, whole.start, at, min(at + per, whole.end), whole.columns) for at in range(0, whole.end, per)]
        return out

    def read(self, part: Range | None):
        if part is None:  # there is no value
            return
        kind, (system, inner) = np.dtype(part.kind), netcdf.located(part.path)
        with system.open_input_file(inner) as f:
            for first in range(part.first, part.end, BATCH):
                n = min(BATCH, part.end - first)
                f.seek(part.start + first * kind.itemsize)
                value = np.frombuffer(f.read(n * kind.itemsize), kind).astype(float)
                at = np.arange(first, first + n)
                if part.columns:
                    at = np.ravel_multi_index(np.unravel_index(at, part.columns, order="F"), part.columns)
                yield pa.RecordBatch.from_arrays([pa.array([part.path]).take(pa.array(np.zeros(n, np.int8))), pa.array(at), pa.array(value, mask=np.isnan(value))], ["path", "at", "value"])


def scan(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """(path, at, value) of npy files, or of raw ones whose numbers are of a kind such as "<f8"; NaN is NULL."""
    spark.dataSource.register(Vector)
    reader = spark.read.format("vector").options(**options)
    return (reader.option("kind", kind) if kind else reader).load(path)
