"""Binary files that many tasks write together: pieces of known offsets, and a commit that makes the files visible.

Rows are (file, at, content): where in which file some bytes go. Tasks write into files of a hidden name beside the
target; the commit adds what comes first in each file and gives it its name, so a reader never sees a part of a file. A
task that runs again writes the same bytes at the same places. The target has to be in a file system that all machines
share and that can be written at offsets.
"""

from __future__ import annotations

import base64
import io
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fieldlab.operators.select import numbered

SCHEMA = "file string, at long, content binary"
ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("content", pa.binary())])
#: Values of a piece of a vector.
PIECE = 1 << 16


class Pieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PiecesWriter(self.options["path"], self.options["token"], json.loads(self.options["files"]), overwrite)


class PiecesWriter(DataSourceArrowWriter):
    """files: {name: [bytes of the whole, what comes first in base64]}; the name "" is the target itself."""

    def __init__(self, path: str, token: str, files: dict, overwrite: bool):
        self.path, self.token, self.files = re.sub("^file:/+", "/", path), token, files
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(path)

    def hidden(self, name: str) -> str:
        folder = self.path if name else os.path.dirname(self.path) or "."
        os.makedirs(folder, exist_ok=True)
        return os.path.join(folder, f".{name or os.path.basename(self.path)}.{self.token}")

    def write(self, iterator) -> WriterCommitMessage:
        now, handle = None, None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if r["file"] != now:
                        if handle is not None:
                            os.close(handle)
                        now, handle = r["file"], os.open(self.hidden(r["file"]), os.O_CREAT | os.O_WRONLY)
                    view, at = memoryview(r["content"]), r["at"]
                    while view:
                        done = os.pwrite(handle, view, at)
                        view, at = view[done:], at + done
        finally:
            if handle is not None:
                os.fsync(handle)
                os.close(handle)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        for name, (size, head) in self.files.items():
            with open(os.open(self.hidden(name), os.O_CREAT | os.O_RDWR), "r+b") as f:
                f.write(base64.b64decode(head))
                f.truncate(size)
        for name in self.files:
            os.replace(self.hidden(name), os.path.join(self.path, name) if name else self.path)

    def abort(self, messages) -> None:
        for name in self.files:
            if os.path.exists(self.hidden(name)):
                os.remove(self.hidden(name))


def write(rows: DataFrame, path: str, heads: dict[str, bytes], sizes: dict[str, int], overwrite: bool = False) -> None:
    """Rows of SCHEMA into files of a folder, or, for the name "", into one file."""
    rows.sparkSession.dataSource.register(Pieces)
    files = json.dumps({name: [sizes[name], base64.b64encode(heads[name]).decode()] for name in heads})
    rows.write.format("pieces").option("token", uuid.uuid4().hex).option("files", files).mode("overwrite" if overwrite else "append").save(path)


def vector(df: DataFrame, order: list[str], value: str, kind: str = "<f8", start: int = 0) -> DataFrame:
    """Pieces of the values of a table, in an order that tells all rows apart."""
    itemsize = np.dtype(kind).itemsize
    placed = numbered(df, order).select("_place", F.col(value).cast("double").alias("v"), F.expr(f"_place DIV {PIECE}").alias("_piece"))

    def run(batches):
        for batch in batches:
            place, v = batch.column("_place").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False).astype(kind)
            for own in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) != 1) + 1):
                if len(own):
                    yield pa.RecordBatch.from_pylist([{"file": "", "at": start + int(place[own[0]]) * itemsize, "content": v[own].tobytes()}], ARROW)

    return placed.repartition("_piece").sortWithinPartitions("_place").mapInArrow(run, SCHEMA)


def write_vector(df: DataFrame, path: str, order: list[str], value: str, kind: str = "<f8", npy: bool = False) -> int:
    """The values in an order as raw numbers, or as npy; missing ones are NaN. How many there are."""
    n = df.count()
    head = npy_head(n, kind) if npy else b""
    write(vector(df, order, value, kind, len(head)), path, {"": head}, {"": len(head) + n * np.dtype(kind).itemsize})
    return n


def npy_head(n: int, kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": (n,)})
    return out.getvalue()
