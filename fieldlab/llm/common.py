"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows sent to a Python worker at once, about; whole texts may be long.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local Spark may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder, so lost executors cost nothing.

    With rows, it's read by tasks of so many rows, about: what is small needn't be read, and shuffled again, by as
    many tasks as made it.
    """
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return df.coalesce(max(1, -(-df.count() // rows))) if rows else df


class Stored:
    """Tables in the shared folder for intermediate results that are large: compressed, unlike checkpoints, and
    removed when they have served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes a batch, if it is higher; results don't depend on it."""
    now = spark.conf.get(BATCH_CONF).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """run, and at its end what it has freed goes back to the system: a worker lives on, beside other ones."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library can't
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def send(spark: SparkSession, value) -> Callable:
    """A broadcast that carries its classes along; the result gives the value inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def add_columns(df: DataFrame, text: str, added: str, start: Callable[[], Callable[[list[bytes]], Iterable]]) -> DataFrame:
    """df with columns computed from its text, batch by batch; narrow, so no shuffle.

    start() runs once in each task and returns a function from a list of UTF-8 texts to one list of
    values for each added column. Columns of df that have the name of an added one are replaced.
    """
    new = T._parse_datatype_string(added)
    names = [f.name for f in new]
    kept = [f for f in df.schema if f.name not in names]
    small_batches(df.sparkSession)

    def run(batches):
        work = start()
        for batch in batches:
            columns = [batch.column(f.name) for f in kept] + [None] * len(names)
            for i, values in enumerate(work(raw_texts(batch, text))):
                columns[len(kept) + i] = values
            yield as_batch(columns, [f.name for f in kept] + names, arrow_types)

    arrow_types = dict(zip(names, (arrow_type(f.dataType) for f in new), strict=True))
    return df.mapInArrow(tidy(run), T.StructType([*kept, *new]))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def as_batch(columns: list, names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def az_lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)  # then lower() does the same, much faster
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
