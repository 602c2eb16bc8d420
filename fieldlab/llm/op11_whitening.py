"""Embedding whitening by a digit-slice GEMM.

Entries become integers, x = floor(64 c) + 1000000; each distinct x vector counts once. The covariance is exact: a task
takes a rounded mean off its vectors, splits what is left into signed limbs of LIMB bits, multiplies limb matrices in
float64 BLAS (ROWS rows at a time, so no product or sum passes 2^53), and puts the limbs' products together as big
integers. Tasks' matrices are merged by sums of PART-bit parts, what the rounding of the mean left is taken off
exactly, and one matrix of the vectors' dimension is decomposed on the driver. A first decomposition in doubles is
made better by rotations of the matrix as it stands in that basis, which the same limb products give exactly; so small
eigenvalues are right too beside very large ones.

Vectors that are null, or hold null or non-finite entries, are left out; so are those of another length than most (of
equally frequent lengths the longest counts). Entries beyond 2^54 count as 2^54. A component of no variance has null
whitened values and explains 0; a single distinct vector has no other. A deviation beyond a long is null. Rows that are
repeated are all returned. Columns of the input stay; those named as added ones are replaced. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.llm.common import Stored, send, table, tidy

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of 64 c beyond 2^60 would make differences that leave a long.
MOST = float(1 << 60)
#: Signed limbs of 20 bits: their products are at most 2^38, and sums of 2^13 of them at most 2^51.
LIMB, ROWS = 20, 1 << 13
#: Bits of the parts that carry big integers through Spark's sums.
PART = 60
#: Eigenvalues below this share of the largest are nil.
NIL = 1e-27
ADDED = ["deviation", "whitened"]


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float matrices of signed digits d with x = sum of d[p] 2^(LIMB p), |d| <= 2^(LIMB - 1). x: int64 or big integers."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        rest = (x + half) >> LIMB
        out.append((x - (rest << LIMB)).astype(float))
        if not rest.any():
            return out
        x = rest


def product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Integer matrices c with (sum of a[p] 2^(LIMB p)) (sum of b[q] 2^(LIMB q)) = sum of c[s] 2^(LIMB s); at most ROWS inner rows."""
    out = [0] * (len(a) + len(b) - 1)
    for p, x in enumerate(a):
        for q, y in enumerate(b):
            out[p + q] = out[p + q] + (x @ y).astype(np.int64)
    return out


def recombined(digits: list) -> np.ndarray:
    """Big integers of limb products."""
    return sum(np.asarray(d).astype(object) << (LIMB * s) for s, d in enumerate(digits))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of matrices of big integers."""
    cut = range(0, a.shape[1], ROWS)
    return sum(recombined(product(limbs(a[:, i : i + ROWS]), limbs(b[i : i + ROWS]))) for i in cut)


def parts(x: int) -> Iterator[tuple[int, int]]:
    """(place, part): x as a sum of signed parts of PART bits."""
    at, half = 0, 1 << (PART - 1)
    while x or not at:
        rest = (x + half) >> PART
        yield at, x - (rest << PART)
        at, x = at + 1, rest


def exact_sums(df: DataFrame, run) -> dict[tuple[int, int], int]:
    """The big integers that tasks yield as (i, j, value), added up over tasks. Only cells come to the driver."""

    def whole(batches):
        import pyarrow as pa

        rows = [(i, j, at, part) for i, j, x in run(batches) for at, part in parts(int(x))]
        columns = [[r[k] for r in rows] for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["i", "j", "at", "part"])

    sums = df.mapInArrow(tidy(whole), "i int, j int, at int, part long").groupBy("i", "j", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.s) << (PART * r.at))
    return out


def matrix(batch, column: str, d: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, d)


def grid(vector: Column) -> Column:
    """The integer vector x; NULL if the vector is null or holds what isn't a finite number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    level = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))
    return F.when(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(level(c)).cast("long") + SHIFT))


def moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S): number and exact sums of the fit list."""

    def run(batches):
        total, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch, "x", d)
            total, low, high = total + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        yield -1, 0, total
        yield from ((i, 0, (int(high[i]) << 32) + int(low[i])) for i in range(d))

    sums = exact_sums(fit, run)
    return sums.get((-1, 0), 0), [sums.get((i, 0), 0) for i in range(d)]


def gram(fit: DataFrame, middle: np.ndarray) -> np.ndarray:
    """The exact sum of (x - middle)(x - middle)', as big integers."""
    d = len(middle)

    def run(batches):
        total, digits, blocks = np.zeros((d, d), object), [], 0
        for batch in batches:
            x = matrix(batch, "x", d) - middle
            for i in range(0, len(x), ROWS):
                own = limbs(x[i : i + ROWS])
                new = product([a.T for a in own], own)
                digits += [np.zeros((d, d), np.int64)] * (len(new) - len(digits))
                for s, c in enumerate(new):
                    digits[s] = digits[s] + c
                blocks += 1
                if blocks % 256 == 0:  # before sums leave a long
                    total, digits = total + recombined(digits), []
        total = total + recombined(digits) if digits else total
        yield from ((i, j, total[i, j]) for i in range(d) for j in range(i, d))

    sums = exact_sums(fit, run)
    return np.array([[sums.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], object)


def rotated(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of a nearly diagonal matrix by Jacobi's rotations, each entry right relative to its size."""
    b, q, d = b.copy(), np.eye(len(b)), len(b)
    for _ in range(60):
        size = np.sqrt(np.maximum(np.abs(np.diag(b)), 1e-300))
        far = np.abs(b) > 1e-16 * np.outer(size, size)
        np.fill_diagonal(far, False)
        if not far.any():
            break
        for i, j in zip(*np.nonzero(np.triu(far)), strict=True):
            if b[i, j] == 0:
                continue
            theta = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            turn = np.array([[c, t * c], [-t * c, c]])
            b[[i, j]] = turn.T @ b[[i, j]]
            b[:, [i, j]] = b[:, [i, j]] @ turn
            b[i, j] = b[j, i] = 0.0
            q[:, [i, j]] = q[:, [i, j]] @ turn
    return np.diag(b).copy(), q


def decomposed(numerator: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors as columns) of the exact matrix numerator / divisor."""
    v = np.array([[x / divisor for x in row] for row in numerator], float)
    vectors = np.linalg.eigh(v)[1][:, ::-1]
    for _ in range(2):
        z = np.array([[int(x) for x in row] for row in np.rint(vectors * 2.0**PART)], object)
        inner = times(times(z.T.copy(), numerator), z)
        values, turn = rotated(np.array([[x / (divisor << (2 * PART)) for x in row] for row in inner], float))
        vectors = vectors @ turn
        vectors = vectors / np.linalg.norm(vectors, axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening:
    """A fit: n and S of the fit list, its components, and what they explain."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, k: int):
        self.n, self.sums, d = n, sums, len(sums)
        self.middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.middle, strict=True)]
        real = values > NIL * max(values[0], 0.0)
        total = values[real].sum()
        self.k = min(k, d)
        self.real = real[: self.k]
        self.explained = [float(e / total) if ok else 0.0 for e, ok in zip(values[: self.k], self.real, strict=True)]
        self.basis = vectors[:, : self.k] / np.sqrt(np.where(self.real, values[: self.k], 1.0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, by their standard deviations. The integer part of the mean is taken off exactly."""
        away = (x - self.middle) - np.array([r / self.n for r in self.rest])
        return away @ self.basis

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The squared length of n x - S; None beyond a long."""
        y = x - self.middle
        bound = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest))
        if bound * bound * len(self.rest) < 1 << 63:
            v = self.n * y - np.array(self.rest, np.int64)
            return (v * v).sum(1).tolist()
        v = self.n * y.astype(object) - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (v * v).sum(1)]

    def identity_error(self, fit: DataFrame) -> float | None:
        """Largest absolute entry of the whitened fit list's covariance minus the identity."""
        k, d, n, real, sent = self.k, len(self.sums), self.n, np.flatnonzero(self.real), send(fit.sparkSession, self)

        def run(batches):
            import pyarrow as pa

            work, total, square = sent(), np.zeros(k), np.zeros((k, k))
            for batch in batches:
                w = work.whitened(matrix(batch, "x", d))
                total, square = total + w.sum(0), square + w.T @ w
            rows = [(i, -1, total[i]) for i in range(k)] + [(i, j, square[i, j]) for i in range(k) for j in range(i, k)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.float64()], strict=True)], ["i", "j", "v"])

        sums = {(r.i, r.j): r.v / n for r in fit.mapInArrow(tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        return max((abs(sums[i, j] - sums[i, -1] * sums[j, -1] - (i == j)) for i in real for j in real if i <= j), default=None)


def whiten(df: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """(df with deviation and whitened, an array of at most k values; the fit; the identity error) over df's vectors."""
    store = Stored(df.sparkSession)
    kept = [c for c in df.columns if c not in ADDED]
    rows = df.select(*kept, grid(F.col(column)).alias("_x")).where("_x IS NOT NULL")
    length = rows.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = T.StructType([f for f in df.schema if f.name in kept] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if length is None:
        return df.sparkSession.createDataFrame([], schema), None, None
    d = length.d
    rows = rows.where(F.size("_x") == d)
    fit = store(rows.select(F.col("_x").alias("x")).distinct())
    n, sums = moments(fit, d)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)
    values, vectors = decomposed(n * gram(fit, middle) - np.outer(rest, rest), n * n)
    found = Whitening(n, sums, values, vectors, k)
    error = found.identity_error(fit)
    store.remove()
    sent = send(df.sparkSession, found)

    def run(batches):
        import pyarrow as pa

        work = sent()
        for batch in batches:
            x = matrix(batch, "_x", d)
            w, offsets = work.whitened(x), pa.array(np.arange(len(x) + 1) * work.k, pa.int32())
            flat = pa.array(w.ravel(), mask=~np.tile(work.real, len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(work.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], schema.names)

    return rows.mapInArrow(tidy(run), schema), found, error


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, fit, error = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    n, explained = (fit.n, fit.explained) if fit else (0, [])
    rows = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)) if explained else F.array(F.lit(None).cast("double")), F.col("at"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
