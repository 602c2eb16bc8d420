"""Poisson solvers on slabs, stream function and velocity potential.

A slab is one row, so fields are solved in parallel over their keys. Spacing is that of each cell; the outer
ring is 0 and there's no periodicity. "direct" solves the linear system; "separated" does so for fields that are too
large for a task; "sor" relaxes in lexicographic order (by wavefronts, which gives the same numbers), "jacobi" uses the
values of the sweep before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.functions.scalar import EARTH_RADIUS
from fieldlab.model import from_slab, to_slab
from fieldlab.operators import calculus, select


def spacing(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of neighbours at each cell."""
    step = lambda x: np.radians(np.gradient(x))
    dx = EARTH_RADIUS * np.cos(np.radians(lat))[:, None] * step(lon)[None, :]
    return dx**2, np.broadcast_to((EARTH_RADIUS * step(lat))[:, None] ** 2, dx.shape)


def relax(rhs, dx2, dy2, omega=0.2, tol=1e-7, max_iter=1_000_000):
    """Successive over-relaxation. Cells of an anti-diagonal don't depend on each other, so they're done at once."""
    x, (m, n) = np.zeros_like(rhs), rhs.shape
    centre = 2 / dx2 + 2 / dy2
    fronts = [(i := np.arange(max(1, d - n + 2), min(m - 1, d)), d - i) for d in range(2, m + n - 3)]
    for sweeps in range(1, max_iter + 1):
        change = 0.0
        for i, j in fronts:
            old = x[i, j]
            new = (1 - omega) * old + omega * ((x[i, j + 1] + x[i, j - 1]) / dx2[i, j] + (x[i + 1, j] + x[i - 1, j]) / dy2[i, j] - rhs[i, j]) / centre[i, j]
            x[i, j] = new
            change = max(change, np.abs(new - old).max(initial=0.0))
        if change < tol:
            break
    return x, sweeps, change


def jacobi(rhs, dx2, dy2, tol=1000.0, max_iter=1_000_000):
    """Two-array sweeps of the equation with the opposite sign of rhs, until the largest change is below tol."""
    x, centre = np.zeros_like(rhs), 2 / dx2 + 2 / dy2
    for sweeps in range(1, max_iter + 1):
        new = x.copy()
        new[1:-1, 1:-1] = (((x[1:-1, 2:] + x[1:-1, :-2]) / dx2[1:-1, 1:-1]) + ((x[2:, 1:-1] + x[:-2, 1:-1]) / dy2[1:-1, 1:-1]) + rhs[1:-1, 1:-1]) / centre[1:-1, 1:-1]
        change, x = np.abs(new - x).max(), new
        if change < tol:
            break
    return x, sweeps, change


def direct(rhs, dx2, dy2):
    """Rows of the interior as blocks of a block-tridiagonal system."""
    m, n = rhs.shape
    k = n - 2
    off = lambda i: np.eye(k) / dy2[i, 1:-1][:, None]

    def block(i):
        a = np.diag(-(2 / dx2[i, 1:-1] + 2 / dy2[i, 1:-1]))
        a[np.arange(k - 1), np.arange(1, k)] = 1 / dx2[i, 1:-2]
        a[np.arange(1, k), np.arange(k - 1)] = 1 / dx2[i, 2:-1]
        return a

    x, steps = np.zeros_like(rhs), []
    for i in range(1, m - 1):
        a, b = block(i), rhs[i, 1:-1].astype(float)
        if steps:
            a, b = a - off(i) @ steps[-1][0], b - off(i) @ steps[-1][1]
        both = np.linalg.solve(a, np.column_stack([off(i), b]))
        steps.append((both[:, :-1], both[:, -1]))
    for i in range(m - 2, 0, -1):
        x[i, 1:-1] = steps[i - 1][1] - steps[i - 1][0] @ x[i + 1, 1:-1]
    return x


def solve(slabs: DataFrame, method: str = "direct", omega: float = 0.2, tol: float = 1e-7, max_iter: int = 1_000_000) -> DataFrame:
    """data of each slab becomes the solution; missing values of the right-hand side count as 0."""
    if method not in ("direct", "sor", "jacobi"):
        raise ValueError("method is direct, sor or jacobi")

    def run(frames):
        for frame in frames:
            out = []
            for lat, lon, data in zip(frame["lat"], frame["lon"], frame["data"], strict=True):
                lat, lon = np.array(lat, float), np.array(lon, float)
                rhs = np.nan_to_num(np.array(data, float).reshape(len(lat), len(lon)))
                if min(rhs.shape) < 3:
                    out.append(np.zeros(rhs.size))
                    continue
                dx2, dy2 = spacing(lat, lon)
                x = direct(rhs, dx2, dy2) if method == "direct" else relax(rhs, dx2, dy2, omega, tol, max_iter)[0] if method == "sor" else jacobi(rhs, dx2, dy2, tol, max_iter)[0]
                out.append(x.ravel())
            frame["data"] = out
            yield frame

    return slabs.mapInPandas(run, slabs.schema)


#: Waves whose columns are solved by one task.
WAVES = 64


class Waves:
    """Eigenvectors of the second difference along a row: sines for even steps, else those of its matrix."""

    def __init__(self, lon: np.ndarray):
        self.n, step = len(lon), np.radians(np.gradient(lon))[1:-1]
        self.even, k = bool(np.allclose(step, step[0], rtol=1e-10)), np.arange(1, len(lon) - 1)
        if self.even:
            self.values = -4 / step[0] ** 2 * np.sin(np.pi * k / (2 * (self.n - 1))) ** 2
            return
        self.root = 1 / step
        m = -2 * np.diag(self.root**2)
        at = np.arange(len(step) - 1)
        m[at, at + 1] = m[at + 1, at] = self.root[:-1] * self.root[1:]
        self.values, self.vectors = np.linalg.eigh(m)

    def sines(self, rows: np.ndarray) -> np.ndarray:
        zero = np.zeros((len(rows), 1))
        return -np.fft.rfft(np.hstack([zero, rows, zero, -rows[:, ::-1]]), axis=1).imag[:, 1:-1] / 2

    def forth(self, rows: np.ndarray) -> np.ndarray:
        return self.sines(rows) if self.even else rows / self.root @ self.vectors

    def back(self, waves: np.ndarray) -> np.ndarray:
        return self.sines(waves) * 2 / (self.n - 1) if self.even else waves @ self.vectors.T * self.root


def separated(df: DataFrame, keys: list[str], rhs: str, to: str) -> DataFrame:
    """(keys, lat, lon, to) of large fields that share their axes, solved directly without a field in one task.

    The spacing is a product of a function of latitude and one of longitude, so waves along the rows don't mix: rows are
    turned into waves, a task each; WAVES waves at a time, columns are solved by elimination; rows are turned back. A
    task holds some rows, or some columns. Missing cells of the right-hand side count as 0; of several rows for a cell
    one counts. Uneven longitudes need the eigenvectors of a matrix of their number, found on the driver.
    """
    cells = df.select(*keys, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(rhs).cast("double").alias("v")).dropna(subset=["lat", "lon"])
    lat, lon = (np.array(sorted(r[0] for r in cells.select(c).distinct().collect())) for c in ("lat", "lon"))
    if min(len(lat), len(lon)) < 3:
        return cells.select(*keys, "lat", "lon", F.lit(0.0).alias(to)).distinct()
    spark, kept = df.sparkSession, [f for f in cells.schema if f.name in keys]
    sent = spark.sparkContext.broadcast((lat, lon, Waves(lon)))
    across, along = 1 / (EARTH_RADIUS * np.cos(np.radians(lat))) ** 2, 1 / (EARTH_RADIUS * np.radians(np.gradient(lat))) ** 2
    names, array = [f.name for f in kept], T.ArrayType(T.DoubleType())
    rows = cells.groupBy(*keys, "lat").agg(F.collect_list(F.struct("lon", "v")).alias("c"))
    rows = rows.select(*keys, "lat", F.transform("c", lambda c: c["lon"]).alias("x"), F.transform("c", lambda c: c["v"]).alias("v"))

    def forth(frames):
        import pandas as pd

        lat, lon, waves = sent.value
        for frame in frames:
            field = np.zeros((len(frame), len(lon)))
            for i, (x, v) in enumerate(zip(frame["x"], frame["v"], strict=True)):
                field[i, np.searchsorted(lon, x)] = np.nan_to_num(np.array(v, float))
            out = waves.forth(field[:, 1:-1])
            for block, first in enumerate(range(0, out.shape[1], WAVES)):
                yield pd.concat([frame[[*names, "lat"]].reset_index(drop=True), pd.DataFrame({"_block": block, "w": list(out[:, first : first + WAVES])})], axis=1)

    def columns(key, frame):
        import pandas as pd

        lat, _, waves = sent.value
        first, width = frame["_block"].iloc[0] * WAVES, len(frame["w"].iloc[0])
        f = np.zeros((len(lat), width))
        f[np.searchsorted(lat, frame["lat"])] = np.stack(frame["w"].to_list())
        values, x, steps = waves.values[first : first + width], np.zeros((len(lat), width)), []
        for i in range(1, len(lat) - 1):
            pivot = values * across[i] - 2 * along[i] - (along[i] * steps[-1][0] if steps else 0.0)
            steps.append((along[i] / pivot, (f[i] - (along[i] * steps[-1][1] if steps else 0.0)) / pivot))
        for i in range(len(lat) - 2, 0, -1):
            x[i] = steps[i - 1][1] - steps[i - 1][0] * x[i + 1]
        out = pd.DataFrame({"lat": lat, "_block": frame["_block"].iloc[0], "w": list(x)})
        for name in names:
            out.insert(0, name, frame[name].iloc[0])
        return out[[*names, "lat", "_block", "w"]]

    def back(frames):
        import pandas as pd

        _, lon, waves = sent.value
        for frame in frames:
            field = waves.back(np.stack([np.concatenate([b["w"] for b in sorted(blocks, key=lambda b: b["_block"])]) for blocks in frame["b"]])) if len(frame) else np.zeros((0, len(lon) - 2))
            out = pd.DataFrame({to: list(np.pad(field, ((0, 0), (1, 1))))})
            yield pd.concat([frame[[*names, "lat"]].reset_index(drop=True), out], axis=1)

    label = T.StructField("lat", T.DoubleType())
    blocks = T.StructType([*kept, label, T.StructField("_block", T.IntegerType()), T.StructField("w", array)])
    waves = rows.mapInPandas(forth, blocks).groupBy(*keys, "_block").applyInPandas(columns, blocks)
    solved = waves.groupBy(*keys, "lat").agg(F.collect_list(F.struct("_block", "w")).alias("b"))
    solved = solved.mapInPandas(back, T.StructType([*kept, label, T.StructField(to, array)]))
    places = spark.createDataFrame([(float(x), i) for i, x in enumerate(lon)], "lon double, _at int")
    return solved.select(*keys, "lat", F.posexplode(to).alias("_at", to)).join(places, "_at").select(*keys, "lat", "lon", to)


def poisson(df: DataFrame, keys: list[str], rhs: str, to: str, method: str = "direct", **how) -> DataFrame:
    """df with the solution of laplace(to) = rhs for each field. method: see solve; "separated" is for large fields."""
    solved = separated(df, keys, rhs, to) if method == "separated" else from_slab(solve(to_slab(df, keys, rhs), method, **how), keys, to)
    return df.join(solved, [*keys, "lat", "lon"])


def potential(df: DataFrame, keys: list[str], kind: str, sign: str = "negated", **how) -> DataFrame:
    columns = ("chi", "u_chi", "v_chi") if kind == "velocity" else ("psi", "u_psi", "v_psi")
    df = calculus.divergence(df, keys, to="_rhs") if kind == "velocity" else calculus.vorticity(df, keys, to="_rhs")
    df = poisson(df, keys, "_rhs", columns[0], **how).drop("_rhs")
    if sign == "negated":
        df = df.withColumn(columns[0], -F.col(columns[0]))
    df = calculus.gradient(df, keys, columns[0], ("_gx", "_gy"))
    winds = (F.col("_gx"), F.col("_gy")) if kind == "velocity" else (-F.col("_gy"), F.col("_gx"))
    df = df.withColumns(dict(zip(columns[1:], winds, strict=True))).drop("_gx", "_gy")
    return select.null_ring(df, keys, list(columns), "lat", "lon")


def velocity_potential(df: DataFrame, keys: list[str], sign: str = "negated", **how) -> DataFrame:
    """chi of the divergence, and its wind; sign="standard" leaves the solution as it is."""
    return potential(df, keys, "velocity", sign, **how)


def stream_function(df: DataFrame, keys: list[str], sign: str = "negated", **how) -> DataFrame:
    """psi of the vorticity, and its wind."""
    return potential(df, keys, "stream", sign, **how)


def prototype_stream_function(df: DataFrame, keys: list[str], step: float = 5.0, tol: float = 1000.0, max_iter: int = 1_000_000) -> DataFrame:
    """Fixed-step vorticity relaxed by Jacobi sweeps, on the interior grid."""
    rhs = select.interior(calculus.vorticity_fixed_step(df, keys, to="_rhs", step=step), keys)
    return poisson(rhs, keys, "_rhs", "psi", method="jacobi", tol=tol, max_iter=max_iter).drop("_rhs")
