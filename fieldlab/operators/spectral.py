"""Grid to spherical-harmonic coefficients and back.

Coefficients are rows (m, l, part, coef): zonal wave m, l = n - m, parts re and im. Orthonormal associated
Legendre functions on Gaussian latitudes; each slab is transformed in one row, slabs in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.sources import pieces


@dataclass(frozen=True)
class Truncation:
    """128 x 64 grid, 20 levels, triangular at 42."""

    n_lon: int = 128
    n_lat: int = 64
    n: int = 42
    m: int = 42
    l: int = 42  # noqa: E741
    levels: int = 20

    def pairs(self) -> list[tuple[int, int]]:
        """(m, l), l outer, as coefficients are stored."""
        return [(m, k) for k in range(self.l + 1) for m in range(min(self.m, self.n - k) + 1)]

    @property
    def size(self) -> int:
        return 2 * len(self.pairs())


def index_map(spark: SparkSession, t: Truncation = Truncation()) -> DataFrame:
    """(m, l, re_index, im_index), 1-based, l-major."""
    rows = [(m, k, *((2 * i - 1, 2 * i) if t.m else (i, i))) for i, (m, k) in enumerate(t.pairs(), 1)]
    return spark.createDataFrame(rows, "m int, l int, re_index int, im_index int")


def legendre(t: Truncation) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sin lat north first, weights, P, dP/dlat) with P[m, l, lat]."""
    mu, w = np.polynomial.legendre.leggauss(t.n_lat)
    mu, w = mu[::-1], w[::-1]
    cos, size = np.sqrt(1 - mu**2), t.l + 3
    p = np.zeros((t.m + 1, size, t.n_lat))
    p[0, 0] = np.sqrt(0.5)
    for m in range(t.m + 1):
        if m:
            p[m, 0] = -np.sqrt((2 * m + 1) / (2 * m)) * cos * p[m - 1, 0]
        p[m, 1] = np.sqrt(2 * m + 3) * mu * p[m, 0]
        for k in range(2, size):
            n = m + k
            a, b = np.sqrt((4 * n * n - 1) / (n * n - m * m)), np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
            p[m, k] = a * (mu * p[m, k - 1] - b * p[m, k - 2])
    d = np.zeros((t.m + 1, t.l + 1, t.n_lat))
    eps = lambda n, m: np.sqrt((n * n - m * m) / (4.0 * n * n - 1))
    for m in range(t.m + 1):
        for k in range(t.l + 1):
            n = m + k
            lower = (n + 1) * eps(n, m) * p[m, k - 1] if k else 0
            d[m, k] = (lower - n * eps(n + 1, m) * p[m, k + 1]) / cos
    return mu, w, p[:, : t.l + 1], d


def forward(grid: np.ndarray, t: Truncation, tables, gradient: str = "", offset: bool = False, mode: str = "P") -> np.ndarray:
    """Complex coefficients [m, l] of a (lat, lon) field. gradient: X (zonal), Y (meridional) or none; offset takes the
    first value off before the transform and puts it back; mode N negates and S subtracts."""
    _, w, p, d = tables
    base = grid.flat[0] if offset and gradient != "Y" else 0.0
    waves = np.fft.rfft(grid - base, axis=1)[:, : t.m + 1] / t.n_lon
    if gradient == "X":
        waves = waves * (1j * np.arange(t.m + 1))[None, :]
    out = np.einsum("jm,j,mlj->ml", waves, w, -d if gradient == "Y" else p)
    if gradient != "X":
        out[0, 0] += (-base if mode in ("N", "S") else base) * np.sqrt(2.0)
    out[0, 0] = out[0, 0].real
    return -out if mode == "N" else out


def backward(coef: np.ndarray, t: Truncation, tables, gradient: str = "", mode: str = "", onto: np.ndarray | None = None) -> np.ndarray:
    """The (lat, lon) field of coefficients; mode A adds to a field, S subtracts from it, N negates."""
    _, _, p, d = tables
    waves = np.einsum("ml,mlj->jm", coef, d if gradient == "Y" else p)
    if gradient == "X":
        waves = waves * (1j * np.arange(t.m + 1))[None, :]
    full = np.zeros((t.n_lat, t.n_lon // 2 + 1), complex)
    full[:, : t.m + 1] = waves * t.n_lon
    grid = np.fft.irfft(full, n=t.n_lon, axis=1)
    return {"A": lambda: onto + grid, "S": lambda: onto - grid, "N": lambda: -grid}.get(mode, lambda: grid)()


def to_waves(slabs: DataFrame, keys: list[str], t: Truncation = Truncation(), gradient: str = "", offset: bool = False, mode: str = "P") -> DataFrame:
    """(keys, m, l, part, coef) of slabs on the model grid (latitudes ascending, as slabs have them). See forward."""
    kept = [f for f in slabs.schema if f.name in keys]

    def run(frames):
        import pandas as pd

        tables, pairs = legendre(t), t.pairs()
        for frame in frames:
            parts = []
            for row in frame.itertuples(index=False):
                grid = np.array(row.data, float).reshape(t.n_lat, t.n_lon)[::-1]
                c = forward(np.nan_to_num(grid), t, tables, gradient, offset, mode)
                own = pd.DataFrame([(m, k, part, x) for m, k in pairs for part, x in (("re", c[m, k].real), ("im", c[m, k].imag))], columns=["m", "l", "part", "coef"])
                for f in kept:
                    own.insert(0, f.name, getattr(row, f.name))
                parts.append(own)
            if parts:
                yield pd.concat(parts)[[*(f.name for f in kept), "m", "l", "part", "coef"]]

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return slabs.mapInPandas(run, head + "m int, l int, part string, coef double")


def to_grid(waves: DataFrame, keys: list[str], t: Truncation = Truncation(), gradient: str = "", mode: str = "", onto: DataFrame | None = None) -> DataFrame:
    """(keys, data): fields of coefficient rows, latitudes ascending. Modes A and S add to and subtract from the slabs onto, N negates."""
    based = onto is not None
    if (mode in ("A", "S")) != based:
        raise ValueError("modes A and S, and no others, need slabs to go onto")
    spectra = waves.groupBy(*keys).agg(F.collect_list(F.struct("m", "l", "part", "coef")).alias("c"))
    kept = [f for f in spectra.schema if f.name in keys]
    if based:
        spectra = spectra.join(onto.select(*keys, F.col("data").alias("onto")), keys)

    def run(frames):
        tables = legendre(t)
        for frame in frames:
            out = []
            for rows, base in zip(frame["c"], frame["onto"] if based else [None] * len(frame), strict=True):
                field = None if base is None else np.nan_to_num(np.array(base, float)).reshape(t.n_lat, t.n_lon)[::-1]
                c = np.zeros((t.m + 1, t.l + 1), complex)
                for r in rows:
                    c[r["m"], r["l"]] += r["coef"] * (1j if r["part"] == "im" else 1)
                out.append(backward(c, t, tables, gradient, mode, field)[::-1].ravel())
            yield frame[[f.name for f in kept]].assign(data=out)

    return spectra.mapInPandas(run, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + "data array<double>")


def zonal_derivative(m: Column, re: Column, im: Column) -> tuple[Column, Column]:
    """i m times a coefficient, in parts."""
    return -m * im, m * re


def packed(waves: DataFrame, order: list[str]) -> DataFrame:
    """Coefficients of several variables in the order of the model's forcing file: by m, then variable, l, part and level."""
    if not order:
        raise ValueError("no variables")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("var"))
    rows = waves.where(F.col("var").isin(order)).withColumn("block", place.cast("int"))
    return rows.select("m", "block", "l", F.when(F.col("part") == "re", 0).otherwise(1).alias("row"), "k", "coef")


def dump(packed_rows: DataFrame, path: str) -> int:
    """Packed coefficients as raw float64, in order, written by many tasks into one file; how many there are."""
    return pieces.write_vector(packed_rows, path, ["m", "block", "l", "row", "k"], "coef")
