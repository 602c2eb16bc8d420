"""Modes of variability: EOFs, clusters and ensemble decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Directions beyond the wanted modes that an EOF analysis carries along, and its accuracy relative to the largest eigenvalue.
SPARE, ACCURACY = 8, 1e-11


def anomalies(df: DataFrame, time: str, cell: list[str], value: str) -> DataFrame:
    """Values minus their cell's mean; cells without a value at some time are left out."""
    n = df.select(time).distinct().count()
    mean = df.groupBy(*cell).agg(F.avg(value).alias("_m"), F.count(value).alias("_n")).where(F.col("_n") == n).drop("_n")
    return df.join(mean, cell).withColumn("x", F.col(value) - F.col("_m")).select(time, *cell, "x")


def numbers(batch, column: str) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    rows = batch.column(column)
    return np.asarray(rows.flatten(), float).reshape(len(rows), -1)


def applied(rows: DataFrame, v: np.ndarray) -> tuple[np.ndarray, float]:
    """(X'X v, sum of squares of X) for rows x of X. A task adds up its rows; what it returns has the size of v."""
    sent, n = rows.sparkSession.sparkContext.broadcast(v), v.shape[1]

    def run(batches):
        import pyarrow as pa

        w, total, square = sent.value, np.zeros(v.shape), 0.0
        for batch in batches:
            x = numbers(batch, "s")
            total += x.T @ (x @ w)
            square += float((x * x).sum())
        at = [np.append(np.arange(len(total)), -1).astype(np.int32), *np.vstack([total, [square] + [0.0] * (n - 1)]).T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in at], ["at", *[f"z{j}" for j in range(n)]])

    added = rows.select("s").mapInArrow(run, "at int, " + ", ".join(f"z{j} double" for j in range(n)))
    out = {r[0]: r[1:] for r in added.groupBy("at").agg(*[F.sum(f"z{j}") for j in range(n)]).collect()}
    z = np.array([out.get(i, (0.0,) * n) for i in range(len(v))])
    return z, out.get(-1, (0.0,))[0]


def leading(rows: DataFrame, size: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(k largest eigenvalues of X'X, eigenvectors, their sum over all) by a block Krylov space from random directions.

    Each pass over the rows adds a block to the space; the best vectors in it are taken once X'X leaves them in their
    direction, within ACCURACY. No matrix is larger than size x (passes (k + SPARE)).
    """
    block = min(size, k + SPARE)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, block)))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    while True:
        w, total = applied(rows, v)
        basis, image = np.hstack([basis, v]), np.hstack([image, w])
        values, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        rest = np.linalg.norm(image @ inner - basis @ inner * values, axis=0)
        if rest.max(initial=0.0) <= ACCURACY * max(values[0], 1e-300) or basis.shape[1] == size:
            return np.maximum(values, 0.0), basis @ inner, total
        for _ in range(2):  # once more, as the first time leaves rounding errors
            w = w - basis @ (basis.T @ w)
            w = w / np.maximum(np.linalg.norm(w, axis=0), 1e-300)
        q, r = np.linalg.qr(w)
        q = q[:, np.abs(np.diag(r)) > 1e-8][:, : size - basis.shape[1]]
        if not q.shape[1]:
            return np.maximum(values, 0.0), basis @ inner, total
        v = np.linalg.qr(q - basis @ (basis.T @ q))[0]


def eof(df: DataFrame, time: str, cell: list[str], value: str, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(EOFs scaled by sqrt(lambda), PCs of unit variance, variance fractions) of the k leading modes.

    Cells are rows of all their times; passes over them multiply with a few directions (see leading), so neither times
    nor cells meet in a square matrix. The largest loading of a mode is positive.
    """
    spark = df.sparkSession
    x = anomalies(df, time, cell, value)
    columns = x.groupBy(*cell).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "x"))), lambda s: s["x"]).alias("s")).persist()
    times = [r[0] for r in df.select(time).distinct().orderBy(time).collect()]
    lam, vec, total = leading(columns, len(times), k) if times else (np.zeros(0), np.zeros((0, 0)), 0.0)
    degrees = max(1, len(times) - 1)
    share = lam / max(total, 1e-300)
    loads = spark.sparkContext.broadcast(vec / np.sqrt(degrees))  # x times it is EOF sqrt(lambda)
    kept = [f for f in columns.schema if f.name in cell]

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            out = numbers(batch, "s") @ loads.value
            n, modes = out.shape
            which = pa.array(np.repeat(np.arange(n), modes))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(1, modes + 1, dtype=np.int32), n)), *[batch.column(f.name).take(which) for f in kept], pa.array(out.ravel())], ["mode", *[f.name for f in kept], "eof"])

    schema = T.StructType([T.StructField("mode", T.IntegerType()), *kept, T.StructField("eof", T.DoubleType())])
    eofs = columns.mapInArrow(project, schema)
    top = eofs.groupBy("mode").agg(F.max_by("eof", F.struct(F.abs("eof"), *[F.col(c) for c in cell])).alias("top"))
    sign = {r.mode: -1.0 if r.top < 0 else 1.0 for r in top.collect()}
    columns.unpersist()
    signs = spark.createDataFrame(list(sign.items()) or [(0, 1.0)], "mode int, s double")
    eofs = eofs.join(F.broadcast(signs), "mode").withColumn("eof", F.col("eof") * F.col("s")).drop("s")
    kind = dict(df.dtypes)[time]
    pcs = spark.createDataFrame([(t, m + 1, float(vec[i, m] * np.sqrt(degrees) * sign.get(m + 1, 1.0))) for i, t in enumerate(times) for m in range(len(lam))], f"{time} {kind}, mode int, pc double")
    return eofs, pcs, spark.createDataFrame([(m + 1, float(s)) for m, s in enumerate(share)], "mode int, fraction double")


def kmeans(samples: DataFrame, k: int = 4, seed: int = 1, features: str = "features") -> DataFrame:
    """samples with `type`, the cluster of their feature arrays."""
    if samples.isEmpty():
        return samples.withColumn("type", F.lit(0))
    rows = samples.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="type").fit(rows)
    return model.transform(rows).drop("_v")


#: Samples from which the first centres are drawn, and passes over all samples at most.
DRAWN, PASSES = 2_000, 40


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of samples to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def first_centres(x: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Centres that are drawn one after the other, farther samples likelier."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    while len(out) < most:
        far = nearest(x, np.array(out)).min(1)
        out.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else out[0])
    return np.array(out)


def by_cluster(rows: DataFrame, centres: dict[int, np.ndarray], judge: dict[int, tuple] | None = None) -> dict[int, list[np.ndarray]]:
    """{k: [sums, squares, inertia or silhouette, sizes]} by cluster, of all ks in one pass. judge has the statistics that silhouettes need."""
    sent = rows.sparkSession.sparkContext.broadcast((centres, judge))

    def run(batches):
        import pyarrow as pa

        (every, stats), out = sent.value, {}
        for batch in batches:
            x = numbers(batch, "features")
            square = (x * x).sum(1)
            for k, c in every.items():
                far = nearest(x, c)
                own = far.argmin(1)
                member = np.zeros((len(x), k))
                member[np.arange(len(x)), own] = 1.0
                score = far[np.arange(len(x)), own] if stats is None else silhouettes(x, square, own, *stats[k])
                new = [member.T @ x, member.T @ square, member.T @ score, member.sum(0)]
                out[k] = [a + b for a, b in zip(out[k], new, strict=True)] if k in out else new
        table = [(k, j, i, float(v)) for k, parts in out.items() for j in range(k) for i, v in enumerate([parts[1][j], parts[2][j], parts[3][j], *parts[0][j]])]
        columns = list(zip(*table, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.float64()], strict=True)], ["k", "j", "i", "v"])

    added = rows.select("features").mapInArrow(run, "k int, j int, i int, v double").groupBy("k", "j", "i").agg(F.sum("v").alias("v")).collect()
    tables = {k: np.zeros((k, 3 + c.shape[1])) for k, c in centres.items()}
    for r in added:
        tables[r.k][r.j, r.i] = r.v
    return {k: [t[:, 3:], t[:, 0], t[:, 1], t[:, 2]] for k, t in tables.items()}


def silhouettes(x: np.ndarray, square: np.ndarray, own: np.ndarray, sums: np.ndarray, squares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of squared distances: those to the own cluster's other samples against those to the nearest other cluster."""
    total = np.maximum(sizes * square[:, None] + squares - 2 * x @ sums.T, 0.0)
    at = np.arange(len(x))
    inner = total[at, own] / np.maximum(sizes[own] - 1, 1)
    mean = np.where(sizes > 0, total / np.maximum(sizes, 1), np.inf)
    mean[at, own] = np.inf
    outer = mean.min(1)
    high = np.maximum(inner, outer)
    return np.where((sizes[own] > 1) & (high > 0) & np.isfinite(outer), (outer - inner) / np.where(high > 0, high, 1.0), 0.0)


def cluster_curve(samples: DataFrame, most: int = 20, seed: int = 1, features: str = "features") -> DataFrame:
    """(k, inertia, silhouette) for each number of clusters from 2 on.

    Each pass over the samples moves the centres of all ks at once, so the number of passes doesn't grow with the ks.
    Where more clusters end with a larger inertia than fewer, they start again from the fewer ones' centres and the
    drawn one that is farthest from them; inertia never rises with k.
    """
    spark = samples.sparkSession
    rows = samples.select(F.transform(features, lambda x: x.cast("double")).alias("features")).where(F.col("features").isNotNull()).persist()
    n = rows.count()
    drawn = rows.sample(min(1.0, 1.5 * DRAWN / max(n, 1)), seed=seed).limit(DRAWN).collect() or rows.limit(DRAWN).collect()
    if not drawn:
        return spark.createDataFrame([], "k int, inertia double, silhouette double")
    x = np.array([r.features for r in drawn], float)
    start = first_centres(x, most, seed)
    centres, inertia, stats = {k: start[:k] for k in range(2, most + 1)}, {}, {}
    active = set(centres)
    for step in range(2 * PASSES):
        found = by_cluster(rows, {k: centres[k] for k in active})
        for k, (sums, squares, scores, sizes) in found.items():
            before, inertia[k] = inertia.get(k, np.inf), float(scores.sum())
            stats[k] = (centres[k], sums, squares, sizes)
            if before - inertia[k] <= 1e-4 * inertia[k] or step >= PASSES:
                active.discard(k)
            else:
                centres[k] = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres[k])
        if not active:
            for k in range(3, most + 1):
                if inertia[k] > inertia[k - 1] and k - 1 not in active:
                    fewer = stats[k - 1][0]
                    centres[k] = np.vstack([fewer, x[nearest(x, fewer).min(1).argmax()]])
                    inertia.pop(k)
                    active.add(k)
                    break
            if not active:
                break
    scores = by_cluster(rows, {k: s[0] for k, s in stats.items()}, {k: s[1:] for k, s in stats.items()})
    rows.unpersist()
    return spark.createDataFrame([(k, inertia[k], float(scores[k][2].sum() / n)) for k in sorted(stats)], "k int, inertia double, silhouette double")


def sift(x: np.ndarray, most: int = 10, rounds: int = 20) -> np.ndarray:
    """Intrinsic modes of a series and its rest: the mean of the envelopes is taken off until it's small."""
    out, rest, at = [], x.astype(float), np.arange(len(x))

    def envelope(h, better):
        inner = np.flatnonzero(better(h[1:-1], h[:-2]) & better(h[1:-1], h[2:])) + 1
        if len(inner) < 2:
            return None
        ends = np.concatenate([[0], inner, [len(h) - 1]])
        return spline(ends, np.concatenate([[h[inner[0]]], h[inner], [h[inner[-1]]]]), at)

    for _ in range(most):
        h = rest.copy()
        for _ in range(rounds):
            up, low = envelope(h, np.greater), envelope(h, np.less)
            if up is None or low is None:
                break
            mean = (up + low) / 2
            h = h - mean
            if (mean**2).sum() < 1e-4 * (h**2).sum():
                break
        if np.array_equal(h, rest):
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def tridiagonal(low: np.ndarray, middle: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a system with three diagonals, by cyclic reduction: each round takes a row's neighbours, ever farther away, out."""
    low, middle, high, right = (a.astype(float) for a in (low, middle, high, right))
    step, n = 1, len(middle)
    while step < n:
        before = lambda a, fill: np.concatenate([np.full(step, fill), a[:-step]])  # noqa: E731, B023
        after = lambda a, fill: np.concatenate([a[step:], np.full(step, fill)])  # noqa: E731, B023
        up, down = -low / before(middle, 1.0), -high / after(middle, 1.0)
        middle = middle + up * before(high, 0.0) + down * after(low, 0.0)
        right = right + up * before(right, 0.0) + down * after(right, 0.0)
        low, high = up * before(low, 0.0), down * after(high, 0.0)
        step *= 2
    return right / middle


def spline(x, y, at):
    """Natural cubic spline; memory is linear in the knots."""
    n, h = len(x), np.diff(x).astype(float)
    slope = np.diff(y) / h
    zero = np.zeros(1)
    c = tridiagonal(np.concatenate([zero, h[:-1], zero]), np.concatenate([zero + 1, 2 * (h[:-1] + h[1:]), zero + 1]), np.concatenate([zero, h[1:], zero]), np.concatenate([zero, 6 * np.diff(slope), zero]))
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    return (c[k] * right**3 + c[k + 1] * left**3) / (6 * h[k]) + (y[k] / h[k] - c[k] * h[k] / 6) * right + (y[k + 1] / h[k] - c[k + 1] * h[k] / 6) * left


def eemd(series: DataFrame, keys: list[str], trials: int = 200, noise: float = 0.2, seed: int = 1, modes: int = 8) -> DataFrame:
    """(keys, mode, at, value): averages over noisy trials of the modes of each series. Trials run as rows of their own."""
    if trials < 1 or noise < 0:
        raise ValueError("trials must be positive and noise not negative")
    spark = series.sparkSession
    rows = series.crossJoin(F.broadcast(spark.range(trials).select(F.col("id").cast("int").alias("trial")))).repartition(*keys, "trial")
    kept = [f for f in series.schema if f.name in keys]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for _, own in frame.groupby([f.name for f in kept], dropna=False, sort=False) if kept else [((), frame)]:
                total = None  # a batch's trials of a series are added up here
                for row in own.itertuples(index=False):
                    x = np.array([p["v"] for p in row.series], float)
                    rng = np.random.default_rng([seed, row.trial])
                    found = sift(x + rng.normal(0, noise * x.std(), len(x)) if noise else x, modes)
                    total = np.zeros((modes + 1, len(x))) if total is None else total
                    total[: len(found) - 1] += found[:-1] / trials
                    total[modes] += found[-1] / trials
                n = total.shape[1]
                out = pd.DataFrame({"mode": np.repeat(np.arange(1, modes + 2), n).astype("int32"), "at": np.tile(np.arange(n), modes + 1).astype("int32"), "value": total.ravel()})
                for f in kept:
                    out[f.name] = getattr(row, f.name)
                yield out[[*(f.name for f in kept), "mode", "at", "value"]]

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInPandas(run, head + "mode int, at int, value double").groupBy(*keys, "mode", "at").agg(F.sum("value").alias("value"))
