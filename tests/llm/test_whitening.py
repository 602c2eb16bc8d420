import math
import random

import numpy as np
import pytest

from fieldlab.llm import op11_whitening as op

from .common_cases import saved

SCHEMA = "vec_id long, embedding array<double>"


def grid(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def brute(rows, k):
    """(n, deviations, components, eigenvalues, trace) in big integers up to the decomposition."""
    fit = sorted({tuple(grid(v)) for _, v in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    away = [[n * x[i] - sums[i] for i in range(d)] for x in fit]
    cov = np.array([[sum(a[i] * a[j] for a in away) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    deviations = {i: sum((n * x - s) ** 2 for x, s in zip(grid(v), sums, strict=True)) for i, v in rows}
    white = {i: [sum((x - s / n) * vectors[j, -1 - c] for j, (x, s) in enumerate(zip(grid(v), sums, strict=True))) / values[-1 - c] ** 0.5 for c in range(k)] for i, v in rows}
    return n, deviations, white, values[::-1] / values.sum()


@pytest.mark.parametrize("parts", [1, 4])
def test_equals_brute_force(spark, parts):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(3, 1 + j) for j in range(6)]) for i in range(80)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(60)]
    out, fit, error = op.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts), k=4)
    n, deviations, white, explained = brute(rows, 4)
    got = {r.vec_id: r for r in out.collect()}
    assert fit.n == n == 80 and error < 1e-10 and {i: r.deviation for i, r in got.items()} == deviations
    assert fit.explained == pytest.approx(explained[:4], rel=1e-9)
    for c in range(4):
        sign = math.copysign(1, got[0].whitened[c] * white[0][c])
        assert all(r.whitened[c] == pytest.approx(sign * white[i][c], abs=1e-8) for i, r in got.items())


def test_limb_products_are_exact():
    rng = random.Random(1)
    for bits in (3, 19, 20, 21, 61, 200):
        a, b = (np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(5)] for _ in range(5)], object) for _ in range(2))
        assert (op.times(a, b) == a.dot(b)).all()
        for x in [*a[0], 0, 2**bits - 1, -(2**bits)]:
            assert sum(p << (op.PART * at) for at, p in op.parts(x)) == x
    x = np.array([[2**61, -(2**61), -1, 0, 2**19]], np.int64)
    assert (op.recombined([d.astype(np.int64) for d in op.limbs(x)]) == x).all() and all(np.abs(d).max() <= 2**19 for d in op.limbs(x))


def test_small_variances_beside_very_large_ones(spark):
    """Entries of one dimension up to 10^12, of the others about 1: a covariance in doubles loses the others."""
    rng = np.random.default_rng(3)
    small = rng.normal(0, 1, (400, 5))
    big = np.where(np.arange(400) % 2, 1.0, -1.0)[:, None] * 1e12
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.hstack([small, big]))]
    _, fit, error = op.whiten(spark.createDataFrame(rows, SCHEMA))
    assert fit.k == 6 and error < 1e-6
    x = np.floor(64 * small)
    x -= x.mean(0)
    own = x - np.outer(big[:, 0], x.T @ big[:, 0]) / (big**2).sum()  # what is left beside the large component
    expected = np.sort(np.linalg.eigvalsh(own.T @ own / 400))[::-1]
    assert np.array(fit.explained[1:]) / fit.explained[1] == pytest.approx(expected / expected[0], rel=1e-6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [3.0, -1.0]), (7, [3.0, -1.0]), (8, [0.5, 1e300])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS whitened", "1 AS deviation", "'x' AS label")
    out, fit, _ = op.whiten(df)
    got = out.collect()
    assert fit.n == 3 and sorted(str(r.vec_id) for r in got) == ["7", "7", "8", "None"] and {r.label for r in got} == {"x"}
    assert [len(r.whitened) for r in got] == [2] * 4 and [r.deviation for r in got if r.vec_id == 8] == [None]
    assert len({str(r) for r in got if r.vec_id == 7}) == 1


def test_no_variance_and_no_rows(spark):
    out, fit, error = op.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA))
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [None, None])] * 2 and fit.explained == [0.0, 0.0] and error is None
    out, fit, error = op.whiten(spark.createDataFrame([(1, None)], SCHEMA))
    assert out.count() == 0 and fit is None and error is None


def test_query(spark, tmp_path):
    got = op.query(spark, "/root/testdata/sf0.001").collect()
    n = len({r.vec_id for r in got})
    assert len(got) == 16 * n and {r.component for r in got} == set(range(1, 17)) and max(r.identity_error for r in got) < 1e-9
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op.query(spark, saved(empty, tmp_path, "embeddings")).count() == 0
