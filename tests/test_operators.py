"""Closed-form answers of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions import scalar, stats
from fieldlab.model import from_series, from_slab, normalise, to_series, to_slab
from fieldlab.operators import calculus, climate, elliptic, forcing, joins, modes, reduce, regrid, select, spatial, spectral, window


def grid(spark, f, lats=range(10, 80, 10), lons=range(0, 100, 10)):
    return spark.createDataFrame([(1, float(y), float(x), float(f(x, y))) for y in lats for x in lons], "k int, lat double, lon double, f double")


def test_normalise_makes_nan_null_and_dates(spark):
    df = normalise(spark.createDataFrame([(19610101, 1.0), (19610102, float("nan"))], "date int, x double"), {"date": "time"}, time_format="yyyyMMdd")
    rows = df.orderBy("time").collect()
    assert str(rows[0].time) == "1961-01-01" and rows[1].x is None


@pytest.mark.parametrize("values, mean, total", [([None, None], None, 0.0), ([1.0, None, 3.0], 2.0, 4.0), ([1.0, 2.0], 1.5, 3.0)])
def test_null_matrix(spark, values, mean, total):
    df = spark.createDataFrame([("2000-06-01", 1.0, 1.0, v) for v in values], "time string, lat double, lon double, x double").withColumn("time", F.to_date("time"))
    assert reduce.area_mean(df, ["time"], ["x"]).first().x == mean
    assert reduce.yearly_sum(df, "time", ["lat"], ["x"]).first().x == total
    assert reduce.valid_count(df, ["lat"], "x").first().n == sum(v is not None for v in values)
    assert reduce.composite(df, ["lat"], "x").first().x == (mean if None not in values else None)


def test_trend_is_found_and_taken_off(spark):
    df = spark.createDataFrame([(y, 2 + 0.1 * (y - 1961)) for y in range(1961, 2023)], "year int, x double").withColumn("cell", F.lit(1))
    r = reduce.regression(df, ["cell"], "x", "year").first()
    assert r.slope == pytest.approx(0.1) and r.n == 62
    assert window.detrended(df, [], "year", "x").agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    assert reduce.correlation(df, ["cell"], "x", "year").first().r == pytest.approx(1.0)


def test_regression_of_one_pair_is_null(spark):
    r = reduce.regression(spark.createDataFrame([(1, 1.0, 2.0)], "c int, x double, y double"), ["c"], "y", "x").first()
    assert r.slope is None and r.intercept is None


def test_standardised_and_classes(spark):
    df = spark.createDataFrame([(i, float((-1) ** i)) for i in range(10)], "i int, x double")
    z = window.standardised(df, [], "x").withColumn("c", scalar.three_way(F.col("z")))
    assert {r.c for r in z.collect()} == {1, -1} and {round(r.z, 9) for r in z.collect()} == {1.0, -1.0}


def test_winter_needs_three_months_and_ignores_order(spark):
    rows = [(f"{y}-{m:02d}-01", float(y * 100 + m)) for y in (1960, 1961, 1962) for m in range(1, 13)][::-1]
    df = spark.createDataFrame(rows, "t string, x double").withColumn("time", F.to_date("t"))
    got = {r.year: r["index"] for r in climate.winter_index(df, "time", "x").collect()}
    assert got == {1961: pytest.approx((196012 + 196101 + 196102) / 3), 1962: pytest.approx((196112 + 196201 + 196202) / 3)}


def test_quantile_interpolates(spark):
    assert reduce.quantile(spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9, 3)], "x double"), "x", 0.8).first().q == pytest.approx(5.0)


def test_moving_average_keeps_full_windows(spark):
    df = spark.createDataFrame([(1, i, None if i == 9 else float(i)) for i in range(12)], "cell int, d int, x double")
    got = window.moving_average(df, ["cell"], "d", "x").orderBy("d").collect()
    assert [r.day for r in got] == list(range(1, 9)) and [r.x for r in got] == [2.0, 3.0, 4.0, 5.0, 6.0, None, None, None]


def test_gradients_on_an_uneven_axis(spark):
    df = spark.createDataFrame([(1, i, float(c), float(c * c)) for i, c in enumerate((0, 1, 3, 7))], "k int, i int, c double, f double")
    got = df.select("i", window.derivative("f", "c", ["k"], "i").alias("a"), window.coordinate_gradient("f", "c", ["k"], "i").alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [1.0, 3.0, pytest.approx(8.0), 10.0]
    assert [r.b for r in got] == [1.0, 2.0, 6.0, 10.0]


def test_edges_are_told_by_place(spark):
    df = spark.createDataFrame([(1, i, None if i == 1 else float(i)) for i in range(4)], "k int, i int, f double")
    got = [r.g for r in df.select("i", window.index_gradient("f", ["k"], "i").alias("g")).orderBy("i").collect()]
    assert got == [None, 1.0, None, 1.0]


def test_solid_body_rotation(spark):
    df = grid(spark, lambda x, y: 10 * math.cos(math.radians(y))).withColumnRenamed("f", "u").withColumn("v", F.lit(0.0))
    assert calculus.divergence(df, ["k"]).agg(F.max(F.abs("div"))).first()[0] < 1e-12
    got = calculus.vorticity(df, ["k"]).where("lat = 40 AND lon = 50").first().vor
    exact = 10 * math.sin(math.radians(40)) / scalar.EARTH_RADIUS
    assert got == pytest.approx(exact, rel=0.01)


def test_poles_bands_and_rings(spark):
    df = grid(spark, lambda x, y: 1, range(-90, 100, 30), range(0, 40, 10))
    got = df.select("lat", select.null_poles(F.col("lat"), F.col("f")).alias("p"), select.null_band(F.col("lat"), F.col("f"), 30.0, inclusive=True).alias("b"))
    assert {r.lat for r in got.where("p IS NULL").collect()} == {-90.0, 90.0} and {r.lat for r in got.where("b IS NULL").collect()} == {-30.0, 0.0, 30.0}
    assert select.interior(df, ["k"]).count() == 5 * 2 == select.null_ring(df, ["k"], ["f"]).where("f IS NOT NULL").count()


def test_flux_of_a_constant_is_zero_and_needs_a_mode(spark):
    df = grid(spark, lambda x, y: 5).withColumnRenamed("f", "psi").withColumn("u", F.lit(10.0)).withColumn("v", F.lit(1.0))
    for mode in (1, 2):
        got = calculus.wave_activity_flux(df, ["k"], 250.0, mode=mode).agg(F.max(F.abs("fx")), F.max(F.abs("fy")), F.count("fx")).first()
        assert got[0] < 1e-15 and got[1] < 1e-15 and got[2] > 0
    with pytest.raises(ValueError):
        calculus.wave_activity_flux(df, ["k"], 250.0, mode=3)


def test_sweeps_agree_with_the_direct_solution():
    lat, lon = np.arange(20.0, 62, 6), np.arange(0.0, 60, 6)
    dx2, dy2 = elliptic.spacing(lat, lon)
    rhs = np.random.default_rng(1).normal(size=(len(lat), len(lon))) * 1e-10
    exact = elliptic.direct(rhs, dx2, dy2)
    swept, sweeps, _ = elliptic.relax(rhs, dx2, dy2, 1.5, 1e-9, 5000)
    assert np.abs(exact - swept).max() < 1e-6 and sweeps < 5000
    plain, _, _ = elliptic.jacobi(-rhs, dx2, dy2, 1e-9, 20000)
    assert np.abs(exact - plain).max() < 1e-5


def test_wavefronts_equal_lexicographic_sweeps():
    rng = np.random.default_rng(2)
    rhs, dx2, dy2 = rng.normal(size=(6, 8)), np.full((6, 8), 1.5), np.full((6, 8), 0.7)
    x, c = np.zeros_like(rhs), 2 / 1.5 + 2 / 0.7
    for _ in range(3):
        for i in range(1, 5):
            for j in range(1, 7):
                x[i, j] = 0.8 * x[i, j] + 0.2 * ((x[i, j + 1] + x[i, j - 1]) / 1.5 + (x[i + 1, j] + x[i - 1, j]) / 0.7 - rhs[i, j]) / c
    assert np.allclose(elliptic.relax(rhs, dx2, dy2, 0.2, 0, 3)[0], x, atol=1e-14)


def test_potentials_have_opposite_signs_on_request(spark):
    df = grid(spark, lambda x, y: math.sin(x / 9) + y / 50).withColumnRenamed("f", "u").withColumn("v", F.col("lon") / 30)
    a = elliptic.stream_function(df, ["k"]).where("lat = 40 AND lon = 50").first()
    b = elliptic.stream_function(df, ["k"], sign="standard").where("lat = 40 AND lon = 50").first()
    assert a.psi == pytest.approx(-b.psi) and a.u_psi == pytest.approx(-b.u_psi)


def test_one_harmonic_and_round_trip(spark):
    t = spectral.Truncation(n_lon=32, n_lat=16, n=10, m=10, l=10)
    tables = spectral.legendre(t)
    c = np.zeros((11, 11), complex)
    c[2, 1] = 1 + 2j
    back = spectral.forward(spectral.backward(c, t, tables), t, tables)
    assert np.abs(back - c).max() < 1e-12
    rng = np.random.default_rng(3)
    for m, k in t.pairs():
        c[m, k] = rng.normal() + (1j * rng.normal() if m else 0)
    assert np.abs(spectral.forward(spectral.backward(c, t, tables), t, tables) - c).max() < 1e-11
    assert spectral.Truncation().size == 1892
    assert spectral.index_map(spark).agg(F.max("im_index")).first()[0] == 1892


def test_meridional_derivative_tables():
    t = spectral.Truncation(n_lon=32, n_lat=200, n=6, m=6, l=6)
    mu, _, p, d = spectral.legendre(t)
    lat = np.arcsin(mu)
    for m, k in ((0, 3), (2, 1), (3, 0)):
        assert np.abs(np.gradient(p[m, k], lat) - d[m, k])[5:-5].max() < 2e-2 * np.abs(d[m, k]).max()


def test_rank_one_field_has_one_mode(spark):
    df = spark.createDataFrame([(t, float(y), float(x), math.sin(t) * (x + 2 * y)) for t in range(8) for y in range(3) for x in range(4)], "time int, lat double, lon double, f double")
    eofs, pcs, share = modes.eof(df, "time", ["lat", "lon"], "f", 2)
    s = {r.mode: r.fraction for r in share.collect()}
    assert s[1] == pytest.approx(1.0) and s[2] < 1e-9
    pc = np.array([r.pc for r in pcs.where("mode = 1").orderBy("time").collect()])
    assert pc.std(ddof=1) == pytest.approx(1.0)
    field = eofs.where("mode = 1").join(pcs.where("mode = 1").select("time", "pc"), how="cross").withColumn("g", F.col("eof") * F.col("pc"))
    mean = np.mean([math.sin(t) for t in range(8)])
    worst = max(abs(r.g - (math.sin(r.time) - mean) * (r.lon + 2 * r.lat)) for r in field.collect())
    assert worst < 1e-9


def test_two_blobs(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, float(i % 3) * 0.1]) for i in range(30)], "sample int, features array<double>")
    got = {(r.sample % 2, r.type) for r in modes.kmeans(df, 2).collect()}
    assert len(got) == 2 and len({t for _, t in got}) == 2


def test_modes_add_up_to_the_series(spark):
    x = [math.sin(i / 2) + i / 40 for i in range(60)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "name string, t int, v double")
    out = modes.eemd(to_series(df, ["name"], "t", "v"), ["name"], trials=2, noise=0.0)
    total = [r.s for r in out.groupBy("at").agg(F.sum("value").alias("s")).orderBy("at").collect()]
    assert np.allclose(total, x)
    with pytest.raises(ValueError):
        modes.eemd(df, ["name"], trials=0)


def test_linear_interpolation_is_exact_for_planes(spark):
    df = grid(spark, lambda x, y: x + 2 * y)
    axis = lambda n, v: spark.createDataFrame([(float(x),) for x in v], f"{n} double")
    got = regrid.interpolate(df, ["k"], "f", {"lon": axis("lon", [0, 5, 90, 95]), "lat": axis("lat", [15, 70])}).collect()
    assert len(got) == 8 and all(r.f is None if r.lon > 90 else abs(r.f - r.lon - 2 * r.lat) < 1e-9 for r in got)
    assert regrid.interpolate(df, ["k"], "f", {"lon": axis("lon", [95])}, missing=0.0).first().f == 0.0
    with pytest.raises(Exception, match="targets outside lon"):
        regrid.interpolate(df, ["k"], "f", {"lon": axis("lon", [95])}, outside="error").collect()


def test_polygon_mask_counts_the_inside(spark):
    df = grid(spark, lambda x, y: 1)
    edges = spatial.edge_table(spatial.polygons(spark, [[(5, 15), (45, 15), (45, 45), (5, 45)], [(15, 25), (25, 25), (25, 35), (15, 35)]]))
    once = spatial.masked(df, edges, ["f"])
    assert once.where("f IS NOT NULL").count() == 4 * 3 - 1 and once.count() == df.count()
    assert spatial.masked(once, edges, ["f"]).where("f IS NOT NULL").count() == 11
    assert '"type":"Feature"' in spatial.geojson(spatial.polygons(spark, [[(0, 0), (1, 0), (1, 1)]])).first().value


def test_heat_events(spark):
    rows = [(2000, d, float(c), 0.0, 10.0 if c < {0: 0, 1: 2, 2: 10}[d] else 1.0) for d in range(3) for c in range(10)]
    df = spark.createDataFrame(rows, "year int, dos int, lat double, lon double, x double")
    limit = spark.createDataFrame([(5.0,)], "q double")
    got = {r.dos: r.fraction for r in climate.extreme_events(df, "x", threshold=limit).collect()}
    assert got == {1: 0.2, 2: 1.0}
    assert climate.event_samples(df, climate.extreme_events(df, "x", threshold=limit), "x", limit).count() == 20


def test_profiles_and_forcing(spark):
    for kind, f in {1: lambda s: 8 * math.sin(math.pi * s), 2: lambda s: 8 * math.exp(-20 * (s - 0.45) ** 2), 3: lambda s: 8.0}.items():
        rows = forcing.levels(spark).select("sigma", forcing.vertical_value(F.col("sigma"), kind).alias("v")).collect()
        assert len(rows) == 20 and all(r.v == pytest.approx(f(r.sigma)) for r in rows)
    spot = spark.createDataFrame([(77.0, -1.5), (77.0, 10.0), (300.0, 0.0)], "lon double, lat double")
    assert [r.h for r in spot.select(forcing.horizontal_value(F.col("lon"), F.col("lat"), 1).alias("h")).collect()] == [0.25, 0.0, 0.0]
    hor, ver = spot.withColumn("hor", F.lit(2.0)), spark.createDataFrame([(1, 43200.0)], "lev int, ver double")
    assert forcing.forcing(hor, ver, {"t": 3.0}).select("v", "t").first()[:] == (0.0, 3.0)
    for bad in (lambda: forcing.vertical_value(F.lit(1.0), 4), lambda: forcing.horizontal_value(F.lit(1.0), F.lit(1.0), 1, rx=-1), lambda: forcing.forcing(hor, ver, {"z": 1})):
        with pytest.raises(ValueError):
            bad()
    assert abs(forcing.gauss_latitudes()[0] - 87.8638) < 1e-3


def test_layouts_round_trip(spark):
    df = grid(spark, lambda x, y: x * y).withColumn("f", F.when(F.col("lon") != 30, F.col("f")))
    back = from_slab(to_slab(df, ["k"], "f"), ["k"], "f")
    assert sorted(map(repr, df.select("k", "lat", "lon", "f").collect())) == sorted(map(repr, back.collect()))
    s = from_series(to_series(df.where("lat = 10"), ["k"], "lon", "f"), ["k"], "lon", "f")
    assert s.count() == 10


def test_smoothing_keeps_a_constant(spark):
    df = grid(spark, lambda x, y: 7)
    assert window.gaussian_filter(to_slab(df, ["k"], "f")).select(F.array_max("data"), F.array_min("data")).first()[:] == (pytest.approx(7), pytest.approx(7))


def test_joins_and_lookups(spark):
    a, b = (spark.createDataFrame([(i, i * k) for i in range(n)], "year int, x int") for n, k in ((5, 1), (4, 10)))
    assert joins.same_keys(a, b, "year").first()[:] == (1, False)
    assert joins.lookup(a, b.withColumnRenamed("x", "y"), ["year"], "y", -1).where("y = -1").count() == 1
    assert joins.of_years(a, b).count() == 4 and joins.product(a.select("x"), b.select("year")).count() == 20
    z = joins.zipped(a, b.withColumnsRenamed({"year": "y2", "x": "x2"}), ["year"], ["y2"])
    assert z.count() == 5 and z.where("y2 IS NULL").count() == 1
    assert select.first_match(a, "x", 3, "year").first().year == 3
    assert {r.year for r in select.strided(a, "year", 2).collect()} == {0, 2, 4} and {r.year for r in select.positions(a, "year", 1, 3).collect()} == {1, 2}
    with pytest.raises(ValueError):
        select.months(a, "year", [13])


def test_critical_correlations():
    assert stats.t_quantile(0.975, 43) == pytest.approx(2.0167, abs=1e-4)
    assert [round(stats.r_crit(45, a), 3) for a in (0.01, 0.05, 0.1)] == [0.380, 0.294, 0.248]
    with pytest.raises(ValueError):
        stats.r_crit(2)


def test_scalars(spark):
    r = spark.range(1).select(scalar.char_count(F.lit("tomato Toast"), "t").alias("n"), scalar.season_key(F.lit(1961), F.lit(3)).alias("k"), scalar.longitude(F.lit(350.0), True).alias("w"), scalar.month_seconds(F.lit(2)).alias("s"), scalar.day_of(F.lit(19610203)).cast("string").alias("d"), scalar.zeros(3).alias("z"), scalar.grid_axis(0.0, 2.5, 3).alias("g")).first()
    assert r[:] == (3, 196103, -10.0, 28.25 * 86400, "1961-02-03", [0.0, 0.0, 0.0], [0.0, 2.5, 5.0])


def test_quantile_of_large_and_small_tables(spark):
    rng = np.random.default_rng(3)
    for xs in (rng.random(30_000), np.repeat([1.0, 2.0], [20_000, 3]), np.arange(12_000.0), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
        for q in (0, 0.2, 0.8, 1):
            assert reduce.quantile(df, "x", q).first().q == pytest.approx(np.quantile(xs, q))
    assert reduce.quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5).first().q is None


def test_places_over_parts(spark):
    rows = [(i % 50 if i % 7 else None, i) for i in range(500)]
    got = select.numbered(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r._place)] == order and sorted(r._place for r in got) == list(range(500))
    assert select.numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_slabs_with_gaps(spark):
    rows = [("a", 2.0, 5.0, 1.0), ("a", 1.0, 6.0, 2.0), ("a", 3.0, 5.0, None), ("b", 0.0, 0.0, 9.0)]
    got = {r.k: (r.lat, r.lon, r.data) for r in to_slab(spark.createDataFrame(rows, "k string, lat double, lon double, v double"), ["k"], "v").collect()}
    assert got == {"a": ([1.0, 2.0, 3.0], [5.0, 6.0], [None, 2.0, 1.0, None, None, None]), "b": ([0.0], [0.0], [9.0])}


def test_significance_follows_each_count(spark):
    rows = [(0.9, 4), (0.96, 4), (0.5, 30), (0.3, 30), (1.0, 2)]
    got = {(r.r, r.n): r.mark for r in reduce.significance(spark.createDataFrame(rows, "r double, n long")).collect()}
    assert got == {(0.9, 4): None, (0.96, 4): 0.0, (0.5, 30): 0.0, (0.3, 30): None, (1.0, 2): None}


def test_packed_coefficients_are_written_in_order(spark, tmp_path):
    rows = [(m, k, part, var, lev, float(hash_)) for hash_, (m, k, part, var, lev) in enumerate((m, k, part, var, lev) for var in ("t", "vor") for lev in (1, 2) for part in ("im", "re") for k in (0, 1) for m in (0, 1, 2))]
    packed = spectral.packed(spark.createDataFrame(rows, "m int, l int, part string, var string, k int, coef double"), ["vor", "t"])
    assert spectral.dump(packed, str(tmp_path / "f")) == len(rows)
    want = [r[5] for r in sorted(rows, key=lambda r: (r[0], ["vor", "t"].index(r[3]), r[1], ["re", "im"].index(r[2]), r[4]))]
    assert np.fromfile(tmp_path / "f", "<f8").tolist() == want
    with pytest.raises(ValueError):
        spectral.packed(packed, [])


def test_derivative_of_rows_equals_the_transform():
    t = spectral.Truncation(16, 8, 5, 5, 5)
    tables, field = spectral.legendre(t), np.random.default_rng(1).random((8, 16))
    plain, along = spectral.forward(field, t, tables), spectral.forward(field, t, tables, "X")
    assert np.allclose(along, 1j * np.arange(6)[:, None] * plain)
    grid = spectral.backward(plain, t, tables)
    assert np.allclose(spectral.backward(plain, t, tables, mode="N"), -grid) and np.allclose(spectral.backward(plain, t, tables, mode="A", onto=field), field + grid) and np.allclose(spectral.backward(plain, t, tables, mode="S", onto=field), field - grid)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [10**6, 7])
def test_brackets_by_parts_equal_a_search(spark, monkeypatch, rows):
    """Labels and targets in one part, or in many parts, some without a label."""
    monkeypatch.setattr(select, "PART_ROWS", rows)
    rng = np.random.default_rng(4)
    labels = np.unique(np.concatenate([rng.normal(0, 1, 40).round(2), [50.0, 51.0]]))
    targets = np.unique(np.concatenate([rng.uniform(-3, 60, 120), labels[::3]]))
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    out = regrid.brackets(frame(labels), frame(targets), "x")
    got = {}
    for r in out.collect():
        got.setdefault(r.target, []).append((r.x, r.weight))
    want = [t for t in targets if labels[0] <= t <= labels[-1]]
    assert sorted(got) == sorted(want)
    for t in want:
        assert sum(w for _, w in got[t]) == pytest.approx(1) and sum(x * w for x, w in got[t]) == pytest.approx(t)
        k = np.searchsorted(labels, t, side="right")
        assert {x for x, _ in got[t]} <= {labels[k - 1], labels[min(k, len(labels) - 1)]} and (len(got[t]) == 1) == (t in labels)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def crossing_count(points, rings):
    inside = set()
    for x, y in points:
        for ring in rings:
            n = 0
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            if n % 2:
                inside.add((y, x))
    return inside


def test_mask_by_bands_equals_the_crossing_rule(spark):
    """Edges from a thousandth to thousands of units high, holes, and points at the latitudes of vertices."""
    rng = np.random.default_rng(7)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 60))
    star = [(float(100 + r * math.cos(a)), float(10 + r * math.sin(a))) for a, r in zip(turn, rng.uniform(0.01, 80, 60), strict=True)]
    rings = [star, [(-5e4, -9e3), (6e4, -9e3), (100.0, 12e3)], [(0.0, 0.0), (0.002, 0.0), (0.002, 0.003), (0.0, 0.003)]]
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 200, 300), rng.uniform(-80, 100, 300), strict=True)] + star[:20] + [(0.001, 0.001), (0.001, 0.003)]
    shapes = spatial.polygons(spark, [rings[0]], 0).unionByName(spatial.polygons(spark, [rings[1]], 1)).unionByName(spatial.polygons(spark, [rings[2]], 2))
    for some in ([0], [0, 1, 2], [2]):
        found = spatial.inside(spark.createDataFrame(points, "lon double, lat double"), spatial.edge_table(shapes.where(F.col("geom_id").isin(some))))
        assert {tuple(r) for r in found.collect()} == crossing_count(points, [rings[i] for i in some])
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_mask_of_many_edges_and_points(spark):
    """A circle of 100,000 edges and 200,000 scattered points: a nested loop would make 2 * 10^10 pairs."""
    n = 100_000
    at = lambda k: (F.cos(2 * math.pi * (k % n) / n) * 50, F.sin(2 * math.pi * (k % n) / n) * 50)
    (x1, y1), (x2, y2) = at(F.col("id")), at(F.col("id") + 1)
    edges = spark.range(n).select(F.lit(0).alias("geom_id"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("y1 <> y2")
    points = spark.range(200_000).select((F.rand(1) * 120 - 60).alias("lon"), (F.rand(2) * 120 - 60).alias("lat"))
    far = F.hypot("lon", "lat")
    got = spatial.inside(points, edges)
    assert got.where(far > 50.001).count() == 0 and got.count() >= points.where(far < 49.999).count()


@pytest.mark.parametrize("values", ["ties", "outlier", "spread", "two"])
def test_quantile_by_rounds(spark, monkeypatch, values):
    monkeypatch.setattr(reduce, "FEW", 20)
    monkeypatch.setattr(reduce, "ACCURACY", 50)
    rng = np.random.default_rng(2)
    xs = {"ties": np.repeat([1.0, 2.0, 5.0], [700, 900, 900]), "outlier": np.concatenate([rng.random(3000), [1e300, -1e300]]), "spread": np.exp(rng.normal(0, 40, 4000)), "two": np.repeat([-0.5, 7.0], [1, 2500])}[values]
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(xs)], "x double").repartition(3)
    for q in (0.0, 0.27, 0.28, 0.5, 0.8, 0.9997, 1.0):
        assert reduce.quantile(df, "x", q).first().q == pytest.approx(np.quantile(xs, q))


def test_places_with_a_constant_first_column(spark, monkeypatch):
    """Parts are cut by the whole key, texts and dates too, and stay of about one size."""
    monkeypatch.setattr(select, "PART_ROWS", 400)
    df = spark.range(8000).select(F.lit("same").alias("a"), F.when(F.col("id") % 2 == 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))).alias("b"), F.sha1(F.col("id").cast("string")).alias("c"), "id")
    rows = select.parted(df, ["a", "b"], select.cuts_of(df, ["a", "b"]))
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 2.5 * 8000 / 21 and sum(sizes) == 8000
    placed = select.numbered(df, ["a", "b"]).collect()
    assert sorted(r._place for r in placed) == list(range(8000))
    got = [r.id for r in sorted(placed, key=lambda r: r._place) if r.b is not None]
    assert got == sorted(got) and max(r._place for r in placed if r.b is None) == 3999


def dense_spline(x, y, at):
    """The same spline by its full matrix."""
    n, h = len(x), np.diff(x).astype(float)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    return (c[k] * right**3 + c[k + 1] * left**3) / (6 * h[k]) + (y[k] / h[k] - c[k] * h[k] / 6) * right + (y[k + 1] / h[k] - c[k + 1] * h[k] / 6) * left


def test_modes_equal_those_of_dense_splines(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=747)) + 5 * np.sin(np.arange(747) / 12)
    got = modes.sift(x)
    monkeypatch.setattr(modes, "spline", dense_spline)
    want = modes.sift(x)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


def test_modes_of_a_long_series(spark):
    """20,000 values: a dense system for 7,000 knots would hold 400 MB for each envelope."""
    at = np.arange(20_000)
    x = np.sin(at / 3) + 3 * np.sin(at / 100) + at / 5000
    df = spark.createDataFrame([("a", [(int(i), float(v)) for i, v in zip(at, x, strict=True)])], "name string, series array<struct<t:int,v:double>>")
    out = modes.eemd(df, ["name"], trials=3, noise=0.01)
    total = out.groupBy("at").agg(F.sum("value").alias("s"))
    away = total.orderBy("at").toPandas()["s"].to_numpy() - x
    assert len(away) == 20_000 and np.abs(away).max() < 0.2 and out.count() == 9 * 20_000


def gram_modes(field, k):
    """Eigenvalues and vectors by the matrix of all times."""
    x = field - field.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(x.T @ x)
    return values[::-1][:k] / values.sum(), vectors[:, ::-1][:, :k]


@pytest.mark.parametrize("times, spread", [(7, 1.0), (90, 0.9), (300, 0.999)])
def test_modes_equal_those_of_all_times(spark, times, spread):
    """Fewer times than directions, and spectra that fall fast and hardly."""
    rng = np.random.default_rng(times)
    field = (rng.normal(size=(40, min(40, times))) * spread ** np.arange(min(40, times))) @ rng.normal(size=(min(40, times), times))
    df = spark.createDataFrame([(t, c, float(field[c, t])) for c in range(40) for t in range(times)], "time int, cell int, f double").repartition(4)
    eofs, pcs, share = modes.eof(df, "time", ["cell"], "f", 3)
    fraction, vectors = gram_modes(field, 3)
    assert [r.fraction for r in share.orderBy("mode").collect()] == pytest.approx(fraction, rel=1e-8)
    for m in (1, 2, 3):
        pc = np.array([r.pc for r in pcs.where(F.col("mode") == m).orderBy("time").collect()]) / math.sqrt(times - 1)
        load = np.array([r.eof for r in eofs.where(F.col("mode") == m).orderBy("cell").collect()])
        assert abs(abs(pc @ vectors[:, m - 1]) - 1) < 1e-8 and load[np.abs(load).argmax()] > 0
        assert np.allclose((field - field.mean(1, keepdims=True)) @ pc / math.sqrt(times - 1), load, atol=1e-8)


def test_cluster_curve_by_passes_for_all_ks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    blobs = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (8, 0), (0, 8), (9, 9))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(blobs)], "sample int, features array<double>").repartition(3)
    passes, true = [], modes.by_cluster
    monkeypatch.setattr(modes, "by_cluster", lambda *a: passes.append(1) or true(*a))
    got = modes.cluster_curve(df, 9).orderBy("k").collect()
    assert [r.k for r in got] == list(range(2, 10)) and len(passes) < 60
    assert all(a.inertia >= b.inertia for a, b in zip(got, got[1:], strict=False)) and max(got, key=lambda r: r.silhouette).k == 4
    centres = np.array([blobs[60 * i : 60 * i + 60].mean(0) for i in range(4)])
    assert got[2].inertia == pytest.approx(modes.nearest(blobs, centres).min(1).sum(), rel=1e-6)
    assert modes.cluster_curve(df.limit(0)).count() == 0


def test_silhouettes_equal_those_of_all_pairs():
    rng = np.random.default_rng(8)
    x, own = rng.normal(size=(30, 3)), rng.integers(0, 4, 30)
    own[own == 3] = 0
    own[0] = 3  # a cluster of one sample
    sums, squares, sizes = (np.array([f(x[own == j]) for j in range(4)]) for f in (lambda a: a.sum(0), lambda a: (a * a).sum(), len))
    got = modes.silhouettes(x, (x * x).sum(1), own, sums, squares, sizes.astype(float))
    far = ((x[:, None] - x) ** 2).sum(2)
    for i in range(30):
        inner = far[i][(own == own[i]) & (np.arange(30) != i)]
        outer = min(far[i][own == j].mean() for j in range(4) if j != own[i])
        want = 0.0 if not len(inner) else (outer - inner.mean()) / max(outer, inner.mean())
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("size", [4, 9, 10**6])
def test_chunks_equal_whole_histories(spark, monkeypatch, size):
    """Histories of 1 to 37 rows with gaps in their labels and missing values; borders of chunks fall inside them."""
    monkeypatch.setattr(window, "CHUNK", size)
    monkeypatch.setattr(select, "PART_ROWS", 30)
    rng = np.random.default_rng(1)
    rows = [(k, int(t), None if rng.random() < 0.1 else float(rng.normal())) for k, n in ((1, 37), (2, 1), (3, 2), (4, 12), (5, 30)) for t in np.sort(rng.choice(100, n, replace=False))]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    work = lambda r, keys: r.withColumns({"g": window.index_gradient("x", keys, "t"), "c": window.coordinate_gradient("x", F.col("t").cast("double"), keys, "t"), "d": window.centred_difference("x", keys, "t"), "s": window.shifted("x", keys, "t", 3)})
    for keys in (["k"], []):
        own = df if keys else df.where("k = 1")
        order = lambda r: (r.k, r.t)
        assert sorted(window.chunked(own, keys, "t", 3, work).collect(), key=order) == sorted(work(own, keys).collect(), key=order)
        whole, parts = (window.moving_average(own, keys, "t", "x", 5, by_chunks=b).select("k", "t", "x", "day").collect() for b in (False, True))
        assert len(whole) and [tuple(r) for r in sorted(parts, key=order)] == [(a, b, pytest.approx(x), d) for a, b, x, d in sorted(whole, key=order)]


@pytest.mark.parametrize("uneven", [False, True])
def test_separated_equals_direct(spark, uneven):
    rng = np.random.default_rng(5)
    lats, lons = np.sort(rng.uniform(-70, 70, 9)), (np.sort(rng.uniform(0, 300, 80)) if uneven else np.arange(0, 300, 3.75))
    df = spark.createDataFrame([(k, "a", float(y), float(x), float(rng.normal())) for k in (1, 2) for y in lats for x in lons], "k int, name string, lat double, lon double, r double").where("lat < 60 OR k = 1 OR lon > 20")
    a, b = (elliptic.poisson(df.where("k = 1").unionByName(df.where("k = 2")), ["k"], "r", "psi", method=m).orderBy("k", "lat", "lon").toPandas() for m in ("separated", "direct"))
    assert len(a) == len(b) == df.count() and np.abs(a.psi - b.psi).max() < 1e-9 * np.abs(b.psi).max()


def test_separated_solves_a_large_field(spark):
    """500 x 1,000 cells (a dense system would have 2.5 * 10^11 entries): the right-hand side comes back as the Laplacian."""
    lats, lons = np.linspace(-60, 60, 500), np.linspace(0, 200, 1000)
    df = spark.range(500_000).select(F.lit(1).alias("k"), (F.lit(-60.0) + F.expr("id DIV 1000") * (120 / 499)).alias("lat"), (F.col("id") % 1000 * (200 / 999)).alias("lon"), (F.sin(F.col("id") % 1000 / 50) * F.cos(F.expr("id DIV 1000") / 30)).alias("r"))
    x = elliptic.poisson(df, ["k"], "r", "psi", method="separated").orderBy("lat", "lon").select("psi", "r").toPandas()
    psi, r = (x[c].to_numpy().reshape(500, 1000) for c in ("psi", "r"))
    dx2, dy2 = elliptic.spacing(lats, lons)
    laplace = (psi[1:-1, 2:] - 2 * psi[1:-1, 1:-1] + psi[1:-1, :-2]) / dx2[1:-1, 1:-1] + (psi[2:, 1:-1] - 2 * psi[1:-1, 1:-1] + psi[:-2, 1:-1]) / dy2[1:-1, 1:-1]
    assert np.abs(laplace - r[1:-1, 1:-1]).max() < 1e-6 and not psi[[0, -1]].any() and not psi[:, [0, -1]].any()


def test_output_modes_of_the_transforms(spark):
    t = spectral.Truncation(16, 8, 5, 5, 5)
    field = np.random.default_rng(2).random((8, 16))
    slabs = spark.createDataFrame([(1, [float(i) for i in range(8)], [float(i) for i in range(16)], field.ravel().tolist())], "k int, lat array<double>, lon array<double>, data array<double>")
    waves = spectral.to_waves(slabs, ["k"], t)
    got = lambda **how: np.array(spectral.to_grid(waves, ["k"], t, **how).first().data).reshape(8, 16)
    plain = got()
    assert np.allclose(got(mode="N"), -plain) and np.allclose(got(mode="A", onto=slabs), field + plain) and np.allclose(got(mode="S", onto=slabs), field - plain)
    assert {(r.m, r.l, r.part): -r.coef for r in spectral.to_waves(slabs, ["k"], t, mode="N").collect()} == pytest.approx({(r.m, r.l, r.part): r.coef for r in waves.collect()})
    with pytest.raises(ValueError):
        spectral.to_grid(waves, ["k"], t, mode="A")
