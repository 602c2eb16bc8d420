import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.sources import files, netcdf, pieces, shapefile, vectors
from fieldlab.streaming import windows


def test_npy_and_grads(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(4.0))
    assert [r.value for r in files.read_npy(spark, str(tmp_path / "a.npy")).orderBy("at").collect()] == [0.0, 1.0, 2.0, 3.0]
    data = np.arange(12, dtype=">f4")
    data[5] = -999
    data.tofile(tmp_path / "x.gra")
    ctl = "DSET ^x.gra\nUNDEF -999.\nXDEF 3 LINEAR 0 10\nYDEF 2 LEVELS -5\n 5\nZDEF 1 LEVELS 500\nTDEF 2 LINEAR 00z01jan2000 1mo\nVARS 1\nt 1 99 temperature\nENDVARS"
    rows = files.read_grads(spark, str(tmp_path / "x.gra"), ctl)
    assert rows.count() == 12 and rows.where("value IS NULL").select("time", "lat", "lon").collect() == [(0, 5.0, 20.0)]


def classic(records, wide):
    """A classic NetCDF file: time (records), lat, lon; t as packed shorts with a fill value, u as floats."""
    order, offset = (lambda n: struct.pack(">i", n)), (">q" if wide else ">i")
    name = lambda s: order(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    floats = lambda n, x: name(n) + order(6) + order(1) + struct.pack(">d", x)
    head = b"CDF" + bytes([2 if wide else 1]) + order(records) + order(10) + order(3) + name("time") + order(0) + name("lat") + order(2) + name("lon") + order(3) + order(0) + order(0)
    packing = order(12) + order(3) + floats("scale_factor", 0.5) + floats("add_offset", 10.0) + name("_FillValue") + order(3) + order(1) + struct.pack(">h", -9) + b"\0\0"
    none = order(0) + order(0)
    specs = [("lat", [1], none, 6, 16), ("lon", [2], none, 6, 24), ("time", [0], none, 4, 4), ("t", [0, 1, 2], packing, 3, 12), ("u", [0, 1, 2], none, 5, 24)]
    build = lambda begins: head + order(11) + order(len(specs)) + b"".join(name(n) + order(len(d)) + b"".join(map(order, d)) + a + order(k) + order(size) + struct.pack(offset, at) for (n, d, a, k, size), at in zip(specs, begins, strict=True))
    start = len(build([0] * 5))
    body = struct.pack(">2d", 10, 20) + struct.pack(">3d", 1, 2, 3)
    body += b"".join(struct.pack(">i", 100 + r) + struct.pack(">6h", *(-9 if i == 4 else 10 * r + i for i in range(6))) + struct.pack(">6f", *(r + i / 2 for i in range(6))) for r in range(records))
    return build([start, start + 16, start + 40, start + 44, start + 56]) + body


@pytest.mark.parametrize("wide", [False, True])
def test_netcdf(spark, tmp_path, wide):
    (tmp_path / "a.nc").write_bytes(classic(3, wide))
    got = {(r.time, r.lat, r.lon, r.variable): r.value for r in files.read_netcdf(spark, str(tmp_path / "a.nc"), "t", "u").collect()}
    want = {(100.0 + r, 10.0 * (1 + i // 3), 1.0 + i % 3, v): {"t": None if i == 4 else 10 + (10 * r + i) / 2, "u": r + i / 2}[v] for r in range(3) for i in range(6) for v in ("t", "u")}
    assert got == want


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "p.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    r = files.read_shapefile(spark, str(tmp_path / "p.shp")).first()
    assert r.geom_id == 1 and [(v.x, v.y) for v in r.vertices] == ring[:-1]


def test_cache_and_records(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), compute).count() == 3
    assert len(calls) == 1
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    for _ in range(2):
        files.append_records(df, str(tmp_path / "r"))
    assert files.read_records(spark, str(tmp_path / "r"), ["x", "y", "z"]).where("z = 'c'").count() == 2
    files.write_cube(spark.createDataFrame([(2000, 1.0)], "year int, x double"), str(tmp_path / "q"))
    assert files.read_cube(spark, str(tmp_path / "q"), "x").first().x == 1.0


def test_downloads_are_bounded(tmp_path):
    tries = []

    def fetch(year, path):
        tries.append(year)
        raise OSError("no network")

    with pytest.raises(OSError):
        files.download_years([2000], fetch, str(tmp_path), retries=2, wait=0)
    assert len(tries) == 2


def test_streamed_windows_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 0{h}:30:00", "a", float(h)) for h in range(6)], "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "2 hours", ["kind"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(windows.tumbling(df, "2 hours", ["kind"], "v").collect())
    assert windows.sessions(df, "90 minutes", ["kind"]).first().n == 6


def test_netcdf_columns_and_unknown_lengths(spark, tmp_path):
    """A column for each variable; a file that says its records are still being written; fields that don't share dimensions."""
    raw = classic(3, True)
    (tmp_path / "a.nc").write_bytes(raw)
    (tmp_path / "b.nc").write_bytes(raw[:4] + b"\xff" * 4 + raw[8:])
    df = netcdf.scan(spark, str(tmp_path))
    assert df.columns == ["path", "time", "lat", "lon", "t", "u"] and df.count() == 36
    a, b = (netcdf.scan(spark, str(tmp_path / f"{n}.nc"), "u").select("time", "lat", "lon", "u").collect() for n in "ab")
    assert sorted(a) == sorted(b) and len(a) == 18
    with pytest.raises(Exception, match="share their dimensions"):
        netcdf.scan(spark, str(tmp_path / "a.nc"), "t", "lat")
    with pytest.raises(Exception, match="no variable"):
        netcdf.scan(spark, str(tmp_path / "a.nc"), "z")


def test_netcdf_default_fill_values():
    v = netcdf.Variable(["x"], [3], 3, 0, 2)
    assert np.isnan(v.decoded(np.array([1, -32767, 2], ">i2"))).tolist() == [False, True, False]
    assert not np.isnan(netcdf.Variable(["x"], [1], 1, 0, 1).decoded(np.array([-127], ">i1")))[0]


def days(spark, n=40):
    time = F.expr("timestamp'1999-12-01 06:00:00' + make_dt_interval(CAST(id DIV 24 AS INT))")
    cells = spark.range(24 * n).select(time.alias("time"), (10.0 * (F.col("id") % 24 / 6).cast("int")).alias("lat"), (F.col("id") % 6).cast("double").alias("lon"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("x"), (-F.col("id")).cast("float").alias("y"))
    return cells.where("lat <> 10 OR lon <> 3")  # no rows for one cell


@pytest.mark.parametrize("single", [False, True])
def test_netcdf_round_trip(spark, tmp_path, single):
    df, path = days(spark), str(tmp_path / "out")
    netcdf.write_netcdf(df, path, ["time", "lat", "lon"], ["x", "y"], steps=9, single=single)
    names = sorted(p.name for p in ([tmp_path / "out"] if single else (tmp_path / "out").iterdir()))
    assert names == (["out"] if single else [f"part-{i:05d}.nc" for i in range(5)])
    back = netcdf.scan(spark, path, partitionBytes=24 * 16 * 4)
    assert back.count() == 40 * 24 and back.rdd.getNumPartitions() == (10 if single else 13)
    both = back.join(df.withColumnsRenamed({"x": "a", "y": "b"}), ["time", "lat", "lon"], "left")
    assert both.where("NOT (x <=> a AND y <=> b)").count() == 0
    with pytest.raises(Exception):
        netcdf.write_netcdf(df, path, ["time", "lat", "lon"], ["x"], single=single) if single else netcdf.scan(spark, path, "z")


def test_netcdf_filters_choose_steps_and_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    netcdf.write_netcdf(days(spark), path, ["time", "lat", "lon"], ["x", "y"], single=True)
    all_cells = netcdf.scan(spark, path, partitionBytes=24 * 16)
    some = all_cells.where("time > timestamp'2000-01-05 00:00:00' AND lat >= 20 AND lon IN (1.0, 4.0)")
    assert all_cells.rdd.getNumPartitions() == 40 and some.rdd.getNumPartitions() == 5 and some.count() == 5 * 2 * 2
    assert sorted(some.select("time", "lat", "lon", "x").collect()) == sorted(days(spark).where("time > timestamp'2000-01-05 00:00:00' AND lat >= 20 AND lon IN (1.0, 4.0)").select("time", "lat", "lon", "x").collect())
    assert all_cells.where("lat = 5").count() == 0 and all_cells.where("time < timestamp'1990-01-01'").count() == 0


def test_netcdf_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file: one field of 5 MB in 600 steps, 3 GB; only the steps that are asked for are opened."""
    axes = {"time": np.arange(600.0), "lat": np.arange(800.0), "lon": np.arange(800.0)}
    head, size, cells = netcdf.header(axes, {}, ["x"], 600)
    with open(tmp_path / "big.nc", "wb") as f:
        f.write(head)
        for i in range(600):
            f.seek(len(head) + i * size)
            f.write(struct.pack(">d", i) + (np.full(cells, i + 0.5, ">f8").tobytes() if i == 431 else b""))
        f.truncate(len(head) + 600 * size)
    df = netcdf.scan(spark, str(tmp_path / "big.nc"), partitionBytes=64 << 20)
    assert (tmp_path / "big.nc").stat().st_size > 2 << 30 and df.rdd.getNumPartitions() == 47
    classic, file = netcdf.opened(str(tmp_path / "big.nc"))
    assert (classic.raw(classic.variables["x"], 431) == 431.5).all() and len(classic.seen) < 1 << 17
    file.close()
    got = df.where("time = 431 AND lat < 10").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    assert tuple(got) == (8000, 431.5, 431.5) and df.where("time = 431").rdd.getNumPartitions() == 1


def test_npy_and_raw_sinks(spark, tmp_path):
    df = spark.range(150_000).select("id", (F.col("id") * 0.5).alias("v")).repartition(5)
    assert pieces.write_vector(df, str(tmp_path / "v.npy"), ["id"], "v", npy=True) == 150_000
    assert (np.load(tmp_path / "v.npy") == np.arange(150_000) * 0.5).all() and [p.name for p in tmp_path.iterdir()] == ["v.npy"]
    with pytest.raises(Exception, match="v.npy"):
        pieces.write_vector(df, str(tmp_path / "v.npy"), ["id"], "v")
    pieces.write_vector(df.limit(0), str(tmp_path / "none"), ["id"], "v")
    assert (tmp_path / "none").stat().st_size == 0


def test_grads_reads_by_fields(spark, tmp_path):
    """Two variables of two levels and one: time 1 of a variable is one field of six."""
    np.arange(2 * 3 * 6, dtype="<f4").tofile(tmp_path / "x.gra")
    ctl = "UNDEF 7\nOPTIONS little_endian\nXDEF 3 LINEAR 0 10\nYDEF 2 LINEAR -5 10\nZDEF 2 LEVELS 500 200\nTDEF 2 LINEAR 00z01jan2000 1mo\nVARS 2\nt 2 99 temperature\np 0 99 pressure\nENDVARS"
    rows = files.read_grads(spark, str(tmp_path / "x.gra"), ctl, partitionBytes=6 * 4)
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 36 and rows.where("value IS NULL").count() == 1
    some = rows.where("variable = 't' AND lev = 200.0 AND time >= 1")
    assert some.rdd.getNumPartitions() == 1 and [r.value for r in some.orderBy("lat", "lon").collect()] == [24.0, 25.0, 26.0, 27.0, 28.0, 29.0]


def test_npy_is_read_by_ranges(spark, tmp_path):
    """Arrays of several dimensions, also stored by columns, count in the order of rows; missing is NULL."""
    a = np.arange(24, dtype=">f4").reshape(2, 3, 4)
    a[1, 2, 3] = np.nan
    np.save(tmp_path / "rows.npy", a)
    np.save(tmp_path / "columns.npy", np.asfortranarray(a))
    np.save(tmp_path / "none.npy", np.array([], "<i2"))
    df = vectors.scan(spark, str(tmp_path), partitionBytes=20)
    assert df.rdd.getNumPartitions() == 10
    for name in ("rows", "columns"):
        got = df.where(F.col("path").endswith(f"/{name}.npy")).orderBy("at").collect()
        assert [r.at for r in got] == list(range(24)) and [r.value for r in got] == [*map(float, range(23)), None]
    assert files.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    np.arange(5, dtype="<i4").tofile(tmp_path / "raw.bin")
    assert [r.value for r in vectors.scan(spark, str(tmp_path / "raw.bin"), "<i4", partitionBytes=8).orderBy("at").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="no multiple"):
        vectors.scan(spark, str(tmp_path / "raw.bin"), "<f8").count()
    with pytest.raises(Exception, match="no npy file"):
        vectors.scan(spark, str(tmp_path / "raw.bin")).count()
    np.save(tmp_path / "text.npy", np.array(["a"]))
    with pytest.raises(Exception, match="not numbers"):
        vectors.scan(spark, str(tmp_path / "text.npy")).count()


def rings_of(n):
    """n polygons; every third one has a hole, and ids aren't dense."""
    box = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y)]
    return {3 * i + 5: [box(i * 1.0, -i * 0.5, 2.0), *([box(i + 0.5, 0.5 - i * 0.5, 0.25)[::-1]] if i % 3 == 0 else [])] for i in range(n)}


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_shapefile_round_trip(spark, tmp_path, n):
    want = rings_of(n)
    rows = [(g, i, r) for g, rings in want.items() for i, r in enumerate(rings)] + [(None, 0, [(0.0, 0.0)]), (1, 0, [])]
    df = spark.createDataFrame(rows, "geom_id int, ring_id int, vertices array<struct<x:double,y:double>>").repartition(7)
    assert shapefile.write_shapefile(df, str(tmp_path / "out"), "p") == n
    got = {}
    for r in files.read_shapefile(spark, str(tmp_path / "out")).orderBy("geom_id", "ring_id").collect():
        got.setdefault(r.geom_id, []).append([(v.x, v.y) for v in r.vertices])
    assert got == {i + 1: rings for i, rings in enumerate(want.values())}
    shp, shx, dbf = ((tmp_path / "out" / f"p.{k}").read_bytes() for k in ("shp", "shx", "dbf"))
    for content in (shp, shx):
        assert struct.unpack(">i", content[:4]) == (9994,) and struct.unpack(">i", content[24:28])[0] * 2 == len(content) and struct.unpack("<2i", content[28:36]) == (1000, 5)
    if n:
        points = np.array([p for rings in want.values() for r in rings for p in r])
        assert struct.unpack("<4d", shp[36:68]) == (*points.min(0), *points.max(0))
    # The index tells where each record is, the table which id it has.
    for i, (g, rings) in enumerate(want.items()):
        at, words = struct.unpack(">2i", shx[100 + 8 * i : 108 + 8 * i])
        assert struct.unpack(">2i", shp[2 * at : 2 * at + 8]) == (i + 1, words) and struct.unpack("<2i", shp[2 * at + 44 : 2 * at + 52]) == (len(rings), 5 * len(rings))
        assert int(dbf[65 + 19 * i + 1 : 65 + 19 * (i + 1)]) == g
    assert struct.unpack("<IHH", dbf[4:12]) == (n, 65, 19) and dbf[32:39] == b"geom_id" and dbf[64:65] == b"\r" and dbf[-1:] == b"\x1a" and len(dbf) == 66 + 19 * n


def test_grads_round_trip(spark, tmp_path):
    cells = [(t, lev, lat, lon, float(100 * t + lev / 100 + lat + lon / 10), None if lon == 20.0 else float(t)) for t in (3, 7, 9) for lev in (850.0, 500.0) for lat in (-5.0, 5.0) for lon in (0.0, 10.0, 20.0) if (t, lev, lat) != (7, 500.0, 5.0)]
    df = spark.createDataFrame([*cells, (None, 1.0, 1.0, 1.0, 1.0, 1.0)], "time int, lev double, lat double, lon double, a double, b double")
    ctl = files.write_grads(df, str(tmp_path / "x.gra"), ["a", "b"])
    assert (tmp_path / "x.gra").stat().st_size == 3 * 2 * 2 * 2 * 3 * 4
    got = {(r.time, r.lev, r.lat, r.lon, r.variable): r.value for r in files.read_grads(spark, str(tmp_path / "x.gra"), ctl).where("value IS NOT NULL").collect()}
    want = {((3, 7, 9).index(t), lev, lat, lon, v): x for t, lev, lat, lon, a, b in cells for v, x in (("a", float(np.float32(a))), ("b", b)) if x is not None}
    assert got == want
    flat = files.write_grads(df.where("lev = 500").drop("lev"), str(tmp_path / "y.gra"), ["a"], levels=False)
    assert files.read_grads(spark, str(tmp_path / "y.gra"), flat).where("value IS NOT NULL").count() == 15
