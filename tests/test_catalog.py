"""Every query runs on the small tables, and equals its SQL."""

import duckdb
import pytest

import __spark_entry__
from fieldlab.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is not None, round(v, 9) if isinstance(v, float) else str(v)) if v is not None else (False, "") for v in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(map(str, (key(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())))
    other = duck.sql(catalog.SQL[name])
    assert sorted(other.columns) == columns
    theirs = sorted(map(str, (key(r) for r in other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())))
    assert mine == theirs


@pytest.mark.parametrize("name", ["stream_function", "sht_inverse", "variance_fraction"])
def test_query_beyond_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["poisson_sor", "stream_function", "velocity_potential"])
def test_elliptic_queries_cover_the_grid(spark, name):
    """All 7 x 50 cells, and only the ring of the whole grid without values (or 0)."""
    got = {(r.lat, r.lon): r for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert set(got) == {(10.0 * i, 5.0 * j) for i in range(1, 8) for j in range(1, 51)}
    value = "chi" if name == "velocity_potential" else "psi"
    assert {k for k, r in got.items() if not r[value]} == {(10.0 * i, 5.0 * j) for i in range(1, 8) for j in range(1, 51) if i in (1, 7) or j in (1, 50)}


def test_sor_of_the_grid_equals_the_direct_solution(spark):
    from fieldlab.operators import calculus, elliptic

    rows = calculus.vorticity(catalog.flow(spark, DATA), ["k"], to="rhs").select("k", "lat", "lon", "rhs")
    exact = {(r.lat, r.lon): r.psi for r in elliptic.poisson(rows, ["k"], "rhs", "psi").collect()}
    swept = {(r.lat, r.lon): r.psi for r in catalog.QUERIES["poisson_sor"](spark, DATA).collect()}
    assert len(exact) == 350 and all(abs(swept[k] - exact[k]) < 1 for k in exact) and max(map(abs, exact.values())) > 1e5


def test_prototype_covers_the_interior(spark):
    assert catalog.QUERIES["prototype_stream_function"](spark, DATA).count() == 5 * 48


def test_cluster_curve_goes_to_twenty(spark):
    assert [r.k for r in catalog.QUERIES["cluster_curve"](spark, DATA).orderBy("k").collect()] == list(range(2, 21))


@pytest.mark.parametrize("name", ["temperature_advection", "static_stability", "temperature_budget"])
def test_level_queries_over_all_months(spark, duck, name):
    months = {str(m) for (m,) in duck.sql("SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL").fetchall()}
    got = {r.time for r in catalog.QUERIES[name](spark, DATA).select("time").distinct().collect()} - {None}
    assert got == months and len(months) > 80


def test_clusters_of_event_days(spark):
    """Every member of an event day is in one cluster; the table of sf0.001 may have no such day."""
    got = catalog.QUERIES["event_clusters"](spark, "/root/testdata/sf0.01").collect()
    members = catalog.QUERIES["event_members"](spark, "/root/testdata/sf0.01").agg({"n": "sum"}).first()[0]
    assert len({r.type for r in got}) == 4 and sum(r.n for r in got) == members
    assert catalog.QUERIES["event_clusters"](spark, DATA).count() >= 0


@pytest.fixture(scope="module")
def shared_keys(tmp_path_factory):
    """(folder, DuckDB's views): event days of two years that have the same key year * 100 + day, and quiet days."""
    folder, c = tmp_path_factory.mktemp("shared_keys"), duckdb.connect()
    for t in ("nation", "customer"):
        c.execute(f"COPY (SELECT * FROM '{DATA}/{t}.parquet') TO '{folder}/{t}.parquet'")
    hot = "(DATE '1996-04-15', [0, 1]), (DATE '1997-01-06', [1, 2]), (DATE '1996-04-16', [3, 4]), (DATE '1997-01-07', [0, 4])"
    days = f"SELECT * FROM (VALUES {hot}) h(day, regions) UNION ALL SELECT CAST(DATE '1998-01-01' + CAST(k AS INT) AS DATE), CAST([] AS INT[]) FROM range(0, 40) t(k)"
    price = "CASE WHEN list_contains(regions, CAST(n_regionkey AS INT)) THEN 500.0 ELSE 100.0 END::DOUBLE"
    c.execute(f"COPY (SELECT c_custkey AS o_custkey, day AS o_orderdate, {price} AS o_totalprice FROM '{DATA}/customer.parquet' JOIN '{DATA}/nation.parquet' ON c_nationkey = n_nationkey CROSS JOIN ({days})) TO '{folder}/orders.parquet'")
    for t in ("nation", "customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), c


def test_clusters_tell_days_of_one_key_apart(spark, shared_keys):
    folder, c = shared_keys
    got = catalog.QUERIES["event_clusters"](spark, folder).collect()
    cells = len(c.sql(f"WITH {catalog.SALES} SELECT DISTINCT lat, lon FROM sales").fetchall())
    assert len({r.type for r in got}) == 4 and len(got) == 4 * cells and all(r.n == 1 and r.mean in (0.0, 1.0) for r in got)


def test_members_tell_days_of_one_key_apart(spark, shared_keys):
    folder, c = shared_keys
    got = sorted(key(r) for r in catalog.QUERIES["event_members"](spark, folder).select("type", "lat", "lon", "n", "hits").collect())
    assert got == sorted(key(r) for r in c.sql(f"SELECT type, lat, lon, n, hits FROM ({catalog.SQL['event_members']})").fetchall()) and got
