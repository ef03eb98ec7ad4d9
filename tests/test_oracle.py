"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

from stratum.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-5 + 1e-9 * abs(a)
    return a == b


def ordered(rows):
    """By all that isn't a double, then by doubles."""
    exact = lambda r: [repr(x) for x in r if not isinstance(x, float)]
    return sorted(rows, key=lambda r: (exact(r), [-1e300 if math.isnan(x) else round(x, 3) for x in r if isinstance(x, float)]))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered([tuple(r) for r in df.select(*cols).collect()])
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = ordered(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def same_at(spark, name, sf):
    """Whether the query gives the rows of its SQL on larger tables; the number of rows."""
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = ordered([tuple(r) for r in df.select(*cols).collect()])
    assert got == ordered(con.sql(catalogue.ORACLE_SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall())
    return len(got)


def changed(folder, **tables):
    """The smallest tables in a folder, some of them made by SQL over their own rows."""
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        if t in tables:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
            con.sql(f"COPY ({tables[t]}) TO '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_frames_with_a_velocity_of_zero(spark, tmp_path):
    sf = changed(tmp_path, events="SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN 0 ELSE value END AS value) FROM events")
    assert same_at(spark, "slowness_mean_by_frame", sf) > 0


def test_rays_below_the_second_knot(spark, tmp_path):
    sf = changed(tmp_path, supplier="SELECT * REPLACE (s_suppkey + i * 1000 AS s_suppkey) FROM supplier, range(4) r(i)")
    assert same_at(spark, "ray_node_table", sf) > 0


def test_shared_statics_of_every_id(spark):
    sf = "/root/testdata/sf0.01"
    assert same_at(spark, "shared_statics_all", sf) > 0
    ids = catalogue.QUERIES["shared_statics_all"](spark, sf).select("id").distinct().count()
    assert ids == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()


def test_tempering_swap_of_every_row(spark):
    sf = "/root/testdata/sf0.01"
    assert same_at(spark, "tempering_swap_all", sf) == spark.read.parquet(f"{sf}/events.parquet").count() - 1


def test_gnomonic_plane_of_every_supplier(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalogue.QUERIES["gnomonic_plane_all"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert 0 < rows.where("x IS NULL AND y IS NULL").count() < rows.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
