"""Every named query against its SQL, run by DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tilewright.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["z", "x", "y", "tile_id", "data"]
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("piece", [40, 500, 10**6])
def test_ranks_do_not_hang_on_pieces(spark, sf, piece):
    from tilewright.operators.thin import morton_ranks

    points = catalog.view(spark, sf, "geo_points").select("fid", "lon", "lat")
    rows = morton_ranks(points, points.count(), piece).collect()
    want = [r.fid for r in sorted(rows, key=lambda r: (r.morton, r.fid))]
    assert [r.fid for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(len(rows)))


def test_scans_are_pruned(spark, sf):
    plan = catalog.tile_assign_z10(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    assert "Exchange" not in plan
