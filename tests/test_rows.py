"""No row of a source is lost or repeated, whatever its plan; large features and hot places are bounded in a task."""

import math
import os
import random

import pytest

from tilewright.api import LayerSpec, pmtiles_metadata, read_tiles, tile, tile_file, tile_query
from tilewright.functions import crs
from tilewright.functions.geometry import LINE, POLYGON, bbox, from_wkb, srid_of, to_wkb, with_srid
from tilewright.operators.encode import decode_mvt, encode_mvt
from tilewright.plans.model import TileConfig, row_numbers
from tilewright.plans.tiles import Layer


def features(spark, path, z):
    return [f for r in read_tiles(spark, path).where(f"z = {z}").collect() for layer in decode_mvt(bytes(r.data)) for f in layer["features"]]


QUERIES = {
    "group": "SELECT id % 40000 AS k, st_point(max(id) % 360 - 180, max(id) % 170 - 85) AS geometry, repeat('x', 100) AS pad FROM range(60000) GROUP BY id % 40000",
    "join": "SELECT a.id AS k, st_point(a.id % 360 - 180, b.id % 170 - 85) AS geometry FROM range(40000) a JOIN range(40000) b ON a.id = b.id",
    "order": "SELECT id AS k, st_point(id % 360 - 180, id % 170 - 85) AS geometry FROM range(40000) ORDER BY hash(id)",
    "random": "SELECT id AS k, st_point(rand() * 360 - 180, rand() * 170 - 85) AS geometry FROM range(40000) LIMIT 40000",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_of_a_query_is_there_once(spark, tmp_path, name):
    found = features(spark, tile_query(spark, QUERIES[name], tmp_path / "q.pmtiles", min_zoom=2, max_zoom=2, streaming="always"), 2)
    assert sorted(f["properties"]["k"] for f in found) == list(range(40000))
    assert sorted(f["id"] for f in found) == list(range(1, 40001))


def test_numbers_of_a_shuffled_table(spark):
    df = spark.range(100_000).selectExpr("id % 50000 AS k", "id").groupBy("k").count()
    rows = row_numbers(df, "n").collect()
    assert sorted(r.n for r in rows) == list(range(1, 50001)) and len({r.k for r in rows}) == 50000


def test_ids_go_on_across_layers(spark, tmp_path):
    one = spark.range(5).selectExpr("id * 1D AS lon", "0D AS lat")
    path = tile({"a": LayerSpec(one, lon="lon", lat="lat"), "b": LayerSpec(one, lon="lon", lat="lat")}, tmp_path / "l.pmtiles", max_zoom=0)
    assert sorted(f["id"] for f in features(spark, path, 0)) == list(range(1, 11))


@pytest.mark.parametrize("seed", range(3))
def test_point_encoder_gives_the_bytes_of_the_plain_one(seed):
    import numpy as np
    import pyarrow as pa

    from tilewright.operators.points import point_layer

    rng = random.Random(seed)
    n, names = 700, ["a", "b", "c", "d"]
    tile = sorted(rng.randrange(40) for _ in range(n))
    fid = [None if seed == 2 and rng.random() < 0.1 else rng.choice([rng.randrange(300), rng.getrandbits(50), -1]) for _ in range(n)]
    px, py = ([rng.randrange(-300, 4500) for _ in range(n)] for _ in range(2))
    columns = [[rng.choice([None, "x", "y" * 200, "é"]) for _ in range(n)], [rng.choice([None, 0, 5, -7, 2**40]) for _ in range(n)], [rng.choice([None, 1.5, rng.random()]) for _ in range(n)], [rng.choice([None, True, False]) for _ in range(n)]]
    if seed == 1:
        columns[0] = [None] * n
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.bool_())
    found = dict(point_layer("p", names, np.array(tile), pa.array(fid, pa.int64()), np.array(px), np.array(py), [pa.array(c, k) for c, k in zip(columns, kinds)]))
    for t in set(tile):
        rows = [i for i in range(n) if tile[i] == t]
        assert found[t] == encode_mvt([("p", names, [(fid[i], (1, [[[(px[i], py[i])]]]), tuple(c[i] for c in columns)) for i in rows])])


def test_batches_are_cut_at_tiles():
    import pyarrow as pa

    from tilewright.plans.tiles import whole_tiles

    rng = random.Random(1)
    values = sorted(rng.randrange(30) for _ in range(500))
    batches, at = [], 0
    while at < 500:
        n = rng.choice([0, 1, 2, 40])
        batches.append(pa.RecordBatch.from_arrays([pa.array(values[at : at + n], pa.int64())], ["tile"]))
        at += n
    out = [b.column(0).to_pylist() for b in whole_tiles(iter(batches))]
    assert sum(out, []) == values
    seen = [set(o) for o in out]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[:i])


def test_too_many_features_of_a_tile_are_refused(monkeypatch):
    import pyarrow as pa

    from tilewright.plans import tiles

    monkeypatch.setattr(tiles, "TILE_FEATURES", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 30, pa.int64())], ["tile"])
    assert [b.num_rows for b in tiles.whole_tiles(iter([batch]))] == [30]
    with pytest.raises(ValueError, match="set drop_rate"):
        list(tiles.whole_tiles(iter([batch, batch])))


# ---- skew and large features -----------------------------------------------------------------------------------------------


def test_ranking_cuts_a_hot_place(spark):
    """A third of the points at one place are several pieces, and ranks stay exact."""
    from pyspark.sql import functions as F

    from tilewright.operators import thin

    df = spark.range(30_000).selectExpr("id AS fid", "IF(id % 3 = 0, 10D, id % 360 - 180D) AS lon", "IF(id % 3 = 0, 10D, id % 170 - 85D) AS lat")
    placed = thin.with_piece(df.withColumn("morton", thin.layer_morton("lon", "lat")), "morton", 30_000, 1000)
    assert placed.groupBy("__piece").count().agg(F.max("count")).first()[0] < 3000
    rows = thin.morton_ranks(df, 30_000, 1000).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.morton, r.fid))] == list(range(30_000))


@pytest.mark.parametrize("order", ["random", "sorted", "hot"])
def test_clusters_on_hot_and_sorted_points(spark, order, monkeypatch):
    from tilewright.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 4)
    monkeypatch.setattr(cluster, "PER_CELL", 3)
    rng = random.Random(order)
    rows = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(900)]
    if order == "sorted":
        rows.sort()
    if order == "hot":
        rows[::3] = [(1.0 + rng.random() / 50, 1.0) for _ in rows[::3]]
    counts = [rng.choice([None, 2, 5]) for _ in rows]
    df = spark.createDataFrame([(i, x, y, c) for i, ((x, y), c) in enumerate(zip(rows, counts))], "fid long, lon double, lat double, point_count long")
    found = sorted((r.fid, r.lon, r.lat, r.point_count) for r in cluster.cluster_zoom(df, 0.7).collect())
    assert found == sorted(cluster.greedy([r[0] for r in rows], [r[1] for r in rows], counts, 0.7))


def test_a_block_holds_few_points_of_a_cell(spark, monkeypatch):
    """However many points a cell has, a task gets PER_CELL + 1 of them."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tilewright.operators import cluster

    df = spark.range(20_000).selectExpr("id AS fid", "0.1D + id % 1 AS lon", "0.1D + id % 1 AS lat", "id % 1 AS cx", "id % 1 AS cy")
    first = df.withColumn("r", F.row_number().over(W.partitionBy("cx", "cy").orderBy("fid", "lon", "lat"))).where(F.col("r") <= cluster.PER_CELL + 1)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert cluster.seeds_of(df, 0.5).count() == 1


def test_a_long_line_is_dealt_in_parts(spark):
    """Blocks get the part that they need, not the whole line, and tiles are those of the line as a whole."""
    from pyspark.sql import functions as F

    from tilewright.operators.cut import cut, pieces

    line = [(-170 + i / 10, 60 * math.sin(i / 200)) for i in range(3000)]
    row = (1, 8, bytearray(to_wkb((LINE, [[line]]))), *bbox((LINE, [[line]])))
    df = spark.createDataFrame([row], "fid long, z int, wkb binary, west double, south double, east double, north double")
    parts = pieces(df, False, [])
    sizes = [r[0] for r in parts.select(F.octet_length("wkb")).collect()]
    assert len(sizes) > 30 and sum(sizes) < 2 * len(row[2])
    whole = df.withColumns({"bx": F.explode(F.sequence(F.lit(0), F.lit(15))), "whole": F.lit(True)}).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(15))))
    tiles = lambda rows: {(r.x, r.y): from_wkb(bytes(r.shape)) for r in cut(rows.select("z", "bx", "by", "fid", "wkb", "whole"), False, []).collect()}
    a, b = tiles(parts), tiles(whole)
    assert set(a) == set(b)
    for k in a:
        assert bbox(a[k]) == pytest.approx(bbox(b[k]), abs=1e-3)


def test_a_large_polygon_in_parts_covers_the_same(spark):
    from pyspark.sql import functions as F

    from tilewright.functions.geometry import area2
    from tilewright.operators.cut import cut, pieces

    ring = [(40 * math.cos(t / 500 * 2 * math.pi) * (1 + 0.3 * math.sin(t)), 40 * math.sin(t / 500 * 2 * math.pi) * (1 + 0.3 * math.sin(t))) for t in range(500)]
    g = (POLYGON, [[[*ring, ring[0]]]])
    df = spark.createDataFrame([(1, 7, bytearray(to_wkb(g)), *bbox(g))], "fid long, z int, wkb binary, west double, south double, east double, north double")
    whole = df.withColumns({"bx": F.explode(F.sequence(F.lit(0), F.lit(7))), "whole": F.lit(True)}).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(7))))
    size = lambda shape: sum(abs(area2(m[0][:-1])) for m in from_wkb(bytes(shape))[1])
    area = lambda rows: {(r.x, r.y): size(r.shape) for r in cut(rows.select("z", "bx", "by", "fid", "wkb", "whole"), False, []).collect()}
    a, b = area(pieces(df, False, [])), area(whole)
    assert {k for k, v in a.items() if v > 1} == {k for k, v in b.items() if v > 1}
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1) for k in a if k in b)


# ---- coordinates, the SQL door, files --------------------------------------------------------------------------------------


@pytest.mark.parametrize("code,lon,lat", [(32617, -80.5, 35.2), (32718, -75, -12), (26918, -75.5, 40), (25832, 9.5, 52), (5070, -100, 40), (2154, 2.35, 48.85), (3347, -100, 60), (3035, 5, 60), (3577, 140, -30), (3857, 10, 20), (4269, 1, 2)])
def test_projections_come_back(spark, code, lon, lat):
    from pyspark.sql import functions as F

    system = crs.known(f"EPSG:{code}")
    x, y = crs.from_degrees(lon, lat, system)
    assert crs.to_degrees(x, y, system) == pytest.approx((lon, lat), abs=1e-7)
    if not isinstance(system, crs.Degrees):
        one = spark.range(1).select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
        r = one.select(*crs.to_degrees(F.col("x"), F.col("y"), system, F), *crs.from_degrees(F.col("lon"), F.col("lat"), system, F)).first()
        assert tuple(r)[:2] == pytest.approx((lon, lat), abs=1e-7) and tuple(r)[2:] == pytest.approx((x, y), abs=1e-5)


def test_known_places_in_projections():
    """Published coordinates of well-known places, to the metre or so."""
    assert crs.from_degrees(2.2945, 48.8583, crs.known("EPSG:2154")) == pytest.approx((648237, 6862266), abs=30)
    assert crs.from_degrees(9.0, 0.0, crs.known(32632)) == pytest.approx((500000, 0), abs=1e-6)
    assert crs.from_degrees(10.0, 52.0, crs.known(3035)) == pytest.approx((4321000, 3210000), abs=1e-3)
    wkt = 'PROJCS["NAD_1983_UTM_Zone_17N",GEOGCS["GCS",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],UNIT["Degree",0.017]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-81.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    assert crs.known(wkt) == crs.known("EPSG:26917")
    with pytest.raises(ValueError, match="EPSG"):
        crs.known("EPSG:27700")


def test_layers_of_projected_points_and_polygons(spark, tmp_path):
    """As a table in UTM coordinates, by columns and by WKB, and as extended WKB that names its own system."""
    system = crs.known("EPSG:32617")
    ring = [crs.from_degrees(*c, system) for c in ((-82, 35), (-80, 35), (-80, 36), (-82, 36), (-82, 35))]
    wkb = to_wkb((POLYGON, [[ring]]))
    for shape, name in ((wkb, "EPSG:32617"), (with_srid(wkb, 32617), "EPSG:4326")):
        df = spark.createDataFrame([(bytearray(shape),)], "geometry binary")
        path = tile(LayerSpec(df, crs=name), tmp_path / "u.pmtiles", max_zoom=2)
        assert pmtiles_metadata(path)["bounds"] == pytest.approx((-82, 35, -80, 36), abs=1e-6)
    dots = spark.createDataFrame([ring[0], ring[2]], "e double, n double")
    path = tile(LayerSpec(dots, lon="e", lat="n", crs="EPSG:32617"), tmp_path / "d.pmtiles", max_zoom=2)
    assert pmtiles_metadata(path)["bounds"] == pytest.approx((-82, 35, -80, 36), abs=1e-6)
    assert srid_of(with_srid(wkb, 32617)) == 32617 and srid_of(wkb) is None and srid_of(b"\x01") is None


def test_file_functions_in_queries(spark, tmp_path):
    import json

    spark.range(4).selectExpr("id", "id * 1D AS lon", "0D AS lat", "'a''b' AS note").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 1}}]}))
    sql = f"SELECT * EXCLUDE (note, lat), st_point(lon, lat) AS geometry FROM read_parquet(['{tmp_path}/p.parquet']) WHERE note = 'a\\'b' -- read_parquet('no')"
    found = features(spark, tile_query(spark, sql, tmp_path / "a.pmtiles", max_zoom=0), 0)
    assert [set(f["properties"]) for f in found] == [{"id", "lon"}] * 4
    found = features(spark, tile_query(spark, f"SELECT id // 2 AS half, st_point(lon, lat) AS g FROM '{tmp_path}/p.parquet' WHERE 'x//y' LIKE '%//%'", tmp_path / "b.pmtiles", max_zoom=0), 0)
    assert sorted(f["properties"]["half"] for f in found) == [0, 0, 1, 1]
    found = features(spark, tile_query(spark, f"SELECT * FROM ST_Read('{tmp_path}/g.geojson')", tmp_path / "c.pmtiles", max_zoom=0), 0)
    assert [f["properties"] for f in found] == [{"n": 1}]
    made = f"CREATE TEMP TABLE t1 AS SELECT * FROM read_parquet('{tmp_path}/p.parquet'); CREATE TEMP TABLE t2 AS SELECT id, lon + 1 AS lon, lat FROM t1; SELECT id, st_point(lon, lat) AS geometry FROM t2"
    assert len(features(spark, tile_query(spark, made, tmp_path / "d.pmtiles", max_zoom=0), 0)) == 4


def test_points_as_wkb_with_always(spark, tmp_path):
    sql = "SELECT st_geomfromtext('POINT(1 2)') AS geometry, 5 AS n"
    assert [f["properties"] for f in features(spark, tile_query(spark, sql, tmp_path / "w.pmtiles", max_zoom=0, streaming="always"), 0)] == [{"n": 5}]
    with pytest.raises(ValueError, match="POINT geometries only"):
        tile_query(spark, sql.replace("POINT(1 2)", "LINESTRING(0 0, 1 1)"), tmp_path / "w.pmtiles", streaming="always")


def test_spatial_functions_take_structs_and_wkb(spark):
    from tilewright.sources.sqltext import register_spatial

    register_spatial(spark)
    r = spark.sql("SELECT st_x(st_point(3, 4)) AS x, st_y(st_aswkb(st_point(3, 4))) AS y, st_geometrytype(st_point(3, 4)) AS t, st_x(st_point(NULL, 1)) AS none, st_srid(st_setsrid(st_point(1, 2), 32617)) AS s, st_srid(st_point(1, 2)) AS no, st_x(st_transform(st_point(-81, 0), 'EPSG:4326', 'EPSG:32617')) AS e").first()
    assert (r.x, r.y, r.t, r.none, r.s, r.no) == (3, 4, "POINT", None, "EPSG:32617", None) and r.e == pytest.approx(500000)


def test_attached_duckdb_file_and_csv(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect(str(tmp_path / "x.duckdb")) as db:
        db.sql("CREATE TABLE spots AS SELECT range AS id, range * 1.0::DOUBLE AS lon, 2.0::DOUBLE AS lat FROM range(7)")
    path = tile_query(spark, "SELECT id, st_point(lon, lat) AS geometry FROM spots", tmp_path / "a.pmtiles", db_path=str(tmp_path / "x.duckdb"), max_zoom=0)
    assert sorted(f["properties"]["id"] for f in features(spark, path, 0)) == list(range(7))
    (tmp_path / "t.csv").write_text("name,longitude,latitude\na,1,2\nb,3,4\n")
    assert len(features(spark, tile_file(spark, tmp_path / "t.csv", tmp_path / "b.pmtiles", engine="duckdb", max_zoom=0), 0)) == 2
    (tmp_path / "w.csv").write_text('name,wkt\na,"LINESTRING(0 0, 5 5)"\n')
    assert [f["kind"] for f in features(spark, tile_file(spark, tmp_path / "w.csv", tmp_path / "c.pmtiles", max_zoom=0), 0)] == [2]


def test_a_failed_run_leaves_the_old_archive(spark, tmp_path):
    said = []
    df = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    path = tile(LayerSpec(df, lon="lon", lat="lat"), tmp_path / "k.pmtiles", max_zoom=1, progress=said.append)
    assert said[0] == "reading 1 layer" and said[-1].endswith("bytes")
    before = open(path, "rb").read()
    from pyspark.sql import functions as F

    bad = df.withColumn("boom", F.expr("IF(lon = 0, raise_error('boom'), 'x')"))
    with pytest.raises(Exception, match="boom"):
        tile(LayerSpec(bad, lon="lon", lat="lat"), path, max_zoom=1)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["k.pmtiles"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tilewright.plans import store

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, other=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Elsewhere)


def test_plain_layers_run_their_source_once(spark, tmp_path):
    """Statistics, ranks and tiles come from one run: an accumulator counts the rows that the source gives."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.range(500).select(counted(F.col("id") % 90 * 1.0).alias("lon"), F.lit(0.0).alias("lat"))
    layer = Layer(LayerSpec(df, name="p", lon="lon", lat="lat", min_zoom=0, max_zoom=3), TileConfig(max_zoom=3, drop_rate=2.0))
    layer.tiled().count()
    assert seen.value <= 1000  # lon twice in one projection at most
