"""End to end: tables, files and queries as archives."""

import json
import os

import pytest

from tilewright import api
from tilewright.api import LayerSpec, layer, pmtiles_metadata, read_tiles, tile, tile_file, tile_query
from tilewright.functions.geometry import LINE, POLYGON, to_wkb
from tilewright.operators.encode import decode_mlt, decode_mvt
from tilewright.plans.model import TileConfig
from tilewright.sources.sqltext import split_statements


def box(w, s, e, n):
    return bytearray(to_wkb((POLYGON, [[[(w, s), (e, s), (e, n), (w, n), (w, s)]]])))


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [("a", 1, box(-80.0, 35.0, -78.0, 37.0)), ("b", 2, box(-82.0, 34.0, -79.0, 36.0)), ("c", 3, box(-84.0, 33.0, -81.0, 35.0))]
    return spark.createDataFrame(rows, "name string, value long, geometry binary").coalesce(1)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"p{i}", -80 + 0.1 * i, 35 + 0.1 * (i % 5), None if i == 3 else i) for i in range(50)]
    return spark.createDataFrame(rows, "name string, lon double, lat double, n long").coalesce(1)


def dots(points, **kw):
    return LayerSpec(points, lon="lon", lat="lat", **kw)


def decoded(spark, path, fmt="mvt"):
    decode = decode_mvt if fmt == "mvt" else decode_mlt
    return {(r.z, r.x, r.y): {x["name"]: x["features"] for x in decode(bytes(r.data))} for r in read_tiles(spark, path).collect()}


@pytest.mark.parametrize("fmt", ["mvt", "mlt"])
def test_polygons(spark, boxes, tmp_path, fmt):
    path = tile(boxes, tmp_path / "boxes.pmtiles", tile_format=fmt, max_zoom=6)
    meta = pmtiles_metadata(path)
    assert meta["bounds"] == (-84.0, 33.0, -78.0, 37.0) and meta["tile_format"] == fmt
    assert meta["vector_layers"] == [{"id": "boxes", "fields": {"name": "string", "value": "string"}, "minzoom": 0, "maxzoom": 6, "geometry_type": "Polygon"}]
    found = decoded(spark, path, fmt)
    assert meta["num_tiles"] == len(found) and {z for z, _, _ in found} == set(range(7))
    names = {f["properties"]["name"] for f in found[0, 0, 0]["boxes"]}
    assert names == {"a", "b", "c"} and sorted(f["id"] for f in found[0, 0, 0]["boxes"]) == [1, 2, 3]


def test_simplified_and_plain_lines(spark, tmp_path):
    line = bytearray(to_wkb((LINE, [[[(-80 + i / 100, 35 + (i % 2) / 1e6) for i in range(200)]]])))
    df = spark.createDataFrame([(line, "r")], "geometry binary, road string")
    sizes = [len(decoded(spark, tile(df, tmp_path / f"l{s}.pmtiles", simplification=s, max_zoom=4, layer_name="l"))[0, 0, 0]["l"][0]["parts"][0]) for s in (True, False)]
    assert sizes[0] == 2 <= sizes[1]


def test_points_land_in_buffered_and_exact_tiles(spark, tmp_path):
    df = spark.createDataFrame([(0.01, 0.01, "edge")], "lon double, lat double, name string")
    buffered = decoded(spark, tile(dots(df), tmp_path / "b.pmtiles", max_zoom=2, layer_name="p"))
    exact = decoded(spark, tile(dots(df), tmp_path / "e.pmtiles", max_zoom=2, layer_name="p", point_mode="exact"))
    assert len([k for k in buffered if k[0] == 2]) == 4 and len([k for k in exact if k[0] == 2]) == 1
    spots = {k: f["p"][0]["parts"][0][0] for k, f in buffered.items() if k[0] == 1}
    assert spots[1, 0, 0] == (4096, 4096) and spots[1, 1, 1] == (0, 0)


def test_thinning(spark, points, tmp_path):
    n = {}
    for rate, base in ((None, None), (2.5, None), (2.5, 4)):
        path = tile(dots(points), tmp_path / f"{rate}{base}.pmtiles", max_zoom=6, drop_rate=rate, base_zoom=base, layer_name="p", point_mode="exact")
        n[rate, base] = {z: sum(len(t["p"]) for k, t in decoded(spark, path).items() if k[0] == z) for z in range(7)}
    assert set(n[None, None].values()) == {50}
    assert n[2.5, None] == {z: max(1, -(-50 * 2**(6 - z) // 5 ** (6 - z)) if z < 6 else 50) for z in range(7)}
    assert n[2.5, 4][4] == 50 and n[2.5, 4][3] == 20


def test_area_rule_drops_small_polygons(spark, boxes, tmp_path):
    with_rule = decoded(spark, tile(boxes, tmp_path / "d.pmtiles", drop_rate=10.0, max_zoom=10, layer_name="b"))
    without = decoded(spark, tile(boxes, tmp_path / "n.pmtiles", max_zoom=10, layer_name="b"))
    assert (0, 0, 0) not in with_rule and (0, 0, 0) in without
    assert {k for k in with_rule if k[0] == 10} == {k for k in without if k[0] == 10}


def test_clusters_count_points(spark, points, boxes, tmp_path):
    found = decoded(spark, tile(dots(points), tmp_path / "c.pmtiles", cluster_distance=60.0, max_zoom=8, layer_name="p", point_mode="exact"))
    for z in range(8):
        features = [f for k, t in found.items() if k[0] == z for f in t["p"]]
        assert sum(f["properties"].get("point_count", 1) for f in features) == 50
    assert all("point_count" not in f["properties"] for k, t in found.items() if k[0] == 8 for f in t["p"])
    same = decoded(spark, tile(boxes, tmp_path / "x.pmtiles", cluster_distance=60.0, max_zoom=3, layer_name="b"))
    assert all("point_count" not in f["properties"] for t in same.values() for f in t["b"])


def test_clusters_match_global_greedy(spark):
    import random

    from tilewright.operators.cluster import cluster_zoom, greedy

    rng = random.Random(5)
    rows = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(600)]
    df = spark.createDataFrame([(*r, None) for r in rows], "fid long, lon double, lat double, point_count long")
    found = sorted((r.fid, r.lon, r.lat, r.point_count) for r in cluster_zoom(df, 0.3).collect())
    want = [(i, x, y, c) for i, x, y, c in greedy([r[1] for r in rows], [r[2] for r in rows], [None] * 600, 0.3)]
    assert found == want


def test_coalesced_lines_and_polygons(spark, tmp_path):
    rows = [(box(-80, 35, -79, 36), "same"), (box(-79, 35, -78, 36), "same"), (box(-70, 35, -69, 36), "other")]
    df = spark.createDataFrame(rows, "geometry binary, name string").coalesce(1)
    found = decoded(spark, tile(df, tmp_path / "m.pmtiles", coalesce=True, max_zoom=3, layer_name="b"))[0, 0, 0]["b"]
    assert [(f["id"], len(f["parts"])) for f in found] == [(1, 2), (3, 1)]


def test_layers_keep_names_zooms_and_order(spark, boxes, points, tmp_path):
    path = tile({"areas": layer(boxes, 0, 3), "dots": layer(points, 2, 5, lon="lon", lat="lat")}, tmp_path / "two.pmtiles", max_zoom=9)
    found = decoded(spark, path)
    assert {z for z, _, _ in found} == {0, 1, 2, 3, 4, 5}
    assert list(found[2, 1, 1]) == ["areas", "dots"] and list(found[0, 0, 0]) == ["areas"]
    meta = pmtiles_metadata(path)
    assert [(v["id"], v["minzoom"], v["maxzoom"]) for v in meta["vector_layers"]] == [("areas", 0, 3), ("dots", 2, 5)]
    assert (meta["min_zoom"], meta["max_zoom"], meta["center"][2]) == (0, 5, 2)


def test_property_types_and_nulls(spark, tmp_path):
    df = spark.sql("SELECT 0D AS lon, 0D AS lat, 'x' AS s, 5 AS i, 1.25D AS d, true AS b, DOUBLE('NaN') AS nan, CAST(NULL AS STRING) AS none, DATE'2020-01-02' AS day, array(1, 2) AS list, 2.5BD AS dec")
    f = decoded(spark, tile(dots(df), tmp_path / "t.pmtiles", max_zoom=0, layer_name="p"))[0, 0, 0]["p"][0]
    assert f["properties"] == {"s": "x", "i": 5, "d": 1.25, "b": True, "day": "2020-01-02", "list": "[1,2]", "dec": 2.5}


def test_null_and_odd_geometry_goes(spark, tmp_path):
    rows = [(box(0, 0, 1, 1), "ok"), (None, "null"), (bytearray(b"\x01\x02"), "broken"), (bytearray(b"\x01\x07\x00\x00\x00\x00\x00\x00\x00"), "collection")]
    df = spark.createDataFrame(rows, "geometry binary, name string")
    assert [f["properties"]["name"] for f in decoded(spark, tile(df, tmp_path / "o.pmtiles", max_zoom=0, layer_name="p"))[0, 0, 0]["p"]] == ["ok"]
    with pytest.raises(ValueError, match="No valid features"):
        tile(df.where("name <> 'ok'"), tmp_path / "none.pmtiles", max_zoom=0)


def test_edges_of_the_world(spark, tmp_path):
    rows = [(180.0, 0.0), (-180.0, 0.0), (0.0, 85.06), (0.0, 90.0), (0.0, -90.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    found = decoded(spark, tile(dots(df), tmp_path / "w.pmtiles", max_zoom=3, layer_name="p", point_mode="exact"))
    assert sum(len(t["p"]) for k, t in found.items() if k[0] == 3) == 5
    assert all(0 <= x < 2**z and 0 <= y < 2**z for z, x, y in found)


def test_refusals(spark, boxes, points, tmp_path):
    path = tmp_path / "r.pmtiles"
    tile(boxes, path, max_zoom=1)
    with pytest.raises(FileExistsError):
        tile(boxes, path, max_zoom=1, overwrite=False)
    for bad in (dict(tile_format="png"), dict(min_zoom=5, max_zoom=3), dict(point_mode="x")):
        with pytest.raises(ValueError):
            tile(boxes, path, **bad)
    with pytest.raises(ValueError, match="named"):
        tile([boxes], path)
    with pytest.raises(TypeError):
        tile({"a": 5}, path)
    with pytest.raises(ValueError, match="EPSG"):
        tile(LayerSpec(boxes, crs="EPSG:27700"), path)
    with pytest.raises(ValueError, match="engine"):
        tile_file(spark, "x.parquet", path, engine="gdal")
    with pytest.raises(FileNotFoundError):
        tile_file(spark, str(tmp_path / "no.geojson"), path)
    with pytest.raises(FileNotFoundError):
        pmtiles_metadata(tmp_path / "no.pmtiles")
    with pytest.raises(ValueError, match="streaming"):
        tile_query(spark, "SELECT 1", path, streaming="sometimes")


def test_many_tiles_use_leaf_directories(spark, tmp_path):
    df = spark.range(6000).selectExpr("(id % 100) * 3.5D - 175 AS lon", "(id div 100) * 2.5D - 75 AS lat", "id AS n")
    path = tile(dots(df, id="n"), tmp_path / "many.pmtiles", min_zoom=9, max_zoom=9, layer_name="p", point_mode="exact")
    with open(path, "rb") as f:
        from tilewright.sources.pmtiles import header_of

        assert header_of(f)["leaf_length"] > 0
    found = decoded(spark, path)
    assert sum(len(t["p"]) for t in found.values()) == 6000 and len(found) == pmtiles_metadata(path)["num_tiles"]


def test_geoparquet_and_projection(spark, boxes, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    import math

    def square(lon, lat):
        return 6378137.0 * math.radians(lon), 6378137.0 * math.asinh(math.tan(math.radians(lat)))

    ring = [square(*c) for c in ((-80, 35), (-78, 35), (-78, 37), (-80, 37), (-80, 35))]
    table = pa.table({"shape": [to_wkb((POLYGON, [[ring]]))], "name": ["p"]})
    geo = {"primary_column": "shape", "columns": {"shape": {"crs": {"id": {"authority": "EPSG", "code": 3857}}}}}
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "p.parquet")
    path = tile_file(spark, tmp_path / "p.parquet", tmp_path / "gp.pmtiles", max_zoom=2)
    assert pmtiles_metadata(path)["bounds"] == pytest.approx((-80, 35, -78, 37), abs=1e-6)
    boxes.write.parquet(str(tmp_path / "plain.parquet"))
    with pytest.warns(UserWarning, match="assumed"):
        tile_file(spark, tmp_path / "plain.parquet", tmp_path / "pl.pmtiles", max_zoom=2)


@pytest.mark.parametrize("name", ["f.geojson", "f.geojsonl"])
def test_geojson(spark, tmp_path, name):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-78.6, 35.8]}, "properties": {"name": "a", "n": 1}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"name": "b", "d": 1.5}},
        {"type": "Feature", "geometry": None, "properties": {"name": "c"}},
    ]
    body = "\n".join(map(json.dumps, features)) if name.endswith("l") else json.dumps({"type": "FeatureCollection", "features": features})
    (tmp_path / name).write_text(body)
    found = decoded(spark, tile_file(spark, tmp_path / name, tmp_path / "g.pmtiles", max_zoom=0))[0, 0, 0]["g"]
    assert sorted((f["kind"], f["properties"]["name"]) for f in found) == [(1, "a"), (3, "b")]


def test_query(spark, tmp_path):
    sql = "LOAD spatial; CREATE OR REPLACE TEMPORARY VIEW v AS SELECT ';' AS label, 7 AS score; SELECT *, st_point(-78.6, 35.8) AS geometry FROM v;"
    found = decoded(spark, tile_query(spark, sql, tmp_path / "q.pmtiles", max_zoom=1, streaming="always"))
    assert found[0, 0, 0]["q"][0]["properties"] == {"label": ";", "score": 7}
    polygon = "SELECT st_geomfromtext('POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))') AS geometry"
    with pytest.raises(ValueError, match="POINT geometries only"):
        tile_query(spark, polygon, tmp_path / "q2.pmtiles", streaming="always")
    assert decoded(spark, tile_query(spark, polygon, tmp_path / "q2.pmtiles", max_zoom=0))[0, 0, 0]["q2"][0]["kind"] == 3
    with pytest.raises(ValueError, match="no geometry"):
        tile_query(spark, "SELECT 1 AS x", tmp_path / "q3.pmtiles")


def test_statements():
    assert split_statements("LOAD spatial; LOAD h3; SELECT 1;") == ["LOAD spatial", "LOAD h3", "SELECT 1"]
    assert split_statements("SELECT ';' -- a;b\n, `c;d` /* e;f */;") == ["SELECT ';' -- a;b\n, `c;d` /* e;f */"]
    assert split_statements(" ;; ") == []


def test_numbers_follow_the_scan(spark):
    from tilewright.plans.model import row_numbers

    rows = row_numbers(spark.range(0, 1000, 1, 7), "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.id)] == list(range(1, 1001))


def test_config_defaults():
    assert TileConfig(max_zoom=9, cluster_distance=5.0).clusters_to == 8 and TileConfig().clusters_to is None
    assert not TileConfig(drop_rate=-1.0).thins and api.STREAMING == ("auto", "always", "never")


@pytest.mark.parametrize("more", [{}, {"drop_rate": 2.0}, {"cluster_distance": 50.0}, {"coalesce": True}])
def test_without_ids(spark, points, tmp_path, more):
    found = decoded(spark, tile(dots(points), tmp_path / "n.pmtiles", generate_ids=False, max_zoom=3, layer_name="p", point_mode="exact", **more))
    assert all(f["id"] is None for t in found.values() for f in t["p"])
    assert sum(f["properties"].get("point_count", 1) for k, t in found.items() if k[0] == 3 for f in t["p"]) == 50


def test_archive_sizes_as_the_settings_say(spark, points, boxes, tmp_path):
    """Relations that hold between settings: thinning and merging do not enlarge, columns beat rows on polygons."""
    size = lambda layers, **kw: os.path.getsize(tile(layers, tmp_path / "z.pmtiles", layer_name="l", **kw))
    many = boxes.selectExpr("explode(sequence(1, 40)) AS n", "name", "value", "geometry")
    assert size(many, tile_format="mlt", max_zoom=4) < size(many, max_zoom=4)
    assert size(dots(points), max_zoom=6, drop_rate=2.5) <= size(dots(points), max_zoom=6)
    assert size(dots(points), max_zoom=6, drop_rate=2.5, base_zoom=4) >= size(dots(points), max_zoom=6, drop_rate=2.5)
    assert size(many, max_zoom=4, coalesce=True) <= 1.05 * size(many, max_zoom=4)
    assert size(many, max_zoom=4, coalesce=True, drop_rate=2.0, cluster_distance=30.0) > 0
