import sqlite3
import struct
import urllib.error
import urllib.request

import pytest

from tests.test_tiles import box, decoded, dots
from tilewright import serve
from tilewright.api import pmtiles_metadata, tile, tile_file
from tilewright.plans.model import TileConfig
from tilewright.streaming.retile import current_tiles, retile_batch, retile_stream


def test_geopackage(spark, tmp_path):
    path = tmp_path / "boxes.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('boxes', 'geom', 'POLYGON', 4326, 0, 0)")
        db.execute("CREATE TABLE boxes (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, value REAL, good BOOLEAN)")
        head = b"GP\0\x03" + struct.pack("<i4d", 4326, -80, -78, 35, 37)
        db.execute("INSERT INTO boxes VALUES (7, ?, 'a', 1.5, 1), (9, NULL, 'b', NULL, NULL), (50000, ?, 'c', 2, 0)", (head + bytes(box(-80.0, 35.0, -78.0, 37.0)), b"GP\0\x01" + struct.pack("<i", 4326) + bytes(box(-82.0, 34.0, -79.0, 36.0))))
    found = decoded(spark, tile_file(spark, path, tmp_path / "g.pmtiles", max_zoom=0))[0, 0, 0]["g"]
    assert sorted((f["properties"]["fid"], f["properties"]["name"], f["properties"]["value"], f["properties"]["good"]) for f in found) == [(7, "a", 1.5, True), (50000, "c", 2.0, False)]


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    records = [body, struct.pack("<i", 0)]
    shp, shx, at = b"", b"", 50
    for k, r in enumerate(records):
        shp += struct.pack(">2i", k + 1, len(r) // 2) + r
        shx += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (tmp_path / "s.shp").write_bytes(head + shp)
    (tmp_path / "s.shx").write_bytes(head + shx)
    fields = b"".join(struct.pack("<11sc4xBB14x", n, k, w, d) for n, k, w, d in ((b"name", b"C", 5, 0), (b"n", b"N", 4, 0), (b"d", b"N", 6, 2)))
    (tmp_path / "s.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, 2, 32 + len(fields) + 1, 16) + fields + b"\r" + b" ab      7  1.25" + b" cd                 "[:16])
    found = decoded(spark, tile_file(spark, tmp_path / "s.shp", tmp_path / "o.pmtiles", max_zoom=0, simplification=False))[0, 0, 0]["o"]
    assert [f["properties"] for f in found] == [{"name": "ab", "n": 7, "d": 1.25}] and len(found[0]["parts"]) == 2
    (tmp_path / "s.prj").write_text('PROJCS["NAD83 / North Carolina"]')
    with pytest.raises(ValueError, match="projection"):
        tile_file(spark, tmp_path / "s.shp", tmp_path / "o.pmtiles")


def test_stream_touches_only_its_tiles(spark, tmp_path):
    store, config = str(tmp_path / "store"), TileConfig(max_zoom=4, point_mode="exact")
    first = spark.createDataFrame([(1, -78.6, 35.8, "a"), (2, 120.0, 30.0, "b")], "fid long, lon double, lat double, name string")
    second = spark.createDataFrame([(3, -78.5, 35.7, "c")], first.schema)
    retile_batch(first, 0, store, config)
    retile_batch(second, 1, store, config)
    retile_batch(second, 1, store, config)  # a batch that is run again
    rows = {(r.z, r.x, r.y): r.epoch for r in spark.read.parquet(f"{store}/tiles").collect() if r.epoch == 1}
    assert len(rows) == 5
    import gzip

    from tilewright.operators.encode import decode_mvt

    now = {(r.z, r.x, r.y): decode_mvt(gzip.decompress(bytes(r.data)))[0]["features"] for r in current_tiles(spark, store).collect()}
    whole = decoded(spark, tile(dots(first.unionByName(second), id="fid"), tmp_path / "w.pmtiles", layer_name="points", max_zoom=4, point_mode="exact"))
    assert {k: sorted(f["id"] for f in v) for k, v in now.items()} == {k: sorted(f["id"] for f in v["points"]) for k, v in whole.items()}
    with pytest.raises(ValueError):
        retile_batch(first, 2, store, TileConfig(drop_rate=2.0))


def test_stream_query(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "fid long, lon double, lat double"
    for k in range(2):
        spark.createDataFrame([(k, 10.0 * k, 5.0)], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        retile_stream(stream, store, TileConfig(max_zoom=2, point_mode="exact")).awaitTermination(120)
    assert current_tiles(spark, store).where("z = 0").count() == 1
    assert spark.read.parquet(f"{store}/features").count() == 2


def test_server(spark, tmp_path):
    path = tile(dots(spark.sql("SELECT 1D AS lon, 2D AS lat")), tmp_path / "s.pmtiles", max_zoom=1)
    base = serve.serve_tiles(path, port=0)
    try:
        raw = open(path, "rb").read()
        ask = lambda name, **h: urllib.request.urlopen(urllib.request.Request(f"{base}/{name}", headers=h), timeout=10)
        assert ask("s.pmtiles").read() == raw
        part = ask("s.pmtiles", Range="bytes=7-20")
        assert part.status == 206 and part.read() == raw[7:21] and part.headers["Access-Control-Allow-Origin"] == "*"
        assert ask("s.pmtiles", Range="bytes=-5").read() == raw[-5:]
        for bad, code in (("../../etc/passwd", 404), ("none", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(bad)
            assert e.value.code == code
        with pytest.raises(urllib.error.HTTPError) as e:
            ask("s.pmtiles", Range="bytes=99999999-")
        assert e.value.code == 416
        page = ask(serve.view_tiles(path, base).rsplit("/", 1)[1]).read().decode()
        assert '"type": "circle"' in page and "s.pmtiles" in page
        with pytest.raises(ValueError):
            serve.view_tiles(path, base, layer="none")
    finally:
        serve.stop_server()
    assert pmtiles_metadata(path)["num_tiles"] == 5
