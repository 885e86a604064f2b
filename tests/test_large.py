"""Large tiles and archives: work is dealt to tasks by bytes, and tiles are made and read by pieces, with the same results."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tilewright.api import LayerSpec, tile
from tilewright.operators import encode, reading
from tilewright.operators.coalesce import with_group
from tilewright.operators.points import MltPoints, MvtPoints
from tilewright.operators.reading import mlt_points, mvt_points
from tilewright.plans import catalog, tiles
from tilewright.plans.store import saved
from tilewright.sources import pmtiles

WANTED = {"s": pa.string(), "d": pa.float64(), "i": pa.int64(), "b": pa.bool_(), "none": pa.string(), "nothing": pa.float64()}


def features(n, seed=1):
    r = random.Random(seed)
    one = lambda k: (r.choice([None, "a", "bé" * 70, f"n{k % 400}"]), r.choice([None, r.random(), 7.5]), r.choice([None, -5, 1 << 40]), r.choice([None, True, False]), None, None)
    return [(r.randrange(1 << r.randrange(1, 62)), (1, [[[(r.randrange(-300, 5000), r.randrange(-300, 5000))]]]), one(k)) for k in range(n)]


@pytest.mark.parametrize("leaf_entries", [4096, 16])
def test_archive_is_read_by_many_tasks(spark, tmp_path, monkeypatch, leaf_entries):
    df = spark.range(3000).selectExpr("id AS fid", "id * 7919 % 360 - 180D AS lon", "id * 104729 % 160 - 80D AS lat")
    monkeypatch.setattr(pmtiles, "LEAF_ENTRIES", leaf_entries)
    monkeypatch.setattr(pmtiles, "ROOT_LIMIT", 16384 if leaf_entries > 16 else 200)
    path = tile(LayerSpec(df, lon="lon", lat="lat", id="fid"), tmp_path / "a.pmtiles", max_zoom=3)
    rows = lambda parts: [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    reader = pmtiles.Reader({"path": path})
    whole = rows(reader.partitions())
    monkeypatch.setattr(pmtiles, "SLICE_BYTES", 2000)
    parts = reader.partitions()
    assert len(parts) > 8
    assert rows(parts) == whole
    assert len({r["tile_id"] for r in whole}) == len(whole) == pmtiles.pmtiles_metadata(path)["num_tiles"]


@pytest.mark.parametrize("make, points", [(encode.encode_mvt, mvt_points), (encode.encode_mlt, mlt_points)])
@pytest.mark.parametrize("n", [1, 2, 1000])
def test_points_are_read_by_pieces(monkeypatch, make, points, n):
    monkeypatch.setattr(reading, "PIECE", 64)
    own = features(n)
    pieces = list(points(make([("p", list(WANTED), own), ("q", [], [])]), WANTED))
    assert max(len(p["id"]) for p in pieces) <= 64
    found = [r for p in pieces for r in zip(p["id"].to_pylist(), p["x"].tolist(), p["y"].tolist(), *(p[k].to_pylist() for k in WANTED))]
    assert found == [(f, *g[1][0][0][0], *v) for f, g, v in own]


@pytest.mark.parametrize("make, layer", [(encode.encode_mvt, MvtPoints), (encode.encode_mlt, MltPoints)])
@pytest.mark.parametrize("piece", [7, 97, 1000])
def test_layers_made_by_pieces_have_the_same_bytes(make, layer, piece):
    own = features(300)
    one = layer("p", list(WANTED))
    for a in range(0, len(own), piece):
        ids, shapes, values = zip(*own[a : a + piece])
        x, y = (np.array([g[1][0][0][0][k] for g in shapes]) for k in (0, 1))
        one.add(pa.array(ids, pa.int64()), x, y, [pa.array(c, t) for c, t in zip(zip(*values), WANTED.values())])
    assert one.finish() == make([("p", list(WANTED), own)])
    assert layer("p", []).finish() == b""


@pytest.mark.parametrize("settings", [{}, {"tile_format": "mlt"}, {"generate_ids": False}])
def test_large_tiles_are_made_by_pieces(spark, monkeypatch, settings):
    """In the process itself, so that what is handed to an encoder at once can be seen."""
    df = spark.range(3000).selectExpr("id AS fid", "id * 7919 % 360 - 180D AS lon", "id * 104729 % 160 - 80D AS lat", "string(id % 7) AS s")
    config = tiles.TileConfig(max_zoom=2, **settings)
    layers = [tiles.Layer(LayerSpec(df, name=n, lon="lon", lat="lat", id=None, min_zoom=0, max_zoom=2), config) for n in "ab"]
    rows = tiles.union_of(layers)
    plain = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, run, schema: plain.update(run=run, df=df))
    tiles.encoded(rows, layers, config)
    batches = [b for b in plain["df"].coalesce(1).sortWithinPartitions("tile", "layer", "fid").toArrow().to_batches(max_chunksize=100)]
    whole = [r for b in plain["run"](iter(batches)) for r in b.to_pylist()]
    sizes = []
    for kind in (MvtPoints, MltPoints):
        monkeypatch.setattr(kind, "add", lambda self, fid, px, *more, add=kind.add: (sizes.append(len(px)), add(self, fid, px, *more)))
    monkeypatch.setattr(tiles, "PIECE_ROWS", 250)
    assert [r for b in plain["run"](iter(batches)) for r in b.to_pylist()] == whole
    assert len(whole) == 21 and len(sizes) > 60 and max(sizes) <= 300


def test_features_of_a_layer_are_read_one_by_one():
    own = [(k, (3, [[[(0, 0), (k + 1, 0), (k + 1, 9), (0, 0)]]]), (f"n{k % 3}", k)) for k in range(50)]
    data = encode.encode_mvt([("p", ["s", "i"], own)])
    (layer,) = reading.mvt_layers(data)
    assert list(layer.features()) == encode.decode_mvt(data)[0]["features"]
    one = encode.MvtFeatures("p", ["s", "i"])
    for f in own:
        one.add(*f)
    assert one.finish() == data


def by_pieces(spark, rows, start, schema):
    """A step of ``_tile_pieces`` in the process itself, with batches of 10 rows: the result, and how many rows came at once."""
    kept, sizes = {}, []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda df, run, schema: kept.update(run=run, df=df))
        catalog._tile_pieces(rows, lambda: Watched(start(), sizes), schema)
    batches = kept["df"].toArrow().to_batches(max_chunksize=10)
    return sorted(tuple(r.values()) for b in kept["run"](iter(batches)) for r in b.to_pylist()), sizes


class Watched:
    def __init__(self, own, sizes):
        self.own, self.rows, self.sizes = own, own.rows, sizes

    def add(self, fid, *more):
        self.sizes.append(len(fid))
        self.own.add(fid, *more)


def test_tiles_are_never_held_as_rows(spark):
    rows = spark.range(400).selectExpr("id % 3 AS x", "0L AS y", "id AS fid", "0L AS px", "0L AS py", "if(id % 3 = 1, null, double(id)) AS d", "if(id % 5 = 0, null, 's') AS s")
    types = lambda data: ([[c["type"]] for c in layer.columns] for layer in reading.mlt_layers(data))
    found, sizes = by_pieces(spark, rows, lambda: catalog._ReadBack(MltPoints, ["d", "s"], types), "x long, y long, d_type long, s_type long")
    assert found == [(0, 0, 26, 29), (1, 0, 29, 29), (2, 0, 26, 29)]
    assert max(sizes) <= 10 and sum(sizes) == 400


def test_values_are_indexed_across_pieces(spark):
    rows = spark.range(100).selectExpr("id % 2 AS x", "0L AS y", "id AS fid", "0L AS px", "0L AS py", "string(id DIV 25) AS s")
    index = lambda data: ((layer.values, range(len(layer.values))) for layer in reading.mvt_layers(data))
    found, sizes = by_pieces(spark, rows, lambda: catalog._ReadBack(MvtPoints, ["s"], index), "x long, y long, s string, i long")
    assert found == [(x, 0, str(k), k) for x in (0, 1) for k in range(4)] and max(sizes) <= 10


def test_commands_of_points_need_no_shuffle(spark, sf):
    assert "Exchange" not in catalog.mvt_point_commands(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_ids_step_across_pieces(spark):
    rows = spark.range(100).selectExpr("id % 2 AS x", "0L AS y", "id * id AS fid", "0L AS px", "0L AS py")

    def steps(data):
        for layer in reading.mlt_layers(data):
            own = layer.id_steps()
            yield own.cumsum(), own

    found, _ = by_pieces(spark, rows, lambda: catalog._ReadBack(MltPoints, [], steps), "x long, y long, fid long, delta long")
    assert found == sorted((k % 2, 0, k * k, k * k - max(k - 2, 0) ** 2) for k in range(100))


def test_runs_across_pieces(spark):
    rows = spark.range(100).selectExpr("0L AS x", "0L AS y", "id AS fid", "0L AS px", "0L AS py", "if(id BETWEEN 15 AND 44, null, string(id DIV 30)) AS s")
    found, sizes = by_pieces(spark, rows, catalog._Runs, "x long, y long, runs long")
    assert found == [(0, 0, 5)] and max(sizes) <= 10


def test_lines_are_grouped_by_what_hangs_together(spark):
    """Paths 0 to 9 of nine steps each, mixed; a ring, a line that is a point, and one that meets path 3 with -0.0 for 0.0."""
    lines = [(10 * p + k, float(p), float(k), float(p), float(k + 1)) for p in range(10) for k in range(9)]
    lines += [(200, 50.0, 0.0, 51.0, 0.0), (201, 51.0, 0.0, 50.0, 0.0), (202, 60.0, 0.0, 60.0, 0.0), (203, 3.0, -0.0, 2.5, 7.5)]
    random.Random(2).shuffle(lines)
    rows = saved(spark.createDataFrame(lines, "fid long, a double, b double, c double, d double"))
    found = {r.fid: r.group for r in with_group(rows, ["a", "b"], ["c", "d"]).collect()}
    want = {fid: 3 if fid == 203 else fid // 10 if fid < 200 else fid // 2 for fid, *_ in lines}
    assert len(found) == len(lines) and None not in found.values()
    assert len(set(found.values())) == len(set(want.values())) == len({(found[k], want[k]) for k in found})
