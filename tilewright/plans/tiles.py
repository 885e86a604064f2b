"""The tile pyramid as one lazy plan.

source -> zooms -> thinning -> tiles -> (shuffle by tile, sorted) -> bytes -> written table -> (shuffle by ranges of tile ids) -> archive

Points in columns never leave the JVM before their bytes are made; other geometries pass through Python once to be described and once to be cut.
"""

from __future__ import annotations

import gzip
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.functions.geometry import POINT, from_wkb
from tilewright.operators import thin
from tilewright.operators.cluster import clusters
from tilewright.operators.coalesce import coalesce
from tilewright.operators.cut import centre_key, cut, described, is_point, pieces
from tilewright.operators.encode import MvtFeatures, encode_mlt, encode_mvt
from tilewright.operators.points import MltPoints, MvtPoints, point_layer
from tilewright.plans.model import LayerSpec, TileConfig, normalised, numbered
from tilewright.plans.store import saved

COUNT = "point_count"
#: Features of one tile, which is one blob and made by one task. More are refused: no viewer could show such a tile.
TILE_FEATURES = 20_000_000
#: Rows of one tile that are joined to be encoded at once; larger tiles are made by pieces of so many. Bytes of tiles that a task hands on at once.
PIECE_ROWS, FLUSH_BYTES = 40_000, 8 << 20
TOO_MANY = "tile {}/{}/{} holds more than {} features; set drop_rate (or cluster_distance), or raise min_zoom"
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


class Layer:
    """A layer, written once, with the statistics that its plan needs, from one aggregation. Statistics, ranks and tiles read the columns that
    they need of that table, so a source that is dear, or not the same twice (``rand``, ``LIMIT``), is run once. Ids go on from ``before``."""

    def __init__(self, spec: LayerSpec, config: TileConfig, before: int = 0):
        self.spec, self.config = spec, config
        rows, self.names = normalised(spec, config)
        self.plain = bool(spec.lon) or "struct" in dict(spec.df.dtypes).get(spec.geometry, "")
        self.table = saved(rows.drop("wkb") if self.plain else described(rows, spec.crs or "EPSG:4326"))
        own = self.table if spec.id else numbered(self.table, "ord", "fid", before)
        if self.plain:
            own = own.select("ord", "fid", F.lit(None).cast("binary").alias("wkb"), "props", F.lit(POINT).alias("kind"), F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"), "lon", "lat")
        self.rows = own
        dots = is_point(F.col("kind"))
        s = self.rows.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(dots).alias("points"), F.count_if(F.col("kind") == POINT).alias("single"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
            F.min_by("kind", "ord").alias("kind"), F.max("fid").alias("last"),
        ).first()
        self.stats = s
        self.all_points = s["n"] > 0 and s["n"] == s["points"]
        #: Every feature is drawn as one point.
        self.dots = s["n"] == s["single"]
        #: The number from which ids of a next layer go on.
        self.after = before if spec.id else max(before, s["last"] or 0)

    @property
    def clusters_to(self) -> int | None:
        return self.config.clusters_to if self.all_points else None

    def field_names(self) -> list[str]:
        return [*self.names, COUNT] if self.clusters_to is not None else self.names

    def zoomed(self) -> DataFrame:
        """A row for each feature and zoom that it is shown at, with ``point_count`` where clusters apply."""
        spec, config = self.spec, self.config
        low, high = spec.min_zoom, spec.max_zoom
        base, rows, top = config.base_for(spec), self.rows, self.clusters_to
        clustered = None
        if top is not None and top >= low:
            # by place in the input, which is unique where ids may not be
            seeds = clusters(rows.select(F.col("ord").alias("fid"), "lon", "lat"), config.cluster_distance, top, low).where(F.col("z") <= high)
            seeds = seeds.withColumnsRenamed({"lon": "clon", "lat": "clat", "fid": "ord"})
            own = seeds.join(rows, "ord")
            moved = own.select("ord", "fid", F.when(F.col(COUNT).isNull(), F.col("wkb")).alias("wkb"), "props", F.when(F.col(COUNT).isNull(), F.col("kind")).otherwise(POINT).alias("kind"), *[F.when(F.col(COUNT).isNull(), F.col(k)).otherwise(F.col(v)).alias(k) for k, v in (("west", "clon"), ("south", "clat"), ("east", "clon"), ("north", "clat"), ("lon", "clon"), ("lat", "clat"))], F.col("z").cast("int").alias("z"), COUNT)
            clustered, low = moved, top + 1
        if low > high:
            return clustered
        z = F.col("z")
        thins = config.thins and base > low
        if thins and self.stats["points"]:
            ranked = thin.morton_ranks(rows.where(is_point(F.col("kind"))), self.stats["points"])
            rest = rows.where(~is_point(F.col("kind")))
            rows = ranked.drop("morton") if self.all_points else ranked.drop("morton").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
        out = rows.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
        if thins:
            rule = "even" if config.point_mode == "buffered" else "integer"
            large = thin.keeps_area(F.col("west"), F.col("south"), F.col("east"), F.col("north"), config.drop_rate, base, z)
            n = self.stats["points"]
            if n:
                # zoom by zoom, so that quotas are constants
                kept = F.lit(False)
                for own in range(low, min(base, high + 1)):
                    kept = F.when(z == own, thin.keeps_point(rule, F.col("rank"), n, config.drop_rate, base, F.lit(own))).otherwise(kept)
                kept = F.when(z >= base, True).otherwise(kept)
                kept = kept if self.all_points else F.when(is_point(F.col("kind")), kept).otherwise(large)
            else:
                kept = large
            out = out.where(kept).drop("rank")
        out = out.withColumn(COUNT, F.lit(None).cast("long"))
        return out if clustered is None else clustered.unionByName(out)

    def tiled(self) -> DataFrame:
        """``(z, x, y, key, fid, px, py, shape, props, point_count)``: single points by columns, other geometries by WKB in tile units."""
        rows = self.zoomed()
        points = rows.where(F.col("kind") == POINT) if self.stats["single"] or self.clusters_to is not None else None
        others = rows.where(F.col("kind") != POINT) if self.stats["single"] < self.stats["n"] else None
        parts = []
        if points is not None:
            at = point_tiles(points, self.config.point_mode)
            px, py = tm.tile_px("lon", "z", "x"), tm.tile_py("lat", "z", "y")
            snapped = self.config.point_mode == "buffered" and self.config.simplification
            key = centre_key(px / tm.EXTENT, py / tm.EXTENT) if snapped else tm.in_tile_morton("lon", "lat", "z", "x", "y")
            parts.append(at.select("z", "x", "y", key.alias("key"), "fid", px.alias("px"), py.alias("py"), F.lit(None).cast("binary").alias("shape"), "props", COUNT))
        if others is not None:
            # dealt anew, so that one task never cuts all blocks of a large geometry or of a small file
            found = cut(pieces(others, self.config.simplification, ["props", COUNT]).repartition("fid", "z", "bx", "by"), self.config.simplification, ["props", COUNT])
            parts.append(found.select("z", "x", "y", centre_key(F.col("cx"), F.col("cy")).alias("key"), "fid", F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), "shape", "props", COUNT))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def point_tiles(points: DataFrame, mode: str) -> DataFrame:
    """``points(z, lon, lat, …)`` with ``x``, ``y``: exactly one tile, or every tile whose buffer holds the point."""
    if mode == "exact":
        lat = tm.clamped(F.col("lat"), -tm.LAT_EXACT, tm.LAT_EXACT)
        return points.withColumns({"x": tm.tile_x("lon", "z"), "y": tm.tile_y(lat, "z")})
    x0, x1, y0, y1 = tm.buffered_range("lon", "lat", "lon", "lat", "z")
    wide = points.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
    return wide.where(tm.in_buffered_tile("lon", "lat", "z", "x", "y"))


def union_of(layers: list[Layer]) -> DataFrame:
    """Rows of all layers with ``layer`` (its place) and one property column a layer."""
    out = None
    for k, layer in enumerate(layers):
        rows = layer.tiled().withColumn("layer", F.lit(k)).withColumnsRenamed({"props": f"props{k}"})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def encoded(rows: DataFrame, layers: list[Layer], config: TileConfig) -> DataFrame:
    """``(z, x, y, data)``: tiles, gzip-compressed. Rows of a tile meet by one shuffle, sorted. Of one tile at a time the bytes made so far are held, of
    merged features and of lines and polygons in MLT the features."""
    plain, mvt = all(layer.dots for layer in layers), config.tile_format == "mvt"
    props = [f"props{k}" for k in range(len(layers))]
    # one number for the tile: the sort then compares numbers, and rows only within a tile
    tile = F.shiftleft(F.col("z").cast("long"), 50).bitwiseOR(F.shiftleft(F.col("x"), 25)).bitwiseOR(F.col("y"))
    dealt = rows.select(tile.alias("tile"), "layer", "key", "fid", "px", "py", *([] if plain else ["shape"]), "point_count", *props)
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "layer", "key", "fid").drop("key")
    named = [(layer.spec.name, layer.field_names(), len(layer.names), layer.clusters_to is not None) for layer in layers]
    shown = [bool(layer.spec.id) or config.generate_ids for layer in layers]
    make = encode_mvt if mvt else encode_mlt
    merges = config.coalesce

    def flushed(done):
        """Tiles in batches of at most 256, cut by bytes."""
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array([d[i] for d in held], k) for i, k in enumerate(kinds)], ["z", "x", "y", "data"])
        held, size = [], 0
        for d in done:
            if held and (size + len(d[3]) > FLUSH_BYTES or len(held) == 256):
                yield batch(held)
                held, size = [], 0
            held.append(d)
            size += len(d[3])
        yield batch(held)

    def columns_of(batch, k):
        """Rows of layer ``k`` as its encoder takes them; None without rows."""
        own = batch if len(named) == 1 else batch.filter(pc.equal(batch.column(1), k))
        if not own.num_rows:
            return None
        columns = own.column((6 if plain else 7) + k).flatten()[: named[k][2]] if named[k][2] else []
        if named[k][3]:
            columns.append(own.column(5 if plain else 6))
        return own.column(2) if shown[k] else None, own.column(3).to_numpy(), own.column(4).to_numpy(), columns

    def points(batches):
        """Tiles of single points: whole tiles of the batches at hand at once, large tiles by pieces."""
        yield from flushed(dotted(batches))

    def dotted(batches):
        large = None
        for batch, goes_on in tile_pieces(batches):
            at = batch.column(0).to_numpy()
            if goes_on or large or not mvt:
                starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1)).tolist()
                for a, b in zip(starts, [*starts[1:], len(at)]):
                    large = large or [(MvtPoints if mvt else MltPoints)(name, names) for name, names, _, _ in named]
                    for k, layer in enumerate(large):
                        if own := columns_of(batch.slice(a, b - a), k):
                            layer.add(*own)
                    if not goes_on:
                        yield (*unpacked(int(at[a])), packed(b"".join(layer.finish() for layer in large)))
                        large = None
                continue
            tile = np.cumsum(np.diff(at, prepend=at[0]) != 0)
            found: dict[int, list[bytes]] = {}
            for k, (name, names, _, _) in enumerate(named):
                if own := columns_of(batch, k):
                    mine = tile if len(named) == 1 else tile[batch.column(1).to_numpy() == k]
                    for t, data in point_layer(name, names, mine, *own):
                        found.setdefault(t, []).append(data)
            tiles = [unpacked(t) for t in at[np.flatnonzero(np.diff(tile, prepend=-1))].tolist()]
            for t, layers in sorted(found.items()):
                yield (*tiles[t], packed(b"".join(layers)))

    def run(batches):
        yield from flushed(made_tiles(batches))

    def made_tiles(batches):
        tile, held, count = None, [], 0
        fresh = lambda: [MvtFeatures(name, names) if mvt and not merges else [] for name, names, _, _ in named]

        def close():
            if tile is None:
                return
            if mvt and not merges:
                data = b"".join(layer.finish() for layer in held)
            else:
                data = make([(name, names, coalesce(features) if merges else features) for (name, names, _, _), features in zip(named, held) if features])
            if data:
                yield (*tile, packed(data))

        for batch in batches:
            place = [batch.column(k).to_numpy() for k in range(2)]
            n = batch.num_rows
            if not n:
                continue
            # where the tile or the layer changes
            turns = np.flatnonzero(np.logical_or.reduce([np.diff(p) != 0 for p in place])) + 1
            fids, pxs, pys, shapes, counts = (batch.column(k).to_pylist() for k in range(2, 7))
            values = []
            for k, (_, _, m, counted) in enumerate(named):
                props = batch.column(7 + k)
                fields = [f.to_pylist() for f in props.flatten()[:m]] if m and props.null_count < n else []
                if counted:
                    fields.append(counts)
                values.append(fields)
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), n]):
                at, k = unpacked(int(place[0][a])), int(place[1][a])
                if at != tile:
                    yield from close()
                    tile, held, count = at, fresh(), 0
                rows = zip(*(f[a:b] for f in values[k])) if values[k] else repeat((), b - a)
                for fid, x, y, shape, props in zip(fids[a:b], pxs[a:b], pys[a:b], shapes[a:b], rows):
                    g = (1, [[[(x, y)]]]) if shape is None else from_wkb(shape)
                    if g is not None:
                        count += 1
                        if mvt and not merges:
                            held[k].add(fid if shown[k] else None, g, props)
                        else:
                            held[k].append((fid if shown[k] else None, g, props))
                if count > TILE_FEATURES:
                    raise ValueError(TOO_MANY.format(*tile, TILE_FEATURES))
        yield from close()

    return dealt.mapInArrow(points if plain else run, "z int, x long, y long, data binary")


def unpacked(tile: int) -> tuple[int, int, int]:
    return tile >> 50, tile >> 25 & 0x1FFFFFF, tile & 0x1FFFFFF


def packed(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def whole_tiles(batches):
    """Batches sorted by tile, cut anew so that each tile lies in one."""
    held = []
    for batch, goes_on in tile_pieces(batches):
        held.append(batch)
        if not goes_on:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []


def tile_pieces(batches):
    """Batches sorted by tile (their first column), cut anew so that each tile lies in one: ``(batch, False)``. A tile of more than ``PIECE_ROWS``
    rows comes by pieces, alone: ``(piece, True)``, and ``(piece, False)`` at last."""
    held: list[pa.RecordBatch] = []
    last, rows, joint, going = None, 0, 0, False

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).to_numpy()
        first, end = int(at[0]), int(at[-1])
        if last not in (None, first):
            yield joined(), False
            held, rows, joint, going = [], 0, 0, False
        turns = np.flatnonzero(np.diff(at)) + 1
        start = 0
        if len(turns):
            if going:
                start = int(turns[0])
                held.append(batch.slice(0, start))
                yield joined(), False
                held, going = [], False
            cut = int(turns[-1])
            if cut > start:
                held.append(batch.slice(start, cut - start))
                yield joined(), False
            held, rows, joint = [], 0, 0
            batch = batch.slice(cut)
        n = batch.num_rows
        if held and joint + n > PIECE_ROWS:
            yield joined(), True
            held, joint, going = [], 0, True
        held.append(batch)
        rows, joint, last = rows + n, joint + n, end
        if rows > TILE_FEATURES:
            raise ValueError(TOO_MANY.format(*unpacked(last), TILE_FEATURES))
    if held:
        yield joined(), False


def pyramid(specs: list[LayerSpec], config: TileConfig, points_only: bool = False) -> tuple[DataFrame, dict]:
    """Tiles ``(z, x, y, tile_id, data)`` and what the archive says of them. Statistics run at once, the rest is lazy. ``tables`` in the second are
    written tables that the plan reads."""
    layers, after = [], 0
    for spec in specs:
        layers.append(Layer(spec, config, after))
        after = layers[-1].after
    there = [layer for layer in layers if layer.stats["n"]]
    if not there:
        raise ValueError("No valid features found")
    if points_only and not all(layer.dots for layer in there):
        raise ValueError("streaming='always' takes POINT geometries only")
    tiles = encoded(union_of(there), there, config)
    tiles = tiles.withColumn("tile_id", tm.hilbert_id("z", "x", "y"))
    bounds = [f(layer.stats[c] for layer in there) for f, c in ((min, "west"), (min, "south"), (max, "east"), (max, "north"))]
    info = {
        "tables": [layer.table for layer in layers],
        "tile_format": config.tile_format,
        "min_zoom": min(layer.spec.min_zoom for layer in layers),
        "max_zoom": max(layer.spec.max_zoom for layer in layers),
        "bounds": bounds,
        "vector_layers": [
            {"id": layer.spec.name, "fields": {n: "string" for n in layer.field_names()}, "minzoom": layer.spec.min_zoom, "maxzoom": layer.spec.max_zoom, **({"geometry_type": KINDS[layer.stats["kind"]]} if layer.stats["kind"] else {})} for layer in layers
        ],
    }
    return tiles.select("z", "x", "y", "tile_id", "data"), info
