"""Lines, polygons and multipoints: description of a geometry, and cutting into tiles, both Arrow-batched."""

from __future__ import annotations

from math import atan, degrees, pi, sinh

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import crs as projections
from tilewright.functions.geometry import POINT, bbox, from_wkb, mercator, srid_of, to_wkb, transform
from tilewright.functions.tilemath import BUFFER, EXTENT, LAT_BUFFERED, buffered_range, clamped, morton
from tilewright.operators.clip import clip
from tilewright.operators.simplify import simplify_lines, snap

#: Tiles a side of a block. Large geometries are dealt to blocks before they are cut, so that one row is never all tiles of a continent.
BLOCK = 16
#: Bytes of parts that a worker holds before it hands them on.
PIECE_BYTES = 16 << 20


def described(df: DataFrame, crs: str = "EPSG:4326") -> DataFrame:
    """``df(ord, fid, wkb, props)`` with ``kind``, the bounding box, and ``lon``, ``lat`` of the first vertex. Null, broken and unsupported geometries go;
    the WKB is written anew, in degrees and two dimensions."""
    schema = df.select("ord", "fid", "wkb", "props", F.lit(0).alias("kind"), *[F.lit(0.0).alias(c) for c in ("west", "south", "east", "north", "lon", "lat")]).schema
    given = projections.known(crs)
    degrees_ = projections.Degrees()
    systems = {None: given}

    def system_of(data):
        """That of the geometry itself (extended WKB), else that of the table."""
        srid = srid_of(data)
        if srid not in systems:
            systems[srid] = projections.known(srid)
        return systems[srid]


    def run(batches):
        for batch in batches:
            keep, out = [], [[] for _ in range(8)]
            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                g = from_wkb(data)
                if g is None:
                    continue
                system = system_of(data)
                if system != degrees_:
                    try:
                        g = transform(g, lambda x, y: projections.to_degrees(x, y, system))
                    except (ValueError, OverflowError, ZeroDivisionError):  # beyond the domain of the projection
                        continue
                keep.append(i)
                first = g[1][0][0][0]
                for column, v in zip(out, (to_wkb(g), g[0], *bbox(g), *first)):
                    column.append(v)
            rows = batch.take(pa.array(keep, pa.int64()))
            kinds = (pa.binary(), pa.int32(), *[pa.float64()] * 6)
            made = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), made[0], rows.column(3), *made[1:]], ["ord", "fid", "wkb", "props", "kind", "west", "south", "east", "north", "lon", "lat"])

    return df.select("ord", "fid", "wkb", "props").mapInArrow(run, schema)


def pieces(df: DataFrame, simplify: bool, others: list[str]) -> DataFrame:
    """``df(z, fid, wkb, west, south, east, north, …others)`` by blocks: ``(z, bx, by, fid, wkb, whole, …others)``. A feature whose buffered
    bounding box lies in one block passes through as it is (``whole``); a larger one is simplified once, and clipped to ever smaller halves of its blocks,
    so that each block gets only the part that it needs."""
    x0, x1, y0, y1 = buffered_range("west", "south", "east", "north", "z")
    block = lambda c: F.floor(c / BLOCK).cast("long")
    at = df.select("z", "fid", "wkb", *others, block(x0).alias("bx"), block(x1).alias("bx1"), block(y0).alias("by"), block(y1).alias("by1"))
    small = (F.col("bx") == F.col("bx1")) & (F.col("by") == F.col("by1"))
    direct = at.where(small).select("z", "bx", "by", "fid", "wkb", F.lit(True).alias("whole"), *others)
    schema = direct.schema

    def run(batches):
        for batch in batches:
            rows, bxs, bys, shapes = [], [], [], []

            def made():
                own = batch.take(pa.array(rows, pa.int64()))
                arrays = [own.column(0), pa.array(bxs, pa.int64()), pa.array(bys, pa.int64()), own.column(1), pa.array(shapes, pa.binary()), pa.array([False] * len(rows), pa.bool_()), *own.columns[7:]]
                return pa.RecordBatch.from_arrays(arrays, schema.names)

            ranges = list(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6))))
            zs, held = batch.column(0).to_pylist(), 0
            for i, value in enumerate(batch.column(2)):
                g = from_wkb(value.as_py())
                if g is None:
                    continue
                for bx, by, part in split(simplify_lines(g, tolerance(zs[i])) if simplify else g, zs[i], *ranges[i]):
                    shapes.append(to_wkb(part))
                    held += len(shapes[-1])
                    rows.append(i), bxs.append(bx), bys.append(by)
                    if held > PIECE_BYTES:
                        yield made()
                        rows, bxs, bys, shapes, held = [], [], [], [], 0
            yield made()

    large = at.where(~small).select("z", "fid", "wkb", "bx", "bx1", "by", "by1", *others).mapInArrow(run, schema)
    return direct.unionByName(large)


def tolerance(z: int) -> float:
    return 8.0 * (360.0 / (1 << z) / EXTENT) ** 2


def split(g, z: int, x0: int, x1: int, y0: int, y1: int):
    """``(bx, by, part)`` of a geometry for each block that it meets. Parts reach a tile beyond their block, which is more than any tile's buffer."""
    n = 1 << z
    unit = 360.0 / n
    left = [(g, x0, x1, y0, y1)]
    while left:
        own, a, b, c, d = left.pop()
        if a == b and c == d:
            yield a, c, own
            continue
        halves = ((a, (a + b) // 2, c, d), ((a + b) // 2 + 1, b, c, d)) if b - a >= d - c else ((a, b, c, (c + d) // 2), (a, b, (c + d) // 2 + 1, d))
        for e, f, u, v in halves:
            box = ((e * BLOCK - 1) * unit - 180.0, _north((v + 1) * BLOCK + 1, n), ((f + 1) * BLOCK + 1) * unit - 180.0, _north(u * BLOCK - 1, n))
            if (part := clip(own, box)) is not None:
                left.append((part, e, f, u, v))


def _north(y: int, n: int) -> float:
    return degrees(atan(sinh(pi - 2 * pi * y / n)))


def _latitude(y: float, high: float, low: float) -> float:
    return degrees(atan(sinh(high - y / EXTENT * (high - low))))


def _column_of(lon: float, n: int) -> int:
    return min(max(int((lon + 180.0) / 360.0 * n // 1), 0), n - 1)


def _row_of(lat: float, n: int) -> int:
    return min(max(int((1.0 - mercator(lat) / pi) / 2.0 * n // 1), 0), n - 1)


def tiles_of(g, z: int, bx: int, by: int, simplify: bool):
    """``(x, y, geometry in tile units, sort key)`` for each tile of a block that ``g`` has a part in. Cut first by columns, then each column by rows."""
    n = 1 << z
    unit = 360.0 / n
    west, south, east, north = bbox(g)
    reach = unit * BUFFER
    x0, x1 = _column_of(max(west - reach, -180.0), n), _column_of(min(east + reach, 180.0), n)
    y0, y1 = _row_of(min(north + reach, LAT_BUFFERED), n), _row_of(max(south - reach, -LAT_BUFFERED), n)
    x0, x1 = max(x0, bx * BLOCK), min(x1, bx * BLOCK + BLOCK - 1)
    y0, y1 = max(y0, by * BLOCK), min(y1, by * BLOCK + BLOCK - 1)
    for x in range(x0, x1 + 1):
        left = x * unit - 180.0
        right = (x + 1) * unit - 180.0
        strip = clip(g, (left - reach, -90.0, right + reach, 90.0)) if x1 > x0 or y1 > y0 else g
        if strip is None:
            continue
        for y in range(y0, y1 + 1):
            top, bottom = _north(y, n), _north(y + 1, n)
            margin = (top - bottom) * BUFFER
            piece = clip(strip, (left - reach, bottom - margin, right + reach, top + margin))
            if piece is None:
                continue
            high, low = mercator(top), mercator(bottom)
            inside = transform(piece, lambda lon, lat: ((lon - left) / (right - left) * EXTENT, (high - mercator(lat)) / (high - low) * EXTENT))
            if simplify:
                inside = snap(inside)
            a, b, c, d = bbox(inside)
            middle = (_latitude(b, high, low) + _latitude(d, high, low)) / 2
            yield x, y, inside, (a + c) / 2 / EXTENT, (high - mercator(middle)) / (high - low)


def cut(df: DataFrame, simplify: bool, others: list[str]) -> DataFrame:
    """Rows of ``pieces`` cut into tiles: ``(z, x, y, fid, shape, cx, cy, …others)``, with ``shape`` WKB in tile units and ``cx``, ``cy`` the centre as parts of the tile."""
    source = df.select("z", "bx", "by", "fid", "wkb", "whole", *others)
    schema = df.select("z", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "fid", "wkb", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), *others).withColumnRenamed("wkb", "shape").schema

    def run(batches):
        for batch in batches:
            at, xs, ys, shapes, cxs, cys = [], [], [], [], [], []

            def made():
                rows = batch.take(pa.array(at, pa.int64()))
                arrays = [rows.column(0), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), rows.column(3), pa.array(shapes, pa.binary()), pa.array(cxs, pa.float64()), pa.array(cys, pa.float64()), *rows.columns[6:]]
                return pa.RecordBatch.from_arrays(arrays, schema.names)

            zs, bxs, bys = (batch.column(k).to_pylist() for k in range(3))
            whole = batch.column(5).to_pylist()
            for i, value in enumerate(batch.column(4)):
                g = from_wkb(value.as_py())
                if g is None:
                    continue
                if simplify and whole[i]:
                    g = simplify_lines(g, tolerance(zs[i]))
                for x, y, inside, cx, cy in tiles_of(g, zs[i], bxs[i], bys[i], simplify):
                    for column, v in zip((at, xs, ys, shapes, cxs, cys), (i, x, y, to_wkb(inside), cx, cy)):
                        column.append(v)
                if len(at) > 5000:
                    yield made()
                    at, xs, ys, shapes, cxs, cys = [], [], [], [], [], []
            yield made()

    return source.mapInArrow(run, schema)


def centre_key(cx: Column, cy: Column) -> Column:
    return morton(clamped(cx * 65535.0, 0.0, 65535.0).cast("long"), clamped(cy * 65535.0, 0.0, 65535.0).cast("long"))


def is_point(kind: Column) -> Column:
    return kind.isin(POINT, POINT + 3)
