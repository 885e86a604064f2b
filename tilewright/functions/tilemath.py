"""Web-Mercator tile arithmetic as Column expressions; all of it stays inside code generation.

Longitudes and latitudes are degrees, tile rows count from the north, a tile has 4096 units a side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENT = 4096
#: Buffer around a tile, as a part of its side, for assignment and clipping.
BUFFER = 0.05
#: Latitudes are held within these when tiles are assigned, with a buffer and without.
LAT_BUFFERED, LAT_EXACT = 85.051, 85.05112878


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def tiles_across(z) -> Column:
    return _pow2(z).cast("long")


def clamped(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def asinh(v: Column) -> Column:
    """Exact for large negative values too."""
    return F.signum(v) * F.asinh(F.abs(v))


def mercator(lat) -> Column:
    return asinh(F.tan(F.radians(_c(lat))))


def world_x(lon, z) -> Column:
    """Fractional tile column."""
    return (_c(lon) + 180.0) / 360.0 * _pow2(z)


def world_y(lat, z) -> Column:
    return (1.0 - mercator(lat) / math.pi) / 2.0 * _pow2(z)


def _pow2(z) -> Column:
    return F.pow(F.lit(2.0), _c(z).cast("double"))


def tile_x(lon, z) -> Column:
    return clamped(F.floor(world_x(lon, z)), F.lit(0).cast("long"), tiles_across(z) - 1).cast("long")


def tile_y(lat, z) -> Column:
    return clamped(F.floor(world_y(lat, z)), F.lit(0).cast("long"), tiles_across(z) - 1).cast("long")


def tile_west(x, z) -> Column:
    return _c(x) / _pow2(z) * 360.0 - 180.0


def tile_north(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) - 2.0 * math.pi * _c(y) / _pow2(z))))


def tile_bounds(z, x, y) -> Column:
    return F.struct(tile_west(x, z).alias("west"), tile_north(_c(y) + 1, z).alias("south"), tile_west(_c(x) + 1, z).alias("east"), tile_north(y, z).alias("north"))


def pixel_degrees(z) -> Column:
    return F.lit(360.0) / (_pow2(z) * EXTENT)


def radius_degrees(pixels: float, z) -> Column:
    return F.lit(pixels * 360.0 / 256.0) / _pow2(z)


def simplify_tolerance(z) -> Column:
    return 8.0 * pixel_degrees(z) * pixel_degrees(z)


def buffered_range(west, south, east, north, z) -> tuple[Column, Column, Column, Column]:
    """First and last tile column and row of a box with the buffer around it. The buffer is that of longitude on both axes."""
    reach = F.lit(360.0 * BUFFER) / _pow2(z)
    return (
        tile_x(F.greatest(_c(west) - reach, F.lit(-180.0)), z),
        tile_x(F.least(_c(east) + reach, F.lit(180.0)), z),
        tile_y(F.least(_c(north) + reach, F.lit(LAT_BUFFERED)), z),
        tile_y(F.greatest(_c(south) - reach, F.lit(-LAT_BUFFERED)), z),
    )


def in_buffered_tile(lon, lat, z, x, y) -> Column:
    """Inclusive on all sides; the buffer is a part of the tile's degrees on either axis."""
    west, east = tile_west(x, z), tile_west(_c(x) + 1, z)
    north, south = tile_north(y, z), tile_north(_c(y) + 1, z)
    wide, high = (east - west) * BUFFER, (north - south) * BUFFER
    return _c(lon).between(west - wide, east + wide) & _c(lat).between(south - high, north + high)


def tile_px(lon, z, x) -> Column:
    west, east = tile_west(x, z), tile_west(_c(x) + 1, z)
    return F.round((_c(lon) - west) / (east - west) * EXTENT).cast("long")


def tile_py(lat, z, y) -> Column:
    north, south = mercator(tile_north(y, z)), mercator(tile_north(_c(y) + 1, z))
    return F.round((north - mercator(lat)) / (north - south) * EXTENT).cast("long")


def snapped_lon(lon, z, x) -> Column:
    west, east = tile_west(x, z), tile_west(_c(x) + 1, z)
    return west + tile_px(lon, z, x) / EXTENT * (east - west)


def snapped_lat(lat, z, y) -> Column:
    north, south = mercator(tile_north(y, z)), mercator(tile_north(_c(y) + 1, z))
    return F.degrees(F.atan(F.sinh(north - tile_py(lat, z, y) / EXTENT * (north - south))))


def spread_bits(v: Column) -> Column:
    """A zero between any two of the low 32 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """``x`` in the even bits, ``y`` in the odd ones."""
    return spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(spread_bits(y.cast("long")), 1))


def layer_morton(lon, lat) -> Column:
    """Place on a 65,536 grid of the whole world, linear in both degrees."""
    grid = lambda v, low, span: clamped(F.floor((_c(v) - low) / span * 65536.0), F.lit(0).cast("long"), F.lit(65535).cast("long"))
    return morton(grid(lon, -180.0, 360.0), grid(lat, -90.0, 180.0))


def in_tile_morton(lon, lat, z, x, y) -> Column:
    """Place on a 65,535 grid of the tile, linear in Mercator units; outside positions are held at the rim."""
    west, east = tile_west(x, z), tile_west(_c(x) + 1, z)
    north, south = mercator(tile_north(y, z)), mercator(tile_north(_c(y) + 1, z))
    gx = clamped((_c(lon) - west) / (east - west) * 65535.0, 0.0, 65535.0)
    gy = clamped((north - mercator(lat)) / (north - south) * 65535.0, 0.0, 65535.0)
    return morton(gx.cast("long"), gy.cast("long"))


def hilbert_id(z, x, y) -> Column:
    """PMTiles tile id: tiles of lower zooms come first, then the place on the zoom's Hilbert curve, by a fold over the levels."""
    tile = F.struct(_c(z).cast("int").alias("z"), _c(x).cast("long").alias("x"), _c(y).cast("long").alias("y"))

    def of(t: Column) -> Column:
        first = F.floor((_pow2(t["z"] * 2).cast("long") - 1) / 3)
        start = F.struct(first.alias("d"), t["x"].alias("x"), t["y"].alias("y"))
        levels = F.when(t["z"] > 0, F.sequence(t["z"] - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))

        def step(a: Column, level: Column) -> Column:
            s = _pow2(level).cast("long")
            rx, ry = a["x"].bitwiseAND(s) > 0, a["y"].bitwiseAND(s) > 0
            quadrant = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
            turned = lambda own, other: F.when(ry, own).when(rx, s - 1 - other).otherwise(other)
            return F.struct((a["d"] + s * s * quadrant).alias("d"), turned(a["x"], a["y"]).alias("x"), turned(a["y"], a["x"]).alias("y"))

        return F.aggregate(levels, start, step, lambda a: a["d"])

    return F.transform(F.array(tile), of)[0]


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def command(kind: int, count: Column) -> Column:
    return F.lit(kind).bitwiseOR(F.shiftleft(count, 3))


def endpoint_key(v) -> Column:
    return F.round(_c(v) * 1e8).cast("long")


def retain_count(n: Column, rate: float, steps: Column) -> Column:
    """How many of ``n`` points stay, ``steps`` zooms below the zoom that keeps all."""
    return clamped(F.ceil(n / F.pow(F.lit(float(rate)), steps.cast("double"))), F.lit(1).cast("long"), n).cast("long")


def keeps_even_rank(rank: Column, n: Column, retain: Column) -> Column:
    """Whether 0-based ``rank`` is one of floor(j * (n / retain)), j < retain. The candidates j are the floor of rank / step and
    its neighbours, each tried with that very product, so floats round as where positions are listed."""
    step = n.cast("double") / retain.cast("double")
    near = F.floor(rank / step)
    hit = F.lit(False)
    for by in (-1, 0, 1):
        j = near + by
        hit = hit | ((j >= 0) & (j < retain) & (F.least(F.floor(j.cast("double") * step), n - 1) == rank))
    return (retain >= n) | hit


def keeps_integer_rule(rank1: Column, n: Column, retain: Column) -> Column:
    """Whether 1-based ``rank1`` is where floor(rank * retain / n) grows."""
    whole = lambda r: F.call_function("div", r * retain, n)
    return whole(rank1) > whole(rank1 - 1)
