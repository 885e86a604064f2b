"""Named queries over the synthetic geometry views, each with the SQL that states its result."""

from __future__ import annotations

from itertools import islice
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import crs as projections
from tilewright.functions import tilemath as tm
from tilewright.functions.geometry import LINE, POLYGON, from_wkb, to_wkb
from tilewright.operators import encode, thin
from tilewright.operators.cluster import clusters
from tilewright.operators.coalesce import coalesce, with_group
from tilewright.operators.cut import cut, pieces
from tilewright.operators.points import MltPoints, MvtPoints
from tilewright.operators.reading import mlt_layers, mlt_points, mvt_layers, mvt_points
from tilewright.operators.simplify import visvalingam
from tilewright.plans.model import LayerSpec, TileConfig, normalised, row_numbers
from tilewright.plans.store import saved
from tilewright.plans.tiles import Layer, point_tiles, pyramid, whole_tiles

# ---- views; the same text serves both engines ------------------------------------------------------------------------------

_LON = "((({k} * 7919 + 13) % 100003) / CAST(100003 AS DOUBLE))"
_LAT = "((({k} * 104729 + 7) % 100019) / CAST(100019 AS DOUBLE))"


def _world(k: str) -> tuple[str, str]:
    return f"{_LON.format(k=k)} * 360.0 - 180.0", f"{_LAT.format(k=k)} * 170.0 - 85.0"


def _region(k: str) -> tuple[str, str]:
    return f"{_LON.format(k=k)} * 5.0 - 80.0", f"{_LAT.format(k=k)} * 5.0 + 35.0"


def _views() -> dict[str, tuple[str, str]]:
    wx, wy = _world("o_orderkey")
    cx, cy = _region("c_custkey")
    bx, by = _world("p_partkey")
    lx, ly = _region("o_orderkey")
    return {
        "geo_points": ("orders", f"SELECT o_orderkey AS fid, CAST({wx} AS DOUBLE) AS lon, CAST({wy} AS DOUBLE) AS lat, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders"),
        "geo_points_region": ("customer", f"SELECT c_custkey AS fid, CAST({cx} AS DOUBLE) AS lon, CAST({cy} AS DOUBLE) AS lat, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer"),
        "geo_boxes": (
            "part",
            f"SELECT p_partkey AS fid, xmin, ymin, xmin + w AS xmax, ymin + w / 2.0 AS ymax, brand, size FROM (SELECT p_partkey, CAST({bx} AS DOUBLE) AS xmin, CAST({by} AS DOUBLE) AS ymin, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS w, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part) b",
        ),
        "geo_line_vertices": (
            "orders",
            f"SELECT o_custkey AS fid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS seq, CAST({lx} AS DOUBLE) AS lon, CAST({ly} AS DOUBLE) AS lat FROM orders",
        ),
    }


VIEWS = _views()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = VIEWS[name]
    base = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {base}", 1), base=base)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names) + " "


# ---- SQL texts of the tile math --------------------------------------------------------------------------------------------

PI = "pi()"


def _n(z) -> str:
    return f"power(CAST(2 AS DOUBLE), {z})"


def _merc(lat: str) -> str:
    return f"asinh(tan(radians({lat})))"


def _tx(lon: str, z) -> str:
    return f"CAST(least(greatest(floor((({lon}) + 180.0) / 360.0 * {_n(z)}), 0), {_n(z)} - 1) AS BIGINT)"


def _ty(lat: str, z) -> str:
    return f"CAST(least(greatest(floor((1.0 - {_merc(lat)} / {PI}) / 2.0 * {_n(z)}), 0), {_n(z)} - 1) AS BIGINT)"


def _west(x: str, z) -> str:
    return f"(({x}) / {_n(z)} * 360.0 - 180.0)"


def _north(y: str, z) -> str:
    return f"degrees(atan(sinh({PI} - 2.0 * {PI} * ({y}) / {_n(z)})))"


def _px(lon: str, z, x: str) -> str:
    return f"CAST(round((({lon}) - {_west(x, z)}) / ({_west(x + ' + 1', z)} - {_west(x, z)}) * 4096.0) AS BIGINT)"


def _py(lat: str, z, y: str) -> str:
    top, bottom = _merc(_north(y, z)), _merc(_north(y + " + 1", z))
    return f"CAST(round(({top} - {_merc(lat)}) / ({top} - {bottom}) * 4096.0) AS BIGINT)"


_RANGES = f"""{_tx('greatest(lon - 18.0 / ' + _n('z') + ', -180.0)', 'z')} AS x0, {_tx('least(lon + 18.0 / ' + _n('z') + ', 180.0)', 'z')} AS x1,
  {_ty('least(lat + 18.0 / ' + _n('z') + ', 85.051)', 'z')} AS y0, {_ty('greatest(lat - 18.0 / ' + _n('z') + ', -85.051)', 'z')} AS y1"""
_ZOOMS = "(SELECT unnest(range({a}, {b} + 1)) AS z) zooms"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _zoomed(df: DataFrame, a: int, b: int) -> DataFrame:
    return df.withColumn("z", F.explode(F.sequence(F.lit(a), F.lit(b))))


def _z(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.col("z").cast("long"))


# ---- assignment ------------------------------------------------------------------------------------------------------------


@query(_with("geo_points") + f"SELECT fid, {_tx('lon', 10)} AS x, {_ty('lat', 10)} AS y FROM geo_points")
def tile_assign_z10(spark, sf_dir):
    return view(spark, sf_dir, "geo_points").select("fid", tm.tile_x("lon", F.lit(10)).alias("x"), tm.tile_y("lat", F.lit(10)).alias("y"))


@query(_with("geo_points") + f"SELECT z, {_tx('lon', 'z')} AS x, {_ty('lat', 'z')} AS y, count(*) AS n FROM geo_points, {_ZOOMS.format(a=0, b=6)} GROUP BY 1, 2, 3")
def tile_counts_pyramid(spark, sf_dir):
    rows = _zoomed(view(spark, sf_dir, "geo_points").select("lon", "lat"), 0, 6)
    return _z(rows.groupBy("z", tm.tile_x("lon", "z").alias("x"), tm.tile_y("lat", "z").alias("y")).agg(F.count(F.lit(1)).alias("n")))


@query(_with("geo_points") + f"SELECT fid, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT fid, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT fid, z, {_RANGES} FROM geo_points, {_ZOOMS.format(a=2, b=4)}) r) s")
def tile_assign_buffered(spark, sf_dir):
    rows = _zoomed(view(spark, sf_dir, "geo_points").select("fid", "lon", "lat"), 2, 4)
    x0, x1, y0, y1 = tm.buffered_range("lon", "lat", "lon", "lat", "z")
    return _z(rows.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1))).select("fid", "z", "x", "y"))


@query(
    _with("geo_points")
    + f"""SELECT fid, z, x, y FROM (SELECT fid, lon, lat, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT fid, lon, lat, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT fid, lon, lat, z, {_RANGES} FROM geo_points, {_ZOOMS.format(a=2, b=4)}) r) s) t
WHERE lon BETWEEN {_west('x', 'z')} - 18.0 / {_n('z')} AND {_west('x + 1', 'z')} + 18.0 / {_n('z')}
  AND lat BETWEEN {_north('y + 1', 'z')} - 0.05 * ({_north('y', 'z')} - {_north('y + 1', 'z')}) AND {_north('y', 'z')} + 0.05 * ({_north('y', 'z')} - {_north('y + 1', 'z')})"""
)
def clip_points_buffered(spark, sf_dir):
    rows = _zoomed(view(spark, sf_dir, "geo_points").select("fid", "lon", "lat"), 2, 4)
    return _z(point_tiles(rows, "buffered").select("fid", "z", "x", "y"))


@query(_with("geo_points") + f"SELECT DISTINCT x, y, round({_west('x', 8)}, 7) AS west, round({_west('x + 1', 8)}, 7) AS east, round({_north('y + 1', 8)}, 7) AS south, round({_north('y', 8)}, 7) AS north FROM (SELECT {_tx('lon', 8)} AS x, {_ty('lat', 8)} AS y FROM geo_points) t")
def tile_bounds(spark, sf_dir):
    tiles = view(spark, sf_dir, "geo_points").select(tm.tile_x("lon", F.lit(8)).alias("x"), tm.tile_y("lat", F.lit(8)).alias("y")).distinct()
    b = tm.tile_bounds(F.lit(8), F.col("x"), F.col("y"))
    return tiles.withColumn("b", b).select("x", "y", *[F.round(F.col("b")[c], 7).alias(c) for c in ("west", "east", "south", "north")])


@query(
    _with("geo_points")
    + f"""SELECT px, py, count(DISTINCT cx * 1000000 + cy) AS children, count(*) AS n FROM (SELECT {_tx('lon', 6)} AS px, {_ty('lat', 6)} AS py, {_tx('lon', 7)} AS cx, {_ty('lat', 7)} AS cy FROM geo_points) t WHERE cx // 2 = px AND cy // 2 = py GROUP BY 1, 2"""
)
def tile_children_parent(spark, sf_dir):
    rows = view(spark, sf_dir, "geo_points").select(tm.tile_x("lon", F.lit(6)).alias("px"), tm.tile_y("lat", F.lit(6)).alias("py"), tm.tile_x("lon", F.lit(7)).alias("cx"), tm.tile_y("lat", F.lit(7)).alias("cy"))
    inside = rows.where((F.shiftright("cx", 1) == F.col("px")) & (F.shiftright("cy", 1) == F.col("py")))
    return inside.groupBy("px", "py").agg(F.countDistinct(F.col("cx") * 1000000 + F.col("cy")).alias("children"), F.count(F.lit(1)).alias("n"))


# ---- coordinates, codes and ids --------------------------------------------------------------------------------------------

_TILE9 = f"SELECT fid, lon, lat, {_tx('lon', 9)} AS x, {_ty('lat', 9)} AS y FROM geo_points"


def _tile9(spark, sf_dir):
    return view(spark, sf_dir, "geo_points").select("fid", "lon", "lat", tm.tile_x("lon", F.lit(9)).alias("x"), tm.tile_y("lat", F.lit(9)).alias("y"))


@query(_with("geo_points") + f"SELECT fid, {_px('lon', 9, 'x')} AS px, {_py('lat', 9, 'y')} AS py FROM ({_TILE9}) t")
def quantize_points(spark, sf_dir):
    return _tile9(spark, sf_dir).select("fid", tm.tile_px("lon", F.lit(9), "x").alias("px"), tm.tile_py("lat", F.lit(9), "y").alias("py"))


@query(
    _with("geo_points")
    + f"""SELECT fid, round({_west('x', 9)} + px / 4096.0 * 360.0 / 512.0, 7) AS lon, round(degrees(atan(sinh({_merc(_north('y', 9))} - py / 4096.0 * ({_merc(_north('y', 9))} - {_merc(_north('y + 1', 9))})))), 7) AS lat
FROM (SELECT fid, x, y, {_px('lon', 9, 'x')} AS px, {_py('lat', 9, 'y')} AS py FROM ({_TILE9}) t) u"""
)
def snap_points(spark, sf_dir):
    return _tile9(spark, sf_dir).select("fid", F.round(tm.snapped_lon("lon", F.lit(9), "x"), 7).alias("lon"), F.round(tm.snapped_lat("lat", F.lit(9), "y"), 7).alias("lat"))


@query(_with("geo_points") + f"SELECT fid, CAST(9 AS BIGINT) AS command, CASE WHEN px >= 0 THEN 2 * px ELSE -2 * px - 1 END AS zx, CASE WHEN py >= 0 THEN 2 * py ELSE -2 * py - 1 END AS zy FROM (SELECT fid, {_px('lon', 9, 'x')} AS px, {_py('lat', 9, 'y')} AS py FROM ({_TILE9}) t) u")
def mvt_point_commands(spark, sf_dir):
    """Encoded by batches, whatever their tiles: the commands of a point hang on itself alone."""
    import pyarrow as pa

    rows = _tile9(spark, sf_dir).select("fid", tm.tile_px("lon", F.lit(9), "x").alias("px"), tm.tile_py("lat", F.lit(9), "y").alias("py"))

    def run(batches):
        for batch in batches:
            layer = MvtPoints("p", [])
            layer.add(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), [])
            for piece in mvt_points(layer.finish(), {}):
                yield pa.RecordBatch.from_arrays([piece["id"], *(pa.array(piece[k]) for k in ("command", "zx", "zy"))], ["fid", "command", "zx", "zy"])

    return rows.mapInArrow(run, "fid long, command long, zx long, zy long")


_MORTON = """SELECT fid, lon, lat, {more} list_sum(list_transform(range(0, 16), lambda i: (((gx >> i) & 1) << (2 * i)) + (((gy >> i) & 1) << (2 * i + 1))))::BIGINT AS morton FROM (SELECT *, {gx} AS gx, {gy} AS gy FROM ({src}) s) g"""
_LAYER_MORTON = _MORTON.format(more="", gx="CAST(least(greatest(floor((lon + 180.0) / 360.0 * 65536.0), 0), 65535) AS BIGINT)", gy="CAST(least(greatest(floor((lat + 90.0) / 180.0 * 65536.0), 0), 65535) AS BIGINT)", src="SELECT * FROM geo_points")


@query(_with("geo_points") + f"SELECT fid, morton FROM ({_LAYER_MORTON}) m")
def morton_code_points(spark, sf_dir):
    return view(spark, sf_dir, "geo_points").select("fid", tm.layer_morton("lon", "lat").alias("morton"))


_IN_TILE = _MORTON.format(
    more="x, y,",
    gx=f"CAST(floor(least(greatest((lon - {_west('x', 9)}) / ({_west('x + 1', 9)} - {_west('x', 9)}) * 65535.0, 0), 65535)) AS BIGINT)",
    gy=f"CAST(floor(least(greatest(({_merc(_north('y', 9))} - {_merc('lat')}) / ({_merc(_north('y', 9))} - {_merc(_north('y + 1', 9))}) * 65535.0, 0), 65535)) AS BIGINT)",
    src=_TILE9,
)


@query(_with("geo_points") + f"SELECT fid, x, y, morton >> 12 AS key FROM ({_IN_TILE}) m")
def tile_morton_sort_key(spark, sf_dir):
    """The key without its lowest bits, which hang on the last place of a double."""
    return _tile9(spark, sf_dir).select("fid", "x", "y", F.shiftright(tm.in_tile_morton("lon", "lat", F.lit(9), "x", "y"), 12).alias("key"))


@query(
    "WITH RECURSIVE "
    + _with("geo_points")[5:-1]
    + f""", t AS (SELECT DISTINCT {_tx('lon', 7)} AS tx, {_ty('lat', 7)} AS ty FROM geo_points),
h AS (SELECT tx, ty, tx AS x, ty AS y, CAST(64 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM t
  UNION ALL SELECT tx, ty,
    CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN s - 1 - y ELSE y END, CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN s - 1 - x ELSE x END, s // 2,
    d + s * s * (CASE WHEN (x & s) > 0 AND (y & s) > 0 THEN 2 WHEN (x & s) > 0 THEN 3 WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
SELECT tx AS x, ty AS y, d + 5461 AS tile_id FROM h WHERE s = 0"""
)
def hilbert_tile_id(spark, sf_dir):
    tiles = view(spark, sf_dir, "geo_points").select(tm.tile_x("lon", F.lit(7)).alias("x"), tm.tile_y("lat", F.lit(7)).alias("y")).distinct()
    return tiles.select("x", "y", tm.hilbert_id(F.lit(7), "x", "y").alias("tile_id"))


# ---- thinning --------------------------------------------------------------------------------------------------------------

_RANKED = f"SELECT fid, row_number() OVER (ORDER BY morton, fid) - 1 AS r, count(*) OVER () AS n FROM ({_LAYER_MORTON}) m"


def _ranked(spark, sf_dir, piece=thin.PIECE):
    points = view(spark, sf_dir, "geo_points").select("fid", "lon", "lat")
    n = points.count()
    return thin.morton_ranks(points, n, piece), n


@query(
    _with("geo_points")
    + f""", ranked AS ({_RANKED}), quota AS (SELECT z, n, CAST(ceil(n / power(2.5, 8 - z)) AS BIGINT) AS k FROM (SELECT DISTINCT n FROM ranked) c, {_ZOOMS.format(a=4, b=7)}),
spots AS (SELECT z, CAST(least(floor(j * (CAST(n AS DOUBLE) / k)), n - 1) AS BIGINT) AS r FROM (SELECT z, n, k, unnest(range(0, k)) AS j FROM quota) q)
SELECT s.z, fid FROM ranked JOIN spots s ON s.r = ranked.r"""
)
def thin_points_even_rank(spark, sf_dir):
    rows, n = _ranked(spark, sf_dir)
    rows = _zoomed(rows, 4, 7)
    return _z(rows.where(thin.keeps_point("even", F.col("rank"), n, 2.5, 8, F.col("z"))).select("z", "fid"))


@query(
    _with("geo_points")
    + f""", ranked AS ({_RANKED}) SELECT z, fid FROM (SELECT z, fid, r + 1 AS rk, n, CAST(ceil(n / power(2.5, 8 - z)) AS BIGINT) AS k FROM ranked, {_ZOOMS.format(a=4, b=7)}) t WHERE rk * k // n > (rk - 1) * k // n"""
)
def thin_points_integer_rule(spark, sf_dir):
    rows, n = _ranked(spark, sf_dir)
    rows = _zoomed(rows, 4, 7)
    return _z(rows.where(thin.keeps_point("integer", F.col("rank"), n, 2.5, 8, F.col("z"))).select("z", "fid"))


@query(_with("geo_points") + f"SELECT z, CAST(least(greatest(ceil(n / power(2.5, 14 - z)), 1), n) AS BIGINT) AS retain FROM (SELECT count(*) AS n FROM geo_points) c, {_ZOOMS.format(a=0, b=14)}")
def retain_counts(spark, sf_dir):
    n = view(spark, sf_dir, "geo_points").agg(F.count(F.lit(1)).alias("n"))
    return _z(_zoomed(n, 0, 14).select("z", tm.retain_count(F.col("n"), 2.5, F.lit(14) - F.col("z")).alias("retain")))


# ---- statistics ------------------------------------------------------------------------------------------------------------


@query(_with("geo_points") + "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM geo_points")
def layer_bounds(spark, sf_dir):
    return view(spark, sf_dir, "geo_points").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query(_with("geo_points") + "SELECT count(*) FILTER (WHERE status = 'O') AS n_open, count(*) FILTER (WHERE status <> 'O') AS n_other, min(lon) FILTER (WHERE status = 'O') AS west, max(lat) FILTER (WHERE status = 'O') AS north FROM geo_points")
def point_stats_filtered(spark, sf_dir):
    own = F.col("status") == "O"
    return view(spark, sf_dir, "geo_points").agg(F.count_if(own).alias("n_open"), F.count_if(~own).alias("n_other"), F.min(F.when(own, F.col("lon"))).alias("west"), F.max(F.when(own, F.col("lat"))).alias("north"))


_KINDS = "SELECT 'boxes' AS layer, fid, 'Polygon' AS kind FROM geo_boxes UNION ALL SELECT 'points', fid, 'Point' FROM geo_points"


@query(_with("geo_points", "geo_boxes") + f"SELECT layer, arg_min(kind, fid) AS geometry_type, count(*) AS n FROM ({_KINDS}) k GROUP BY layer")
def layer_geometry_type(spark, sf_dir):
    named = [view(spark, sf_dir, v).select(F.lit(n).alias("layer"), "fid", F.lit(k).alias("kind")) for n, k, v in (("boxes", "Polygon", "geo_boxes"), ("points", "Point", "geo_points"))]
    return named[0].unionByName(named[1]).groupBy("layer").agg(F.min_by("kind", "fid").alias("geometry_type"), F.count(F.lit(1)).alias("n"))


# ---- boxes and lines -------------------------------------------------------------------------------------------------------


@query(_with("geo_boxes") + f"SELECT z, fid FROM geo_boxes, {_ZOOMS.format(a=2, b=8)} WHERE NOT (xmax - xmin) * (ymax - ymin) < power(360.0 / ({_n('z')} * 4096.0), 2) * power(2.5, 8 - z)")
def area_drop_boxes(spark, sf_dir):
    rows = _zoomed(view(spark, sf_dir, "geo_boxes"), 2, 8)
    return _z(rows.where(thin.keeps_area(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 2.5, 8, F.col("z"))).select("z", "fid"))


_BOX_RANGES = f"""{_tx('greatest(xmin - 18.0 / ' + _n('z') + ', -180.0)', 'z')} AS x0, {_tx('least(xmax + 18.0 / ' + _n('z') + ', 180.0)', 'z')} AS x1,
  {_ty('least(ymax + 18.0 / ' + _n('z') + ', 85.051)', 'z')} AS y0, {_ty('greatest(ymin - 18.0 / ' + _n('z') + ', -85.051)', 'z')} AS y1"""
_BOX_TILES = f"SELECT fid, xmin, ymin, xmax, ymax, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, {_BOX_RANGES} FROM geo_boxes, {_ZOOMS.format(a=6, b=8)}) r) s"


@query(_with("geo_boxes") + f"SELECT fid, z, x, y FROM ({_BOX_TILES}) t")
def bbox_assign_boxes(spark, sf_dir):
    rows = _zoomed(view(spark, sf_dir, "geo_boxes"), 6, 8)
    x0, x1, y0, y1 = tm.buffered_range("xmin", "ymin", "xmax", "ymax", "z")
    return _z(rows.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1))).select("fid", "z", "x", "y"))


def _boxes(spark, sf_dir) -> DataFrame:
    """Boxes as features: WKB is laid out in SQL by Arrow-batched code."""
    rows = view(spark, sf_dir, "geo_boxes")

    @F.pandas_udf("binary")
    def wkb(a, b, c, d):
        import pandas as pd

        return pd.Series([to_wkb((POLYGON, [[[(w, s), (e, s), (e, n), (w, n), (w, s)]]])) for w, s, e, n in zip(a, b, c, d)])

    return rows.select("fid", wkb("xmin", "ymin", "xmax", "ymax").alias("wkb"), "brand", "size", F.col("xmin").alias("west"), F.col("ymin").alias("south"), F.col("xmax").alias("east"), F.col("ymax").alias("north"))


_H = "0.05 * ({n} - {s})".format(n=_north("y", "z"), s=_north("y + 1", "z"))


@query(
    _with("geo_boxes")
    + f"""SELECT fid, z, x, y, CAST(floor(greatest(xmin, {_west('x', 'z')} - 18.0 / {_n('z')}) * 1000000.0 + 0.37) AS BIGINT) AS west, CAST(floor(least(xmax, {_west('x + 1', 'z')} + 18.0 / {_n('z')}) * 1000000.0 + 0.37) AS BIGINT) AS east,
  CAST(floor(greatest(ymin, {_north('y + 1', 'z')} - {_H}) * 1000000.0 + 0.37) AS BIGINT) AS south, CAST(floor(least(ymax, {_north('y', 'z')} + {_H}) * 1000000.0 + 0.37) AS BIGINT) AS north FROM ({_BOX_TILES}) t
WHERE xmin < {_west('x + 1', 'z')} + 18.0 / {_n('z')} AND xmax > {_west('x', 'z')} - 18.0 / {_n('z')} AND ymin < {_north('y', 'z')} + {_H} AND ymax > {_north('y + 1', 'z')} - {_H}"""
)
def clip_boxes_rect(spark, sf_dir):
    """Rectangles cut by the polygon clipper, as the bounds, in millionths of a degree, of what is left in each tile."""
    from tilewright.functions.geometry import bbox

    rows = cut(pieces(_zoomed(_boxes(spark, sf_dir), 6, 8), False, []), False, [])
    n = F.pow(F.lit(2.0), F.col("z").cast("double"))

    @F.pandas_udf("array<double>")
    def bounds(shape):
        return shape.map(lambda b: list(bbox(from_wkb(b))))

    at = rows.withColumn("b", bounds("shape"))
    lon = lambda v: (F.col("x") + v / 4096.0) / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) - 2 * 3.141592653589793 * (F.col("y") + v / 4096.0) / n)))
    micro = lambda v: F.floor(v * 1000000.0 + 0.37).cast("long")
    b = F.col("b")
    return _z(at.select("fid", "z", "x", "y", micro(lon(b[0])).alias("west"), micro(lon(b[2])).alias("east"), micro(lat(b[3])).alias("south"), micro(lat(b[1])).alias("north")))


_BBOX_LINES = "SELECT fid, count(*) AS n, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM geo_line_vertices GROUP BY fid HAVING count(*) >= 2"


@query(_with("geo_line_vertices") + _BBOX_LINES)
def bbox_lines(spark, sf_dir):
    rows = view(spark, sf_dir, "geo_line_vertices")
    return rows.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")).where("n >= 2")


_LINE_RANGES = _BOX_RANGES.replace("xmin", "west").replace("xmax", "east").replace("ymin", "south").replace("ymax", "north")


@query(_with("geo_line_vertices") + f"SELECT fid, z, (x1 - x0 + 1) * (y1 - y0 + 1) AS n_tiles FROM (SELECT fid, z, {_LINE_RANGES} FROM ({_BBOX_LINES}) b, {_ZOOMS.format(a=4, b=9)}) r")
def lines_zoom_assign(spark, sf_dir):
    rows = _zoomed(bbox_lines(spark, sf_dir), 4, 9)
    x0, x1, y0, y1 = tm.buffered_range("west", "south", "east", "north", "z")
    return _z(rows.select("fid", "z", ((x1 - x0 + 1) * (y1 - y0 + 1)).alias("n_tiles")))


# ---- layers ----------------------------------------------------------------------------------------------------------------


@query(_with("geo_points_region", "geo_boxes") + "SELECT 'region' AS layer, fid, row_number() OVER (ORDER BY fid) AS id FROM geo_points_region UNION ALL SELECT 'boxes', fid, row_number() OVER (ORDER BY fid) + (SELECT count(*) FROM geo_points_region) FROM geo_boxes")
def feature_ids_across_layers(spark, sf_dir):
    """Layers without ids of their own, as the pyramid numbers them."""
    out, before = None, 0
    boxes = _boxes(spark, sf_dir).select("fid", F.col("wkb").alias("geometry"))
    for name, rows, columns in (("region", view(spark, sf_dir, "geo_points_region").select("fid", "lon", "lat"), {"lon": "lon", "lat": "lat"}), ("boxes", boxes, {})):
        layer = Layer(LayerSpec(rows.orderBy("fid"), name=name, min_zoom=0, max_zoom=1, **columns), TileConfig(max_zoom=1), before)
        before = layer.after
        one = layer.rows.select(F.lit(name).alias("layer"), F.col("props.fid").alias("fid"), F.col("fid").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_with("geo_points") + "SELECT priority, count(*) AS n, sum(price) > 0 AS positive, row_number() OVER (ORDER BY priority) AS id FROM geo_points GROUP BY priority")
def feature_ids_of_grouped_query(spark, sf_dir):
    """Numbers of the rows of a query with shuffles."""
    rows = view(spark, sf_dir, "geo_points").groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s")).orderBy("priority")
    found = row_numbers(rows.withColumn("positive", F.col("s") > 0), "id")
    return found.select("priority", "n", "positive", "id")


@query(_with("geo_points_region", "geo_boxes") + f"SELECT layer, z, count(*) AS n FROM (SELECT 'region' AS layer, 0 AS lo, 5 AS hi FROM geo_points_region UNION ALL SELECT 'boxes', 3, 8 FROM geo_boxes) l, {_ZOOMS.format(a=0, b=8)} WHERE z BETWEEN lo AND hi GROUP BY 1, 2")
def layer_zoom_ranges(spark, sf_dir):
    out = None
    for name, source, low, high in (("region", "geo_points_region", 0, 5), ("boxes", "geo_boxes", 3, 8)):
        one = _zoomed(view(spark, sf_dir, source).select(F.lit(name).alias("layer")), low, high)
        out = one if out is None else out.unionByName(one)
    return _z(out.groupBy("layer", "z").agg(F.count(F.lit(1)).alias("n")))


@query(_with("geo_points", "geo_points_region") + f"SELECT x, y, count(*) FILTER (WHERE layer = 0) AS n_world, count(*) FILTER (WHERE layer = 1) AS n_region FROM (SELECT 0 AS layer, {_tx('lon', 6)} AS x, {_ty('lat', 6)} AS y FROM geo_points UNION ALL SELECT 1, {_tx('lon', 6)}, {_ty('lat', 6)} FROM geo_points_region) u GROUP BY x, y")
def multilayer_tile_union(spark, sf_dir):
    at = lambda source, k: view(spark, sf_dir, source).select(F.lit(k).alias("layer"), tm.tile_x("lon", F.lit(6)).alias("x"), tm.tile_y("lat", F.lit(6)).alias("y"))
    return at("geo_points", 0).unionByName(at("geo_points_region", 1)).groupBy("x", "y").agg(F.count_if(F.col("layer") == 0).alias("n_world"), F.count_if(F.col("layer") == 1).alias("n_region"))


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(tile, features)`` for the rows of each tile ``(x, y)``, by ``fid``: features are (fid, place, px, py, values of the other columns)."""
    import pandas as pd

    names = [c for c in rows.columns if c not in ("x", "y", "fid", "px", "py")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fid")
        values = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in names]
        features = list(zip(pdf["fid"].tolist(), pdf["px"].tolist(), pdf["py"].tolist(), zip(*values) if names else [()] * len(pdf)))
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        return pd.DataFrame([(x, y, *r) for r in run(features)], columns=[f.split()[0] for f in schema.split(", ")])

    return rows.groupBy("x", "y").applyInPandas(one, schema)


_ARROW = {"long": "int64", "string": "string", "boolean": "bool_"}


def _tile_pieces(rows: DataFrame, start, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``start()`` makes of the rows of each tile ``(x, y)``, and of ``more`` keys within it, in order of ``fid``: ``add(fid, px, py, columns)`` takes Arrow
    columns of the rows by pieces, ``rows()`` gives pieces of the result's columns after ``x``, ``y``. The sort is Spark's, which spills; no task holds the rows of a tile."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c for c in rows.columns if c not in ("x", "y", "fid", "px", "py", *more)]
    out = [f.split() for f in schema.split(", ")]
    wide = 2 + len(more)
    dealt = rows.select("x", "y", *more, "fid", "px", "py", *names).repartition("x", "y").sortWithinPartitions("x", "y", *more, "fid")

    def made(tile, own):
        for columns in own.rows():
            n = len(columns[0])
            if n:
                columns = [*(pa.repeat(pa.scalar(v, pa.int64()), n) for v in tile[:2]), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=getattr(pa, _ARROW[k])()) if not isinstance(c, pa.Array) else c.cast(getattr(pa, _ARROW[k])()) for c, (_, k) in zip(columns, out)], [n for n, _ in out])

    def cells(column):
        return pc.if_else(pc.is_nan(column), None, column) if pa.types.is_floating(column.type) else column

    def run(batches):
        tile, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = np.zeros(batch.num_rows, bool)
            for k in range(wide):
                code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                turn[1:] |= np.diff(code) != 0
            starts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
            fid, px, py, *columns = batch.columns[wide:]
            columns = [cells(c) for c in columns]
            for a, b in zip(starts, starts[1:]):
                at = tuple(batch.column(k)[a].as_py() for k in range(wide))
                if at != tile:
                    if own:
                        yield from made(tile, own)
                    tile, own = at, start()
                own.add(fid.slice(a, b - a), px.slice(a, b - a).to_numpy(), py.slice(a, b - a).to_numpy(), [c.slice(a, b - a) for c in columns])
        if own:
            yield from made(tile, own)

    return dealt.mapInArrow(run, schema)


class _ReadBack:
    """The points of a tile through an encoder that takes pieces, and what ``read`` finds in the bytes."""

    def __init__(self, make, names: list[str], read):
        self.layer, self.read = make("p", names), read
        self.add = self.layer.add

    def rows(self):
        return self.read(self.layer.finish())


@query(_with("geo_boxes") + f"SELECT x, y, brand, count(*) AS members, min(fid) AS first_id FROM (SELECT fid, brand, {_tx('xmin', 4)} AS x, {_ty('ymin', 4)} AS y FROM geo_boxes) b GROUP BY x, y, brand")
def coalesce_polygon_groups(spark, sf_dir):
    """Boxes of a tile, merged by brand: members and id of each multipolygon."""
    rows = _boxes(spark, sf_dir).select(tm.tile_x("west", F.lit(4)).alias("x"), tm.tile_y("south", F.lit(4)).alias("y"), "fid", F.lit(0).alias("px"), F.lit(0).alias("py"), "brand", "wkb")

    def run(features):
        merged = coalesce([(fid, from_wkb(wkb), (brand,)) for fid, _, _, (brand, wkb) in features])
        return [(values[0], len(g[1]), fid) for fid, g, values in merged]

    return _by_tile(rows, run, "x long, y long, brand string, members long, first_id long")


# ---- encoder rules, read back from the encoders' bytes ---------------------------------------------------------------------

_VALUES = f"SELECT {_tx('lon', 3)} AS x, {_ty('lat', 3)} AS y, fid, status, priority FROM geo_points"


def _values(spark, sf_dir, *columns):
    return view(spark, sf_dir, "geo_points").select(tm.tile_x("lon", F.lit(3)).alias("x"), tm.tile_y("lat", F.lit(3)).alias("y"), "fid", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"), *columns)


@query(_with("geo_points") + f"SELECT x, y, priority, row_number() OVER (PARTITION BY x, y ORDER BY first_fid) - 1 AS value_index FROM (SELECT x, y, priority, min(fid) AS first_fid FROM ({_VALUES}) v GROUP BY x, y, priority) f")
def mvt_dictionary_keys_values(spark, sf_dir):
    index = lambda data: ((layer.values, range(len(layer.values))) for layer in mvt_layers(data))
    return _tile_pieces(_values(spark, sf_dir, "priority"), lambda: _ReadBack(MvtPoints, ["priority"], index), "x long, y long, priority string, value_index long")


_TYPED = "SELECT fid % 7 AS x, CAST(0 AS BIGINT) AS y, fid, CASE WHEN fid % 5 = 0 THEN NULL ELSE status END AS s, CASE WHEN fid % 7 = 3 THEN NULL WHEN fid % 7 = 4 AND fid % 2 = 0 THEN NULL ELSE price END AS d FROM geo_points"


@query(_with("geo_points") + f"SELECT x, y, CASE WHEN count(s) = count(*) THEN 28 ELSE 29 END::BIGINT AS s_type, CASE WHEN count(d) = 0 THEN 29 WHEN count(d) = count(*) THEN 26 ELSE 27 END::BIGINT AS d_type FROM ({_TYPED}) t GROUP BY x, y")
def mlt_column_types(spark, sf_dir):
    rows = spark.sql(_TYPED.replace("FROM geo_points", "FROM {points}"), points=view(spark, sf_dir, "geo_points"))
    rows = rows.select("x", "y", "fid", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"), "s", "d")
    types = lambda data: ([[c["type"]] for c in layer.columns] for layer in mlt_layers(data))
    return _tile_pieces(rows, lambda: _ReadBack(MltPoints, ["s", "d"], types), "x long, y long, s_type long, d_type long")


@query(
    _with("geo_points")
    + f""", v AS ({_VALUES}), e AS (SELECT x, y, priority, count(*) AS n FROM v GROUP BY x, y, priority), c AS (SELECT x, y, sum(length(priority) + 1 + n) + 12 < sum(n * (length(priority) + 1)) + 8 AND count(*) < sum(n) AS pays, count(*) AS k, sum(n)::BIGINT AS n FROM e GROUP BY x, y)
SELECT x, y, pays, CASE WHEN pays THEN k ELSE n END::BIGINT AS lengths, CASE WHEN pays THEN n ELSE 0 END::BIGINT AS offsets FROM c"""
)
def mlt_dictionary_decision(spark, sf_dir):
    """Whether texts are written by dictionary, and how many lengths and offsets there are. Lengths and indexes here need one byte each."""

    def decision(data):
        for layer in mlt_layers(data):
            streams = layer.columns[0]["streams"]
            pays = len(streams) == 3
            yield [pays], [streams[0][4]], [streams[2][4] if pays else 0]

    return _tile_pieces(_values(spark, sf_dir, "priority"), lambda: _ReadBack(MltPoints, ["priority"], decision), "x long, y long, pays boolean, lengths long, offsets long")


class _Runs:
    """Runs of the values of a column that comes by pieces."""

    def __init__(self):
        self.runs, self.last = 0, []

    def add(self, fid, px, py, columns):
        values = columns[0].to_pylist()
        self.runs += encode.run_count([*self.last, *values]) - len(self.last)
        self.last = values[-1:]

    def rows(self):
        yield ([self.runs],)


@query(_with("geo_points") + f"SELECT x, y, sum(CASE WHEN status IS DISTINCT FROM before THEN 1 ELSE 0 END)::BIGINT AS runs FROM (SELECT x, y, status, lag(status) OVER (PARTITION BY x, y ORDER BY fid) AS before FROM ({_VALUES}) v) l GROUP BY x, y")
def mlt_rle_runs(spark, sf_dir):
    return _tile_pieces(_values(spark, sf_dir, "status"), _Runs, "x long, y long, runs long")


@query(_with("geo_points") + f"SELECT x, y, fid, fid - coalesce(lag(fid) OVER (PARTITION BY x, y ORDER BY fid), 0) AS delta FROM ({_VALUES}) v")
def mlt_delta_ids(spark, sf_dir):
    def steps(data):
        for layer in mlt_layers(data):
            own = layer.id_steps()
            yield own.cumsum(), own

    return _tile_pieces(_values(spark, sf_dir), lambda: _ReadBack(MltPoints, [], steps), "x long, y long, fid long, delta long")


_ODD = "SELECT s_suppkey AS fid, s_name AS name, s_nationkey AS nation, CASE WHEN s_suppkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE s_acctbal END AS balance, CAST(s_acctbal AS DECIMAL(12, 1)) AS short, s_acctbal > 0 AS good FROM supplier"


@query(f"SELECT fid, name, CAST(nation AS BIGINT) AS nation, CASE WHEN isnan(balance) THEN NULL ELSE balance END AS balance, CAST(short AS DOUBLE) AS short, good FROM ({_ODD}) s")
def property_type_coercion(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    odd = spark.sql(_ODD.replace("FROM supplier", "FROM {base}"), base=base)
    rows, names = normalised(LayerSpec(odd.withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)}), name="s", lon="lon", lat="lat", id="fid"), TileConfig())
    return rows.select(*[F.col("props")[n].alias(n) for n in names])


_SQL = """SELECT n_name, {x} AS x, {y} AS y, count(*) AS n, sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
FROM geo_points JOIN orders ON o_orderkey = fid JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 1000 GROUP BY 1, 2, 3"""


@query(_with("geo_points") + _SQL.format(x=_tx("lon", 2), y=_ty("lat", 2)).replace(" END)", " END)::BIGINT"))
def sql_query_points(spark, sf_dir):
    """A join, a filter and an aggregate in SQL, with the tile math as SQL text."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    sql = _SQL.format(x=_tx("lon", 2), y=_ty("lat", 2))
    for t in (*tables, "geo_points"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, geo_points=view(spark, sf_dir, "geo_points"), **tables)


# ---- whole operators -------------------------------------------------------------------------------------------------------


_RADIUS = 40.0 * 360.0 / 256.0


def _greedy_sql(z: int, source: str) -> str:
    """CTEs of one clustered zoom: the first point left is a seed and takes all points left in reach."""
    reach = f"{_RADIUS!r} / power(2, {z}) * ({_RADIUS!r} / power(2, {z}))"
    part = lambda left, op: f"list_filter({left}, lambda p: (p.lon - {left}[1].lon) * (p.lon - {left}[1].lon) + (p.lat - {left}[1].lat) * (p.lat - {left}[1].lat) {op} {reach})"
    units = lambda c: f"sum(floor(m.{c} * 4294967296.0 + 0.5)::HUGEINT * coalesce(m.w, 1))::DOUBLE / sum(coalesce(m.w, 1))::DOUBLE / 4294967296.0"
    return f"""a{z} AS (SELECT list({{'fid': fid, 'lon': lon, 'lat': lat, 'w': w}} ORDER BY fid) AS rest FROM {source}),
r{z} AS (SELECT rest[1] AS seed, {part('rest', '<=')} AS members, {part('rest', '>')} AS rest FROM a{z}
  UNION ALL SELECT rest[1], {part('rest', '<=')}, {part('rest', '>')} FROM r{z} WHERE len(rest) > 0),
m{z} AS (SELECT seed, unnest(members) AS m FROM r{z}),
l{z} AS (SELECT seed.fid AS fid, CASE WHEN count(*) = 1 THEN any_value(seed.lon) ELSE {units('lon')} END AS lon, CASE WHEN count(*) = 1 THEN any_value(seed.lat) ELSE {units('lat')} END AS lat,
  CASE WHEN count(*) = 1 THEN any_value(seed.w) ELSE sum(coalesce(m.w, 1))::BIGINT END AS w FROM m{z} GROUP BY seed)"""


@query(
    "WITH RECURSIVE "
    + _with("geo_points_region")[5:-1]
    + f", start AS (SELECT fid, lon, lat, CAST(NULL AS BIGINT) AS w FROM geo_points_region), {_greedy_sql(7, 'start')}, {_greedy_sql(6, 'l7')}, {_greedy_sql(5, 'l6')} "
    + " UNION ALL ".join(f"SELECT CAST({z} AS BIGINT) AS z, fid, CAST(floor(lon * 1000000.0 + 0.37) AS BIGINT) AS lon, CAST(floor(lat * 1000000.0 + 0.37) AS BIGINT) AS lat, w AS point_count FROM l{z}" for z in (7, 6, 5))
)
def cluster_points(spark, sf_dir):
    """Three zooms of clusters, each made of the one above; places in millionths of a degree."""
    micro = lambda c: F.floor(F.col(c) * 1000000.0 + 0.37).cast("long").alias(c)
    return _z(clusters(view(spark, sf_dir, "geo_points_region"), 40.0, 7, 5)).select("z", "fid", micro("lon"), micro("lat"), "point_count")


def _lines(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "geo_line_vertices")
    lines = rows.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y"))).alias("v")).where("size(v) >= 2")

    @F.pandas_udf("binary")
    def wkb(v):
        return v.map(lambda ps: to_wkb((LINE, [[[(p["x"], p["y"]) for p in ps]]])))

    return lines.select("fid", wkb("v").alias("geometry"), (F.col("fid") % 3).alias("road"))


_AREAS = "[abs((v[i].x - v[i - 1].x) * (v[i + 1].y - v[i - 1].y) - (v[i + 1].x - v[i - 1].x) * (v[i].y - v[i - 1].y)) / 2 FOR i IN range(2, len(v))]"


@query(
    "WITH RECURSIVE "
    + _with("geo_line_vertices")[5:-1]
    + f""", s AS (SELECT fid, list({{'x': lon, 'y': lat}} ORDER BY seq) AS v FROM geo_line_vertices GROUP BY fid HAVING count(*) >= 2),
t AS (SELECT fid, v, {_AREAS} AS a FROM s),
r AS (SELECT fid, v, a FROM t
  UNION ALL SELECT fid, w, list_transform(range(2, len(w)), lambda i: abs((w[i].x - w[i - 1].x) * (w[i + 1].y - w[i - 1].y) - (w[i + 1].x - w[i - 1].x) * (w[i].y - w[i - 1].y)) / 2) FROM (
    SELECT fid, list_concat(v[1:list_position(a, list_min(a))], v[list_position(a, list_min(a)) + 2:]) AS w FROM r WHERE len(a) > 0 AND list_min(a) <= 0.5) q)
SELECT fid, len(v)::BIGINT AS vertices, CAST(list_sum(list_transform(v, lambda p: floor(p.x * 1000000.0 + 0.37))) AS BIGINT) AS trace FROM r WHERE len(a) = 0 OR list_min(a) > 0.5"""
)
def vw_simplify_lines(spark, sf_dir):
    """How many vertices stay of each line, and the sum of their longitudes in millionths of a degree."""

    @F.pandas_udf("vertices long, trace long")
    def left(v):
        import pandas as pd

        kept = [visvalingam(from_wkb(b)[1][0][0], 0.5) for b in v]
        return pd.DataFrame({"vertices": [len(k) for k in kept], "trace": [sum(floor(x * 1000000.0 + 0.37) for x, _ in k) for k in kept]})

    return _lines(spark, sf_dir).withColumn("s", left("geometry")).select("fid", "s.vertices", "s.trace")


@query(_with("geo_line_vertices") + "SELECT fid % 7 AS x, CAST(0 AS BIGINT) AS y, count(*) AS vertices, CAST(floor(sum(lon) * 1000000.0 + 0.37) AS BIGINT) AS trace FROM geo_line_vertices GROUP BY fid HAVING count(*) >= 2")
def coalesce_lines(spark, sf_dir):
    """Each step of a path as a line of its own, some turned round, in no order: merging makes the paths again."""
    import pyarrow as pa

    step = W.partitionBy("fid").orderBy("seq")
    rows = view(spark, sf_dir, "geo_line_vertices").withColumns({"lon2": F.lead("lon").over(step), "lat2": F.lead("lat").over(step)}).where("lon2 is not null")
    mixed = rows.select((F.col("fid") % 7).alias("x"), F.lit(0).cast("long").alias("y"), F.xxhash64("fid", "seq").alias("fid"), "lon", "lat", "lon2", "lat2")
    grouped = with_group(saved(mixed), ["x", "y", "lon", "lat"], ["x", "y", "lon2", "lat2"])
    dealt = grouped.select("group", "x", "y", "fid", "lon", "lat", "lon2", "lat2").repartition("group").sortWithinPartitions("group", "fid")

    def run(batches):
        for batch in whole_tiles(batches):
            _, xs, ys, _, *ends = (c.to_pylist() for c in batch.columns)
            lines = [(k, (LINE, [[[(a, b), (c, d)] if k % 2 else [(c, d), (a, b)]]]), (x, y, "road")) for k, (x, y, a, b, c, d) in enumerate(zip(xs, ys, *ends))]
            found = [(*values[:2], len(m[0]), floor(sum(x for x, _ in sorted(m[0])) * 1000000.0 + 0.37)) for _, g, values in coalesce(lines) for m in g[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], ["x", "y", "vertices", "trace"])

    return dealt.mapInArrow(run, "x long, y long, vertices long, trace long")


# ---- archives and tiles, decoded -------------------------------------------------------------------------------------------


def _tiles(spark, specs, **settings) -> DataFrame:
    return pyramid(specs, TileConfig(**settings))[0]


def _point_layer(spark, sf_dir, low, high) -> LayerSpec:
    return LayerSpec(view(spark, sf_dir, "geo_points"), name="points", lon="lon", lat="lat", id="fid", min_zoom=low, max_zoom=high)


def point_tiles_of(spark, sf_dir, tile_format: str = "mvt") -> DataFrame:
    """Thinned points of zooms 0 to 4 as tiles ``(z, x, y, tile_id, data)``."""
    return _tiles(spark, [_point_layer(spark, sf_dir, 0, 4)], max_zoom=4, drop_rate=2.5, tile_format=tile_format)


def decoded_points(tiles: DataFrame, tile_format: str = "mvt", more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each feature of tiles of the layer ``points``, with ``more`` whole-number columns of the tiles. Tiles are read by pieces."""
    import gzip

    import pyarrow as pa

    points = mvt_points if tile_format == "mvt" else mlt_points
    wanted = {"status": pa.string(), "priority": pa.string(), "price": pa.float64()}
    names = ["z", "x", "y", *more, "fid", "px", "py", *wanted]

    def run(batches):
        for batch in batches:
            place = batch.column
            for i in range(batch.num_rows):
                data = place(batch.num_columns - 1)[i].as_py()
                at = [place(k)[i].as_py() for k in range(batch.num_columns - 1)]
                for piece in points(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, wanted):
                    n = len(piece["id"])
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(v, pa.int64()), n) for v in at), piece["id"], pa.array(piece["x"]), pa.array(piece["y"]), *(piece[k] for k in wanted)], names)

    return tiles.select("z", "x", "y", *more, "data").mapInArrow(run, "".join(f"{c} long, " for c in names[:-3]) + "status string, priority string, price double")


_THINNED = (
    _with("geo_points")
    + f""", ranked AS ({_RANKED}), quota AS (SELECT z, n, CAST(ceil(n / power(2.5, 4 - z)) AS BIGINT) AS k FROM (SELECT DISTINCT n FROM ranked) c, {_ZOOMS.format(a=0, b=3)}),
spots AS (SELECT z, CAST(least(floor(j * (CAST(n AS DOUBLE) / k)), n - 1) AS BIGINT) AS r FROM (SELECT z, n, k, unnest(range(0, k)) AS j FROM quota) q),
kept AS (SELECT s.z, fid FROM ranked JOIN spots s ON s.r = ranked.r UNION ALL SELECT 4, fid FROM geo_points),
shown AS (SELECT kept.z, geo_points.* FROM kept JOIN geo_points USING (fid)),
spread AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, {_RANGES} FROM shown) r) s),
tiled AS (SELECT * FROM spread WHERE lon BETWEEN {_west('x', 'z')} - 18.0 / {_n('z')} AND {_west('x + 1', 'z')} + 18.0 / {_n('z')}
  AND lat BETWEEN {_north('y + 1', 'z')} - 0.05 * ({_north('y', 'z')} - {_north('y + 1', 'z')}) AND {_north('y', 'z')} + 0.05 * ({_north('y', 'z')} - {_north('y + 1', 'z')})) """
)
_DECODED = _THINNED + f"SELECT z, x, y, fid, {_px('lon', 'z', 'x')} AS px, {_py('lat', 'z', 'y')} AS py, status, priority, price FROM tiled"


@query(_DECODED)
def encode_mvt(spark, sf_dir):
    """Every feature that the tiles hold, read back from their bytes."""
    return decoded_points(point_tiles_of(spark, sf_dir))


@query(_DECODED)
def encode_mlt(spark, sf_dir):
    return decoded_points(point_tiles_of(spark, sf_dir, "mlt"), "mlt")


_BOX_DROP = f"NOT (z < 6 AND (xmax - xmin) * (ymax - ymin) < power(360.0 / ({_n('z')} * 4096.0), 2) * power(2.5, 6 - z))"
_BOX_ALL = _BOX_TILES.replace(_ZOOMS.format(a=6, b=8), _ZOOMS.format(a=2, b=6)).replace("SELECT fid, xmin", "SELECT fid, brand, size, xmin")


def _box_x(lon: str) -> str:
    return f"CAST(round(({lon} - {_west('x', 'z')}) / ({_west('x + 1', 'z')} - {_west('x', 'z')}) * 4096.0) AS BIGINT)"


def _box_y(lat: str) -> str:
    top, bottom = _merc(_north("y", "z")), _merc(_north("y + 1", "z"))
    return f"CAST(round(({top} - {_merc(lat)}) / ({top} - {bottom}) * 4096.0) AS BIGINT)"


@query(
    _with("geo_boxes")
    + f"""SELECT * FROM (SELECT z, x, y, fid, brand, size, {_box_x(f"greatest(xmin, {_west('x', 'z')} - 18.0 / {_n('z')})")} AS x0, {_box_x(f"least(xmax, {_west('x + 1', 'z')} + 18.0 / {_n('z')})")} AS x1,
  {_box_y(f"least(ymax, {_north('y', 'z')} + {_H})")} AS y0, {_box_y(f"greatest(ymin, {_north('y + 1', 'z')} - {_H})")} AS y1 FROM ({_BOX_ALL}) t
WHERE {_BOX_DROP} AND xmin < {_west('x + 1', 'z')} + 18.0 / {_n('z')} AND xmax > {_west('x', 'z')} - 18.0 / {_n('z')} AND ymin < {_north('y', 'z')} + {_H} AND ymax > {_north('y + 1', 'z')} - {_H}) u WHERE x0 < x1 AND y0 < y1"""
)
def encode_boxes(spark, sf_dir):
    """Every rectangle that the tiles hold, by its corners."""
    import gzip

    import pyarrow as pa

    boxes = LayerSpec(_boxes(spark, sf_dir).select("fid", F.col("wkb").alias("geometry"), "brand", "size"), name="boxes", id="fid", min_zoom=2, max_zoom=6)
    tiles = _tiles(spark, [boxes], min_zoom=2, max_zoom=6, drop_rate=2.5)

    def run(batches):
        for batch in batches:
            found = (row for i in range(batch.num_rows) for row in corners(*(c[i].as_py() for c in batch.columns)))
            while rows := list(islice(found, 5000)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(10)], ["z", "x", "y", "fid", "brand", "size", "x0", "x1", "y0", "y1"])

    def corners(z, x, y, data):
        for layer in mvt_layers(gzip.decompress(data)):
            for f in layer.features():
                xs, ys = zip(*f["parts"][0])
                yield z, x, y, f["id"], f["properties"]["brand"], f["properties"]["size"], min(xs), max(xs), min(ys), max(ys)

    return tiles.select("z", "x", "y", "data").mapInArrow(run, "z long, x long, y long, fid long, brand string, size long, x0 long, x1 long, y0 long, y1 long")


@query(
    _THINNED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, t AS (SELECT z, x, y, count(*) AS n_features, sum(fid)::BIGINT AS ids FROM tiled GROUP BY z, x, y),
h AS (SELECT z, x AS tx, y AS ty, n_features, ids, x, y, CAST(power(2, z) AS BIGINT) // 2 AS s, CAST(0 AS BIGINT) AS d FROM t
  UNION ALL SELECT z, tx, ty, n_features, ids,
    CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN s - 1 - y ELSE y END, CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN s - 1 - x ELSE x END, s // 2,
    d + s * s * (CASE WHEN (x & s) > 0 AND (y & s) > 0 THEN 2 WHEN (x & s) > 0 THEN 3 WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
SELECT z, tx AS x, ty AS y, d + (CAST(power(4, z) AS BIGINT) - 1) // 3 AS tile_id, n_features, ids FROM h WHERE s = 0"""
)
def pmtiles_roundtrip(spark, sf_dir):
    """Tiles written to an archive in the shared folder and read back: their ids, and their features by number and sum of ids."""
    import uuid

    from tilewright.api import read_tiles, tile
    from tilewright.plans.store import shared_dir

    base = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    path = f"{base}/{uuid.uuid4().hex}.pmtiles"
    tile(_point_layer(spark, sf_dir, 0, 4), path, max_zoom=4, drop_rate=2.5, quiet=True)
    tiles = read_tiles(spark, path)
    return decoded_points(tiles, more=("tile_id",)).groupBy("z", "x", "y", "tile_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("fid").alias("ids"))


# ---- coordinates and the SQL door ------------------------------------------------------------------------------------------

_E2 = "(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))"


def _aq(phi: str) -> str:
    s = f"sin({phi})"
    return f"((1 - {_E2}) * ({s} / (1 - {_E2} * {s} * {s}) - ln((1 - sqrt({_E2}) * {s}) / (1 + sqrt({_E2}) * {s})) / (2 * sqrt({_E2}))))"


def _am(phi: str) -> str:
    return f"(cos({phi}) / sqrt(1 - {_E2} * sin({phi}) * sin({phi})))"


_P1, _P2, _P0 = "radians(CAST(29.5 AS DOUBLE))", "radians(CAST(45.5 AS DOUBLE))", "radians(CAST(23 AS DOUBLE))"
_ALBERS = f"""SELECT fid, lon, lat, rho * sin(n * radians(lon + 96)) AS x, rho0 - rho * cos(n * radians(lon + 96)) AS y FROM (
  SELECT fid, lon, lat, n, 6378137.0 * sqrt(c - n * {_aq('radians(lat)')}) / n AS rho, 6378137.0 * sqrt(c - n * {_aq(_P0)}) / n AS rho0 FROM (
    SELECT fid, lon, lat, n, {_am(_P1)} * {_am(_P1)} + n * {_aq(_P1)} AS c FROM (
      SELECT fid, lon, lat, ({_am(_P1)} * {_am(_P1)} - {_am(_P2)} * {_am(_P2)}) / ({_aq(_P2)} - {_aq(_P1)}) AS n FROM geo_points_region) a) b) r"""


@query(_with("geo_points_region") + f"SELECT fid, CAST(floor(x * 10 + 0.37) AS BIGINT) AS x, CAST(floor(y * 10 + 0.37) AS BIGINT) AS y, true AS lon_close, true AS lat_close FROM ({_ALBERS}) p")
def project_albers(spark, sf_dir):
    """EPSG:5070 forward in decimetres, stated in SQL, and whether the way back from SQL's metres ends within 1e-7 degrees."""
    albers = projections.known("EPSG:5070")
    rows = spark.sql(_ALBERS.replace("FROM geo_points_region", "FROM {points}"), points=view(spark, sf_dir, "geo_points_region"))
    x, y = projections.from_degrees(F.col("lon"), F.col("lat"), albers, F)
    lon, lat = projections.to_degrees(F.col("x"), F.col("y"), albers, F)
    whole = lambda c: F.floor(c * 10 + 0.37).cast("long")
    return rows.select("fid", whole(x).alias("x"), whole(y).alias("y"), (F.abs(lon - F.col("lon")) < 1e-7).alias("lon_close"), (F.abs(lat - F.col("lat")) < 1e-7).alias("lat_close"))


@query("SELECT 1::BIGINT AS n_types, count(*) AS n, 'POINT' AS kind, count(*) AS near, 4326::BIGINT AS srid FROM supplier WHERE s_nationkey > 3")
def sql_door(spark, sf_dir):
    """Setup statements, a file function, EXCLUDE, a created table and spatial functions of points and WKB in one text."""
    from tilewright.sources.sqltext import register_spatial, run_setup

    register_spatial(spark)
    last = run_setup(spark, f"""INSTALL spatial; LOAD spatial;
        CREATE OR REPLACE TEMP TABLE tw_suppliers AS SELECT * EXCLUDE (s_acctbal) FROM read_parquet('{sf_dir}/supplier.parquet') WHERE s_nationkey > 3;
        WITH p AS (SELECT *, st_point(s_suppkey % 90, s_nationkey) AS g FROM tw_suppliers),
        q AS (SELECT *, st_setsrid(st_transform(st_aswkb(g), 'EPSG:4326', 'EPSG:3857'), 3857) AS m FROM p)
        SELECT count(DISTINCT st_geometrytype(g)) AS n_types, count(*) AS n, max(st_geometrytype(m)) AS kind,
          count_if(abs(st_x(st_transform(m, 'EPSG:3857', 'EPSG:4326')) - st_x(g)) < 1e-9 AND st_y(g) = s_nationkey // 1) AS near,
          CASE max(st_srid(m)) WHEN 'EPSG:3857' THEN 4326 END AS srid FROM q""")  # fmt: skip
    return spark.sql(last).withColumns({"srid": F.col("srid").cast("long")})
