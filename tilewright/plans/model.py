"""Layers and settings of a tile pyramid."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import crs as projections
from tilewright.plans.store import saved

FORMATS = ("mvt", "mlt")


@dataclass(frozen=True)
class LayerSpec:
    """A table as a layer. The geometry is either in ``lon``, ``lat`` columns, or in ``geometry``: WKB, or a struct of x and y. Unset zooms are those of the call."""

    df: DataFrame
    name: str | None = None
    min_zoom: int | None = None
    max_zoom: int | None = None
    geometry: str = "geometry"
    lon: str | None = None
    lat: str | None = None
    id: str | None = None
    crs: str | None = "EPSG:4326"


@dataclass(frozen=True)
class TileConfig:
    tile_format: str = "mvt"
    min_zoom: int = 0
    max_zoom: int = 14
    base_zoom: int | None = None
    drop_rate: float | None = None
    cluster_distance: float | None = None
    cluster_maxzoom: int | None = None
    coalesce: bool = False
    simplification: bool = True
    generate_ids: bool = True
    point_mode: str = "buffered"

    def __post_init__(self):
        if self.tile_format not in FORMATS:
            raise ValueError(f"tile_format must be one of {FORMATS}, not {self.tile_format!r}")
        if self.point_mode not in ("buffered", "exact"):
            raise ValueError("point_mode must be 'buffered' or 'exact'")
        if not 0 <= self.min_zoom <= self.max_zoom <= 24:
            raise ValueError("zooms must be within 0 and 24, the least first")

    @property
    def thins(self) -> bool:
        return self.drop_rate is not None and self.drop_rate > 0

    @property
    def clusters_to(self) -> int | None:
        """The highest zoom with clusters, if any."""
        if self.cluster_distance is None or self.cluster_distance <= 0:
            return None
        return self.max_zoom - 1 if self.cluster_maxzoom is None or self.cluster_maxzoom < 0 else self.cluster_maxzoom

    def base_for(self, layer: LayerSpec) -> int:
        return self.base_zoom if self.base_zoom is not None and self.base_zoom >= 0 else layer.max_zoom


def property_column(field: T.StructField) -> Column:
    """A property as text, long, double or boolean: integers become long, decimals and floats double (NaN null), dates and the like text, nested values JSON."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BooleanType, T.LongType)):
        return c
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def marked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with partition and place of each row packed into ``name``. Only fit to be written at once: another run of the plan may deal rows otherwise."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(table: DataFrame, mark: str, name: str, before: int = 0) -> DataFrame:
    """A written table of ``marked`` rows with ``name``: numbers from ``before`` + 1 in the order of the marks. Counts and rows come from the same
    table, so none is lost or repeated whatever the plan behind it does. The broadcast has a row a partition; rows are not shuffled."""
    part, place = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = table.groupBy(part.alias("__p")).agg((F.max(place) + 1).alias("n"))
    starts = saved(sizes.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n") + before).alias("__s")))
    found = table.withColumn("__p", part).join(F.broadcast(starts), "__p", "left")
    return found.withColumn(name, F.col("__s") + place + 1).drop("__p", "__s")


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, with consecutive numbers from 1 in scan order."""
    return numbered(saved(marked(df, "__m")), "__m", name).drop("__m")


def normalised(spec: LayerSpec, config: TileConfig) -> tuple[DataFrame, list[str]]:
    """``(ord, fid, lon, lat, wkb, props)`` of a layer, and its property names. ``ord`` is a mark to be written at once (see ``marked``), ``fid`` null
    without an id column; ``lon`` and ``lat`` are null where ``wkb`` is set, and the other way round; rows without geometry are gone."""
    df = spec.df
    names = {c.lower(): c for c in df.columns}
    if spec.lon or spec.lat:
        lon, lat = names.get((spec.lon or "").lower()), names.get((spec.lat or "").lower())
        if lon is None or lat is None:
            raise ValueError(f"layer {spec.name!r} has no columns {spec.lon!r}, {spec.lat!r}")
        hidden = {lon, lat}
        x, y, wkb = F.col(lon).cast("double"), F.col(lat).cast("double"), F.lit(None).cast("binary")
    else:
        geometry = names.get(spec.geometry.lower())
        if geometry is None:
            raise ValueError(f"layer {spec.name!r} has no geometry column {spec.geometry!r}")
        hidden, kind = {geometry}, df.schema[geometry].dataType
        if isinstance(kind, T.StructType) and {"x", "y"} <= set(kind.names):
            x, y, wkb = F.col(geometry)["x"].cast("double"), F.col(geometry)["y"].cast("double"), F.lit(None).cast("binary")
        elif isinstance(kind, T.BinaryType):
            x, y, wkb = F.lit(None).cast("double"), F.lit(None).cast("double"), F.col(geometry)
        else:
            raise ValueError(f"geometry column {geometry!r} must be WKB or a struct of x and y, not {kind.simpleString()}")
    crs = projections.known(spec.crs)
    if not isinstance(crs, projections.Degrees):
        x, y = projections.to_degrees(x, y, crs, F)
    fields = [f for f in df.schema.fields if f.name not in hidden]
    if spec.id and spec.id not in df.columns:
        raise ValueError(f"layer {spec.name!r} has no id column {spec.id!r}")
    there = (x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)) | wkb.isNotNull()
    fid = F.col(f"`{spec.id}`").cast("long") if spec.id else F.lit(None).cast("long")
    props = F.struct(*[property_column(f).alias(f.name) for f in fields]) if fields else F.struct(F.lit(None).cast("string").alias("__none"))
    rows = marked(df.select(fid.alias("fid"), x.alias("lon"), y.alias("lat"), wkb.alias("wkb"), props.alias("props"), there.alias("__there")), "ord")
    return rows.where("__there").select("ord", "fid", "lon", "lat", "wkb", "props"), [f.name for f in fields]


def with_defaults(layers, config: TileConfig, layer_name: str | None, stem: str) -> list[LayerSpec]:
    """A DataFrame, a LayerSpec or a dict of them as a list with names and zooms."""
    if isinstance(layers, DataFrame):
        layers = LayerSpec(layers)
    if isinstance(layers, LayerSpec):
        out = [replace(layers, name=layers.name or layer_name or stem)]
    elif isinstance(layers, dict):
        if not layers or not all(isinstance(k, str) and k for k in layers):
            raise ValueError("layers must be named")
        out = []
        for name, one in layers.items():
            if isinstance(one, DataFrame):
                one = LayerSpec(one)
            if not isinstance(one, LayerSpec):
                raise TypeError(f"layer {name!r} is neither a DataFrame nor a LayerSpec")
            out.append(replace(one, name=name))
    elif isinstance(layers, (list, tuple)):
        raise ValueError("layers must be named: pass a dict")
    else:
        raise TypeError("expected a DataFrame, a LayerSpec or a dict of them")
    fill = lambda v, d: d if v is None else v
    return [replace(s, min_zoom=fill(s.min_zoom, config.min_zoom), max_zoom=fill(s.max_zoom, config.max_zoom)) for s in out]
