"""Spatial files as tables: GeoParquet, GeoJSON (a collection, or one feature a line), GeoPackage and Shapefile."""

from __future__ import annotations

import io
import json
import warnings

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geometry import from_geojson, from_wkt, to_wkb
from tilewright.sources.legacy import GeoPackage, Shapefile, gpkg_layer, shapefile_crs

PARQUET, GEOJSON, LINES = (".parquet", ".geoparquet"), (".geojson", ".json"), (".geojsonl", ".ndjson", ".geojsonseq")
PACKAGES, SHAPES = (".gpkg",), (".shp",)
TABLES = (".csv", ".tsv")
ENGINES = ("auto", "duckdb", "geoparquet", "geojson", "gpkg", "shapefile", "csv")


class _HadoopFile(io.RawIOBase):
    """A file that only Spark can open, for readers that seek."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [s for s in self.fs.globStatus(at)]
        if not found:
            raise FileNotFoundError(path)
        if found[0].isDirectory():
            found = [s for s in self.fs.listStatus(found[0].getPath()) if s.getPath().getName().endswith(".parquet")]
        self.size, self.stream, self.jvm = found[0].getLen(), self.fs.open(found[0].getPath()), jvm
        self.place = 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.place

    def seek(self, offset, whence=0):
        self.place = offset + (0, self.place, self.size)[whence]
        return self.place

    def read(self, n=-1):
        n = self.size - self.place if n < 0 else min(n, self.size - self.place)
        self.stream.seek(self.place)
        data = bytes(self.stream.readNBytes(n))
        self.place += len(data)
        return data


def geoparquet_geometry(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """Geometry column and CRS of a GeoParquet file, from its footer: ``geo.primary_column``, else ``geometry``."""
    meta = pq.read_metadata(_HadoopFile(spark, path)).metadata or {}
    geo = json.loads(meta.get(b"geo", b"{}"))
    column = geo.get("primary_column", "geometry")
    if not geo:
        warnings.warn(f"{path} says nothing about its coordinates; longitude and latitude are assumed", stacklevel=3)
    return column, crs_name(geo.get("columns", {}).get(column, {}).get("crs"))


def crs_name(crs: dict | None) -> str:
    """``EPSG:n`` of PROJJSON. Without a CRS, OGC:CRS84 and names of WGS 84 are EPSG:4326."""
    if not crs:
        return "EPSG:4326"
    own = crs.get("id") or {}
    code = str(own.get("code", ""))
    if (own.get("authority"), code) in (("EPSG", "4326"), ("OGC", "84"), ("OGC", "CRS84")):
        return "EPSG:4326"
    if own.get("authority") == "EPSG":
        return f"EPSG:{code}"
    name = crs.get("name", "")
    if any(w in name for w in ("WGS 84", "WGS84", "CRS84")) and "/" not in name:
        return "EPSG:4326"
    raise ValueError(f"unknown coordinate reference system {name or crs}")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``geometry`` as WKB and a column for each property. Property types are merged over all features."""
    feature = "geometry STRING, properties STRING"
    if lines:
        rows = spark.read.schema(feature).json(path)
    else:
        # nested objects read as text stay raw JSON
        whole = spark.read.option("multiLine", True).schema(f"features ARRAY<STRUCT<{feature.replace(' ', ': ')}>>".replace(",:", ",")).json(path)
        rows = whole.select(F.explode("features").alias("f")).select("f.*")

    @F.pandas_udf("binary")
    def wkb(geometry: pd.Series) -> pd.Series:
        return geometry.map(lambda t: to_wkb(g) if t and (g := from_geojson(json.loads(t))) else None)

    rows = rows.select(wkb("geometry").alias("geometry"), F.coalesce("properties", F.lit("{}")).alias("p"))
    merged = rows.agg(F.schema_of_variant_agg(F.parse_json("p"))).first()[0] if hasattr(F, "schema_of_variant_agg") else None
    schema = (merged or "OBJECT<>").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    if schema == "STRUCT<>":
        return rows.select("geometry")
    return rows.select("geometry", F.from_json("p", schema).alias("p")).select("geometry", "p.*")


# Names of coordinate columns, pair by pair, in lower case.
COORDINATES = (("lon", "lat"), ("longitude", "latitude"), ("lng", "lat"), ("x", "y"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header: ``geometry`` from a column ``wkt`` or ``geometry`` of well-known text, or from a pair of ``COORDINATES``."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.lower().endswith(".tsv") else ",")
    names = {c.lower(): c for c in df.columns}
    text = names.get("wkt") or names.get("geometry")
    if text:

        @F.pandas_udf("binary")
        def wkb(column: pd.Series) -> pd.Series:
            return column.map(lambda t: to_wkb(g) if (g := from_wkt(t)) else None)

        found = wkb(F.col(f"`{text}`"))
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != text], found.alias("geometry"))
    pair = next(((names[a], names[b]) for a, b in COORDINATES if a in names and b in names), None)
    if pair is None:
        raise ValueError(f"{path} has no column wkt or geometry, and no pair of {COORDINATES}")
    point = F.struct(F.col(f"`{pair[0]}`").cast("double").alias("x"), F.col(f"`{pair[1]}`").cast("double").alias("y"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in pair], point.alias("geometry"))


def read_features(spark: SparkSession, path: str, engine: str = "auto", source_crs: str | None = None) -> tuple[DataFrame, str, str]:
    """Table, geometry column and CRS of a file. ``auto`` (also known as ``duckdb``, of which nothing is used here) goes by suffix."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}, not {engine!r}")
    low = path.lower().rstrip("/")
    if engine in ("auto", "duckdb"):
        known = (("csv", TABLES), ("geoparquet", PARQUET), ("geojson", GEOJSON + LINES), ("gpkg", PACKAGES), ("shapefile", SHAPES))
        engine = next((name for name, suffixes in known if low.endswith(suffixes)), None)
        if engine is None:
            raise ValueError(f"no reader for {path}; known: {', '.join(PARQUET + GEOJSON + LINES + PACKAGES + SHAPES + TABLES)}")
    if engine == "geoparquet":
        column, crs = geoparquet_geometry(spark, path)
        return spark.read.parquet(path), column, source_crs or crs
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raise FileNotFoundError(path)
    if engine == "gpkg":
        spark.dataSource.register(GeoPackage)
        _, column, code, _ = gpkg_layer(path, None)
        return spark.read.format("gpkg").load(path), column, source_crs or f"EPSG:{code}"
    if engine == "shapefile":
        spark.dataSource.register(Shapefile)
        return spark.read.format("shapefile").load(path), "geometry", source_crs or shapefile_crs(path)
    if engine == "csv":
        return read_csv(spark, path), "geometry", source_crs or "EPSG:4326"
    return read_geojson(spark, path, low.endswith(LINES)), "geometry", source_crs or "EPSG:4326"
