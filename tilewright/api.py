"""Entry points: a table, a file or a query as a PMTiles archive."""

from __future__ import annotations

import json
import logging
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.model import LayerSpec, TileConfig, with_defaults
from tilewright.plans.store import forget, saved, shared_dir
from tilewright.plans.tiles import pyramid
from tilewright.sources.files import read_features
from tilewright.sources.pmtiles import PMTiles, pmtiles_metadata
from tilewright.sources.sqltext import register_spatial, run_setup

__all__ = ["LayerSpec", "layer", "pmtiles_metadata", "tile", "tile_file", "tile_query"]

log = logging.getLogger("tilewright")
STREAMING = ("auto", "always", "never")


def layer(df: DataFrame, min_zoom: int | None = None, max_zoom: int | None = None, **columns) -> LayerSpec:
    """A table with zooms of its own. ``columns``: ``geometry``, ``lon``, ``lat``, ``id``, ``crs``."""
    if not isinstance(df, DataFrame):
        raise TypeError("a layer is made of a DataFrame")
    return LayerSpec(df, min_zoom=min_zoom, max_zoom=max_zoom, **columns)


def tile(layers, output, *, layer_name: str | None = None, overwrite: bool = True, quiet: bool = False, points_only: bool = False, progress=None, **settings) -> str:
    """Write an archive and return its path. ``layers``: a DataFrame, a ``LayerSpec`` or a dict of names to either. ``settings``: see ``TileConfig``.
    ``points_only`` refuses other geometries; ``progress`` is called with a line of text at each step."""
    config = TileConfig(**settings)
    say = progress or (lambda text: None)
    output = str(output).removeprefix("file:")
    if os.path.exists(output) and not overwrite:
        raise FileExistsError(f"{output} exists; pass overwrite=True to replace it")
    specs = with_defaults(layers, config, layer_name, Path(output).stem)
    say(f"reading {len(specs)} layer{'s' * (len(specs) > 1)}")
    tiles, info = pyramid(specs, config, points_only)
    spark, tables = specs[0].df.sparkSession, info.pop("tables")
    spark.dataSource.register(PMTiles)
    # ranges are found by sampling ids: over a written table that reads one column, and no tile is encoded twice
    say(f"encoding zooms {info['min_zoom']} to {info['max_zoom']}")
    spool = saved(tiles.select("tile_id", "data"))
    say("writing the archive")
    rows = spool.repartitionByRange("tile_id").sortWithinPartitions("tile_id")
    try:
        rows.write.format("pmtiles").option("info", json.dumps(info)).option("replace", "true" if overwrite else "false").mode("append").save(output)
    except Exception as failed:
        if "No tiles generated" in str(failed):
            raise ValueError("No tiles generated") from failed
        raise
    finally:
        forget(spool, *tables)
    done = f"{output}: {pmtiles_metadata(output)['num_tiles']} tiles, {os.path.getsize(output)} bytes"
    say(done)
    if not quiet:
        log.info(done)
    return output


def tile_file(spark: SparkSession, path, output, *, engine: str = "auto", source_crs: str | None = None, layer_name: str | None = None, **settings) -> str:
    """A spatial file as an archive. ``engine``: ``auto`` (by suffix), ``geoparquet``, ``geojson``, ``gpkg`` or ``shapefile``."""
    df, geometry, crs = read_features(spark, str(path), engine, source_crs)
    return tile(LayerSpec(df, geometry=geometry, crs=crs), output, layer_name=layer_name or Path(str(output)).stem, **settings)


def tile_query(spark: SparkSession, query: str, output, *, db_path: str | None = None, source_crs: str | None = None, streaming: str = "auto", geometry: str | None = None, id: str | None = None, **settings) -> str:
    """The result of SQL as an archive: statements before the last are run for their effect. ``db_path``: a folder of Parquet tables or a DuckDB
    file, see ``attach``. ``streaming="always"`` takes the exact point mode and refuses other geometries and clustering;
    ``auto`` and ``never`` take whatever comes: the plan never holds a table in memory."""
    if streaming not in STREAMING:
        raise ValueError(f"streaming must be one of {STREAMING}, not {streaming!r}")
    if streaming == "always" and settings.get("cluster_distance"):
        raise ValueError("clustering is not supported with streaming='always'")
    register_spatial(spark)
    if db_path:
        attach(spark, str(db_path))
    df = spark.sql(run_setup(spark, query))
    kinds = dict(df.dtypes)
    found = geometry or next((c for c in df.columns if kinds[c] in ("binary", "struct<x:double,y:double>")), None)
    if found is None:
        raise ValueError("the query has no geometry column (WKB, or st_point)")
    if streaming == "always":
        settings.setdefault("point_mode", "exact")
        settings["points_only"] = True
    return tile(LayerSpec(df, geometry=found, id=id, crs=source_crs or "EPSG:4326"), output, **settings)


def attach(spark: SparkSession, path: str) -> list[str]:
    """Register the tables of a folder of Parquet files, or of a DuckDB file, under their names. A DuckDB file is no format that tasks can read: its tables are
    copied once, in batches, into the shared folder; columns of types that Arrow lacks are refused by DuckDB. Needs the ``duckdb`` package."""
    if os.path.isdir(path):
        names = sorted(e for e in os.listdir(path) if e.endswith(".parquet"))
        for entry in names:
            spark.read.parquet(f"{path}/{entry}").createOrReplaceTempView(Path(entry).stem)
        return [Path(e).stem for e in names]
    import duckdb
    import pyarrow.parquet as pq

    folder = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/attached-{uuid.uuid4().hex}"
    os.makedirs(folder)
    with duckdb.connect(path, read_only=True) as db:
        names = [r[0] for r in db.sql("SHOW TABLES").fetchall()]
        for k, name in enumerate(names):
            quoted = name.replace('"', '""')
            relation = db.sql(f'SELECT * FROM "{quoted}"')
            reader = (getattr(relation, "to_arrow_reader", None) or relation.fetch_arrow_reader)(100_000)
            with pq.ParquetWriter(f"{folder}/{k}.parquet", reader.schema) as out:
                for batch in reader:
                    out.write_batch(batch)
            spark.read.parquet(f"{folder}/{k}.parquet").createOrReplaceTempView(name)
    return names


def read_tiles(spark: SparkSession, path) -> DataFrame:
    """Tiles of an archive, ``(z, x, y, tile_id, data)``, decompressed."""
    spark.dataSource.register(PMTiles)
    return spark.read.format("pmtiles").load(str(path))


def tile_count(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes of each zoom."""
    return tiles.groupBy("z").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(F.octet_length("data")).alias("n_bytes"))
