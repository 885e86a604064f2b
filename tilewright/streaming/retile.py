"""Tiles that follow a stream of points: each micro-batch is added to a feature table, and only the tiles it touches are made anew.

Feature and tile tables are folders by micro-batch, each written whole (overwriting what a failed attempt left), so a batch that is run again has the same result. The
newest tile of each place counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.functions import tilemath as tm
from tilewright.plans.model import LayerSpec, TileConfig
from tilewright.plans.store import forget
from tilewright.plans.tiles import Layer, encoded, point_tiles, union_of


def _zoomed(points: DataFrame, config: TileConfig) -> DataFrame:
    return points.withColumn("z", F.explode(F.sequence(F.lit(config.min_zoom), F.lit(config.max_zoom))))


#: Zoom of the cells by which features are stored. Tiles from this zoom on need only the cells that a batch touches, and their neighbours.
CELL = 6


def retile_batch(batch: DataFrame, epoch: int, store: str, config: TileConfig, name: str = "points") -> None:
    """``batch(fid, lon, lat, …properties)``. Features are stored by cell (a folder each, 4,096 at most), so that tiles of high zooms are made of the touched
    cells alone; tiles of zooms below ``CELL`` are made of all features. Thinning and clustering need all points at once and are refused."""
    if config.thins or config.clusters_to is not None:
        raise ValueError("thinning and clustering do not follow a stream")
    spark, across = batch.sparkSession, 1 << CELL
    cell = tm.tile_x("lon", F.lit(CELL)) * across + tm.tile_y(tm.clamped(F.col("lat"), -tm.LAT_EXACT, tm.LAT_EXACT), F.lit(CELL))
    batch.withColumn("__cell", F.coalesce(cell, F.lit(-1))).repartition("__cell").write.mode("overwrite").partitionBy("__cell").parquet(f"{store}/features/epoch={epoch}")
    every = spark.read.option("basePath", f"{store}/features").parquet(f"{store}/features").where(F.col("epoch") <= epoch).drop("epoch")
    fresh = spark.read.option("basePath", f"{store}/features/epoch={epoch}").parquet(f"{store}/features/epoch={epoch}").where("__cell >= 0")
    touched = point_tiles(_zoomed(fresh.select("lon", "lat"), config), config.point_mode).select("z", "x", "y").distinct()
    own = [r[0] for r in fresh.select("__cell").distinct().collect()]  # 4,096 numbers at most
    near = sorted({(c // across + dx) % across * across + c % across + dy for c in own for dx in (-1, 0, 1) for dy in (-1, 0, 1) if 0 <= c % across + dy < across})
    parts = []
    for low, high, rows in ((config.min_zoom, min(config.max_zoom, CELL - 1), every), (max(config.min_zoom, CELL), config.max_zoom, every.where(F.col("__cell").isin(near)))):
        if low <= high and near:
            layer = Layer(LayerSpec(rows.drop("__cell"), name=name, lon="lon", lat="lat", id="fid", min_zoom=low, max_zoom=high), config)
            if layer.stats["n"]:
                found = union_of([layer]).join(touched, ["z", "x", "y"], "left_semi")
                parts.append((layer, encoded(found, [layer], config).withColumn("tile_id", tm.hilbert_id("z", "x", "y"))))
    if parts:
        tiles = parts[0][1] if len(parts) == 1 else parts[0][1].unionByName(parts[1][1])
        tiles.write.mode("overwrite").parquet(f"{store}/tiles/epoch={epoch}")
        forget(*(layer.table for layer, _ in parts))


def retile_stream(stream: DataFrame, store: str, config: TileConfig, name: str = "points", **trigger) -> StreamingQuery:
    """Start following ``stream(fid, lon, lat, …)``. ``trigger`` as of ``DataStreamWriter.trigger``; default: what is there, then stop."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: retile_batch(batch, epoch, store, config, name)).option("checkpointLocation", f"{store}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_tiles(spark: SparkSession, store: str) -> DataFrame:
    """The newest ``(z, x, y, tile_id, data)`` of each tile."""
    tiles = spark.read.option("basePath", f"{store}/tiles").parquet(f"{store}/tiles")
    return tiles.groupBy("z", "x", "y", "tile_id").agg(F.max_by("data", "epoch").alias("data"))
