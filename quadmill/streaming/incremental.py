"""Structured Streaming over a folder of feature files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import tilemath as tm
from ..plans.config import TileConfig
from ..plans.tiler import generate_tiles


def watch(spark: SparkSession, folder: str, schema: StructType, config: TileConfig, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Tiles each batch of new files and gives the tiles to sink(tiles, batch_id), exactly once for each batch id if the
    sink overwrites by id. Runs until the files of now are done."""
    stream = spark.readStream.schema(schema).parquet(folder)
    each = lambda df, batch: sink(generate_tiles(df, config), batch)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tile_counts(points: DataFrame, zoom: int, time: str, window: str, late: str) -> DataFrame:
    """Points (lng, lat, time column) per tile and time window, with a watermark of `late`. Streaming or batch."""
    tiles = points.withColumn("tile_id", tm.tile_id(zoom, tm.tile_x(F.col("lng"), zoom), tm.tile_y(F.col("lat"), zoom)))
    counted = (tiles.withWatermark(time, late) if points.isStreaming else tiles).groupBy(F.window(time, window).alias("w"), "tile_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "tile_id", "n")
