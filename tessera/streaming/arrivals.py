"""An extension: map files that arrive in a folder are rendered batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.render import FRAME, RESOLUTION, render
from tessera.sources.xmap import parse_maps


def render_arrivals(spark: SparkSession, folder: str, table: str, checkpoint: str, resolution: float = RESOLUTION, frame: float = FRAME, files_per_batch: int = 100) -> StreamingQuery:
    """Render each new .omap or .xmap file of a folder once, into Parquet at `table` (a folder for each batch, replaced
    if the batch is run again); ends when nothing new is there."""
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{omap,xmap}").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def draw(batch: DataFrame, number: int) -> None:
        maps = parse_maps(batch.select(F.col("path").alias("map_id"), "content"))
        render(maps, resolution, frame).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return arrived.writeStream.foreachBatch(draw).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
