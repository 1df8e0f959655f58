"""Scenes as they appear, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from arborscan.operators import catalog
from arborscan.sources.stored import read_if_there


def scene_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """File stream of scene rows; event time without zone becomes a timestamp a watermark accepts."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(stream: DataFrame, table: str, checkpoint: str, values: list[str]) -> StreamingQuery:
    """Upsert scenes into a Parquet catalogue, one folder per batch; scenes may come late and more than once.

    A batch holds the merged state of exactly the (tile, date) keys it saw, so writing it
    twice changes nothing; ``catalogue`` reads the newest state of each key. The upsert itself
    drops repeats, so no watermark is kept and no late scene is lost.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        keys = batch.select("tile_id", "image_date").distinct()
        known = catalogue(batch.sparkSession, table, batch.select("tile_id", "image_date", *values), before=number)
        merged = catalog.upsert_scenes(known.join(keys, ["tile_id", "image_date"], "left_semi"), batch, values)
        merged.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (stream.writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def catalogue(spark: SparkSession, table: str, like: DataFrame, before: int | None = None) -> DataFrame:
    """Newest state of every scene; empty if nothing has been ingested. ``like`` has the columns tile_id, image_date and the values."""
    columns = like.withColumn("is_new", F.lit(1)).schema
    rows = read_if_there(spark, table, StructType([*columns.fields, StructField("batch", LongType())]))
    if rows is None:
        return spark.createDataFrame([], columns)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    values = [c for c in rows.columns if c not in ("tile_id", "image_date", "batch")]
    return (rows.groupBy("tile_id", "image_date").agg(F.max_by(F.struct(*values), "batch").alias("_v"))
            .select("tile_id", "image_date", "_v.*"))
