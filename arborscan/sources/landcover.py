"""Forest polygons cached per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborscan.sources.stored import read_if_there


def missing_subset(polygons: DataFrame, wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Polygons of wanted tiles that are not cached yet; all three carry ``tile_id``."""
    todo = wanted.select("tile_id").distinct().join(cached.select("tile_id"), "tile_id", "left_anti")
    return polygons.join(todo, "tile_id", "left_semi")


def refresh_cache(spark: SparkSession, path: str, polygons: DataFrame, wanted: DataFrame) -> DataFrame:
    """Append the polygons of uncached tiles to a Parquet table partitioned by tile and read it back."""
    cached = read_if_there(spark, path, polygons.schema)
    cached = wanted.limit(0) if cached is None else cached
    (missing_subset(polygons, wanted, cached.select("tile_id").distinct())
     .write.mode("append").partitionBy("tile_id").parquet(path))
    return spark.read.schema(polygons.schema).parquet(path).join(wanted.select("tile_id").distinct(), "tile_id", "left_semi")
