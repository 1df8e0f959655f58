"""Rasters as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def with_metadata(cells: DataFrame, **meta) -> DataFrame:
    """Cell rows with the raster's metadata as constant columns (dictionary-encoded on disk)."""
    return cells.withColumns({name: F.lit(value) for name, value in meta.items()})


def write(cells: DataFrame, path: str, partition: list[str], mode: str = "overwrite") -> None:
    """Parquet partitioned by raster keys; rows of one raster are clustered first to avoid small files."""
    (cells.repartition(*partition).sortWithinPartitions(*partition).write.mode(mode).partitionBy(*partition).parquet(path))


def read_window(spark: SparkSession, path: str, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Cells of one window; both ranges are pushed to the scan."""
    return spark.read.parquet(path).where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
