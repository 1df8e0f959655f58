"""Relational tables: Parquet or JDBC scans, keyed updates and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """Table scan split into ranges of a numeric key so that no task reads it all."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low),
                                               upperBound=str(high), numPartitions=str(parts), **options).load())


def list_paths(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """File paths below a folder; contents are never read because only ``path`` is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(root).select("path", "length"))


def read_metadata_text(spark: SparkSession, root: str) -> DataFrame:
    """Whole metadata files as (path, xml)."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def finished_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with a stored result, by their later date."""
    return tasks.where(F.col("result").isNotNull())


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
