"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborscan.session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work done once, and safe from lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parallelism(spark: SparkSession) -> int:
    """The number of partitions a shuffle has by the session's settings; it is meant to grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(rows: DataFrame, key: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: a gapless rank from 0 among the rows of equal ``key``, without a task that sees a whole key.

    Rows of one key are dealt to buckets by a hash of all columns; a prefix sum over the bucket
    counts (one row per key and bucket) starts each bucket's own numbering. Which rank a row gets
    is settled by its content alone; equal rows share their ranks among each other.
    """
    buckets = parallelism(rows.sparkSession)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, [*key, "_bucket"])
    return joined.select(*rows.columns, (F.col("_start") + F.col("_r")).cast("long").alias(name))
