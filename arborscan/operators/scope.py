"""Common extent of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def collection_bounds(boxes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Smallest box around all boxes, per group."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"),
                                  F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


def overlap_scope(a: DataFrame, b: DataFrame) -> DataFrame:
    """The one-row overlap of two collections' bounds."""
    both = collection_bounds(a).unionByName(collection_bounds(b))
    return both.agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))


def inside_scope(boxes: DataFrame, scope: DataFrame) -> DataFrame:
    """Boxes that meet the scope; the scope is a scalar subquery, so there is no join."""
    s: Column = scope.select(F.struct("*")).scalar()
    return (boxes.withColumn("_s", s)
            .where((F.col("x0") <= F.col("_s.xmax")) & (F.col("x1") >= F.col("_s.xmin"))
                   & (F.col("y0") <= F.col("_s.ymax")) & (F.col("y1") >= F.col("_s.ymin"))).drop("_s"))
