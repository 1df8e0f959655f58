"""Colour of marked areas over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.operators import regions


def state_colors(pixels: DataFrame, markup: DataFrame, by: str) -> DataFrame:
    """Mean red, green, blue (0..1) of non-zero pixels inside the markup, per ``by`` and state.

    ``pixels``: by, band 0..2, x, y, v; ``markup``: pk, state, shape.
    """
    inside = regions.covered(pixels.where(F.col("v") != 0), markup, [], "pk", "shape", ["state"], "inner")
    mean = lambda band: F.avg(F.when(F.col("band") == band, F.col("v"))) / 255
    return (inside.groupBy(by, "state").agg(mean(0).alias("red"), mean(1).alias("green"), mean(2).alias("blue"))
            .withColumn("brightness", F.col("red") + F.col("green") + F.col("blue")))
