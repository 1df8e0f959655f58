"""Instances inside predicted chips: threshold, distance peaks, flood."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.functions import chips as chip_fn
from arborscan.operators import histogram, segments

PEAK = 0.2


def distances(chips: DataFrame, keys: list[str]) -> DataFrame:
    """Chips with ``distance``: normalised distance to the background of the Otsu mask."""
    masked = histogram.chip_otsu(chips).withColumn("mask", F.transform("cells", lambda v: (v > F.col("threshold")).cast("double")))
    return segments.distance_to_background(masked, "mask")


def watershed(chips: DataFrame, keys: list[str]) -> DataFrame:
    """Chips with ``instance``: label per cell, 255 background, -1 between instances."""
    peaks = distances(chips, keys).withColumn("seeds", F.transform("distance", lambda d: (d > PEAK).cast("double")))
    grown = peaks.withColumn("seeds", chip_fn.dilate(F.col("seeds"), F.col("w"), F.col("h"), 3))
    sharp = grown.withColumn("sharp", chip_fn.laplacian_sharpen(F.col("cells"), F.col("w"), F.col("h")))
    return segments.flood(sharp, "sharp", "seeds")
