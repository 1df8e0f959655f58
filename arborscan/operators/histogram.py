"""Histogram operations; pixels shrink to at most one row per grey value before any shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def counts(chips: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """(keys, v, n): occurrences of each value."""
    return chips.select(*keys, F.explode(cells).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))


def cumulative(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` (values up to and including v) and ``total``."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumns({"rank": F.sum("n").over(upto), "total": F.sum("n").over(whole)})


def _matched(source: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Source values moved onto the template's distribution.

    A value's quantile is looked up among the template's; between two of them values are
    interpolated, below the first the first is taken.
    """
    values, at, n = np.unique(source, return_inverse=True, return_counts=True)
    points, m = np.unique(template, return_counts=True)
    q, p = np.cumsum(n) / len(source), np.cumsum(m) / len(template)
    right = np.minimum(np.searchsorted(p, q, "left"), len(p) - 1)
    left = np.maximum(np.searchsorted(p, q, "right") - 1, 0)
    gap = np.where(right > left, p[right] - p[left], 1.0)
    share = np.where(right > left, (q - p[left]) / gap, 0.0)
    moved = np.where(q < p[0], points[0], points[left] + share * (points[right] - points[left]))
    return moved[at]


def match(chips: DataFrame, keys: list[str], source: str = "previous", template: str = "cells") -> DataFrame:
    """Chips whose ``source`` cells are matched to the distribution of their ``template`` cells.

    Both arrays of a chip are in its row, so nothing is shuffled. Chips with an empty array keep it.
    """

    @F.pandas_udf("array<double>")
    def matched(sources: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([_matched(np.asarray(s, float), np.asarray(t, float)) if len(s) and len(t) else s for s, t in zip(sources, templates)])

    return chips.withColumn(source, matched(F.col(source), F.col(template)))


def chip_otsu(chips: DataFrame, cells: str = "cells", output: str = "threshold") -> DataFrame:
    """Chips with the value whose split maximises between-class variance (smallest on ties), found inside the row."""

    @F.pandas_udf("double")
    def threshold(column: pd.Series) -> pd.Series:
        out = []
        for values in column:
            v, n = np.unique(np.asarray(values, float), return_counts=True)
            if not len(v):
                out.append(None)
                continue
            w0, s0 = np.cumsum(n).astype(float), np.cumsum(v * n)
            w1 = w0[-1] - w0
            gap = s0 / w0 - (s0[-1] - s0) / np.where(w1 > 0, w1, 1.0)
            out.append(v[int(np.argmax(np.round(np.where(w1 > 0, w0 * w1 * gap * gap, 0.0), 6)))])
        return pd.Series(out, dtype="float64")

    return chips.withColumn(output, threshold(F.col(cells)))


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the value whose split maximises between-class variance (smallest on ties)."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("v") * F.col("n")
    sums = histogram.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(mass).over(upto),
                                  "w": F.sum("n").over(whole), "s": F.sum(mass).over(whole)})
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    score = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    return sums.groupBy(*keys).agg(F.max_by("v", F.struct(F.round(score, 6), -F.col("v"))).alias("threshold"))
