"""Training chips from a scene: cut, cover, mask, filter, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.operators import regions, tiling

PSEUDO = "pseudo-labeled"


def build(pixels: DataFrame, markup: DataFrame, size: int, coverage: float = 0.9, min_mask: int = 20) -> DataFrame:
    """Chips (chip_x, chip_y) of a scene that are covered and carry enough mask.

    ``pixels``: band, x, y, v of the first three bands; ``markup``: pk, shape in pixel
    units. The mask is rasterised once and cut by integer division.
    """
    keyed = pixels.withColumns({"chip_x": F.floor(F.col("x") / size), "chip_y": F.floor(F.col("y") / size)})
    covered = tiling.covered_chips(keyed, ["chip_x", "chip_y"], coverage)
    mask = regions.rasterize(markup, [], "pk", "shape")
    cut = mask.withColumns({"chip_x": F.floor(F.col("x") / size), "chip_y": F.floor(F.col("y") / size)})
    marked = cut.groupBy("chip_x", "chip_y").agg(F.count("*").alias("mask_cells"))
    return covered.join(marked, ["chip_x", "chip_y"]).where(F.col("mask_cells") >= min_mask)


def append_pseudo_labels(train: DataFrame, accepted: DataFrame) -> DataFrame:
    """Train index extended by accepted chips under the pseudo-label dataset."""
    return train.unionByName(accepted.select(F.lit(PSEUDO).alias("dataset_folder"), "name", "position"))
