"""Cutting rasters into chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborscan.functions.rings import affine


def inside_grid(x: Column, y: Column, w: Column, h: Column, size_x: int, size_y: int) -> Column:
    """True for cells of whole windows: the remainder at the right and lower edge is dropped."""
    return (x < F.floor(w / size_x) * size_x) & (y < F.floor(h / size_y) * size_y)


def chip_keys(pixels: DataFrame, width: int, height: int, size_x: int, size_y: int) -> DataFrame:
    """Pixels of whole windows with their chip column/row and local position."""
    keep = inside_grid(F.col("x"), F.col("y"), F.lit(width), F.lit(height), size_x, size_y)
    return pixels.where(keep).withColumns({
        "chip_x": F.floor(F.col("x") / size_x), "chip_y": F.floor(F.col("y") / size_y),
        "cx": F.pmod("x", F.lit(size_x)), "cy": F.pmod("y", F.lit(size_y))})


def chip_index(images: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """One index row per whole window of each image (columns image, w, h)."""
    grid = (images.withColumn("_j", F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / size_y) - 1)))
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") / size_x) - 1))))
    stem = F.concat_ws("_", "image", F.col("_j").cast("string"), F.col("_i").cast("string"))
    return grid.select(F.concat("image", F.lit(".tif")).alias("original_image"),
                       F.concat(stem, F.lit(".tiff")).alias("piece_image"),
                       F.concat(stem, F.lit(".geojson")).alias("piece_geojson"),
                       (F.col("_i") * size_x).cast("long").alias("start_x"),
                       (F.col("_j") * size_y).cast("long").alias("start_y"),
                       F.lit(size_x).cast("long").alias("width"), F.lit(size_y).cast("long").alias("height"))


def footprint(start_x: Column, start_y: Column, width: Column, height: Column, transform: tuple) -> Column:
    """Closed ring of a window's corner cell centres in world coordinates."""
    corner = [(start_x, start_y), (start_x + width, start_y), (start_x + width, start_y + height),
              (start_x, start_y + height), (start_x, start_y)]
    points = [affine(cx, cy, transform, centre=True) for cx, cy in corner]
    return F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in points])


def covered_chips(pixels: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """Chips whose non-zero cells exceed ``share`` of all cells (caller passes the first three bands)."""
    return (pixels.groupBy(*keys).agg(F.count_if(F.col("v") != 0).alias("filled"), F.count("*").alias("cells"))
            .where(F.col("filled") > F.col("cells") * share))


def cut_mask(mask: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """Mask cells keyed by the chip they fall in; the range lookup is an integer division."""
    return mask.withColumns({"start_x": F.floor(F.col("x") / size_x) * size_x,
                             "start_y": F.floor(F.col("y") / size_y) * size_y})
