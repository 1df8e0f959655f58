"""From scene pairs to flagged detections: features, score, clean-up, polygons, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.functions import bands, chips as chip_fn, rings
from arborscan.operators import histogram, rasters, regions, scoring, spatial

PROBABILITY = 0.3
CLOUD = 15
NEAREST = 10


def cloud_union(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Cloud polygons of both dates."""
    return (current.withColumn("source", F.lit("current"))
            .unionByName(previous.withColumn("source", F.lit("previous"))))


def pair_features(chips: DataFrame, series: list[str], keys: list[str], order: str) -> DataFrame:
    """Per chip the byte images diff, cur and prev (previous matched to the current distribution)."""
    pairs = rasters.previous_chip(chips, series, order)
    matched = histogram.match(pairs, keys)
    diff = F.transform(F.arrays_zip("cells", "previous"), lambda c: bands.difference_byte(c["cells"], c["previous"]))
    return matched.select(*dict.fromkeys([*keys, *series, order]), "w", "h", diff.alias("diff"),
                          F.transform("cells", lambda v: F.floor(v).cast("int")).alias("cur"),
                          F.transform("previous", lambda v: F.floor(v).cast("int")).alias("prev"))


def model_input(chips: DataFrame, series: list[str], keys: list[str], order: str) -> DataFrame:
    """Chips with ``stack``: the three images of a band as one array of arrays."""
    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    features = pair_features(chips, series, keys, order)
    return features.select(*keys, "w", "h", F.array(as_double("diff"), as_double("cur"), as_double("prev")).alias("stack"))


def stack_scene(features: DataFrame, keys: list[str], depth: int = len(bands.STACK)) -> DataFrame:
    """One row per chip with the full stack: all difference bands, then current, then previous."""
    image = lambda name: [F.max(F.when(F.col("band") == b, F.transform(name, lambda v: v.cast("double")))).alias(f"{name}_{b}") for b in range(depth)]
    wide = features.groupBy(*keys).agg(F.max("w").alias("w"), F.max("h").alias("h"), *image("diff"), *image("cur"), *image("prev"))
    return wide.select(*keys, "w", "h", F.array(*[f"{name}_{b}" for name in ("diff", "cur", "prev") for b in range(depth)]).alias("stack"))


def detect(chips: DataFrame, keys: list[str], forest: DataFrame, clouds: DataFrame, load_model=lambda: scoring.mean_drop,
           threshold: float = PROBABILITY, transform: tuple = (10.0, 0.0, 0.0, 0.0, -10.0, 0.0)) -> DataFrame:
    """Flagged detections of every scene pair.

    ``chips``: raster keys (with tile_id), scene order ``scene``, chip_x, chip_y, band, w, h,
    cells. ``forest`` and ``clouds``: tile_id, mask_id and boxes x0..y1 in world units.
    Output: keys, scene, shape, box, area, forest, clouds.
    """
    place = [*keys, "chip_x", "chip_y"]
    features = pair_features(chips, [*place, "band"], [*place, "scene", "band"], "scene")
    scored = scoring.score_chips(stack_scene(features, [*place, "scene"]), load_model)
    clean = scored.withColumn("cells", chip_fn.erode3_close5(F.col("cells"), F.col("w"), F.col("h")))
    flat = rasters.to_cells(clean.withColumns({"_w": F.col("w"), "_h": F.col("h")}), ["cells"]).where(F.col("cells") > threshold)
    mask = flat.select(*keys, "scene", (F.col("chip_x") * F.col("_w") + F.col("x")).alias("x"), (F.col("chip_y") * F.col("_h") + F.col("y")).alias("y"))
    labelled = regions.label_regions(mask, [*keys, "scene"])
    polygons = regions.polygonize(labelled, [*keys, "scene"], transform, boundary="center")
    return flag(polygons, keys, forest, clouds)


def flag(polygons: DataFrame, keys: list[str], forest: DataFrame, clouds: DataFrame) -> DataFrame:
    """Polygons with area, box and 0/1 flags for the masks of their tile.

    ``polygons`` and masks have rings in ``shape`` (a mask without that column is its box); the
    flag asks whether the shapes themselves meet, so a mask in the notch of an L does not count.
    """
    named = polygons.withColumn("det_id", F.concat_ws("/", *keys, "scene", "region", "part")).withColumn("area", rings.area(F.col("shape")))
    box = named.withColumn("_b", rings.bounds(F.col("shape"))).withColumns(
        {"x0": F.col("_b.xmin"), "y0": F.col("_b.ymin"), "x1": F.col("_b.xmax"), "y1": F.col("_b.ymax")}).drop("_b")
    corners = ("x0", "y0", "x1", "y1")
    probe = box.select("tile_id", "det_id", *corners, "shape")
    for name, masks in (("forest", forest), ("clouds", clouds)):
        shaped = masks if "shape" in masks.columns else masks.withColumn("shape", rings.rectangle(*[F.col(c) for c in corners]))
        flags = spatial.knn_mask_flag(probe, shaped.select("tile_id", "mask_id", *corners, "shape"), ["tile_id"], "det_id", "mask_id", 640, k=NEAREST,
                                      exact=lambda a, b: rings.intersects(a["shape"], b["shape"]))
        box = box.join(flags.select("det_id", F.col("flag").alias(name)), "det_id")
    return box


def cloud_regions(cloud_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of cleaned cloud probability above the threshold, as regions."""
    clean = rasters.scene_morphology(cloud_cells, keys, chip_fn.close5_dilate3, chip_fn.CLOUD_REACH)
    return regions.label_regions(clean.where(F.col("v") > CLOUD), keys)
