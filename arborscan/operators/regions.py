"""Mask cells to regions and polygons, and polygons to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborscan.operators import cells as cell_sets, outlines
from arborscan.operators.components import connected_components
from arborscan.operators.rasters import to_chips
from arborscan.operators.segments import label_cells
from arborscan.session import cut_lineage


def label_regions(mask: DataFrame, keys: list[str], size: int = 64) -> DataFrame:
    """8-connected regions of mask cells (keys, x, y): adds ``region``.

    Blocks are labelled on their own; only cells on block edges are joined with their
    neighbours, and the remaining graph of block regions is solved by
    ``connected_components``. A region is named by its smallest block region.
    """
    blocks = to_chips(mask.withColumn("v", F.lit(1.0)), keys, size)
    labelled = cut_lineage(label_cells(blocks, "cells").select(*keys, "block_x", "block_y", "label"))
    flat = labelled.select(*keys, "block_x", "block_y", F.posexplode("label").alias("_i", "_l")).where("_l > 0")
    block_region = F.concat_ws("/", *keys, "block_x", "block_y", "_l")
    local = flat.select(*keys, (F.col("block_x") * size + F.col("_i") % size).alias("x"),
                        (F.col("block_y") * size + F.floor(F.col("_i") / size)).alias("y"), block_region.alias("_node"))
    edge = (F.pmod("x", F.lit(size)).isin(0, size - 1)) | (F.pmod("y", F.lit(size)).isin(0, size - 1))
    rim = local.where(edge)
    step = F.expr("sequence(-1, 1)")
    reach = (rim.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
             .select(*keys, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), F.col("_node").alias("src")))
    links = (reach.join(rim.select(*keys, "x", "y", F.col("_node").alias("dst")), [*keys, "x", "y"])
             .where("src < dst").select("src", "dst").distinct())
    names = connected_components(links).withColumnRenamed("node", "_node")
    return (local.join(names, "_node", "left")
            .select(*keys, "x", "y", F.coalesce("component", F.col("_node")).alias("region")))


def polygonize(regions: DataFrame, keys: list[str], transform: tuple = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0),
               boundary: str = "cell", holes: str = "separate", block: int = outlines.BLOCK) -> DataFrame:
    """Region cells -> polygons (keys, region, part, hole, shape).

    ``boundary='center'`` runs through cell centres (contours of fewer than three points
    are dropped), ``'cell'`` along cell borders. ``holes='separate'`` gives hole contours
    as polygons of their own, ``'ring'`` puts them into their region's polygon. Unit edges become
    straight runs line by line, runs become chains block by block, and chains are put in order by
    pointer jumping (``outlines``): only the corners of a finished ring ever stand in one row, and no task holds
    more than a block of a region that covers a whole scene. Coordinates lie within +-2**29.
    """
    own = [*keys, "region"]
    edges = cell_sets.boundary(regions.select(*own, F.col("x").alias("cx"), F.col("y").alias("cy")), "region", keys)
    a, b, c, d, e, f = (F.lit(float(v)) for v in transform)
    shift = 0.5 if boundary == "center" else 0.0  # an affine transform maps centres by adding half a cell

    def world(x: Column, y: Column) -> Column:
        x, y = x.cast("double") + shift, y.cast("double") + shift
        return F.struct((a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y"))

    if boundary == "center":
        line = F.transform(outlines.centres(F.col("points")), lambda p: world(p["x"], p["y"]))
    else:
        line = F.transform("points", lambda s: world(s["x0"], s["y0"]))
    contours = (outlines.rings(edges, keys, "region", block).select(*own, "ring", "hole", line.alias("line")).where(F.size("line") > 2)
                .select(*own, "ring", "hole", F.concat("line", F.slice("line", 1, 1)).alias("line")))
    if holes == "separate":
        return outlines.numbered(cut_lineage(contours), own, "ring").select(*own, "part", "hole", F.array("line").alias("shape"))
    joined = contours.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("hole", "ring", "line"))).alias("_r"))
    return joined.where(~F.col("_r")[0]["hole"]).select(*own, F.lit(0).alias("part"), F.lit(False).alias("hole"), F.col("_r.line").alias("shape"))


def rasterize(shapes: DataFrame, keys: list[str], id: str, shape: str, size: float = 1.0) -> DataFrame:
    """Distinct cells (keys, x, y) whose centre lies in any shape of the group."""
    covered = cell_sets.runs(shapes, keys, id, shape, size)
    return covered.select(*keys, F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("x"), F.col("cy").alias("y"))


def covered(pixels: DataFrame, shapes: DataFrame, keys: list[str], id: str, shape: str, by: list[str] = (), how: str = "left") -> DataFrame:
    """``pixels`` (keys, x, y) joined to the runs of the shapes, a pixel at most once per group of ``by``.

    Adds ``by`` and ``_in`` (true inside). Runs end at tile borders, so a pixel meets the runs of its line and tile only;
    covered areas are never written out cell by cell.
    """
    runs = cell_sets.runs(shapes, [*keys, *by], id, shape).withColumnsRenamed({"cy": "_y", "tile": "_tile"}).withColumn("_in", F.lit(True))
    for key in keys:
        runs = runs.withColumnRenamed(key, f"_{key}")
    same = [F.col(key) == F.col(f"_{key}") for key in keys]
    place = [F.col("y") == F.col("_y"), F.floor(F.col("x") / cell_sets.TILE) == F.col("_tile"), F.col("x") >= F.col("c0"), F.col("x") < F.col("c1")]
    return pixels.join(runs, [*same, *place], how).drop("_y", "_tile", "c0", "c1", *[f"_{key}" for key in keys])


def mask_by_polygons(pixels: DataFrame, shapes: DataFrame, keys: list[str], id: str, shape: str) -> DataFrame:
    """Pixels with ``v`` set to 0 outside the shapes."""
    return covered(pixels, shapes, keys, id, shape).withColumn("v", F.when(F.col("_in"), F.col("v")).otherwise(0)).drop("_in")
