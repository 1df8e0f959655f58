"""Rasters as chip rows: (raster keys, band, w, h, cells array) or, exploded, one row per cell.

Band work stays in array form as long as possible: aligning nine bands moves nine arrays
per chip through the shuffle instead of nine rows per cell.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import bands, chips as chip_fn
from arborscan.functions.rings import let


def align_bands(chips: DataFrame, keys: list[str], order: list[int], names: list[str], size: Column | None = None) -> DataFrame:
    """One row per chip with every band's cells in its own column.

    Chips that lack a band are left out. Bands of different size are an error, as they
    cannot be combined cell by cell.
    """
    picked = [F.max(F.when(F.col("band") == band, F.col("cells"))).alias(name) for band, name in zip(order, names)]
    wide = chips.where(F.col("band").isin(order)).groupBy(*keys).agg(
        F.max("w").alias("w"), F.max("h").alias("h"), *picked)
    complete, same = F.lit(True), F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull()
        same = same & (F.size(name) == F.size(names[0]))
    checked = F.when(same, F.col(names[0])).otherwise(F.raise_error(F.lit("band dimensions differ")).cast("array<double>"))
    return wide.where(complete).withColumn(names[0], checked)


def to_cells(chips: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell with x, y and the named array columns as scalars (map-side)."""
    others = [c for c in chips.columns if c not in columns]
    flat = chips.select(*others, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_c"))
    return flat.select(*others, (F.col("_i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"),
                       *[F.col(f"_c.{c}").alias(c) for c in columns]).drop("w", "h")


def to_chips(cells: DataFrame, keys: list[str], size: int, value: str = "v", halo: int = 0) -> DataFrame:
    """Cells of large rasters -> blocks of ``size`` cells with a halo: columns block_x, block_y, w, h, cells.

    A cell near a block edge is copied to the neighbours it influences, so a neighbourhood
    operation needs exactly one shuffle, and a group never exceeds (size + 2 * halo)^2
    cells. Cells the raster lacks are null.
    """
    lo_x, hi_x = F.floor((F.col("x") - halo) / size), F.floor((F.col("x") + halo) / size)
    lo_y, hi_y = F.floor((F.col("y") - halo) / size), F.floor((F.col("y") + halo) / size)
    side = size + 2 * halo
    placed = (cells.withColumn("block_x", F.explode(F.sequence(lo_x, hi_x)))
              .withColumn("block_y", F.explode(F.sequence(lo_y, hi_y))))
    local = ((F.col("y") - F.col("block_y") * size + halo) * side + F.col("x") - F.col("block_x") * size + halo).cast("int")
    grouped = (placed.select(*keys, "block_x", "block_y", F.struct(local.alias("k"), F.lit(0).alias("gap"), F.col(value).alias("v")).alias("_c"))
               .groupBy(*keys, "block_x", "block_y").agg(F.collect_list("_c").alias("_c")))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)),
                       lambda k: F.struct(k.alias("k"), F.lit(1).alias("gap"), F.lit(None).cast(cells.schema[value].dataType).alias("v")))
    dense = let(F.sort_array(F.concat("_c", gaps)), lambda c: F.transform(
        F.filter(c, lambda e, i: (i == 0) | (F.get(c, i - 1)["k"] != e["k"])), lambda e: e["v"]))
    return grouped.select(*keys, "block_x", "block_y", F.lit(side).alias("w"), F.lit(side).alias("h"), dense.alias("cells"))


def from_chips(blocks: DataFrame, keys: list[str], size: int, halo: int, original: str, value: str = "v") -> DataFrame:
    """Interior cells of blocks, keeping only those whose ``original`` cell exists."""
    flat = blocks.select(*keys, "block_x", "block_y", F.posexplode(F.arrays_zip(F.col(original).alias("o"), F.col(value).alias("n"))).alias("_i", "_c"))
    side = size + 2 * halo
    x, y = F.col("_i") % side - halo, F.floor(F.col("_i") / side) - halo
    inside = x.between(0, size - 1) & y.between(0, size - 1) & F.col("_c.o").isNotNull()
    return flat.where(inside).select(*keys, (F.col("block_x") * size + x).alias("x"), (F.col("block_y") * size + y).alias("y"),
                                     F.col("_c.n").alias(value))


def scene_morphology(cells: DataFrame, keys: list[str], operation, reach: int, size: int = 64) -> DataFrame:
    """Apply a chip operation ``(cells, w, h) -> cells`` across a whole raster of any extent."""
    blocks = to_chips(cells, keys, size, halo=reach)
    done = blocks.withColumn("v", operation(F.col("cells"), F.col("w"), F.col("h")))
    return from_chips(done, keys, size, reach, "cells")


def calc(cells: DataFrame, formula: str, inputs: list[str], nodata: dict[str, float] | None = None,
         kinds: dict[str, str] | None = None, out_type: str | None = None, out_nodata: float | None = None,
         output: str = "result") -> DataFrame:
    """Evaluate a formula over aligned inputs A..Z, one row per cell.

    A cell is nodata when any input is. The output type defaults to the widest input, its
    nodata value to the default of that type.
    """
    nodata, kinds = nodata or {}, kinds or {}
    ranks = list(bands.NODATA)
    out_type = out_type or max((kinds.get(name, "Float64") for name in inputs), key=ranks.index)
    missing = F.lit(False)
    for name in inputs:
        if name in nodata:
            missing = missing | (F.col(name) == nodata[name])
    empty = F.lit(bands.NODATA[out_type] if out_nodata is None else out_nodata)
    value = F.expr(formula).cast("double")
    return cells.withColumn(output, F.when(missing, empty.cast(bands.SQL_TYPES[out_type])).otherwise(bands.to_type(value, out_type)))


def calc_all_bands(multi: DataFrame, single: DataFrame, keys: list[str], formula: str, **options) -> DataFrame:
    """Formula over every band of ``multi`` (A) with one single-band raster (B)."""
    joined = multi.select(*keys, "band", "w", "h", F.col("cells").alias("A")).join(
        single.select(*keys, F.col("cells").alias("B")), keys)
    return calc(to_cells(joined, ["A", "B"]), formula, ["A", "B"], **options)


def mosaic(sources: list[DataFrame], keys: list[str], nodata: float | None = None, init: float | None = None,
           extent: DataFrame | None = None) -> DataFrame:
    """Cells of the union of all sources; later sources overwrite earlier ones.

    Nodata cells and cells flagged ``masked`` never overwrite. ``init`` fills cells of
    ``extent`` (keys, x, y) no source covers. A maximum by source number combines map-side.
    """
    tagged = None
    for number, source in enumerate(sources):
        keep = F.col("v").isNotNull()
        if nodata is not None:
            keep = keep & (F.col("v") != nodata)
        if "masked" in source.columns:
            keep = keep & ~F.col("masked")
        part = source.where(keep).select(*keys, "x", "y", "v", F.lit(number).alias("_n"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if extent is not None:
        fill = init if init is not None else nodata
        tagged = tagged.unionByName(extent.select(*keys, "x", "y", F.lit(fill).alias("v"), F.lit(-1).alias("_n")))
    return tagged.groupBy(*keys, "x", "y").agg(F.max_by("v", "_n").alias("v"))


class Grid(NamedTuple):
    """Header of a north-up raster: upper left corner, cell size and number of cells."""

    left: float
    top: float
    width: int
    height: int
    cell_x: float = 1.0
    cell_y: float = 1.0

    @property
    def right(self) -> float:
        return self.left + self.width * self.cell_x

    @property
    def bottom(self) -> float:
        return self.top - self.height * self.cell_y


def common_grid(grids: list[Grid], cell: tuple[float, float] | None = None, aligned: bool = False) -> Grid:
    """The grid around all grids, with the cell size of the first unless ``cell`` gives one.

    ``aligned`` widens the extent to multiples of the cell size, so that mosaics of neighbouring areas share one lattice.
    """
    dx, dy = cell or (grids[0].cell_x, grids[0].cell_y)
    left, right = min(g.left for g in grids), max(g.right for g in grids)
    bottom, top = min(g.bottom for g in grids), max(g.top for g in grids)
    if aligned:
        left, right = math.floor(left / dx) * dx, math.ceil(right / dx) * dx
        bottom, top = math.floor(bottom / dy) * dy, math.ceil(top / dy) * dy
    return Grid(left, top, int((right - left) / dx + 0.5), int((top - bottom) / dy + 0.5), dx, dy)


def on_grid(cells: DataFrame, source: Grid, target: Grid, others: list[str]) -> DataFrame:
    """Cells (others, x, y) of one grid as cells of another: each target cell takes the source cell its centre falls into.

    The source's edges move to the nearest lines of the target first (starts down from nine tenths of a cell, ends by
    halves), and its cells share that window evenly. A coarse cell is written out once per target cell it covers and
    a fine one that holds no centre is dropped before any shuffle; a window without cells gives none.
    """
    def along(axis: str, near: float, far: float, size: int, limit: int) -> Column:
        start, stop = math.floor(near + 0.1), math.floor(far + 0.5)
        n = max(stop - start, 0)
        first = lambda s: F.ceil((s * (2 * n) - size) / F.lit(2 * size)).cast("long")
        low, high = F.greatest(first(F.col(axis)) + start, F.lit(0)), F.least(first(F.col(axis) + 1) + start, F.lit(limit))
        inside = F.col(axis).between(0, size - 1) & (high > low)
        return F.explode(F.when(inside, F.sequence(low, high - 1))).alias(axis)

    across = along("x", (source.left - target.left) / target.cell_x, (source.right - target.left) / target.cell_x, source.width, target.width)
    down = along("y", (target.top - source.top) / target.cell_y, (target.top - source.bottom) / target.cell_y, source.height, target.height)
    wide = cells.select(*others, "y", across)
    return wide.select(*others, "x", down)


def mosaic_grids(sources: list[tuple[DataFrame, Grid]], keys: list[str], nodata: float | None = None, init: float | None = None,
                 cell: tuple[float, float] | None = None, aligned: bool = False) -> tuple[DataFrame, Grid]:
    """``mosaic`` of sources with grids of their own (cell size and place): cells on the common grid, and that grid.

    Cells count from the common grid's upper left corner. With ``init`` every cell no source covers gets that value,
    for every key that occurs in a source. Only headers are looked at before the job runs.
    """
    target = common_grid([grid for _, grid in sources], cell, aligned)
    placed = [on_grid(df, grid, target, [c for c in df.columns if c not in ("x", "y")]) for df, grid in sources]
    extent = None
    if init is not None:
        names = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(1).alias("_")) for df in placed]).distinct()
        rows = names.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target.height - 1).cast("long")))).repartition(*keys, "y")
        extent = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target.width - 1).cast("long"))))
    return mosaic(placed, keys, nodata, init, extent), target


def accumulate(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of window predictions per cell of the full raster."""
    return parts.groupBy(*keys, "x", "y").agg(F.sum("v").alias("v"))


def statistics(chips: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each band, NaN counting as 0.

    Chips first shrink to five numbers map-side, so the shuffle carries partial sums.
    """
    clean = F.transform("cells", lambda v: F.nanvl(v.cast("double"), F.lit(0.0)))
    part = chips.select(*by, clean.alias("c")).select(
        *by, F.size("c").alias("n"), chip_fn.total(F.col("c")).alias("s"),
        chip_fn.total(F.transform("c", lambda v: v * v)).alias("q"), F.array_min("c").alias("lo"), F.array_max("c").alias("hi"))
    sums = part.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "min", "max")


def sigma_scaled(chips: DataFrame, by: list[str]) -> DataFrame:
    """Chips with cells mapped from the two-sigma range of their raster band to bytes."""
    low, high = bands.clip_range(F.col("mean"), F.col("std"), F.col("min"), F.col("max"))
    limits = statistics(chips, by).select(*by, low.alias("_lo"), high.alias("_hi"))
    scaled = F.transform("cells", lambda v: bands.linear_byte(F.nanvl(v.cast("double"), F.lit(0.0)), F.col("_lo"), F.col("_hi")))
    return chips.join(limits, by).withColumn("cells", scaled).drop("_lo", "_hi")


def max_scaled(chips: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Cells divided by the raster maximum, times ``limit``."""
    tops = chips.groupBy(*by).agg(F.max(F.array_max("cells")).alias("_top"))
    return (chips.join(tops, by)
            .withColumn("cells", F.transform("cells", lambda v: bands.max_scaled(v, F.col("_top"), limit))).drop("_top"))


def previous_chip(chips: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Chip rows with ``previous``, the cells of the same chip at the latest earlier ``order`` there is.

    Steps may be missing: a chip is paired with the one before it among those available. The
    window sees one small row per key and step; cells only take part in the join.
    """
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    steps = chips.select(*keys, order).distinct().withColumn("_before", before).where("_before IS NOT NULL")
    earlier = chips.select(*keys, F.col(order).alias("_before"), F.col("cells").alias("previous"))
    return chips.join(steps, [*keys, order]).join(earlier, [*keys, "_before"]).drop("_before")


def with_reprojection(source: DataFrame, target: DataFrame, keys: list[str], to_source, nodata: float = 0) -> DataFrame:
    """Target cells with the value of the nearest source cell.

    ``to_source`` gives the fractional source column and row of a target cell; rounding
    turns the lookup into an equi-join. Cells that fall outside become ``nodata``.
    """
    px, py = to_source(F.col("x"), F.col("y"))
    placed = target.select(*keys, "x", "y", F.floor(px).alias("_sx"), F.floor(py).alias("_sy"))
    cells = source.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), "v")
    return (placed.join(cells, [*keys, "_sx", "_sy"], "left")
            .select(*keys, "x", "y", F.coalesce("v", F.lit(nodata)).alias("v")))
