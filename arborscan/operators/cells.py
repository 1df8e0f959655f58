"""Regions as sets of grid cells (region_id, cx, cy): overlay and union become joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import rings

TILE = 256  # cells along a line that one run may cover


def _first(low: Column, size: float) -> Column:
    """Index of the first cell whose centre is not left of ``low``."""
    return F.ceil(low / size - 0.5)


def from_boxes(boxes: DataFrame, id: str, size: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Cells whose centre lies in the box (upper borders excluded)."""
    size = float(size)
    return (boxes.withColumn("cx", F.explode(_span("x0", "x1", size)))
            .withColumn("cy", F.explode(_span("y0", "y1", size))).select(*keys, id, "cx", "cy"))


def _span(low: str, high: str, size: float) -> Column:
    start, stop = _first(F.col(low), size), _first(F.col(high), size) - 1
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))


def spans(shapes: DataFrame, id: str, shape: str, size: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Scanline conversion: runs (keys, id, cy, c0, c1) of cells whose centres lie inside the rings, c1 excluded.

    Every side meets the lines of centres between its ends; the crossings of a shape on a line, sorted, are paired by the
    even-odd rule. The work follows the outline: neither the box nor the covered area is looked at,
    and the lines of a large shape are spread over tasks.
    """
    size = float(size)
    numbered = shapes.withColumn("_row", F.monotonically_increasing_id())
    sides = numbered.select(*keys, id, "_row", F.explode(rings.sides(F.col(shape))).alias("_s"))
    ends = sides.select(*keys, id, "_row", *[F.col(f"_s.{end}.{c}").cast("double").alias(f"_{end}{c}") for end in "ab" for c in "xy"])
    low, high = F.least("_ay", "_by"), F.greatest("_ay", "_by")
    lines = ends.withColumns({"y0": low, "y1": high}).withColumn("cy", F.explode(_span("y0", "y1", size)))
    middle = (F.col("cy") + 0.5) * size
    at = (F.col("_bx") - F.col("_ax")) * (middle - F.col("_ay")) / (F.col("_by") - F.col("_ay")) + F.col("_ax")
    line = Window.partitionBy("_row", "cy").orderBy("_x")
    paired = lines.select(*keys, id, "_row", "cy", at.alias("_x")).withColumns({"_n": F.row_number().over(line), "_next": F.lead("_x").over(line)})
    return (paired.where("_n % 2 = 1").select(*keys, id, "cy", _first(F.col("_x"), size).alias("c0"), _first(F.col("_next"), size).alias("c1"))
            .where("c0 < c1"))


def runs(shapes: DataFrame, keys: list[str], id: str, shape: str, size: float = 1.0, tile: int = TILE) -> DataFrame:
    """Disjoint runs (keys, cy, tile, c0, c1) of the cells that any shape of a group covers, cut at multiples of ``tile`` cells."""
    first, last = F.floor(F.col("c0") / tile), F.floor((F.col("c1") - 1) / tile)
    cut = spans(shapes, id, shape, size, keys).withColumn("tile", F.explode(F.sequence(first, last)))
    cut = cut.select(*keys, "cy", "tile", F.greatest("c0", F.col("tile") * tile).alias("c0"), F.least("c1", (F.col("tile") + 1) * tile).alias("c1")).distinct()
    line = Window.partitionBy(*keys, "cy", "tile").orderBy("c0", "c1")
    before = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("_new", F.coalesce(F.col("c0") > before, F.lit(True)).cast("int"))
    island = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "cy", "tile", "_run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_run")


def from_rings(shapes: DataFrame, id: str, shape: str, size: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Cells whose centre lies inside the rings, by scanlines."""
    return spans(shapes, id, shape, size, keys).select(*keys, id, F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("cx"), "cy")


def area(cells: DataFrame, by: list[str], size: float = 1.0) -> DataFrame:
    return cells.groupBy(*by).agg((F.count("*") * F.lit(float(size) ** 2)).alias("area"))


def overlay(a: DataFrame, b: DataFrame, id_a: str, id_b: str, keys: list[str] = ()) -> DataFrame:
    """Common cell count of every pair of regions that share one."""
    return (a.join(b, [*keys, "cx", "cy"]).groupBy(*keys, id_a, id_b).agg(F.count("*").alias("cells")))


def union(cells: DataFrame, region: str, keys: list[str] = ()) -> DataFrame:
    """Cells of the dissolved regions, every cell once per region."""
    return cells.select(*keys, region, "cx", "cy").distinct()


def dilate(cells: DataFrame, region: str, radius: int = 1, keys: list[str] = ()) -> DataFrame:
    """Regions grown by ``radius`` cells in every direction (square buffer).

    Cells meet as blocks of 8 x 8, one bit each: a block's bits are set before the shuffle, which sees one row per
    region and block that a task touches.
    """
    step = F.sequence(F.lit(-radius), F.lit(radius))
    grown = (cells.select(*keys, region, "cx", "cy", F.explode(step).alias("_dx")).withColumn("_dy", F.explode(step))
             .select(*keys, region, (F.col("cx") + F.col("_dx")).cast("long").alias("_x"), (F.col("cy") + F.col("_dy")).cast("long").alias("_y")))
    bit = F.expr("shiftleft(1L, CAST((_x & 7) | ((_y & 7) << 3) AS INT))")
    blocks = grown.groupBy(*keys, region, F.shiftright("_x", 3).alias("_bx"), F.shiftright("_y", 3).alias("_by")).agg(F.bit_or(bit).alias("_bits"))
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("_bits"), i) == 1)
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    return blocks.withColumn("_i", F.explode(there)).select(
        *keys, region, (F.col("_bx") * 8 + F.col("_i") % 8).cast(kinds["cx"]).alias("cx"),
        (F.col("_by") * 8 + F.floor(F.col("_i") / 8)).cast(kinds["cy"]).alias("cy"))


def boundary(cells: DataFrame, region: str, keys: list[str] = ()) -> DataFrame:
    """Directed unit edges between a region cell and an outside neighbour, region on the left.

    Each cell emits its four sides; a side shared by two cells of one region comes up in
    both directions and cancels in one aggregate, so no neighbour join is needed.
    """
    cx, cy = F.col("cx"), F.col("cy")
    corner = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    sides = [(corner(0, 0), corner(1, 0)), (corner(1, 0), corner(1, 1)), (corner(1, 1), corner(0, 1)), (corner(0, 1), corner(0, 0))]
    edges = F.array(*[F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a < b).alias("fwd")) for a, b in sides])
    return (cells.select(*keys, region, F.explode(edges).alias("_e"))
            .groupBy(*keys, region, F.col("_e.lo").alias("lo"), F.col("_e.hi").alias("hi"))
            .agg(F.count("*").alias("_n"), F.bool_or("_e.fwd").alias("fwd")).where(F.col("_n") == 1)
            .select(*keys, region, F.when(F.col("fwd"), F.col("lo")).otherwise(F.col("hi")).alias("a"),
                    F.when(F.col("fwd"), F.col("hi")).otherwise(F.col("lo")).alias("b")))
