"""Training data: chip filters, splits and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import bands, chips as chip_fn, names
from arborscan.session import cut_lineage

SEED = 42
_PRIME, _RANGE = 2654435761, 4294967296  # fixed values: multiplicative hash


def draw(id: Column, seed: int = 0) -> Column:
    """Reproducible number in [0, 1) from an integer id; the same on every run and partitioning."""
    bounded = F.pmod((id + seed).cast("long"), F.lit(2**31))  # keeps the product inside 64 bits
    return F.pmod(bounded * F.lit(_PRIME), F.lit(_RANGE)) / F.lit(float(_RANGE))


def mask_counts(chips: DataFrame, inset: int = 10) -> DataFrame:
    """Chips with the number of mask cells, of those inside the inset and of all cells."""
    return chips.withColumns({"mask_cells": chip_fn.nonzero(F.col("mask")),
                              "centre_cells": chip_fn.inset_count(F.col("mask"), F.col("w"), inset),
                              "all_cells": F.size("mask")})


def border_filter(chips: DataFrame, inset: int = 10, share: float = 0.001) -> DataFrame:
    """Chips with enough mask, most of it away from the border."""
    counted = mask_counts(chips, inset)
    return counted.where((F.col("mask_cells") > F.col("all_cells") * share)
                         & (F.col("centre_cells") > F.col("mask_cells") - F.col("centre_cells")))


def mask_filter(chips: DataFrame, components: DataFrame, id: str, pixels: int = 20, pass_chance: float = 0.0,
                seed: int = 0) -> DataFrame:
    """Chips with a markup component and a mask sum of at least 255 * ``pixels``.

    Each chip is exempt from the test with probability ``pass_chance``.
    """
    marked = components.select(id).distinct().withColumn("_marked", F.lit(True))
    mass = chip_fn.total(F.col("mask"))
    return (chips.join(marked, id, "left")
            .where((draw(F.col(id), seed) < pass_chance) | (F.col("_marked") & (mass >= 255 * pixels))).drop("_marked"))


def geo_label(min_y: Column, max_y: Column, low: Column, height: Column, test: Column | float = 0.2,
              val_bottom: Column | float = 0.2, val: Column | float = 0.3) -> Column:
    """test / val / train by position in the markup's y extent."""
    return (F.when(max_y < low + height * test, "test")
            .when((max_y < low + height * val) & (min_y > low + height * val_bottom), "val").otherwise("train"))


def geo_split(chips: DataFrame, markup: DataFrame, test: float = 0.2, val_bottom: float = 0.2, val: float = 0.3) -> DataFrame:
    """``split`` of each chip (columns y0, y1) by the markup's extent (y0, y1)."""
    extent = markup.agg(F.struct(F.min("y0").alias("low"), (F.max("y1") - F.min("y0")).alias("height"))).scalar()
    placed = chips.withColumn("_e", extent)
    return placed.withColumn("split", geo_label(F.col("y0"), F.col("y1"), F.col("_e.low"), F.col("_e.height"),
                                                test, val_bottom, val)).drop("_e")


def fold_split(chips: DataFrame, markup: DataFrame, folds: int, test: float = 0.3) -> DataFrame:
    """One geo split per fold with a validation band that slides down."""
    extent = markup.agg(F.struct(F.min("y0").alias("low"), (F.max("y1") - F.min("y0")).alias("height"))).scalar()
    fold = F.col("fold")
    width = F.lit((1 - test) / folds)
    placed = chips.withColumn("_e", extent).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    label = geo_label(F.col("y0"), F.col("y1"), F.col("_e.low"), F.col("_e.height"), test,
                      F.lit(1.0) - width * (fold + 1), F.lit(1.0) - width * fold)
    return placed.withColumn("split", label).drop("_e")


def random_split(chips: DataFrame, id: str, share: float, seed: int = SEED) -> DataFrame:
    """Each chip goes to val with probability ``share``."""
    return chips.withColumn("split", F.when(draw(F.col(id), seed) < share, "val").otherwise("train"))


def _smallest_share(df: DataFrame, strata: str, order: str, id: str, share: float) -> DataFrame:
    """Per stratum exactly round(share * n) rows with the smallest (order, id), as ids.

    ``order`` lies in [0, 1), so it cuts every stratum into 1024 even buckets: whole
    buckets below the cut are taken as they are, and only the bucket that holds the cut is
    ordered, so that one stratum with most rows never meets in one task.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(order) * 1024).cast("int"))
    by = Window.partitionBy(strata)
    sizes = (bucketed.groupBy(strata, "_b").agg(F.count("*").alias("_n"))
             .withColumns({"_before": F.sum("_n").over(by.orderBy("_b")) - F.col("_n"),
                           "_take": F.floor(F.sum("_n").over(by) * share + 0.5)}))
    cut = bucketed.join(sizes, [strata, "_b"])
    whole = cut.where(F.col("_before") + F.col("_n") <= F.col("_take")).select(id)
    edge = cut.where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") > F.col("_take")))
    place = F.row_number().over(Window.partitionBy(strata, "_b").orderBy(order, id))
    return whole.unionByName(edge.withColumn("_r", place).where(F.col("_before") + F.col("_r") <= F.col("_take")).select(id))


def stratified_split(chips: DataFrame, id: str, strata: str, test: float, val: float, seed: int = SEED) -> DataFrame:
    """Exact shares per stratum: test from all rows, then val from the rest."""
    # the ids are read several times below, so whatever computed the strata runs once
    drawn = cut_lineage(chips.select(id, strata, draw(F.col(id), seed).alias("_d")))
    test_ids = _smallest_share(drawn, strata, "_d", id, test).withColumn("split", F.lit("test"))
    rest = drawn.join(test_ids, id, "left_anti").withColumn("_d", draw(F.col(id), seed + 1))
    val_ids = _smallest_share(rest, strata, "_d", id, val).withColumn("split", F.lit("val"))
    return (chips.join(test_ids.unionByName(val_ids), id, "left").withColumn("split", F.coalesce("split", F.lit("train"))))


def split_sizes(splits: DataFrame) -> DataFrame:
    """Chip counts per dataset and split with subtotals (null = all)."""
    return splits.rollup("dataset_folder", "split").agg(F.count("*").alias("chips"))


def variant(id: Column, epoch: Column | int, seed: int = 0) -> Column:
    """0..7: quarter turns in the low two bits, mirroring in the third."""
    return F.floor(draw(id * 97 + epoch, seed) * 8).cast("int")


def turn_and_flip(cells: Column, w: Column, h: Column, kind: Column) -> Column:
    """Rotate a square chip by ``kind % 4`` quarter turns and mirror it when ``kind >= 4``.

    Applying it to image and mask with one ``kind`` keeps them aligned.
    """
    def source(x: Column, y: Column) -> tuple[Column, Column]:
        mx = F.when(kind >= 4, w - 1 - x).otherwise(x)
        turn = kind % 4
        sx = F.when(turn == 0, mx).when(turn == 1, y).when(turn == 2, w - 1 - mx).otherwise(h - 1 - y)
        sy = F.when(turn == 0, y).when(turn == 1, w - 1 - mx).when(turn == 2, h - 1 - y).otherwise(mx)
        return sx, sy

    return chip_fn.remap(cells, w, h, source)


def crop_resize(cells: Column, w: Column, h: Column, share: Column, off_x: Column, off_y: Column) -> Column:
    """A window of ``share`` of the side, placed by offsets in [0, 1), stretched back to full size (nearest cell)."""
    side_x, side_y = F.greatest(F.floor(w * share), F.lit(1)), F.greatest(F.floor(h * share), F.lit(1))
    start_x, start_y = F.floor((w - side_x + 1) * off_x), F.floor((h - side_y + 1) * off_y)
    return chip_fn.remap(cells, w, h, lambda x, y: (start_x + F.floor(x * side_x / w), start_y + F.floor(y * side_y / h)))


def shift_rgb(cells: Column, band: Column, id: Column, epoch: Column | int, limit: int = 20, seed: int = 0) -> Column:
    """One random offset per chip and colour band, saturated to 0..255; other bands stay."""
    offset = F.floor((draw(id * 31 + band * 7 + epoch, seed) * 2 - 1) * limit)
    return F.when(band < 3, F.transform(cells, lambda v: F.least(F.greatest(v + offset, F.lit(0.0)), F.lit(255.0)))).otherwise(cells)


def chip_names(files: DataFrame, column: str = "file_name") -> DataFrame:
    """dataset_folder, name and position of chip files such as ``scene_a_3_4.tiff``."""
    stem = F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]*$", "")
    name, position = names.split_chip_name(stem)
    return files.select(name.alias("dataset_folder"), name.alias("name"), position.alias("position"))


def image_pairs(index: DataFrame, images: DataFrame, masks: DataFrame, channels: list[str]) -> DataFrame:
    """Image (chosen bands) and mask of every index row, joined on (name, position)."""
    key = ["name", "position"]
    chosen = images.select(*key, bands.select_channels(F.col("stack"), channels).alias("image"))
    return index.join(chosen, key).join(masks.select(*key, "mask"), key)


def markup_until(markup: DataFrame, image_date: str, order: str) -> DataFrame:
    """Markup dated up to one day after the image.

    When none is as old as the image, the date of the first markup row (by ``order``) counts.
    """
    day = F.lit(image_date).cast("date")
    known = markup.agg(F.when(F.count_if(F.col("img_date") <= day) > 0, day)
                       .otherwise(F.min_by("img_date", order)).alias("d")).scalar()
    return markup.where(F.col("img_date") <= F.date_add(known, 1))


def markup_in_state(markup: DataFrame, state: str | None) -> DataFrame:
    """Markup of one state; None keeps all, anything else is an error."""
    if state is None:
        return markup
    if state not in ("open", "overgrown"):
        raise ValueError(f'unknown state {state!r}: "open" or "overgrown" is available')
    return markup.where(F.col("state") == state)
