"""Segmentation scores. Chips carry ``pred`` and ``truth`` as arrays, so a chip's score is
computed on its own row and only scores travel to the averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import probs
from arborscan.functions.chips import total

EPS = 1e-7
THRESHOLDS = range(50, 100, 5)  # IoU thresholds in hundredths


def _sums(pred: Column, truth: Column) -> tuple[Column, Column, Column]:
    return total(F.zip_with(pred, truth, lambda p, t: p * t)), total(pred), total(truth)


def above(pred: Column, threshold: float) -> Column:
    """0/1 array."""
    return F.transform(pred, lambda p: (p > threshold).cast("double"))


def dice(pred: Column, truth: Column, empty: float | None = 1.0) -> Column:
    """(2 * common + 1e-7) / (sum + sum); ``empty`` is the score of two empty masks, None gives infinity."""
    common, p, t = _sums(pred, truth)
    none = F.lit(float("inf") if empty is None else empty)
    return F.coalesce((2.0 * common + EPS) / F.nullif(p + t, F.lit(0.0)), none)


def iou(pred: Column, truth: Column, smooth: float = 1.0) -> Column:
    common, p, t = _sums(pred, truth)
    return (common + smooth) / (p + t - common + smooth)


def chip_scores(chips: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Chips with ``dice`` and ``iou`` of the thresholded prediction."""
    binary = chips.withColumn("_b", above(F.col("pred"), threshold))
    return binary.withColumns({"dice": dice(F.col("_b"), F.col("truth")), "iou": iou(F.col("_b"), F.col("truth"))}).drop("_b")


def mean_dice(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(F.avg("dice"), 4).alias("dice"))


def is_instance(label: Column) -> Column:
    """Labels of segments: 0 is none, 255 the background; from the 255th seed on they run from 256."""
    return (label > 0) & (label != 255)


def label_overlaps(cells: DataFrame, keys: list[str]) -> DataFrame:
    """IoU of every (label, instance) pair of a chip that shares a cell, with both sizes.

    ``cells``: keys, label, instance (0 = none). A pair without a common cell has IoU
    1 / (sizes + 1), which never exceeds one third.
    """
    joint = cells.groupBy(*keys, "label", "instance").agg(F.count("*").alias("common"))
    # a chip's labels and their instances
    sized = joint.withColumns({"label_cells": F.sum("common").over(Window.partitionBy(*keys, "label")),
                               "instance_cells": F.sum("common").over(Window.partitionBy(*keys, "instance"))})
    value = (F.col("common") + 1) / (F.col("label_cells") + F.col("instance_cells") - F.col("common") + 1)
    return sized.withColumn("iou", value)


def iou_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    overlaps = label_overlaps(cells, keys)
    return overlaps.where(is_instance(F.col("label")) & (F.col("instance") > 0)).select(
        *keys, "label", "instance", "common", "label_cells", "instance_cells", "iou")


def dice_at_thresholds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per chip the mean over IoU thresholds of 2TP / (2TP + FP + FN).

    A label counts as TP when its best instance exceeds the threshold, as FP otherwise; an
    instance is FN when no label exceeds it. No labels and no instances score 1, no labels 0.
    """
    overlaps = label_overlaps(cells, keys)
    real = is_instance(F.col("label")) & (F.col("instance") > 0)
    rows = (overlaps.where(is_instance(F.col("label"))).groupBy(*keys, "label")
            .agg(F.coalesce(F.max(F.when(real, F.col("iou"))), F.lit(0.0)).alias("best")).select(*keys, F.lit("row").alias("side"), "best"))
    columns = (overlaps.where(F.col("instance") > 0).groupBy(*keys, "instance")
               .agg(F.coalesce(F.max(F.when(real, F.col("iou"))), F.lit(0.0)).alias("best")).select(*keys, F.lit("column").alias("side"), "best"))
    chips = cells.select(*keys).distinct().select(*keys, F.lit("chip").alias("side"), F.lit(0.0).alias("best"))
    row, column = F.col("side") == "row", F.col("side") == "column"
    scores = []
    for hundredths in THRESHOLDS:
        limit = hundredths / 100
        tp = F.count_if(row & (F.col("best") > limit))
        fp = F.count_if(row & (F.col("best") <= limit))
        fn = F.count_if(column & (F.col("best") <= limit))
        scores.append(F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(1.0)))
    mean = sum(scores[1:], scores[0]) / len(scores)
    return (rows.unionByName(columns).unionByName(chips).groupBy(*keys)
            .agg(F.when(F.count_if(row | column) == 0, 1.0).when(F.count_if(row) == 0, 0.0).otherwise(mean).alias("dice")))


def soft_dice(cells: DataFrame, by: list[str], classes: tuple = (1, 2)) -> DataFrame:
    """Mean over classes of (2 * sum(p * t) + eps) / (sum(p + t) + eps); cells carry ``p`` and class ``t``."""
    parts = []
    for c in classes:
        p, hit = F.col("p")[c], (F.col("t") == c).cast("double")
        parts.append((2.0 * F.sum(p * hit) + EPS) / (F.sum(p + hit) + EPS))
    return cells.groupBy(*by).agg((sum(parts[1:], parts[0]) / len(parts)).alias("dice"))


def confusion(cells: DataFrame, labels: tuple = (1, 2)) -> DataFrame:
    """One-vs-rest counts and dice per label; cells carry predicted class ``c`` and truth ``t``.

    Counting (c, t) pairs first leaves a handful of rows for the per-label sums.
    """
    pairs = cells.groupBy("c", "t").agg(F.count("*").alias("n"))
    each = pairs.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    said, true = F.col("c") == F.col("label"), F.col("t") == F.col("label")
    count = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    out = each.groupBy("label").agg(count(~said & ~true).alias("tn"), count(said & ~true).alias("fp"),
                                    count(~said & true).alias("fn"), count(said & true).alias("tp"))
    return out.withColumn("dice", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def clear_dice(cells: DataFrame, by: list[str]) -> DataFrame:
    """Dice of p1 + p2 > 0.5 against any non-zero class."""
    p = ((F.col("p")[1] + F.col("p")[2]) > 0.5).cast("double")
    t = (F.col("t") != 0).cast("double")
    return cells.groupBy(*by).agg(F.coalesce((2.0 * F.sum(p * t) + EPS) / F.nullif(F.sum(p) + F.sum(t), F.lit(0.0)), F.lit(1.0)).alias("dice"))


def fold_mean(predictions: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """Cell-wise sum of fold predictions (0..255) over ``folds``: the exact ``mean`` and its truncated ``byte``."""
    return (predictions.groupBy(*keys).agg((F.sum("v") / folds).alias("mean"))
            .withColumn("byte", F.floor("mean").cast("int")))


def bce_dice(chips: DataFrame, by: list[str], weight: float = 0.5, eps: float = 1.0, bootstrapped: bool = False) -> DataFrame:
    """weight * BCE + (1 - weight) * (1 - dice) of logits ``x`` against ``truth``, averaged over all cells of a group."""
    pair = F.zip_with("x", "truth", lambda x, t: F.struct(
        probs.bce_with_logits(x, probs.bootstrapped_target(x, t) if bootstrapped else t).alias("b"),
        (probs.sigmoid(x) * t).alias("pt"), probs.sigmoid(x).alias("p"), t.alias("t")))
    part = chips.select(*by, pair.alias("s")).select(
        *by, F.size("s").alias("n"), *[total(F.col(f"s.{c}")).alias(c) for c in ("b", "pt", "p", "t")])
    sums = part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "b", "pt", "p", "t")])
    overlap = 2.0 * F.col("pt") / (F.col("p") + F.col("t") + eps)
    return sums.select(*by, (F.col("b") / F.col("n") * weight + (1.0 - overlap) * (1 - weight)).alias("loss"))


def ce_dice(cells: DataFrame, by: list[str], weight: float = 0.2) -> DataFrame:
    """weight * cross entropy + (1 - weight) * (1 - soft dice)."""
    own = F.get("p", F.col("t"))
    entropy = cells.groupBy(*by).agg(F.avg(-F.log(own)).alias("ce"))
    return entropy.join(soft_dice(cells, by), by).select(*by, (F.col("ce") * weight + (1.0 - F.col("dice")) * (1 - weight)).alias("loss"))


def squared_error(chips: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean squared difference of two cell arrays."""
    gap = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    part = chips.select(*by, F.size(a).alias("n"), total(gap).alias("s"))
    return part.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mse"))


def confident(chips: DataFrame, confidence: float = 0.8, threshold: float = 0.3, mass: float = 50.0) -> DataFrame:
    """Chips whose prediction is decided enough to serve as a label; adds ``confidence`` and ``mask``."""
    count = lambda keep: F.size(F.filter("pred", keep))
    unsure = count(lambda p: (p > 0.3) & (p < 0.7))
    value = F.lit(1.0) - unsure / (count(lambda p: p > 0.5) + EPS)
    scored = chips.withColumn("confidence", value)
    return (scored.where((F.col("confidence") > confidence) & (total(F.filter("pred", lambda p: p > threshold)) > mass))
            .withColumn("mask", above(F.col("pred"), threshold)))


def season_scores(log: DataFrame) -> DataFrame:
    """Per epoch: share of right season calls, mean joint loss and mean dice.

    ``log``: epoch, p, season (0/1), segmentation_loss, dice.
    """
    right = ((F.col("p") > 0.5).cast("int") == F.col("season")).cast("double")
    joint = 0.8 * F.col("segmentation_loss") + 0.2 * probs.bce(F.col("p"), F.col("season"))
    return log.groupBy("epoch").agg(F.avg(right).alias("accuracy"), F.avg(joint).alias("loss"), F.avg("dice").alias("dice"))


def best_epoch(epochs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Epoch with the highest validation dice, the first one on ties."""
    order = F.struct("dice_score", (-F.col("epoch")).alias("_n"))
    return epochs.groupBy(*by).agg(F.max_by(F.struct("epoch", *values), order).alias("_b")).select(*by, "_b.*")
