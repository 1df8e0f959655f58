"""Scores, records, splits and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan.functions import names
from arborscan.operators import datasets, metrics, rasters, stats
from arborscan.plans import dataset
from arborscan.queries.raster import CHIP, _PATCH, _PROB, _R, _TRUTH, _WIDE, _chips, _class_scores, _patches, _prob, _scene, _wide, _with_truth
from arborscan.queries.registry import Tables, query
from arborscan.session import work_folder
from arborscan.sources import chips as chip_files

_PT = f"""{_TRUTH}, pt AS (SELECT p.chip_id, p.scene, p.band, p.x, p.y, p.v, {_PROB.replace('v -', 'p.v -')} AS p, m.t FROM v_pixels p JOIN m ON p.chip_id = m.chip_id AND p.x = m.x AND p.y = m.y)"""
_DICE = """(2.0 * sum(b * t) + 1e-7) / (sum(b) + sum(t))"""


def _predicted(t: Tables):
    return _with_truth(t).withColumn("pred", _prob())


_SCORES = f"{_PT}, s AS (SELECT chip_id, CASE WHEN sum(b) + sum(t) = 0 THEN 1 ELSE {_DICE} END AS dice, (sum(b * t) + 1.0) / (sum(b) + sum(t) - sum(b * t) + 1.0) AS iou FROM (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS b FROM pt) q GROUP BY chip_id)"


@query("dice_chip", f"WITH {_SCORES} SELECT chip_id, round(dice, 6) AS dice FROM s")
def dice_chip(t: Tables):
    return metrics.chip_scores(_predicted(t), 0.5).select("chip_id", F.round("dice", 6).alias("dice"))


@query("iou_chip", f"WITH {_SCORES} SELECT chip_id, round(iou, 6) AS iou FROM s")
def iou_chip(t: Tables):
    return metrics.chip_scores(_predicted(t), 0.5).select("chip_id", F.round("iou", 6).alias("iou"))


@query("prediction_truth_join", f"WITH {_SCORES} SELECT round(avg(dice), 4) AS dice FROM s")
def prediction_truth_join(t: Tables):
    """Predictions and masks aligned by name and position, then averaged."""
    position = F.concat(F.lit("N_0_"), F.col("chip_id").cast("string"), F.lit("_0"))
    name, place = names.split_chip_name(position)
    predictions = _chips(t).select(name.alias("name"), place.alias("position"), _prob().alias("pred"))
    masks = _with_truth(t).select(name.alias("name"), place.alias("position"), "truth")
    return metrics.mean_dice(metrics.chip_scores(predictions.join(masks, ["name", "position"]), 0.5))


_LABELS = """l AS (SELECT a.chip_id, CASE WHEN a.v >= 100 THEN a.v // 10 - 9 ELSE 0 END AS label, CASE WHEN b.v >= 100 THEN b.v // 10 - 9 ELSE 0 END AS instance
 FROM v_pixels a JOIN v_pixels b ON b.chip_id = a.chip_id + 1 AND a.x = b.x AND a.y = b.y),
 n AS (SELECT chip_id, label, instance, count(*) AS common FROM l GROUP BY ALL),
 o AS (SELECT *, sum(common) OVER (PARTITION BY chip_id, label) AS label_cells, sum(common) OVER (PARTITION BY chip_id, instance) AS instance_cells FROM n),
 i AS (SELECT *, (common + 1) / CAST(label_cells + instance_cells - common + 1 AS DOUBLE) AS iou FROM o)"""


def _label_cells(t: Tables):
    """Grey-level classes of a chip as labels, those of the next chip as instances."""
    grade = lambda c: F.transform(c, lambda v: F.when(v >= 100, F.floor(v / 10) - 9).otherwise(0))
    chips = _chips(t)
    after = chips.select((F.col("chip_id") - 1).alias("chip_id"), grade("cells").alias("instance"))
    both = chips.select("chip_id", "w", "h", grade("cells").alias("label")).join(after, "chip_id")
    return rasters.to_cells(both, ["label", "instance"])


@query("iou_matrix", f"""
WITH {_LABELS} SELECT chip_id, label, instance, common, CAST(label_cells AS BIGINT) AS label_cells, CAST(instance_cells AS BIGINT) AS instance_cells, round(iou, 6) AS iou
FROM i WHERE label > 0 AND instance > 0""")
def iou_matrix(t: Tables):
    return metrics.iou_matrix(_label_cells(t), CHIP).withColumn("iou", F.round("iou", 6))


@query("unique_labels", f"WITH {_LABELS} SELECT DISTINCT chip_id, label FROM l WHERE label > 0 AND label < 255")
def unique_labels(t: Tables):
    return _label_cells(t).select("chip_id", "label").where(metrics.is_instance(F.col("label"))).distinct()


@query("dice_at_iou_thresholds", f"""
WITH {_LABELS}, a AS (SELECT chip_id, label, max(CASE WHEN instance > 0 THEN iou ELSE 0 END) AS best FROM i WHERE label > 0 GROUP BY ALL),
 b AS (SELECT chip_id, instance, max(CASE WHEN label > 0 THEN iou ELSE 0 END) AS best FROM i WHERE instance > 0 GROUP BY ALL),
 c AS (SELECT DISTINCT chip_id FROM l), th AS (SELECT unnest(range(50, 100, 5)) / 100.0 AS th),
 r AS (SELECT c.chip_id, th.th, (SELECT count(*) FROM a WHERE a.chip_id = c.chip_id AND best > th.th) AS tp, (SELECT count(*) FROM a WHERE a.chip_id = c.chip_id AND best <= th.th) AS fp,
  (SELECT count(*) FROM b WHERE b.chip_id = c.chip_id AND best <= th.th) AS fn FROM c, th)
SELECT chip_id, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END), 6) AS dice FROM r GROUP BY chip_id""")
def dice_at_iou_thresholds(t: Tables):
    return metrics.dice_at_thresholds(_label_cells(t), CHIP).withColumn("dice", F.round("dice", 6))


_CLS = f"""{_WIDE}, e AS (SELECT scene, exp((b0 - 100) / 20) AS e0, exp((b1 - 100) / 20) AS e1, exp((b2 - 100) / 20) AS e2, CASE WHEN b3 < 95 THEN 0 WHEN b3 < 105 THEN 1 ELSE 2 END AS t FROM w),
 c AS (SELECT scene, t, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS c FROM e)"""
_SOFT = """(2.0 * sum(p{k} * (CASE WHEN t = {k} THEN 1 ELSE 0 END)) + 1e-7) / (sum(p{k} + (CASE WHEN t = {k} THEN 1 ELSE 0 END)) + 1e-7)"""
_SOFT2 = f"({_SOFT.format(k=1)} + {_SOFT.format(k=2)}) / 2"


@query("multiclass_soft_dice", f"WITH {_CLS} SELECT scene, round({_SOFT2}, 6) AS dice FROM c GROUP BY scene")
def multiclass_soft_dice(t: Tables):
    return metrics.soft_dice(_class_scores(t), ["scene"]).withColumn("dice", F.round("dice", 6))


@query("confusion_matrix", f"""
WITH {_CLS} SELECT k AS label, count(*) FILTER (WHERE c <> k AND t <> k) AS tn, count(*) FILTER (WHERE c = k AND t <> k) AS fp, count(*) FILTER (WHERE c <> k AND t = k) AS fn,
 count(*) FILTER (WHERE c = k AND t = k) AS tp, round(2.0 * count(*) FILTER (WHERE c = k AND t = k) / (count(*) FILTER (WHERE c = k) + count(*) FILTER (WHERE t = k)), 6) AS dice
FROM c, (SELECT unnest([1, 2]) AS k) GROUP BY k""")
def confusion_matrix(t: Tables):
    from arborscan.functions import probs
    return metrics.confusion(_class_scores(t).withColumn("c", probs.argmax(F.col("p")))).withColumn("dice", F.round("dice", 6))


@query("binary_from_multiclass_dice", f"""
WITH {_CLS}, q AS (SELECT scene, CASE WHEN p1 + p2 > 0.5 THEN 1 ELSE 0 END AS b, CASE WHEN t <> 0 THEN 1 ELSE 0 END AS t FROM c) SELECT scene, round({_DICE}, 6) AS dice FROM q GROUP BY scene""")
def binary_from_multiclass_dice(t: Tables):
    return metrics.clear_dice(_class_scores(t), ["scene"]).withColumn("dice", F.round("dice", 6))


@query("fold_ensemble_mean", "SELECT scene, x, y, CAST(floor(sum(v * 2) / 9.0) AS INTEGER) AS byte, sum(v * 2) / 9.0 / 255 > 0.5 AS marked FROM v_pixels GROUP BY ALL")
def fold_ensemble_mean(t: Tables):
    """The nine bands of a scene stand for nine folds."""
    folds = rasters.to_cells(_chips(t).select("scene", "w", "h", F.transform("cells", lambda v: v * 2).alias("v")), ["v"])
    mean = metrics.fold_mean(folds, ["scene", "x", "y"], 9)
    return mean.select("scene", "x", "y", "byte", (F.col("mean") / 255 > 0.5).alias("marked"))


_LOG = """g AS (SELECT o_orderkey % 20 AS epoch, (o_custkey % 99 + 0.5) / 100.0 AS p, o_orderkey % 3 % 2 AS season, CAST(round(o_totalprice) AS BIGINT) % 1000 / 1000.0 AS seg FROM orders)"""


def _log(t: Tables):
    o = t.table("orders")
    loss = F.round("o_totalprice").cast("long") % 1000 / 1000
    return o.select((F.col("o_orderkey") % 20).alias("epoch"), ((F.col("o_custkey") % 99 + 0.5) / 100).alias("p"),
                    (F.col("o_orderkey") % 3 % 2).alias("season"), loss.alias("segmentation_loss"), (1 - loss).alias("dice"))


@query("season_accuracy", f"WITH {_LOG} SELECT epoch, round(avg(CASE WHEN (p > 0.5) = (season = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(1 - seg), 6) AS dice FROM g GROUP BY epoch")
def season_accuracy(t: Tables):
    return metrics.season_scores(_log(t)).select("epoch", F.round("accuracy", 6).alias("accuracy"), F.round("dice", 6).alias("dice"))


@query("season_joint_score", f"WITH {_LOG} SELECT epoch, round(avg(0.8 * seg - 0.2 * (season * ln(p) + (1 - season) * ln(1 - p))), 6) AS loss FROM g GROUP BY epoch")
def season_joint_score(t: Tables):
    return metrics.season_scores(_log(t)).select("epoch", F.round("loss", 6).alias("loss"))


@query("best_epoch", """
SELECT run, epoch, dice_score FROM (SELECT run_id // 20 AS run, epoch, dice_score, row_number() OVER (PARTITION BY run_id // 20 ORDER BY dice_score DESC, epoch) AS r FROM v_epochs) q WHERE r = 1""")
def best_epoch(t: Tables):
    return metrics.best_epoch(t.view("epochs").withColumn("run", F.floor(F.col("run_id") / 20)), ["run"], ["dice_score"])


_LOGIT = "x AS (SELECT chip_id, (v - 100) / 10.0 AS x, t, 1 / (1 + exp(-(v - 100) / 10.0)) AS s FROM pt)"


def _logits(t: Tables):
    return _with_truth(t).withColumn("x", F.transform("cells", lambda v: (v - 100) / 10))


@query("bce_dice_score", f"""
WITH {_PT}, {_LOGIT} SELECT chip_id, round(avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * 0.2 + (1 - 2 * sum(s * t) / (sum(s) + sum(t) + 1)) * 0.8, 6) AS loss FROM x GROUP BY chip_id""")
def bce_dice_score(t: Tables):
    return metrics.bce_dice(_logits(t), CHIP, 0.2).withColumn("loss", F.round("loss", 6))


@query("bootstrapped_bce_score", f"""
WITH {_PT}, {_LOGIT} SELECT chip_id, round(avg(greatest(x, 0) - x * (0.95 * t + 0.05 * s) + ln(1 + exp(-abs(x)))) * 0.5 + (1 - 2 * sum(s * t) / (sum(s) + sum(t) + 1)) * 0.5, 6) AS loss FROM x GROUP BY chip_id""")
def bootstrapped_bce_score(t: Tables):
    return metrics.bce_dice(_logits(t), CHIP, 0.5, bootstrapped=True).withColumn("loss", F.round("loss", 6))


@query("multiclass_ce_dice_score", f"""
WITH {_CLS} SELECT scene, round(0.2 * avg(-ln(CASE t WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) + 0.8 * (1 - {_SOFT2}), 6) AS loss FROM c GROUP BY scene""")
def multiclass_ce_dice_score(t: Tables):
    return metrics.ce_dice(_class_scores(t), ["scene"]).withColumn("loss", F.round("loss", 6))


@query("reconstruction_mse", """
WITH g AS (SELECT *, scene + scene // 5 AS step FROM v_pixels),
 st AS (SELECT band, step, lag(step) OVER (PARTITION BY band ORDER BY step) AS before FROM (SELECT DISTINCT band, step FROM g))
SELECT c.band, round(avg((c.v - p.v) * (c.v - p.v)), 6) AS mse FROM g c JOIN st ON st.band = c.band AND st.step = c.step
 JOIN g p ON p.band = c.band AND p.step = st.before AND c.x = p.x AND c.y = p.y GROUP BY c.band""")
def reconstruction_mse(t: Tables):
    steps = _chips(t).withColumn("step", F.expr("scene + scene DIV 5"))  # scenes with gaps
    pairs = rasters.previous_chip(steps, ["band"], "step")
    return metrics.squared_error(pairs, ["band"], "cells", "previous").withColumn("mse", F.round("mse", 6))


_STEEP = "least(1, greatest(0, (v - 95) / 8.0))"
_SURE = f"""q AS (SELECT chip_id, {_STEEP} AS p FROM v_pixels),
 f AS (SELECT chip_id, 1 - count(*) FILTER (WHERE p > 0.3 AND p < 0.7) / (count(*) FILTER (WHERE p > 0.5) + 1e-7) AS confidence, count(*) FILTER (WHERE p > 0.3) AS marked,
  sum(CASE WHEN p > 0.3 THEN p ELSE 0 END) AS mass FROM q GROUP BY chip_id)"""


def _sure(t: Tables):
    pred = F.transform("cells", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - 95) / 8)))
    return metrics.confident(_chips(t).withColumn("pred", pred), mass=20.0, confidence=0.5)


@query("pseudo_label_select", f"WITH {_SURE} SELECT chip_id, round(confidence, 6) AS confidence, CAST(marked AS INTEGER) AS marked FROM f WHERE confidence > 0.5 AND mass > 20")
def pseudo_label_select(t: Tables):
    from arborscan.functions import chips as chip_fn
    return _sure(t).select("chip_id", F.round("confidence", 6).alias("confidence"), chip_fn.nonzero(F.col("mask")).alias("marked"))


@query("pseudo_label_append", f"""
WITH {_SURE} SELECT concat('S', scene) AS dataset_folder, concat('S', scene) AS name, concat(band, '_0') AS position FROM v_pixels WHERE x = 0 AND y = 0
UNION ALL SELECT 'pseudo-labeled', 'U', concat(chip_id, '_0') FROM f WHERE confidence > 0.5 AND mass > 20""")
def pseudo_label_append(t: Tables):
    scene = F.concat(F.lit("S"), F.col("scene").cast("string"))
    train = _chips(t).select(scene.alias("dataset_folder"), scene.alias("name"), F.concat(F.col("band").cast("string"), F.lit("_0")).alias("position"))
    accepted = _sure(t).select(F.lit("U").alias("name"), F.concat(F.col("chip_id").cast("string"), F.lit("_0")).alias("position"))
    return dataset.append_pseudo_labels(train, accepted)


def _records(t: Tables):
    chips = _predicted(t)
    scored = metrics.chip_scores(chips, 0.5)
    name = F.concat(F.lit("c"), F.col("chip_id").cast("string"))
    to_bytes = chip_files.to_bytes
    return scored.select(F.col("h").cast("long").alias("img_height"), F.col("w").cast("long").alias("img_width"),
                         F.col("dice").alias("dice_score"), F.lit(0.0).alias("metric"), to_bytes(F.col("cells")).alias("img_raw"),
                         to_bytes(F.transform("truth", lambda v: v * 255)).alias("mask_raw"),
                         to_bytes(F.transform("pred", lambda v: F.floor(v * 255))).alias("pred_raw"),
                         name.alias("img_name"), name.alias("msk_name"), name.alias("pred_name"))


def _stored_records(t: Tables):
    """The records as a stored table holds them."""
    folder = work_folder(t.spark, "records")
    chip_files.write_records(_records(t), folder)
    return chip_files.read_records(t.spark, folder)


@query("eval_record_sink", f"""
WITH {_SCORES} SELECT concat('c', chip_id) AS img_name, CAST(8 AS BIGINT) AS img_height, CAST(8 AS BIGINT) AS img_width, round(dice, 6) AS dice_score,
 (SELECT string_agg(printf('%02X', p.v), '' ORDER BY p.y, p.x) FROM v_pixels p WHERE p.chip_id = s.chip_id) AS image FROM s""")
def eval_record_sink(t: Tables):
    return _stored_records(t).select("img_name", "img_height", "img_width", F.round("dice_score", 6).alias("dice_score"), F.hex("img_raw").alias("image"))


@query("eval_record_scan", f"""
WITH {_PT} SELECT concat('c', chip_id) AS img_name, CAST(sum(v) AS BIGINT) AS image_sum, CAST(sum(t) * 255 AS BIGINT) AS mask_sum FROM pt GROUP BY chip_id""")
def eval_record_scan(t: Tables):
    """Binary columns decoded again."""
    add = lambda c: F.aggregate(chip_files.from_bytes(F.col(c)), F.lit(0).cast("long"), lambda a, v: a + v)
    return _stored_records(t).select("img_name", add("img_raw").alias("image_sum"), add("mask_raw").alias("mask_sum"))


@query("dice_band_page", f"""
WITH {_SCORES}, k AS (SELECT chip_id, round(dice, 6) AS dice FROM s WHERE abs(dice - 0.5) < 0.1), r AS (SELECT *, row_number() OVER (ORDER BY dice, chip_id) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT chip_id, dice, CAST(i // 10 AS BIGINT) AS page, CAST(ceil(n / 10.0) AS BIGINT) AS pages FROM r""")
def dice_band_page(t: Tables):
    near = metrics.chip_scores(_predicted(t), 0.5).where(F.abs(F.col("dice") - 0.5) < 0.1).select("chip_id", F.round("dice", 6).alias("dice"))
    return stats.paged(near, "dice", "chip_id", 10)


# ---- splits and training data

_EXT = "e AS (SELECT min(y0) AS low, max(y1) - min(y0) AS height FROM v_masks WHERE kind = 'forest')"


def _geo(t: Tables):
    return t.view("detections").select("det_id", "tile_id", "y0", "y1"), t.view("masks").where("kind = 'forest'")


@query("geo_split", f"""
WITH {_EXT} SELECT det_id, CASE WHEN y1 < low + height * CAST(0.2 AS DOUBLE) THEN 'test' WHEN y1 < low + height * CAST(0.3 AS DOUBLE) AND y0 > low + height * CAST(0.2 AS DOUBLE) THEN 'val' ELSE 'train' END AS split FROM v_detections, e""")
def geo_split(t: Tables):
    chips, markup = _geo(t)
    return datasets.geo_split(chips, markup).select("det_id", "split")


@query("fold_split", f"""
WITH {_EXT}, k AS (SELECT unnest(range(0, 4)) AS fold) SELECT det_id, CAST(fold AS INTEGER) AS fold, CASE WHEN y1 < low + height * CAST(0.3 AS DOUBLE) THEN 'test'
 WHEN y1 < low + height * (CAST(1 AS DOUBLE) - CAST(0.175 AS DOUBLE) * fold) AND y0 > low + height * (CAST(1 AS DOUBLE) - CAST(0.175 AS DOUBLE) * (fold + 1)) THEN 'val' ELSE 'train' END AS split FROM v_detections, e, k""")
def fold_split(t: Tables):
    chips, markup = _geo(t)
    return datasets.fold_split(chips, markup, 4).select("det_id", "fold", "split")


@query("random_split", """
SELECT det_id, CASE WHEN ((det_id + 42) * 2654435761) % 4294967296 / 4294967296.0 < 0.25 THEN 'val' ELSE 'train' END AS split FROM v_detections""")
def random_split(t: Tables):
    return datasets.random_split(t.view("detections").select("det_id"), "det_id", 0.25).select("det_id", "split")


_STRAT = """q AS (SELECT quantile_cont(area, 0.25) AS a, quantile_cont(area, 0.5) AS b, quantile_cont(area, 0.75) AS c FROM v_markup),
 s AS (SELECT markup_id, CASE WHEN area < a THEN 0 WHEN area < b THEN 1 WHEN area < c THEN 2 ELSE 3 END AS label FROM v_markup, q),
 t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((markup_id + 42) * 2654435761) % 4294967296, markup_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s),
 u AS (SELECT markup_id, label FROM t WHERE r > floor(n * 0.2 + 0.5)),
 v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((markup_id + 43) * 2654435761) % 4294967296, markup_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM u),
 z AS (SELECT markup_id, label, 'test' AS split FROM t WHERE r <= floor(n * 0.2 + 0.5) UNION ALL SELECT markup_id, label, CASE WHEN r <= floor(n * 0.25 + 0.5) THEN 'val' ELSE 'train' END FROM v)"""


def _stratified(t: Tables):
    labelled = stats.quartile_label(t.view("markup").select("markup_id", "area"), "area")
    return datasets.stratified_split(labelled, "markup_id", "label", 0.2, 0.25)


@query("stratified_split", f"WITH {_STRAT} SELECT markup_id, label, split FROM z")
def stratified_split(t: Tables):
    return _stratified(t).select("markup_id", "label", "split")


@query("split_size_report", f"""
WITH {_EXT}, g AS (SELECT CAST(tile_id AS VARCHAR) AS dataset_folder, CASE WHEN y1 < low + height * CAST(0.2 AS DOUBLE) THEN 'test' WHEN y1 < low + height * CAST(0.3 AS DOUBLE) AND y0 > low + height * CAST(0.2 AS DOUBLE) THEN 'val' ELSE 'train' END AS split FROM v_detections, e)
SELECT dataset_folder, split, count(*) AS chips FROM g GROUP BY ROLLUP (dataset_folder, split)""")
def split_size_report(t: Tables):
    chips, markup = _geo(t)
    return datasets.split_sizes(datasets.geo_split(chips, markup).select(F.col("tile_id").cast("string").alias("dataset_folder"), "split"))


@query("split_csv", f"WITH {_STRAT} SELECT split, 'D' AS dataset_folder, concat('M', label) AS name, concat(markup_id, '_0') AS position FROM z")
def split_csv(t: Tables):
    rows = _stratified(t).select("split", F.lit("D").alias("dataset_folder"), F.concat(F.lit("M"), F.col("label").cast("string")).alias("name"),
                                 F.concat(F.col("markup_id").cast("string"), F.lit("_0")).alias("position"))
    folder = work_folder(t.spark, "splits")
    chip_files.write_index(rows, folder, ["split"])
    return t.spark.read.schema("dataset_folder string, name string, position string, split string").option("header", True).csv(folder)


@query("chip_index_info", """
SELECT concat('S', scene, '_a') AS dataset_folder, concat('S', scene, '_a') AS name, concat(band, '_', chip_id) AS position FROM v_pixels WHERE x = 0 AND y = 0""")
def chip_index_info(t: Tables):
    path = F.concat_ws("_", F.concat(F.lit("data/S"), F.col("scene").cast("string")), F.lit("a"), F.col("band").cast("string"), F.concat(F.col("chip_id").cast("string"), F.lit(".tiff")))
    return datasets.chip_names(_chips(t).select(path.alias("file_name")))


@query("channel_image_pairs", f"WITH {_WIDE} SELECT scene, x, y, b3 AS first, b0 AS second, CASE WHEN b8 > 100 THEN 255 ELSE 0 END AS mask FROM w")
def channel_image_pairs(t: Tables):
    wide = _wide(t).select(F.lit("S").alias("name"), F.col("scene").cast("string").alias("position"), "scene", "w", "h",
                           F.array(*[f"b{i}" for i in range(9)]).alias("stack"), F.transform("b8", lambda v: F.when(v > 100, 255).otherwise(0)).alias("mask"))
    pairs = datasets.image_pairs(wide.select("name", "position", "scene", "w", "h"), wide, wide, ["b8", "rgb"])
    flat = pairs.select("scene", "w", "h", F.col("image")[0].alias("first"), F.col("image")[1].alias("second"), "mask")
    return rasters.to_cells(flat, ["first", "second", "mask"])


_KIND = "k AS (SELECT chip_id, x, y, v, CAST(floor(((chip_id * 97 + 3) * 2654435761) % 4294967296 / 4294967296.0 * 8) AS INTEGER) AS k FROM v_pixels)"


@query("augment_geometry", f"""
WITH {_KIND}, d AS (SELECT chip_id, k, v, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x ELSE y END AS mx, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 7 - y ELSE 7 - x END AS ny FROM k)
SELECT chip_id, CASE WHEN k >= 4 THEN 7 - mx ELSE mx END AS x, ny AS y, CAST(v AS DOUBLE) AS v FROM d""")
def augment_geometry(t: Tables):
    kind = datasets.variant(F.col("chip_id"), 3)
    turned = _chips(t).withColumn("kind", kind).withColumn("v", datasets.turn_and_flip(F.col("cells"), F.col("w"), F.col("h"), F.col("kind")))
    return rasters.to_cells(turned.select("chip_id", "w", "h", "v"), ["v"])


@query("augment_rgb_shift", """
SELECT chip_id, x, y, CAST(CASE WHEN band < 3 THEN least(255, greatest(0, v + floor((((chip_id * 31 + band * 7 + 3) * 2654435761) % 4294967296 / 4294967296.0 * 2 - 1) * 20))) ELSE v END AS DOUBLE) AS v FROM v_pixels""")
def augment_rgb_shift(t: Tables):
    shifted = _chips(t).withColumn("v", datasets.shift_rgb(F.col("cells"), F.col("band"), F.col("chip_id"), 3))
    return rasters.to_cells(shifted.select("chip_id", "w", "h", "v"), ["v"])


@query("augment_crop", """
WITH i AS (SELECT chip_id, x, y, 1 + CAST(x * 6 // 8 AS INTEGER) AS sx, 2 + CAST(y * 6 // 8 AS INTEGER) AS sy FROM v_pixels)
SELECT i.chip_id, i.x, i.y, CAST(p.v AS DOUBLE) AS v FROM i JOIN v_pixels p ON p.chip_id = i.chip_id AND p.x = i.sx AND p.y = i.sy""")
def augment_crop(t: Tables):
    """Three quarters of the side, placed right of the top left corner, stretched to full size."""
    cropped = _chips(t).withColumn("v", datasets.crop_resize(F.col("cells"), F.col("w"), F.col("h"), F.lit(0.75), F.lit(0.5), F.lit(0.9)))
    return rasters.to_cells(cropped.select("chip_id", "w", "h", "v"), ["v"])


@query("chip_dataset_build", f"""
WITH {_R}, {_PATCH}, d AS (SELECT DISTINCT x, y FROM t),
 c AS (SELECT CAST(x // 4 AS BIGINT) AS chip_x, CAST(y // 4 AS BIGINT) AS chip_y, count(*) FILTER (WHERE v > 80) AS filled, count(*) AS cells FROM r WHERE band < 3 GROUP BY ALL),
 m AS (SELECT CAST(x // 4 AS BIGINT) AS chip_x, CAST(y // 4 AS BIGINT) AS chip_y, count(*) AS mask_cells FROM d GROUP BY ALL)
SELECT c.chip_x, c.chip_y, filled, cells, mask_cells FROM c JOIN m ON c.chip_x = m.chip_x AND c.chip_y = m.chip_y WHERE filled > cells * 0.9 AND mask_cells >= 4""")
def chip_dataset_build(t: Tables):
    pixels = _scene(t).where("band < 3").withColumn("v", F.when(F.col("v") > 80, F.col("v")).otherwise(0))
    return dataset.build(pixels, _patches(t), 4, min_mask=4)


@query("markup_date_filter", "SELECT markup_id, img_date FROM v_markup WHERE img_date <= DATE '2017-03-02'")
def markup_date_filter(t: Tables):
    return datasets.markup_until(t.view("markup"), "2017-03-01", "markup_id").select("markup_id", "img_date")


@query("markup_state_filter", "SELECT markup_id, state FROM v_markup WHERE state = 'overgrown'")
def markup_state_filter(t: Tables):
    return datasets.markup_in_state(t.view("markup"), "overgrown").select("markup_id", "state")
