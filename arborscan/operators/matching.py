"""Matching of predicted polygons to truth polygons."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from arborscan.operators.components import connected_components
from arborscan.session import cut_lineage


_PAIR = "truth_id long, pred_id long, iou double"


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """The sequential walk over the pairs of one conflict component."""
    used, out = set(), []
    ordered = frame.sort_values(["truth_id", "iou", "pred_id"], ascending=[True, False, True])
    done = None
    for truth, pred, iou in zip(ordered["truth_id"], ordered["pred_id"], ordered["iou"]):
        if truth != done and pred not in used:
            used.add(pred)
            out.append((truth, pred, iou))
            done = truth
    return pd.DataFrame(out, columns=["truth_id", "pred_id", "iou"])


def _components(pairs: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """(settled, waiting): matches of all conflict components of up to ``together`` pairs, and the pairs of larger ones."""
    edges = pairs.select((2 * F.col("truth_id")).alias("src"), (2 * F.col("pred_id") + 1).alias("dst"))
    labels = connected_components(edges).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("truth_id"), "component")
    labelled = cut_lineage(pairs.join(labels, "truth_id"))
    small = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= together).select("component")
    settled = (labelled.join(small, "component", "left_semi").groupBy("component")
               .applyInPandas(lambda frame: _walk(frame), _PAIR))
    return cut_lineage(settled), cut_lineage(labelled.join(small, "component", "left_anti").select("truth_id", "pred_id", "iou"))


def greedy_match(pairs: DataFrame, threshold: float, rounds: int = 6, together: int = 20_000) -> DataFrame:
    """Accepted (truth_id, pred_id, iou): truths choose in id order the best prediction still free.

    ``pairs`` holds truth_id, pred_id, iou of intersecting polygons; pairs below the
    threshold can never match. In a round every truth names its best free prediction, and the
    choice is accepted when no earlier waiting truth could still take it: the result is that of
    the sequential walk. Most pairs settle in a few rounds, but a chain of truths that wait for
    each other would need one round per link. So after ``rounds`` rounds the conflict components
    that are left are walked through, each in one task, if they have at most ``together`` pairs;
    larger ones go on in rounds, and fall apart as they do.
    """
    waiting = cut_lineage(pairs.where(F.col("iou") >= threshold).select(
        F.col("truth_id").cast("long").alias("truth_id"), F.col("pred_id").cast("long").alias("pred_id"), F.col("iou").cast("double").alias("iou")))
    accepted: list[DataFrame] = []

    def keep(more: DataFrame) -> None:
        accepted.append(more)
        if len(accepted) == 16:
            accepted[:] = [cut_lineage(reduce(DataFrame.unionByName, accepted))]

    while True:
        for _ in range(rounds):
            best = waiting.groupBy("truth_id").agg(
                F.max_by(F.struct("pred_id", "iou"), F.struct("iou", (-F.col("pred_id")).alias("o"))).alias("b")).select("truth_id", "b.*")
            first = waiting.groupBy("pred_id").agg(F.min("truth_id").alias("_first"))
            settled = cut_lineage(best.join(first, "pred_id").where(F.col("_first") == F.col("truth_id"))
                                  .select("truth_id", "pred_id", "iou"))
            keep(settled)
            waiting = cut_lineage(waiting.join(settled.select("truth_id"), "truth_id", "left_anti")
                                  .join(settled.select("pred_id"), "pred_id", "left_anti"))
            if waiting.isEmpty():
                return reduce(DataFrame.unionByName, accepted)
        settled, waiting = _components(waiting, together)
        keep(settled)
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, accepted)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when undefined."""
    return F.coalesce(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(matches: DataFrame, predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """One row with tp, fp, fn, precision, recall and f1; all ones when both sides are empty."""
    counts = (matches.select(F.lit("m").alias("k")).unionByName(predictions.select(F.lit("p").alias("k")))
              .unionByName(truths.select(F.lit("t").alias("k")))
              .agg(*[F.count_if(F.col("k") == k).alias(k) for k in "mpt"]))
    out = counts.select(F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("t") - F.col("m")).alias("fn"),
                        (F.col("p") + F.col("t") == 0).alias("_none"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumns({c: F.when(F.col("_none"), 1.0).otherwise(F.col(c)) for c in ("precision", "recall", "f1")}).drop("_none")
