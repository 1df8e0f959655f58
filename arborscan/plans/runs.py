"""Catalogue runs: first pass over a tile's history and later passes over its new scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.operators import catalog


def scenes_to_process(scenes: DataFrame, tiles: DataFrame, start: str = catalog.START_DATE) -> DataFrame:
    """Scenes of tracked tiles with ``mode``: the history of a tile without dates, else everything since its last date."""
    tracked = tiles.where(F.col("is_tracked") == 1).select("tile_id", "first_date", "last_date")
    joined = scenes.join(tracked, "tile_id")
    history = F.col("first_date").isNull() & (F.col("image_date") > F.lit(start).cast("date"))
    recent = F.col("first_date").isNotNull() & (F.col("image_date") >= F.col("last_date"))
    return (joined.where(history | recent)
            .withColumn("mode", F.when(F.col("first_date").isNull(), "backfill").otherwise("incremental")).drop("first_date", "last_date"))


def tasks_for(scenes: DataFrame, tiles: DataFrame, nodata, cloud, values: list[str], start: str = catalog.START_DATE) -> DataFrame:
    """Scene pairs of both modes in one pass; ``nodata`` and ``cloud`` are (column, limit) pairs."""
    good = catalog.within_quality(F.col(nodata[0]), F.col(cloud[0]), nodata[1], cloud[1])
    chosen = scenes_to_process(scenes.where(good), tiles, start)
    return catalog.scene_pairs(catalog.scene_per_day(chosen, [*values, "mode"]), [*values, "mode"]).drop("mode_1").withColumnRenamed("mode_0", "mode")


def task_states(pairs: DataFrame, started: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """State of every pair: finished, failed, started or created. A pair with a result is never retried.

    The four inputs share (tile_id, image_date_0, image_date_1); one aggregate over tagged
    rows replaces a chain of outer joins.
    """
    keys = ["tile_id", "image_date_0", "image_date_1"]
    tagged = None
    for rank, part in enumerate((pairs, started, failures, results)):
        rows = part.select(*keys, F.lit(rank).alias("rank"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    names = F.array(*[F.lit(n) for n in ("created", "started", "failed", "finished")])
    return (tagged.groupBy(*keys).agg(F.max("rank").alias("_top"), F.min("rank").alias("_low")).where("_low = 0")
            .select(*keys, F.get(names, F.col("_top")).alias("state")))
