"""Pairs of consecutive scenes per tile, kept right while scenes arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "tile_id long, kind string, image_date_0 date, image_date_1 date"
STATE = "days array<date>"


def pair_scenes(stream: DataFrame) -> DataFrame:
    """Changes to the consecutive pairs of a stream of (tile_id, image_date).

    State per tile is its scene dates, so it is bounded by the calendar. A scene newer than all
    others makes a ``pair`` with the newest; one that falls between two comes out as the two
    pairs it makes and the one it parts as ``retracted``. Repeated dates change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = sorted(state.get[0]) if state.exists else []
        days = sorted({*known, *(day for frame in frames for day in frame["image_date"])})
        before, after = (list(zip(d[:-1], d[1:])) for d in (known, days))
        rows = [(key[0], "retracted", *p) for p in before if p not in set(after)] + [(key[0], "pair", *p) for p in after if p not in set(before)]
        state.update((days,))
        yield pd.DataFrame(rows, columns=["tile_id", "kind", "image_date_0", "image_date_1"])

    return (stream.where("image_date IS NOT NULL").select("tile_id", "image_date").groupBy("tile_id")
            .applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout))


def standing(changes: DataFrame) -> DataFrame:
    """(tile_id, image_date_0, image_date_1): the pairs that hold after all changes."""
    net = F.sum(F.when(F.col("kind") == "pair", 1).otherwise(-1))
    return changes.groupBy("tile_id", "image_date_0", "image_date_1").agg(net.alias("net")).where("net > 0").drop("net")


def write_pairs(stream: DataFrame, table: str, checkpoint: str):
    """Append the changes to Parquet partitioned by kind; ``standing`` reads them."""
    return (pair_scenes(stream).writeStream.format("parquet").option("path", table).partitionBy("kind")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
