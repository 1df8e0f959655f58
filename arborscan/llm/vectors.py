"""What the vector searches share: usable vectors, blocks of a query set against all rows, and merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from arborscan.llm.common import stored

FOUND = "query_id long, vec_id long, score {}"


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and only finite components; with ``nonzero``, not all of them zero.

    Equal rows come out once: they would share a block and crowd out others there.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return stored((kept.where("exists(v, x -> x <> 0)") if nonzero else kept).distinct(), "vectors")


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; shorter vectors are padded with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def blocked(rows: DataFrame, queries: DataFrame, key: list[str], compare: Callable, schema: str,
            rows_per_block: int, queries_per_block: int) -> DataFrame:
    """``compare(rows, queries)`` for every block of rows and block of queries of equal ``key``.

    Both sides have (vec_id, v) and the key; ``compare`` gets (row_id, x) and (query_id, q). Sizes are counted per key first
    (over all rows without a key); each side is cut
    into blocks by a hash of its id and sent to every block of the other side of the same key, so
    a key that holds any share of all rows is spread over many bounded tasks.
    """
    def blocks(n, per: int):
        return F.greatest(F.lit(1), F.ceil(n / per)).cast("int")

    if key:
        counted = rows.groupBy(*key).agg(F.count("*").alias("n")).join(queries.groupBy(*key).agg(F.count("*").alias("q")), key)
        sizes = stored(counted.select(*key, blocks(F.col("n"), rows_per_block).alias("rows_in"),
                                      blocks(F.col("q"), queries_per_block).alias("queries_in")), "blocks")

    def sized(side: DataFrame) -> DataFrame:
        if key:
            return side.join(sizes, key)
        return side.withColumns({"rows_in": rows.agg(blocks(F.count("*"), rows_per_block)).scalar(),
                                 "queries_in": queries.agg(blocks(F.count("*"), queries_per_block)).scalar()})

    def dealt(side: DataFrame, own: str, other: str, block: str, others: str, names: tuple[str, str]) -> DataFrame:
        placed = sized(side).withColumn(block, F.pmod(F.xxhash64("vec_id", "v"), F.col(own)).cast("int"))
        return placed.withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            *key, "row_block", "query_block", F.col("vec_id").alias(names[0]), F.col("v").alias(names[1]))

    left = dealt(rows, "rows_in", "queries_in", "row_block", "query_block", ("row_id", "x"))
    right = dealt(queries, "queries_in", "rows_in", "query_block", "row_block", ("query_id", "q"))
    place = [*key, "row_block", "query_block"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(compare, schema)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all blocks, ties to the smaller id; a pair found twice counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
