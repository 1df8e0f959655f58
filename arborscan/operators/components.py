"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest node around it."""
    low = edges.groupBy("src").agg(F.min("dst").alias("_m")).withColumn("_m", F.least("_m", "src"))
    linked = edges.join(low, "src")
    if larger_only:
        return linked.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("_m").alias("dst")).distinct()
    moved = linked.where(F.col("dst") != F.col("_m")).select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
    own = low.where(F.col("src") != F.col("_m")).select("src", F.col("_m").alias("dst"))
    return moved.unionByName(own).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge table (src, dst).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one
    aggregate plus one join on the same key, the edge set never grows beyond the input,
    and a logarithmic number of rounds suffices. A component is named by its smallest
    node. Every round is checkpointed, so a lost executor costs one round at most.
    """
    both = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    current = cut_lineage(both.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = _signature(current)
    while True:
        mirrored = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _to_minimum(mirrored, larger_only=True)
        downward = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
        current = cut_lineage(_to_minimum(downward, larger_only=False))
        after = _signature(current)
        if after == before:  # each step that changes anything moves links to smaller nodes, so this comes
            break
        before = after
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def with_components(nodes: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """``nodes`` plus ``component``; a node without edges is its own component."""
    labels = connected_components(edges).withColumnRenamed("node", id)
    return nodes.join(labels, id, "left").withColumn("component", F.coalesce("component", F.col(id)))
