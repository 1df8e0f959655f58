"""Outlines of cell regions: straight runs, chains inside blocks, rings ranked by pointer jumping."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from arborscan.functions.rings import let
from arborscan.session import cut_lineage

#: Side of the blocks in which runs are chained; a block has at most two runs per cell and direction.
BLOCK = 256

#: Corners lie within +-2**29, so (y, x, heading) fits one long that sorts like the three.
_HALF = 1 << 29


def _code(x: Column, y: Column, heading: Column) -> Column:
    return (y.cast("long") + _HALF) * (1 << 32) + (x.cast("long") + _HALF) * 4 + heading


def straight_runs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Directed unit edges (keys, a, b), region on the left -> maximal straight runs and what follows them.

    Output: keys, ax, ay, bx, by, ``heading`` (0 east, 1 north, 2 west, 3 south), ``run`` (a code
    of start and heading) and ``after``, the run that follows. Edges of one grid line and heading
    that touch belong together: gaps and islands over one line at a time, so no window grows with a region. Where two cells of
    the region touch diagonally the outline turns right, over to the other cell; elsewhere only one run leaves a corner.
    """
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    heading = F.when(dx > 0, 0).when(dy > 0, 1).when(dx < 0, 2).otherwise(3)
    flat = edges.select(*keys, heading.alias("heading"), F.when(dx != 0, F.col("a.y")).otherwise(F.col("a.x")).cast("long").alias("_line"),
                        F.when(dx != 0, F.least("a.x", "b.x")).otherwise(F.least("a.y", "b.y")).cast("long").alias("_at"))
    island = F.col("_at") - F.row_number().over(Window.partitionBy(*keys, "heading", "_line").orderBy("_at"))
    spans = (flat.withColumn("_island", island).groupBy(*keys, "heading", "_line", "_island")
             .agg(F.min("_at").alias("_lo"), (F.max("_at") + 1).alias("_hi")))
    h, line, lo, hi = F.col("heading"), F.col("_line"), F.col("_lo"), F.col("_hi")
    pick = lambda east, north, west, south: F.when(h == 0, east).when(h == 1, north).when(h == 2, west).otherwise(south)
    runs = spans.select(*keys, "heading", pick(lo, line, hi, line).alias("ax"), pick(line, lo, line, hi).alias("ay"),
                        pick(hi, line, lo, line).alias("bx"), pick(line, hi, line, lo).alias("by"))
    # a corner sees the headings that leave it and the at most two runs that end there
    body = F.struct("ax", "ay", "heading")
    ends = runs.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(0).alias("_out"), body.alias("_in"))
    starts = runs.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"), F.pow(F.lit(2), F.col("heading")).cast("int").alias("_out"),
                         F.lit(None).cast(ends.schema["_in"].dataType).alias("_in"))
    corners = ends.unionByName(starts).groupBy(*keys, "x", "y").agg(F.bit_or("_out").alias("_out"), F.collect_list("_in").alias("_in"))
    turned = corners.select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"), "_out", F.explode("_in").alias("_in")).select(
        *keys, "_in.*", "bx", "by", "_out")
    right, left = (F.col("heading") + 3) % 4, (F.col("heading") + 1) % 4
    onward = F.when(F.col("_out").bitwiseAND(F.pow(F.lit(2), right).cast("int")) != 0, right).otherwise(left)
    return turned.select(*keys, "ax", "ay", "bx", "by", "heading", _code(F.col("ax"), F.col("ay"), F.col("heading")).alias("run"),
                         _code(F.col("bx"), F.col("by"), onward).alias("after"))


def _linked(region: np.ndarray, run: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Place of the run that follows each run, -1 where it lies outside."""
    places = pd.Series(np.arange(len(run)), index=pd.MultiIndex.from_arrays([region, run]))
    return places.reindex(pd.MultiIndex.from_arrays([region, after])).fillna(-1).to_numpy().astype(np.int64)


def _walked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member of every open chain and the place in it, by pointer doubling."""
    head, rank = np.where(before < 0, np.arange(len(before)), before), (before >= 0).astype(np.int64)
    while True:
        further = head[head]
        if (further == head).all():
            return head, rank
        rank, head = rank + rank[head], further


def _ranked(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and place of every member, for places in the order of their runs.

    Chains are parted at their smallest member, and circles start there, so the smallest run of a ring begins a chain.
    """
    n = len(following)
    own = np.arange(n)
    before = np.full(n, -1)
    before[following[following >= 0]] = own[following >= 0]
    far, low = before.copy(), own.copy()
    for _ in range(n.bit_length()):
        on = far >= 0
        low[on] = np.minimum(low[on], low[far[on]])
        far[on] = far[far[on]]
    # a pointer that is still inside after n steps runs in a circle
    before[(far >= 0) & (low == own)] = -1
    smallest = own.copy()
    np.minimum.at(smallest, _walked(before)[0], own)
    before[smallest[before < 0]] = -1
    return _walked(before)


def chains(runs: DataFrame, keys: list[str], region: str, block: int = BLOCK) -> DataFrame:
    """Runs that follow each other inside one block -> one row per chain, by block of the start corner.

    Output: keys, region, ``head`` (first run), ``after`` (the run that follows the last one; the head
    itself if the chain is closed; a chain is parted at its smallest run), ``x0``, ``y0``, ``x1``, ``y1``: arrays with both ends of each run. A group holds the runs
    of one block, whatever the size of the regions.
    """
    fields = {f.name: f for f in runs.schema.fields}
    long, many = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([*[fields[k] for k in (*keys, region)], T.StructField("head", long), T.StructField("after", long),
                           *[T.StructField(name, many) for name in ("x0", "y0", "x1", "y1")]])

    def trace(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run", ignore_index=True)
        name, run, after = frame[region].to_numpy(), frame["run"].to_numpy(), frame["after"].to_numpy()
        head, rank = _ranked(_linked(name, run, after))
        order = np.lexsort((rank, head))
        first = np.flatnonzero(rank[order] == 0)
        last = np.append(first[1:], len(order)) - 1
        made = frame.iloc[order[first]][[*keys, region]].reset_index(drop=True)
        made["head"], made["after"] = run[order[first]], after[order[last]]
        for target, source in (("x0", "ax"), ("y0", "ay"), ("x1", "bx"), ("y1", "by")):
            made[target] = np.split(frame[source].to_numpy()[order], first[1:])
        return made

    placed = runs.withColumns({"_bx": F.floor(F.col("ax") / block), "_by": F.floor(F.col("ay") / block)}).drop("heading")
    return placed.groupBy(*keys, "_bx", "_by").applyInPandas(trace, schema)


def ranked(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Ring and place of every open chain: (keys, head, ring, back).

    Pointer jumping: after k rounds a chain knows the smallest head among the next 2**k chains of its ring and how many
    steps ahead that is (``back``). All is known when no chain disagrees with the one it points to, after as
    many rounds as the chain count of the longest ring has binary digits. Every round is one join on (keys, head)
    of the slim link table, checkpointed.
    """
    state = parts.where("after <> head").select(*keys, "head", "after", F.col("head").alias("ring"), F.lit(0).cast("long").alias("back"))
    step = 1
    while True:
        ahead = state.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("head").alias("_head"), F.col("after").alias("_after"),
                             F.col("ring").alias("_ring"), F.col("back").alias("_back"))
        met = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("after") == F.col("_head"))
        lower = F.col("_ring") < F.col("ring")
        state = cut_lineage(state.join(ahead, met).select(
            *keys, "head", F.col("_after").alias("after"), F.least("ring", "_ring").alias("ring"),
            F.when(lower, F.col("_back") + step).otherwise(F.col("back")).alias("back"), (F.col("ring") != F.col("_ring")).alias("_moved")))
        if state.where("_moved").isEmpty():
            return state.select(*keys, "head", "ring", "back")
        state, step = state.drop("_moved"), step * 2


def rings(edges: DataFrame, keys: list[str], region: str, block: int = BLOCK) -> DataFrame:
    """Closed outlines (keys, region, ring, hole, points) of directed unit edges, region on the left.

    ``points``: structs with both ends of each run in order (x0, y0, x1, y1), from the lowest, then leftmost corner on. ``ring`` is the
    code of that corner. Only corners meet in a ring's row, never unit edges.
    """
    own = [*keys, region]
    parts = cut_lineage(chains(straight_runs(edges, own), keys, region, block))
    places = ranked(parts, own)
    joined = parts.alias("p").join(places.alias("r"), reduce(lambda c, k: c & F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")), own,
                                                             F.col("p.head") == F.col("r.head")), "left")
    # the ring's first chain comes first, then the one that is the most steps ahead of meeting it again
    place = F.when(F.coalesce("r.back", F.lit(0)) == 0, F.lit(-(1 << 62))).otherwise(-F.col("r.back"))
    spans = F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    whole = (joined.select(*[F.col(f"p.{k}").alias(k) for k in own], F.coalesce("r.ring", "p.head").alias("ring"), F.struct(place.alias("place"), spans.alias("s")).alias("_s"))
             .groupBy(*own, "ring").agg(F.sort_array(F.collect_list("_s")).alias("_s")))
    # at the lowest, leftmost corner an outer ring leaves to the east and a hole to the north
    return whole.select(*own, "ring", (F.pmod("ring", F.lit(4)) == 1).alias("hole"), F.flatten("_s.s").alias("points"))


def centres(points: Column) -> Column:
    """Centres of the cells along an outline (x, y of the cell), without repeats and points on a straight way."""
    def ends(s: Column) -> Column:
        dx, dy = F.signum(s["x1"] - s["x0"]), F.signum(s["y1"] - s["y0"])
        # the cell on the left of the first and of the last unit edge
        shift_x, shift_y = F.when((dx < 0) | (dy > 0), -1).otherwise(0), F.when((dx < 0) | (dy < 0), -1).otherwise(0)
        cell = lambda x, y: F.struct((x + shift_x).cast("long").alias("x"), (y + shift_y).cast("long").alias("y"))
        return F.array(cell(s["x0"], s["y0"]), cell(s["x1"] - dx, s["y1"] - dy))

    around = lambda c, i: F.element_at(c, F.when(i < 0, F.size(c)).when(i >= F.size(c), 1).otherwise(i + 1))
    once = let(F.flatten(F.transform(points, ends)), lambda c: F.filter(c, lambda p, i: p != around(c, i - 1)))
    way = lambda p, q: F.struct(F.signum(q["x"] - p["x"]), F.signum(q["y"] - p["y"]))
    return let(once, lambda c: F.filter(c, lambda p, i: way(around(c, i - 1), p) != way(p, around(c, i + 1))))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``part``: 0, 1, ... per key by the ring code ``order``; rows of 256 grid lines at a time, then the counts before them."""
    band = F.shiftright(order, 40)
    tops = rows.groupBy(*keys, band.alias("_b")).count()
    before = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_band"),
                         (F.sum("count").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("count")).alias("_n"))
    met = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_b") == F.col("_band"))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order))
    return (rows.withColumn("_b", band).withColumn("_local", local).join(before, met)
            .withColumn("part", (F.col("_n") + F.col("_local") - 1).cast("int")).drop("_b", "_band", "_n", "_local", *[f"_{k}" for k in keys]))
