"""Merging new detections into zones.

Detections are taken in a fixed order and each one sees everything stored before it. A
detection within reach of stored clearcuts joins the zone of the one it overlaps most and
is stored with the union of its own shape and theirs; one without neighbours founds a
zone. Stored rows never change: a zone is an append-only history.

The order only matters between detections that are near each other or near the same stored
row. Connected components of this relation are independent. One of bounded size is walked
through in its order in one task, however often its spot was revisited; components beyond
that bound are settled in rounds: a detection is due once none of its neighbours is waiting
and it is the first waiting one of every row it meets; all due detections are handled
together. (A row that reaches a detection later on would have to absorb one of the rows it
meets, and whoever does that first waits in front of it.) The rounds are joins over
identifiers, every round is checkpointed, and no group has to fit into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from arborscan.operators import cells, spatial
from arborscan.operators.components import connected_components
from arborscan.session import cut_lineage
from arborscan.sources.stored import read_if_there

REACH = 50.0
TOGETHER = 4_000  # detections, rows and members of a component that one task walks through
BOX = ["x0", "y0", "x1", "y1"]


@dataclass
class Merged:
    """``stored``: new clearcut rows; ``members``: (row_id, member) of their unions; ``rejected``: multipart unions."""

    stored: DataFrame
    members: DataFrame
    rejected: DataFrame


def _contact(a, b):
    """Boxes that overlap or share part of a side; a common corner alone does not make one polygon."""
    dx = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    dy = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return (dx >= 0) & (dy >= 0) & ((dx > 0) | (dy > 0))


def _union(first: DataFrame | None, second: DataFrame) -> DataFrame:
    return second if first is None else first.unionByName(second)


def merge(new: DataFrame, rows: DataFrame, members: DataFrame, shapes: DataFrame, reach: float = REACH, cell: float = 1.0,
          multipart: str = "drop", dates: str = "reference", together: int = TOGETHER) -> Merged:
    """Merge ``new`` into the stored clearcuts.

    new:     id, seq, tile_id, image_date_0, image_date_1, area, x0..y1 (seq: total order)
    rows:    id, seq, tile_id, zone_id, image_date_previous of stored clearcuts
    members: row_id, member: ids of the original shapes a stored clearcut unites
    shapes:  id, tile_id, x0..y1 of those originals
    ``cell`` is the raster cell overlaps are counted in. ``multipart='drop'`` rejects
    detections whose union is not one polygon, ``'keep'`` stores them. With
    ``dates='reference'`` a merged row runs from the task's early date to the earliest
    previous date of its matches; ``'fixed'`` gives (earliest previous, later date).
    """
    if multipart not in ("drop", "keep") or dates not in ("reference", "fixed"):
        raise ValueError("multipart is drop or keep, dates is reference or fixed")
    new = cut_lineage(new)
    old = shapes.select("tile_id", "id", *BOX, F.lit(None).cast(new.schema["seq"].dataType).alias("seq"))
    fresh = new.select("tile_id", "id", *BOX, "seq")
    everyone = old.unionByName(fresh)

    near = spatial.within_distance(fresh, everyone, ["tile_id"], reach)
    near = near.where((F.col("a.id") != F.col("b.id")) & (F.col("b.seq").isNull() | (F.col("b.seq") < F.col("a.seq"))))
    near = cut_lineage(near.select("a.tile_id", F.col("a.id").alias("p"), F.col("b.id").alias("q"), F.col("b.seq").isNull().alias("old"),
                                   _contact(F.col("a"), F.col("b")).alias("touch"),
                                   *[f(f"a.{c}", f"b.{c}").alias(c) for f, c in zip((F.greatest, F.greatest, F.least, F.least), BOX)]))
    # only clearcuts with a member near a new shape can change the outcome
    active = members.join(near.where("old").select(F.col("q").alias("member")).distinct(), "member", "left_semi").select("row_id").distinct()
    held = cut_lineage(members.join(active, "row_id", "left_semi").select("row_id", "member"))
    known = cut_lineage(rows.join(active.withColumnRenamed("row_id", "id"), "id", "left_semi")
                        .select(F.col("id").alias("row_id"), "seq", "zone_id", F.col("image_date_previous").alias("prev")))

    of_new, of_row = 2 * F.col("p"), 2 * F.col("row_id") + 1
    edges = (near.where("NOT old").select(of_new.alias("src"), (2 * F.col("q")).alias("dst"))
             .unionByName(near.where("old").join(held, F.col("q") == F.col("member")).select(of_new.alias("src"), of_row.alias("dst"))))
    labels = cut_lineage(connected_components(edges))
    labelled = cut_lineage(new.join(labels.withColumnRenamed("node", "_node"), 2 * F.col("id") == F.col("_node"), "left").drop("_node"))
    alone = labelled.where("component IS NULL").select(
        "id", "seq", "tile_id", "area", F.concat_ws("/", "tile_id", "id").alias("zone_id"),
        F.col("image_date_0").alias("image_date_previous"), F.col("image_date_1").alias("image_date_current"))
    founded = Merged(alone, alone.select(F.col("id").alias("row_id"), F.col("id").alias("member")), alone.limit(0).select("id", "tile_id", "area"))

    row_labels = labels.where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("long").alias("row_id"), "component")
    grouped = labelled.where("component IS NOT NULL")
    parts = held.join(row_labels, "row_id")
    size = (grouped.select("component").unionByName(known.join(row_labels, "row_id").select("component")).unionByName(parts.select("component"))
            .groupBy("component").agg(F.count("*").alias("n")))
    small = cut_lineage(size.where(F.col("n") <= together).select("component"))
    results = [founded, _walked(grouped, known.join(row_labels, "row_id"), parts, shapes, small, reach, cell, multipart, dates)]
    large = cut_lineage(grouped.join(small, "component", "left_anti").drop("component"))
    if not large.isEmpty():
        near = near.join(large.select(F.col("id").alias("p")), "p", "left_semi")
        results.append(_rounds(large, everyone, near, held, known, reach, cell, multipart, dates))
    return Merged(*[reduce(DataFrame.unionByName, [getattr(r, name) for r in results]) for name in ("stored", "members", "rejected")])


_ENTRY = ["seq", "id", "is_new", *BOX, "image_date_0", "image_date_1", "zone_id", "prev"]
_OUTCOME = "kind string, id long, other long, zone_id string, image_date_previous date, image_date_current date"


def _walked(grouped: DataFrame, known: DataFrame, parts: DataFrame, shapes: DataFrame, small: DataFrame, reach: float, cell: float,
            multipart: str, dates: str) -> Merged:
    """Walk through the ``small`` components, each as one row of its detections and rows in order and of its members."""
    fresh = grouped.withColumns({"is_new": F.lit(True), "zone_id": F.concat_ws("/", "tile_id", "id"), "prev": F.lit(None).cast("date")})
    rows = known.withColumns({"id": F.col("row_id"), "is_new": F.lit(False), **{c: F.lit(None).cast(grouped.schema[c].dataType) for c in
                                                                             (*BOX, "image_date_0", "image_date_1")}})
    entries = (fresh.select("component", *_ENTRY).unionByName(rows.select("component", *_ENTRY)).join(small, "component", "left_semi")
               .groupBy("component").agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("entries")))
    boxed = parts.join(small, "component", "left_semi").join(shapes.select(F.col("id").alias("member"), *BOX), "member")
    united = boxed.groupBy("component").agg(F.collect_list(F.struct("row_id", "member", *BOX)).alias("parts"))
    plain = entries.join(united, "component", "left").select(
        F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in _ENTRY if c != "seq"])).alias("entries"), "parts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for entries_, parts_ in zip(frame["entries"], frame["parts"]):
                yield pd.DataFrame(list(_walk(entries_, parts_ if parts_ is not None else [], reach, cell, multipart, dates)),
                                   columns=["kind", "id", "other", "zone_id", "image_date_previous", "image_date_current"])

    out = cut_lineage(plain.mapInPandas(run, _OUTCOME))
    keyed = grouped.select("id", "seq", "tile_id", "area")
    stored = out.where("kind = 'stored'").drop("kind", "other").join(keyed, "id").select(
        "id", "seq", "tile_id", "area", "zone_id", "image_date_previous", "image_date_current")
    rejected = out.where("kind = 'rejected'").select("id").join(keyed, "id").select("id", "tile_id", "area")
    return Merged(stored, out.where("kind = 'member'").select(F.col("id").alias("row_id"), F.col("other").alias("member")), rejected)


def _gap_sq(a, b) -> float:
    dx, dy = max(0.0, a[0] - b[2], b[0] - a[2]), max(0.0, a[1] - b[3], b[1] - a[3])
    return dx * dx + dy * dy


def _meet(a, b) -> bool:
    dx, dy = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return dx >= 0 and dy >= 0 and (dx > 0 or dy > 0)


def _common_cells(own, others, cell: float) -> int:
    """Cells of ``own`` whose centre also lies in one of ``others``."""
    first = lambda v: math.ceil(v / cell - 0.5)
    x0, y0, x1, y1 = map(first, own)
    grid = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), bool)
    for box in others:
        a, b, c, d = (first(v) - o for v, o in zip(box, (x0, y0, x0, y0)))
        if c > 0 and d > 0:
            grid[max(0, b): d, max(0, a): c] = True
    return int(grid.sum())


def _walk(entries, parts, reach: float, cell: float, multipart: str, dates: str):
    """Outcome records of one component, its entries in order of seq; a detection's own zone_id is that of the zone it would found."""
    box = {p["member"]: tuple(p[c] for c in BOX) for p in parts}
    rows, rank = {}, {}
    for place, e in enumerate(entries):
        rank[(e["is_new"], e["id"])] = place
        if not e["is_new"]:
            rows[(False, e["id"])] = {"zone": e["zone_id"], "prev": e["prev"], "members": set()}
    for p in parts:
        rows[(False, p["row_id"])]["members"].add(p["member"])
    for e in entries:
        if not e["is_new"]:
            continue
        key, own = e["id"], tuple(e[c] for c in BOX)
        close = {m for m, b in box.items() if _gap_sq(own, b) <= reach * reach}
        hits = [k for k, row in rows.items() if not close.isdisjoint(row["members"])]
        box[key] = own
        if hits and multipart == "drop" and not _whole(own, [rows[k]["members"] for k in hits], box):
            del box[key]  # no row has it as a member
            yield "rejected", key, None, None, None, None
            continue
        members = {key}.union(*[rows[k]["members"] for k in hits])
        if hits:
            best = min(hits, key=lambda k: (-_common_cells(own, [box[m] for m in rows[k]["members"]], cell), rank[k]))
            zone, earliest = rows[best]["zone"], min(rows[k]["prev"] for k in hits)
            previous, current = (e["image_date_0"], earliest) if dates == "reference" else (min(e["image_date_0"], earliest), e["image_date_1"])
        else:
            zone, previous, current = e["zone_id"], e["image_date_0"], e["image_date_1"]
        rows[(True, key)] = {"zone": zone, "prev": previous, "members": members}
        yield "stored", key, None, zone, previous, current
        for member in members:
            yield "member", key, member, None, None, None


def _whole(own, groups: list[set], box: dict) -> bool:
    """Whether all groups of shapes, each in one piece, hang together with ``own``."""
    reached, apart = [own], list(groups)
    inside: set = set()
    while apart:
        more = [g for g in apart if not inside.isdisjoint(g) or any(_meet(r, box[m]) for m in g for r in reached)]
        if not more:
            return False
        reached = [box[m] for g in more for m in g - inside] or reached
        inside.update(*more)
        apart = [g for g in apart if g not in more]
    return True


def _rounds(new: DataFrame, everyone: DataFrame, near: DataFrame, held: DataFrame, known: DataFrame, reach: float, cell: float,
            multipart: str, dates: str) -> Merged:
    """Settle components of any size in rounds."""
    shared = cut_lineage(cells.from_boxes(near.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).select(
        F.struct("p", "q").alias("pq"), *BOX), "pq", cell).select("pq.p", "pq.q", "cx", "cy"))
    near = near.select("p", "q", "touch")
    parts = everyone.join(held.select(F.col("member").alias("id")).unionByName(near.select(F.col("p").alias("id")))
                          .unionByName(near.select(F.col("q").alias("id"))).distinct(), "id", "left_semi")
    contacts = cut_lineage(spatial.box_join(parts.drop("seq"), parts.drop("seq"), ["tile_id"], max(reach, 1.0),
                                            on=lambda a, b: (a["id"] != b["id"]) & _contact(a, b))
                           .select(F.col("a.id").alias("u"), F.col("b.id").alias("v")))

    waiting = new.select(F.col("id").alias("p"), "seq")
    stored = rejected = added = None
    turn = 0
    while True:
        met = cut_lineage(near.join(waiting, "p").join(held, F.col("q") == F.col("member"))
                          .groupBy("p", "seq", "row_id").agg(F.bool_or("touch").alias("touch")))
        first_in_line = met.groupBy("row_id").agg(F.min("seq").alias("_first"))
        behind = met.join(first_in_line, "row_id").where(F.col("_first") < F.col("seq")).select("p")
        blocked = near.join(waiting.select(F.col("p").alias("q")), "q", "left_semi").select("p").unionByName(behind)
        ready = cut_lineage(waiting.join(blocked, "p", "left_anti").select("p"))
        hits = met.join(ready, "p", "left_semi").select("p", "row_id", "touch")
        whole = _one_piece(hits, held, contacts) if multipart == "drop" else hits.select("p").distinct()

        common = (shared.join(ready, "p", "left_semi").join(held, F.col("q") == F.col("member"))
                  .select("p", "row_id", "cx", "cy").distinct().groupBy("p", "row_id").agg(F.count("*").alias("common")))
        choice = (hits.join(common, ["p", "row_id"], "left").join(known, "row_id")
                  .groupBy("p").agg(F.min_by("zone_id", F.struct(-F.coalesce("common", F.lit(0)), "seq")).alias("_zone"),
                                    F.min("prev").alias("_prev")))
        task = new.join(ready.withColumnRenamed("p", "id"), "id", "left_semi").join(choice.withColumnRenamed("p", "id"), "id", "left")
        merged = F.col("_zone").isNotNull()
        ok = task.join(whole.select(F.col("p").alias("id"), F.lit(True).alias("_ok")), "id", "left")
        kept = ~merged | F.coalesce("_ok", F.lit(False))
        first, second = ((F.col("image_date_0"), F.col("_prev")) if dates == "reference"
                         else (F.least("image_date_0", "_prev"), F.col("image_date_1")))
        settled = cut_lineage(ok.select(
            "id", "seq", "tile_id", "area", kept.alias("kept"),
            F.when(merged, F.col("_zone")).otherwise(F.concat_ws("/", "tile_id", "id")).alias("zone_id"),
            F.when(merged, first).otherwise(F.col("image_date_0")).alias("image_date_previous"),
            F.when(merged, second).otherwise(F.col("image_date_1")).alias("image_date_current")))
        saved = settled.where("kept").drop("kept")
        stored = _union(stored, saved)
        rejected = _union(rejected, settled.where("NOT kept").select("id", "tile_id", "area"))
        unions = cut_lineage(hits.join(saved.select(F.col("id").alias("p")), "p", "left_semi").join(held, "row_id")
                             .select(F.col("p").alias("row_id"), "member").distinct()
                             .unionByName(saved.select(F.col("id").alias("row_id"), F.col("id").alias("member"))))
        added = _union(added, unions)
        waiting = cut_lineage(waiting.join(ready, "p", "left_anti"))
        if waiting.isEmpty():
            return Merged(stored, added, rejected)
        turn += 1
        if turn % 8 == 0:  # else the plans of all rounds would add up
            stored, rejected, added, held, known = (cut_lineage(x) for x in (stored, rejected, added, held, known))
        held = held.unionByName(unions)
        known = known.unionByName(saved.select(F.col("id").alias("row_id"), "seq", "zone_id", F.col("image_date_previous").alias("prev")))


def _one_piece(hits: DataFrame, held: DataFrame, contacts: DataFrame) -> DataFrame:
    """Detections whose matched rows all hang together with them (p).

    Every stored row is in one piece, so it is enough to reach the rows: first those in
    contact with the detection itself, then those sharing a member or a contact with a row
    already reached.
    """
    reached = hits.where("touch").select("p", "row_id")
    apart = hits.where("NOT touch").select("p", "row_id")
    while not apart.isEmpty():
        inside = reached.join(held, "row_id").select("p", "member")
        beside = inside.join(contacts, F.col("member") == F.col("u")).select("p", F.col("v").alias("member"))
        grown = inside.unionByName(beside).distinct()
        more = cut_lineage(apart.join(held, "row_id").join(grown, ["p", "member"], "left_semi").select("p", "row_id").distinct())
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        apart = cut_lineage(apart.join(more, ["p", "row_id"], "left_anti"))
    return hits.select("p").distinct().join(apart.select("p").distinct(), "p", "left_anti")


def prepare(detections: DataFrame, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Detections with ``area``, ``task`` keys and flags -> (accepted, rejected) above the relative area."""
    from arborscan.operators import zones
    big = zones.above_mean_area(detections, ["tile_id", "task_id"], share).withColumn("route", zones.route(F.col("forest"), F.col("clouds")))
    return big.where("route = 'accepted'").drop("route"), big.where("route = 'rejected'").drop("route")


def save_tasks(spark, folder: str, detections: DataFrame, **options) -> None:
    """Merge the detections of finished tasks into the tables below ``folder``.

    Tables: clearcuts, members, shapes, not_clearcuts, rejected, tasks. Tasks already in
    ``tasks`` are skipped and the task list is written last, so a batch that is repeated
    after a failure reads past the rows of its first attempt by their batch number.
    """
    store = Store(spark, folder)
    done = store.read("tasks", "tile_id long, task_id long")
    todo = cut_lineage(detections.join(done, ["tile_id", "task_id"], "left_anti"))
    if todo.isEmpty():
        return
    accepted, off = prepare(todo)
    result = merge(accepted.select("id", "seq", "tile_id", "image_date_0", "image_date_1", F.col("area").cast("double"), *BOX),
                   store.rows(), store.members(), store.shapes(), **options)
    stored = cut_lineage(result.stored)
    store.append("clearcuts", stored)
    store.append("members", result.members)
    store.append("shapes", accepted.join(stored.select("id"), "id", "left_semi").select("id", "tile_id", *[F.col(c).cast("double") for c in BOX]))
    store.append("not_clearcuts", off.select("id", "tile_id", "image_date_0", "image_date_1", F.col("area").cast("double"), "forest", "clouds"))
    store.append("rejected", result.rejected)
    store.commit(todo.select(F.col("tile_id").cast("long"), F.col("task_id").cast("long")).distinct())


class Store:
    """Append-only Parquet tables with one folder per batch; a batch counts once its task list is written."""

    SCHEMAS = {
        "clearcuts": "id long, seq struct<day: date, id: long>, tile_id long, area double, zone_id string, image_date_previous date, image_date_current date",
        "members": "row_id long, member long",
        "shapes": "id long, tile_id long, x0 double, y0 double, x1 double, y1 double",
    }

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.batch = self._batches() + 1

    def _batches(self) -> int:
        tasks = read_if_there(self.spark, f"{self.folder}/tasks", "tile_id long, task_id long, batch int")
        return 0 if tasks is None else tasks.agg(F.max("batch"), F.count("tile_id")).first()[0] or 0

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of committed batches."""
        if self.batch == 1:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{table}")
        return rows.where(F.col("batch") < self.batch).drop("batch")

    def rows(self) -> DataFrame:
        return self.read("clearcuts", self.SCHEMAS["clearcuts"]).drop("area", "image_date_current")

    def members(self) -> DataFrame:
        return self.read("members", self.SCHEMAS["members"])

    def shapes(self) -> DataFrame:
        return self.read("shapes", self.SCHEMAS["shapes"])

    def append(self, table: str, df: DataFrame) -> None:
        """Write this batch's rows; a repeated attempt replaces its own folder."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={self.batch}")

    def commit(self, tasks: DataFrame) -> None:
        self.append("tasks", tasks)
