"""Merging new detections into zones by their true shapes.

The rules are those of ``zone_merge``: detections are taken in a fixed order, one within reach of
stored clearcuts joins the zone of the one it overlaps most and is stored with the union of its
own shape and theirs, one without neighbours founds a zone, and stored rows never change. Here
shapes are polygons of any form (notches, holes): reach is the distance of the shapes
themselves, overlap their common area, and a stored row holds its union as a polygon, so that a
later batch needs neither the members of a union nor anything else of its history.

Who is near whom among detections and stored rows is found once, by a spatial join. A union meets a
later detection if and only if one of its parts does, so that all further meetings follow from
these links without geometry. Components of the links are independent. Rounds settle them: a
round takes from every component the first ``together`` waiting detections and walks through them
in order in one task. The rule is the same for every size; a component of up to ``together``
detections takes one round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import polygons, rings
from arborscan.functions.overlay import combine_many
from arborscan.operators import spatial
from arborscan.operators.components import connected_components
from arborscan.session import cut_lineage
from arborscan.sources.stored import read_if_there

REACH = 50.0
TOGETHER = 2_000  # detections of a component that one task walks through in a round
_SIDE_BY_SIDE = 512  # components whose unions a task makes together
_ROW = "id long, seq {seq}, tile_id long, zone_id string, image_date_previous date, rings array<array<struct<x:double,y:double>>>"
_OUTCOME = "kind string, id long, other long, zone_id string, image_date_previous date, image_date_current date, flat array<array<double>>"


@dataclass
class Merged:
    """``stored``: id, seq, tile_id, area, zone_id, both dates, rings (of the union); ``rejected``: multipart unions (id, tile_id, area)."""

    stored: DataFrame
    rejected: DataFrame


def _boxed(shapes: DataFrame) -> DataFrame:
    """Shapes with the box around all their rings."""
    points = F.flatten("rings")
    return shapes.withColumns({name: pick(F.transform(points, lambda p: p[axis])) for name, pick, axis in
                               (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))})


def _rings(flat: Column) -> Column:
    """Plain arrays x, y, x, y, ... as rings."""
    return F.transform(flat, lambda ring: F.transform(F.sequence(F.lit(1), F.size(ring).cast("int") - 1, F.lit(2)), lambda i: F.struct(
        F.element_at(ring, i).alias("x"), F.element_at(ring, i + 1).alias("y"))))


def links(new: DataFrame, rows: DataFrame, reach: float) -> DataFrame:
    """(p, q): the new shape p is at most ``reach`` from q, a stored row or a new shape earlier in order."""
    own = _boxed(new.select("tile_id", "id", "seq", "rings"))
    stored = _boxed(rows.select("tile_id", "id", F.lit(None).cast(new.schema["seq"].dataType).alias("seq"), "rings"))
    pairs = spatial.within_distance(own, stored.unionByName(own), ["tile_id"], reach)
    pairs = pairs.where((F.col("a.id") != F.col("b.id")) & (F.col("b.seq").isNull() | (F.col("b.seq") < F.col("a.seq"))))
    near = pairs.where(rings.distance(F.col("a.rings"), F.col("b.rings")) <= reach)
    return near.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"))


def merge(new: DataFrame, rows: DataFrame, reach: float = REACH, multipart: str = "drop", dates: str = "reference",
          together: int = TOGETHER) -> Merged:
    """Merge ``new`` into the stored clearcuts.

    new:  id, seq, tile_id, image_date_0, image_date_1, area, rings (seq: total order)
    rows: id, seq, tile_id, zone_id, image_date_previous, rings of stored clearcuts
    Ids are those of detections and belong to one of both sides only. ``multipart='drop'`` rejects
    detections whose union is not one polygon (a common corner does not join two shapes), ``'keep'``
    stores them. With ``dates='reference'`` a merged row runs from the task's early date to the earliest
    previous date of its matches; ``'fixed'`` gives (earliest previous, later date). Of equal overlaps the
    row first in order wins. A detection without a shape (null, no rings) founds a zone of its own.
    """
    if multipart not in ("drop", "keep") or dates not in ("reference", "fixed"):
        raise ValueError("multipart is drop or keep, dates is reference or fixed")
    new = cut_lineage(new.select("id", "seq", "tile_id", "image_date_0", "image_date_1", "area", "rings"))
    near = cut_lineage(links(new, rows, reach))
    known = rows.select("id", "seq", "zone_id", F.col("image_date_previous").alias("prev"), polygons._flat(F.col("rings")).alias("flat"))
    known = cut_lineage(known.join(near.select(F.col("q").alias("id")).distinct(), "id", "left_semi"))
    linked = near.select(F.explode(F.array("p", "q")).alias("id")).distinct()

    own_zone = F.concat_ws("/", "tile_id", "id")
    alone = new.join(linked, "id", "left_anti").select("id", "seq", "tile_id", "area", own_zone.alias("zone_id"), F.col("image_date_0").alias("image_date_previous"),
                                                       F.col("image_date_1").alias("image_date_current"), "rings")
    stored, rejected = [alone], [alone.select("id", "tile_id", "area").limit(0)]
    waiting = cut_lineage(new.join(linked, "id", "left_semi").select("id", "seq"))
    while not waiting.isEmpty():
        labels = cut_lineage(connected_components(near.select(F.col("p").alias("src"), F.col("q").alias("dst"))).withColumnRenamed("node", "id"))
        # who has lost all links to rejected ones stands alone and is its own component
        ordered = waiting.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        place = F.row_number().over(Window.partitionBy("component").orderBy("seq"))
        due = cut_lineage(ordered.withColumn("_place", place).where(F.col("_place") <= together).select("id", "component"))
        out = cut_lineage(_walked(due, new, near, known, labels, multipart, dates))
        keyed = new.select("id", "seq", "tile_id", "area")
        saved = cut_lineage(out.where("kind = 'stored'").join(keyed, "id").select(
            "id", "seq", "tile_id", "area", "zone_id", "image_date_previous", "image_date_current", "flat"))
        stored.append(saved.withColumn("rings", _rings(F.col("flat"))).drop("flat"))
        rejected.append(cut_lineage(out.where("kind = 'rejected'").select("id").join(keyed, "id").select("id", "tile_id", "area")))
        waiting = cut_lineage(waiting.join(due, "id", "left_anti"))
        later = near.join(waiting.select(F.col("id").alias("p")), "p", "left_semi").join(rejected[-1].select(F.col("id").alias("q")), "q", "left_anti")
        near = cut_lineage(later.select("p", "q").unionByName(out.where("kind = 'link'").select(F.col("id").alias("p"), F.col("other").alias("q"))).distinct())
        known = known.unionByName(saved.select("id", "seq", "zone_id", F.col("image_date_previous").alias("prev"), "flat"))
        known = cut_lineage(known.join(near.select(F.col("q").alias("id")).distinct(), "id", "left_semi"))
    return Merged(reduce(DataFrame.unionByName, stored), reduce(DataFrame.unionByName, rejected))


def _walked(due: DataFrame, new: DataFrame, near: DataFrame, known: DataFrame, labels: DataFrame, multipart: str, dates: str) -> DataFrame:
    """Outcomes of the ``due`` detections, walked through by component in order, and the links of later ones to the rows they make."""
    fresh = new.join(due, "id").withColumn("flat", polygons._flat(F.col("rings")))
    entries = fresh.groupBy("component").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "id", "image_date_0", "image_date_1", F.concat_ws("/", "tile_id", "id").alias("zone_id"), "flat"))).alias("entries"))
    # rows and links that the due detections meet, and those that others have with the same rows and detections
    touched = near.join(due.select(F.col("id").alias("p"), "component"), "p").select("q", "component").unionByName(
        due.select(F.col("id").alias("q"), "component")).distinct()
    held = (known.join(touched.withColumnRenamed("q", "id"), "id").groupBy("component")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "id", "zone_id", "prev", "flat"))).alias("rows")))
    linked = near.join(touched, "q").groupBy("component").agg(F.collect_list(F.struct("p", "q")).alias("links"))
    groups = entries.join(held, "component", "left").join(linked, "component", "left").select(
        F.transform("entries", lambda e: e.dropFields("seq")).alias("entries"), F.transform("rows", lambda r: r.dropFields("seq")).alias("rows"), "links")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), _SIDE_BY_SIDE):
                groups = [[() if x is None else x for x in group] for group in frame.iloc[start: start + _SIDE_BY_SIDE].itertuples(index=False)]
                found = _side_by_side([_walk(*group, multipart, dates) for group in groups])
                yield pd.DataFrame(found, columns=["kind", "id", "other", "zone_id", "image_date_previous", "image_date_current", "flat"])

    return groups.mapInPandas(run, _OUTCOME)


def _side_by_side(walks: list[Generator]) -> list[tuple]:
    """Outcomes of independent walks; the unions that they wait for are made together, one of each walk at a time."""
    outcomes, waiting = [], [(walk, None) for walk in walks]
    while waiting:
        asked = []
        for walk, answer in waiting:
            try:
                found = walk.send(answer)
                while len(found) > 2:
                    outcomes.append(found)
                    found = next(walk)
                asked.append((walk, found))
            except StopIteration:
                pass
        waiting = list(zip([walk for walk, _ in asked], combine_many([shapes for _, shapes in asked], "union")))
    return outcomes


def _walk(entries, rows, pairs, multipart: str, dates: str) -> Generator:
    """Outcomes of one component: entries and rows in order, ``pairs`` (p, q) of later ones near earlier ones.

    Two shapes, where they come in place of an outcome, ask for their union.
    """
    meets, followers = defaultdict(set), defaultdict(set)
    for pair in pairs:
        meets[pair["p"]].add(pair["q"])
        followers[pair["q"]].add(pair["p"])
    made = {r["id"]: (r["zone_id"], r["prev"], [list(x) for x in r["flat"]]) for r in rows}
    rank = {r["id"]: k for k, r in enumerate(rows)}
    waiting, inside = {e["id"] for e in entries}, {r["id"]: set() for r in rows}  # inside: the rows a row has united
    for e in entries:
        key, own = e["id"], [list(x) for x in e["flat"]] if e["flat"] is not None else []
        waiting.discard(key)
        hits = sorted((q for q in meets[key] if q in made), key=rank.__getitem__)
        if hits:
            covered = set().union(*[inside[q] for q in hits])
            united = [own]
            for q in hits:
                if q not in covered:  # what another row has united adds nothing
                    joined = yield united[0], made[q][2]
                    united = [[ring.ravel().tolist() for polygon in joined for ring in polygon]]
            whole = yield united[0], united[0]
            if len(whole) != 1 and multipart == "drop":
                for p in followers[key]:
                    meets[p].discard(key)
                yield "rejected", key, None, None, None, None, None
                continue
            common = polygons.areas([own] * len(hits), [made[q][2] for q in hits])[:, 2]
            best = min(range(len(hits)), key=lambda k: (-round(float(common[k]), 6), k))
            earliest = min(made[q][1] for q in hits)
            previous, current = (e["image_date_0"], earliest) if dates == "reference" else (min(e["image_date_0"], earliest), e["image_date_1"])
            zone, shape = made[hits[best]][0], united[0]
        else:
            zone, previous, current, shape = e["zone_id"], e["image_date_0"], e["image_date_1"], own
        made[key], rank[key], inside[key] = (zone, previous, shape), len(rank), set(hits).union(*[inside[q] for q in hits])
        for p in set().union(*[followers[q] for q in hits]) - {key}:  # whoever meets a part meets the union
            if p in waiting:
                meets[p].add(key)
                followers[key].add(p)
            elif p not in made:
                followers[key].add(p)
                yield "link", p, key, None, None, None, None
        yield "stored", key, None, zone, previous, current, shape


class Store:
    """Zones as Parquet, one folder per batch and below it one per tile: a batch reads the folders of its own tiles only."""

    def __init__(self, spark, folder: str, seq: str = "long"):
        self.spark, self.folder, self.schema = spark, folder, _ROW.format(seq=seq) + ", area double, image_date_current date, batch int"

    def rows(self, tiles: DataFrame | None = None) -> DataFrame:
        """Stored rows, of some tiles (tile_id) or all. The tiles, at most those of the world's grid, prune folders before a task starts."""
        found = read_if_there(self.spark, f"{self.folder}/clearcuts", self.schema)
        found = self.spark.createDataFrame([], self.schema) if found is None else found
        if tiles is None:
            return found
        return found.where(F.col("tile_id").isin([r["tile_id"] for r in tiles.select("tile_id").distinct().collect()]))

    def save(self, new: DataFrame, batch: int, **options) -> None:
        """Merge ``new`` as batch number ``batch``; a repeated attempt replaces its own folder and does not see its rows."""
        earlier = self.rows(new).where(F.col("batch") < batch)
        result = merge(new, earlier, **options)
        result.stored.write.mode("overwrite").partitionBy("tile_id").parquet(f"{self.folder}/clearcuts/batch={batch}")
