"""Incremental runs: the same functions as the batch jobs, driven by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan.functions import rings
from arborscan.operators import catalog
from arborscan.plans import runs, shape_merge, zone_merge
from arborscan.queries.catalogue import _DAILY, _daily
from arborscan.queries.registry import Tables, query
from arborscan.queries.spatial import _ell
from arborscan.session import work_folder
from arborscan.streaming import ingest, pairs, zones


def _arrivals(t: Tables, rows, column: str, parts: int, run) -> None:
    """Let ``rows`` arrive in ``parts`` steps by a date or number column; after each step ``run(folder)`` processes what is new.

    Every run continues from the streaming checkpoint of the one before, as a scheduled job would.
    """
    folder = work_folder(t.spark, "arrivals")
    low, high = rows.agg(F.min(column), F.max(column)).first()
    edges = [low + (high - low) * i // parts for i in range(parts)]
    for i, edge in enumerate(edges):
        keep = F.col(column) >= edge
        if i + 1 < parts:
            keep = keep & (F.col(column) < edges[i + 1])
        rows.where(keep).write.mode("append").parquet(folder)
        run(folder)


def _events(t: Tables):
    return t.view("scene_events").select("ts", F.col("tile_id").cast("long").alias("tile_id"), "image_date", "cloud_hundredths")


@query("stream_scene_ingest", "SELECT DISTINCT tile_id, image_date, 1 AS is_new FROM v_scene_events")
def stream_scene_ingest(t: Tables):
    events, table, offsets = _events(t), work_folder(t.spark, "catalogue"), work_folder(t.spark, "offsets")

    def run(folder: str) -> None:
        stream = ingest.scene_stream(t.spark, folder, events.schema)
        ingest.ingest(stream, table, offsets, ["cloud_hundredths"]).awaitTermination()

    _arrivals(t, events, "image_date", 2, run)
    return ingest.catalogue(t.spark, table, events.select("tile_id", "image_date", "cloud_hundredths")).select("tile_id", "image_date", "is_new")


@query("stream_scene_pairs", """
WITH d AS (SELECT DISTINCT tile_id, image_date FROM v_scene_events), p AS (SELECT tile_id, image_date AS image_date_0,
 lead(image_date) OVER (PARTITION BY tile_id ORDER BY image_date) AS image_date_1 FROM d) SELECT * FROM p WHERE image_date_1 IS NOT NULL""")
def stream_scene_pairs(t: Tables):
    """Scenes arrive shuffled, in three parts; the standing pairs are those of the whole history."""
    events, table, offsets = _events(t), work_folder(t.spark, "pairs"), work_folder(t.spark, "offsets")
    events = events.withColumn("ticket", F.pmod(F.xxhash64("tile_id", "image_date", "ts"), F.lit(1000)))

    def run(folder: str) -> None:
        pairs.write_pairs(ingest.scene_stream(t.spark, folder, events.schema), table, offsets).awaitTermination()

    _arrivals(t, events, "ticket", 3, run)
    return pairs.standing(t.spark.read.parquet(table))


def _detections(orders):
    """Order rows as detections of tasks: the task is the tile's image month, its dates are 30 days apart."""
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    x0 = (k * 7919) % 1997 + k - k % 15000
    y0 = (k * 104729) % 2003
    w, h = 5 + k % 20, 5 + (k * 3) % 17
    month = (F.year(day) * 12 + F.month(day)).cast("long")
    return orders.select(k.alias("id"), (F.col("o_custkey") % 25).alias("tile_id"), month.alias("task_id"),
                         F.struct(F.last_day(day).alias("day"), k.alias("id")).alias("seq"),
                         F.date_sub(F.last_day(day), 30).alias("image_date_0"), F.last_day(day).alias("image_date_1"),
                         (w * h).alias("area"), F.when(k % 5 == 0, 0).otherwise(1).alias("forest"), F.when(k % 7 == 0, 1).otherwise(0).alias("clouds"),
                         *[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x0 + w, "x1"), (y0 + h, "y1"))])


@query("stream_zone_merge")
def stream_zone_merge(t: Tables):
    """Detections arrive task by task and are merged with what earlier runs stored."""
    detections = _detections(t.table("orders"))
    store, offsets = work_folder(t.spark, "zones"), work_folder(t.spark, "offsets")

    def run(folder: str) -> None:
        stream = t.spark.readStream.schema(detections.schema).parquet(folder)
        zones.merge_stream(stream, store, offsets, reach=5.0).awaitTermination()

    _arrivals(t, detections, "task_id", 2, run)
    stored = t.spark.read.schema(zone_merge.Store.SCHEMAS["clearcuts"]).parquet(f"{store}/clearcuts")
    return stored.select("id", "zone_id", "image_date_previous", "image_date_current")


@query("replay_results")
def replay_results(t: Tables):
    """All stored results by date in one batch; agrees with the streaming run."""
    accepted, _ = zone_merge.prepare(_detections(t.table("orders")))
    store = zone_merge.Store(t.spark, work_folder(t.spark, "zones"))
    result = zone_merge.merge(accepted, store.rows(), store.members(), store.shapes(), reach=5.0)
    return result.stored.select("id", "zone_id", "image_date_previous", "image_date_current")


@query("zone_merge_shapes")
def zone_merge_shapes(t: Tables):
    """L-shaped detections merged by their true shapes, with the area of the union that each row stores.

    Two batches, by date; the second reads what the first has stored for its tiles.
    """
    accepted, _ = zone_merge.prepare(_detections(t.table("orders")))
    shaped = accepted.withColumn("rings", _ell(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    store = shape_merge.Store(t.spark, work_folder(t.spark, "shapes"), seq="struct<day: date, id: long>")
    first, last = shaped.agg(F.min("image_date_1"), F.max("image_date_1")).first()
    if first is not None:
        middle = first + (last - first) / 2
        for batch, part in enumerate((F.col("image_date_1") <= middle, F.col("image_date_1") > middle)):
            store.save(shaped.where(part), batch, reach=5.0)
    return store.rows().select("id", "zone_id", "image_date_previous", "image_date_current", F.round(rings.area(F.col("rings")), 6).alias("united"))


@query("backfill_then_incremental", """
WITH c AS (SELECT s.tile_id, s.image_date, min(s.scene_id) AS scene_id, min(CASE WHEN t.first_date IS NULL THEN 'backfill' ELSE 'incremental' END) AS mode
  FROM v_scenes s JOIN v_tiles t ON s.tile_id = t.tile_id WHERE t.is_tracked = 1 AND s.nodata_tenths < 50 AND s.cloud_tenths < 500
   AND ((t.first_date IS NULL AND s.image_date > DATE '1998-01-01') OR (t.first_date IS NOT NULL AND s.image_date >= t.last_date)) GROUP BY ALL),
 p AS (SELECT tile_id, mode, image_date AS image_date_0, lead(image_date) OVER w AS image_date_1, scene_id AS scene_id_0, lead(scene_id) OVER w AS scene_id_1
  FROM c WINDOW w AS (PARTITION BY tile_id ORDER BY image_date)) SELECT * FROM p WHERE image_date_1 IS NOT NULL""")
def backfill_then_incremental(t: Tables):
    return runs.tasks_for(t.view("scenes"), t.view("tiles"), ("nodata_tenths", 50), ("cloud_tenths", 500), ["scene_id"], "1998-01-01")


@query("task_state_table", f"""
WITH {_DAILY}, p AS (SELECT tile_id, image_date AS image_date_0, lead(image_date) OVER (PARTITION BY tile_id ORDER BY image_date) AS image_date_1 FROM d),
 k AS (SELECT * FROM p WHERE image_date_1 IS NOT NULL),
 i AS (SELECT DISTINCT tile_id, image_date, min(cloud_tenths) AS c FROM v_incoming GROUP BY ALL)
SELECT k.tile_id, k.image_date_0, k.image_date_1, CASE WHEN i.c IS NULL THEN 'created' WHEN i.c < 300 THEN 'finished' WHEN i.c < 600 THEN 'failed' ELSE 'started' END AS state
FROM k LEFT JOIN i ON k.tile_id = i.tile_id AND k.image_date_0 = i.image_date""")
def task_state_table(t: Tables):
    made = catalog.scene_pairs(_daily(t), [])
    seen = (t.view("incoming").groupBy("tile_id", F.col("image_date").alias("image_date_0")).agg(F.min("cloud_tenths").alias("c")))
    log = made.join(seen, ["tile_id", "image_date_0"])
    return runs.task_states(made, log, log.where("c < 300"), log.where("c >= 300 AND c < 600"))
