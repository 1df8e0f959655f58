"""Zone queries over clearcuts and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan.functions import rings
from arborscan.operators import zones
from arborscan.plans import map_query
from arborscan.queries.registry import Tables, query
from arborscan.sources import geojson

START, END = "1997-01-01", "1998-12-31"
_KEEP = "forest = 1 AND clouds = 0 AND tile_id IS NOT NULL"
_P = f"p AS (SELECT * FROM v_clearcuts WHERE image_date_current BETWEEN DATE '{START}' AND DATE '{END}' AND {_KEEP})"
_SPAN = "s AS (SELECT zone_id, min(image_date_current) AS lo, max(image_date_current) AS hi FROM p GROUP BY 1)"
_CHANGE = f"""{_P}, {_SPAN}, c AS (SELECT s.zone_id, s.lo, s.hi,
  CAST(sum(CASE WHEN image_date_current = lo THEN area END) AS BIGINT) AS a0,
  CAST(sum(CASE WHEN image_date_current = hi THEN area END) AS BIGINT) AS a1 FROM p JOIN s ON p.zone_id = s.zone_id GROUP BY ALL)"""
_NEWEST = f"""n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY image_date_current DESC, area DESC, id) AS r
  FROM v_clearcuts WHERE {_KEEP}) q WHERE r = 1)"""


@query("clearcut_period_filter", f"WITH {_P} SELECT id, zone_id, image_date_current FROM p")
def clearcut_period_filter(t: Tables):
    return zones.in_period(t.view("clearcuts"), START, END).select("id", "zone_id", "image_date_current")


@query("zone_date_span", f"WITH {_P}, {_SPAN} SELECT zone_id, lo AS min_date, hi AS max_date, hi > lo AS several FROM s")
def zone_date_span(t: Tables):
    return zones.date_span(zones.in_period(t.view("clearcuts"), START, END))


@query("zone_change_status", f"""
WITH {_CHANGE}, {_NEWEST} SELECT n.zone_id, n.id, n.image_date_current,
 CASE WHEN c.zone_id IS NULL THEN 2 WHEN c.a0 < c.a1 THEN 0 ELSE 1 END AS status FROM n LEFT JOIN c ON n.zone_id = c.zone_id""")
def zone_change_status(t: Tables):
    return zones.zone_status(t.view("clearcuts"), START, END).select("zone_id", "id", "image_date_current", "status")


@query("changed_unchanged_sets", f"""
WITH {_CHANGE} SELECT zone_id, CASE WHEN a0 < a1 THEN 'changed' ELSE 'unchanged' END AS kind FROM c""")
def changed_unchanged_sets(t: Tables):
    change = zones.change(zones.in_period(t.view("clearcuts"), START, END))
    return change.select("zone_id", F.when(F.col("status") == zones.CHANGED, "changed").otherwise("unchanged").alias("kind"))


@query("zone_newest", f"WITH {_NEWEST} SELECT zone_id, id, image_date_current, area FROM n")
def zone_newest(t: Tables):
    return zones.newest(t.view("clearcuts"), [])


@query("newest_correlated", f"""
WITH z AS (SELECT DISTINCT zone_id FROM v_clearcuts), {_NEWEST}
SELECT z.zone_id, n.image_date_current AS newest_date, n.id AS newest_pk FROM z JOIN n ON z.zone_id = n.zone_id""")
def newest_correlated(t: Tables):
    cuts = t.view("clearcuts")
    all_zones = cuts.select("zone_id").distinct()
    return (all_zones.join(zones.newest(cuts, []), "zone_id")
            .select("zone_id", F.col("image_date_current").alias("newest_date"), F.col("id").alias("newest_pk")))


@query("changed_zone_semi", f"""
WITH {_P}, {_SPAN} SELECT p.id, p.zone_id, p.area FROM p WHERE zone_id IN (SELECT zone_id FROM s WHERE hi > lo)""")
def changed_zone_semi(t: Tables):
    return zones.changed_semi(t.view("clearcuts"), START, END).select("id", "zone_id", "area")


@query("zone_area_chart", f"""
SELECT zone_id, image_date_current, CAST(sum(area) AS BIGINT) AS zone_area FROM v_clearcuts
WHERE image_date_current BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL""")
def zone_area_chart(t: Tables):
    return zones.area_series(t.view("clearcuts"), START, END)


@query("clearcut_status_update", """
WITH r AS (SELECT l_orderkey AS id, l_partkey % 4 - 1 AS status, l_partkey * 100000 + l_suppkey AS review_no FROM lineitem),
 b AS (SELECT id, max(review_no) AS m FROM r WHERE status <= 1 GROUP BY 1)
SELECT c.id, COALESCE((b.m // 100000) % 4 - 1, 0) AS status FROM v_clearcuts c LEFT JOIN b ON c.id = b.id""")
def clearcut_status_update(t: Tables):
    cuts = t.view("clearcuts").withColumn("status", F.lit(0).cast("long"))
    reviews = t.table("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 4 - 1).alias("status"),
                                         (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("review_no"))
    updated, _ = zones.review(cuts, reviews)
    return updated.select("id", "status")


@query("detection_route", """
SELECT det_id, CASE WHEN forest = 0 OR clouds = 1 THEN 'rejected' ELSE 'accepted' END AS route FROM v_detections""")
def detection_route(t: Tables):
    return t.view("detections").select("det_id", zones.route(F.col("forest"), F.col("clouds")).alias("route"))


_AREA = "d AS (SELECT det_id, tile_id, task_no, (x1 - x0) * (y1 - y0) AS area FROM v_detections)"


def _areas(t: Tables):
    return t.view("detections").select("det_id", "tile_id", "task_no", F.expr("(x1 - x0) * (y1 - y0) AS area"))


@query("detection_area_filter", f"""
WITH {_AREA}, m AS (SELECT tile_id, task_no, avg(area) AS mean_area FROM d GROUP BY ALL)
SELECT d.det_id, d.area FROM d JOIN m ON d.tile_id = m.tile_id AND d.task_no = m.task_no WHERE d.area > m.mean_area * 0.2""")
def detection_area_filter(t: Tables):
    return zones.above_mean_area(_areas(t), ["tile_id", "task_no"]).select("det_id", "area")


@query("task_mean_area", f"WITH {_AREA} SELECT tile_id, task_no, round(avg(area), 6) AS mean_area FROM d GROUP BY ALL")
def task_mean_area(t: Tables):
    return _areas(t).groupBy("tile_id", "task_no").agg(F.round(F.avg("area"), 6).alias("mean_area"))


@query("min_polygon_area", f"WITH {_AREA} SELECT det_id, area FROM d WHERE area > 295")
def min_polygon_area(t: Tables):
    return _areas(t).where(F.col("area") > 295).select("det_id", "area")


@query("nonempty_geometry_filter", """
SELECT o_orderkey AS det_id, CAST((o_orderkey % 7) * (o_custkey % 5) AS DOUBLE) AS area FROM orders WHERE (o_orderkey % 7) * (o_custkey % 5) > 0""")
def nonempty_geometry_filter(t: Tables):
    shape = rings.rectangle(F.lit(0), F.lit(0), F.col("o_orderkey") % 7, F.col("o_custkey") % 5)
    shapes = t.table("orders").select(F.col("o_orderkey").alias("det_id"), shape.alias("geometry"))
    return shapes.select("det_id", rings.area(F.col("geometry")).alias("area")).where(F.col("area") > 0)


@query("valid_geometry_filter", "SELECT det_id AS pk FROM v_detections WHERE clouds = 0")
def valid_geometry_filter(t: Tables):
    det = t.view("detections").repartition("det_id")
    shape = geojson.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    text = geojson.feature_text(shape, pk=F.col("det_id"))
    broken = F.when(F.col("clouds") == 1, F.replace(text, F.lit("]]]"), F.lit("]"))).otherwise(text)
    return geojson.valid_only(geojson.parse_markup(det.select(broken.alias("value")))).select("pk")


@query("geojson_feature", f"""
WITH {_CHANGE}, {_NEWEST} SELECT concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[', n.zone_id, '.0,0.0],[', n.zone_id + 1,
 '.0,0.0],[', n.zone_id + 1, '.0,1.0],[', n.zone_id, '.0,1.0],[', n.zone_id, '.0,0.0]]]}},"properties":{{"pk":', n.id, ',"color":',
 CASE WHEN c.zone_id IS NULL THEN 2 WHEN c.a0 < c.a1 THEN 0 ELSE 1 END, '}}}}') AS value
FROM n LEFT JOIN c ON n.zone_id = c.zone_id""")
def geojson_feature(t: Tables):
    x = F.col("zone_id")
    cuts = t.view("clearcuts").withColumn("geometry", rings.rectangle(x, F.lit(0), x + 1, F.lit(1)))
    return map_query.change_map(cuts, START, END)
