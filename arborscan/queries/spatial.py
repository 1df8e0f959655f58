"""Spatial joins, components and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan.functions import crs, overlay, polygons, rings
from arborscan.operators import cells, components, matching, spatial, stats, zones
from arborscan.queries.registry import Tables, query

BOX = ["x0", "y0", "x1", "y1"]
_GAP = "greatest(0, {a}.x0 - {b}.x1, {b}.x0 - {a}.x1) ** 2 + greatest(0, {a}.y0 - {b}.y1, {b}.y0 - {a}.y1) ** 2"
_HIT = "{a}.x0 <= {b}.x1 AND {b}.x0 <= {a}.x1 AND {a}.y0 <= {b}.y1 AND {b}.y0 <= {a}.y1"
_OVL = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _sql(text: str, a: str, b: str) -> str:
    return text.format(a=a, b=b)


def _det(t: Tables, *more: str):
    return t.view("detections").select("tile_id", "det_id", *BOX, *more).repartition("det_id")


def _truth(t: Tables):
    return t.view("truth").select("tile_id", "truth_id", *BOX).repartition("truth_id")


def _masks(t: Tables, kind: str):
    return t.view("masks").where(F.col("kind") == kind).select("tile_id", "mask_id", *BOX)


def _ell(x0, y0, x1, y1):
    """Rings of a box without its upper right quarter."""
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    corners = [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1), (x0, y0)]
    return F.array(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]))


def _common(a: str, b: str) -> str:
    """SQL: common area of two such shapes, by inclusion and exclusion of boxes and quarters."""
    box = lambda t: (f"{t}.x0", f"{t}.y0", f"{t}.x1", f"{t}.y1")
    quarter = lambda t: (f"({t}.x0 + {t}.x1) / 2.0", f"({t}.y0 + {t}.y1) / 2.0", f"{t}.x1", f"{t}.y1")
    ovl = lambda p, q: f"greatest(0, least({p[2]}, {q[2]}) - greatest({p[0]}, {q[0]})) * greatest(0, least({p[3]}, {q[3]}) - greatest({p[1]}, {q[1]}))"
    return f"({ovl(box(a), box(b))} - {ovl(quarter(a), box(b))} - {ovl(box(a), quarter(b))} + {ovl(quarter(a), quarter(b))})"


@query("dwithin_join", f"""
SELECT a.truth_id, b.det_id FROM v_truth a JOIN v_detections b ON a.tile_id = b.tile_id WHERE {_sql(_GAP, 'a', 'b')} <= 25""")
def dwithin_join(t: Tables):
    pairs = spatial.within_distance(_truth(t), _det(t), ["tile_id"], 5, cell=32)
    return pairs.select("a.truth_id", "b.det_id")


def _ells_meet(a: str, b: str) -> str:
    """SQL: two such shapes have a point in common; each is its lower and its left half."""
    halves = lambda t: ((f"{t}.x0", f"{t}.y0", f"{t}.x1", f"({t}.y0 + {t}.y1) / 2.0"), (f"{t}.x0", f"{t}.y0", f"({t}.x0 + {t}.x1) / 2.0", f"{t}.y1"))
    return "(" + " OR ".join(f"({p[0]} <= {q[2]} AND {q[0]} <= {p[2]} AND {p[1]} <= {q[3]} AND {q[1]} <= {p[3]})" for p in halves(a) for q in halves(b)) + ")"


@query("knn_mask_flag", f"""
WITH r AS (SELECT d.det_id, CASE WHEN {_ells_meet('d', 'm')} THEN 1 ELSE 0 END AS hit,
  row_number() OVER (PARTITION BY d.det_id, m.kind ORDER BY (d.x0 + d.x1 - m.x0 - m.x1) ** 2 + (d.y0 + d.y1 - m.y0 - m.y1) ** 2, m.mask_id) AS r, m.kind
  FROM v_detections d JOIN v_masks m ON d.tile_id = m.tile_id)
SELECT det_id, CAST(max(CASE WHEN kind = 'forest' THEN hit ELSE 0 END) AS INTEGER) AS forest,
       CAST(max(CASE WHEN kind = 'cloud' THEN hit ELSE 0 END) AS INTEGER) AS clouds FROM r WHERE r <= 10 GROUP BY det_id""")
def knn_mask_flag(t: Tables):
    """L-shaped detections and masks: the shapes themselves have to meet, not their boxes."""
    det = _det(t)
    meet = lambda a, b: rings.intersects(_ell(*[a[c] for c in BOX]), _ell(*[b[c] for c in BOX]))
    forest, clouds = (spatial.knn_mask_flag(det, _masks(t, kind), ["tile_id"], "det_id", "mask_id", 64, exact=meet)
                      .select("det_id", F.col("flag").alias(name)) for kind, name in (("forest", "forest"), ("cloud", "clouds")))
    return forest.join(clouds, "det_id")


@query("knn_topk", """
SELECT det_id, mask_id, r AS rank FROM (SELECT d.det_id, m.mask_id, CAST(row_number() OVER (PARTITION BY d.det_id
  ORDER BY (d.x0 + d.x1 - m.x0 - m.x1) ** 2 + (d.y0 + d.y1 - m.y0 - m.y1) ** 2, m.mask_id) AS INTEGER) AS r
  FROM v_detections d JOIN v_masks m ON d.tile_id = m.tile_id WHERE m.kind = 'forest') q WHERE r <= 10""")
def knn_topk(t: Tables):
    near = spatial.k_nearest(_det(t), _masks(t, "forest"), ["tile_id"], "det_id", "mask_id", 10, 128)
    return near.select("det_id", "mask_id", "rank")


@query("intersects_join", f"""
SELECT d.det_id, m.mask_id FROM v_detections d JOIN v_masks m ON d.tile_id = m.tile_id AND m.kind = 'forest' WHERE {_sql(_HIT, 'd', 'm')}""")
def intersects_join(t: Tables):
    return spatial.intersecting(_det(t), _masks(t, "forest"), ["tile_id"], 64).select("a.det_id", "b.mask_id")


@query("tile_landcover_join", """
SELECT t.tile_index, m.mask_id FROM v_tiles t JOIN v_masks m ON m.kind = 'forest' AND m.y0 <= t.tile_id * 80 + 79 AND m.y1 >= t.tile_id * 80""")
def tile_landcover_join(t: Tables):
    """Tiles as strips over all of the ground: a few huge boxes against many small ones."""
    bounds = t.view("tiles").select("tile_index", F.lit(-1_000_000_000).alias("x0"), (F.col("tile_id") * 80).alias("y0"),
                                    F.lit(1_000_000_000).alias("x1"), (F.col("tile_id") * 80 + 79).alias("y1"))
    forest = t.view("masks").where("kind = 'forest'").select("mask_id", *BOX)
    return spatial.intersecting(bounds, forest, [], 128).select("a.tile_index", "b.mask_id")


@query("scope_overlap_join", """
WITH s AS (SELECT greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM
  (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_truth) a,
  (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_masks WHERE kind = 'forest') b)
SELECT d.truth_id FROM v_truth d, s WHERE d.x0 <= s.x1 AND d.x1 >= s.x0 AND d.y0 <= s.y1 AND d.y1 >= s.y0""")
def scope_overlap_join(t: Tables):
    from arborscan.operators import scope
    truth = _truth(t)
    return scope.inside_scope(truth, scope.overlap_scope(truth, _masks(t, "forest"))).select("truth_id")


@query("collection_bounds", """
SELECT tile_id, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM v_detections GROUP BY 1""")
def collection_bounds(t: Tables):
    from arborscan.operators import scope
    return scope.collection_bounds(_det(t), ["tile_id"])


@query("overlay_intersection", f"""
SELECT d.det_id, m.mask_id, CAST({_sql(_OVL, 'd', 'm')} AS DOUBLE) AS area FROM v_detections d JOIN v_masks m
ON d.tile_id = m.tile_id AND m.kind = 'forest' WHERE {_sql(_OVL, 'd', 'm')} > 0""")
def overlay_intersection(t: Tables):
    pairs = spatial.intersecting(_det(t), _masks(t, "forest"), ["tile_id"], 64)
    shape = rings.rectangle(*[F.col(f"a.{c}") for c in BOX])
    box = F.struct(*[F.col(f"b.{c}").cast("double").alias(n) for c, n in zip(BOX, ("xmin", "ymin", "xmax", "ymax"))])
    out = pairs.select("a.det_id", "b.mask_id", shape.alias("shape"), box.alias("box"))
    out = out.withColumn("common", rings.clip_to_box(F.col("shape"), F.col("box")))
    return out.select("det_id", "mask_id", rings.area(F.col("common")).alias("area")).where(F.col("area") > 0)


_ADJ = f"""e AS (SELECT a.det_id AS src, b.det_id AS dst FROM v_detections a JOIN v_detections b ON a.tile_id = b.tile_id AND a.det_id < b.det_id
 WHERE {_sql(_HIT, 'a', 'b')} AND (least(a.x1 + 1, b.x1) - greatest(a.x0 - 1, b.x0)) * (least(a.y1 + 1, b.y1) - greatest(a.y0 - 1, b.y0)) > 20)"""


@query("adjacency_join", f"WITH {_ADJ} SELECT src, dst FROM e")
def adjacency_join(t: Tables):
    return spatial.adjacent(_det(t), ["tile_id"], "det_id", 32)


_PAIRS = f"""i AS (SELECT d.det_id AS pred_id, t.truth_id, {_sql(_OVL, 'd', 't')} AS ovl,
 (d.x1 - d.x0) * (d.y1 - d.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS areas FROM v_detections d JOIN v_truth t ON d.tile_id = t.tile_id WHERE {_sql(_HIT, 'd', 't')})"""


def _iou_pairs(t: Tables):
    pairs = spatial.intersecting(_det(t), _truth(t), ["tile_id"], 32)
    return pairs.select(F.col("a.det_id").alias("pred_id"), F.col("b.truth_id").alias("truth_id"),
                        spatial.box_iou(F.col("a"), F.col("b")).alias("iou"))


_ELL_IOU = _common("d", "t")


@query("iou_pair_join", f"""
WITH i AS (SELECT d.det_id AS pred_id, t.truth_id, {_ELL_IOU} AS common, 0.75 * ((d.x1 - d.x0) * (d.y1 - d.y0) + (t.x1 - t.x0) * (t.y1 - t.y0)) AS areas
 FROM v_detections d JOIN v_truth t ON d.tile_id = t.tile_id WHERE {_sql(_HIT, 'd', 't')})
SELECT pred_id, truth_id, round(common / (areas - common), 6) AS iou FROM i WHERE common > 0""")
def iou_pair_join(t: Tables):
    """Intersection over union of L-shaped polygons: boxes find the pairs, exact areas measure them."""
    pairs = spatial.intersecting(_det(t), _truth(t), ["tile_id"], 32)
    shape = lambda side: _ell(*[F.col(f"{side}.{c}") for c in BOX])
    out = pairs.select(F.col("a.det_id").alias("pred_id"), F.col("b.truth_id").alias("truth_id"), polygons.iou(shape("a"), shape("b")).alias("iou"))
    return out.where("iou > 0").withColumn("iou", F.round("iou", 6))


# the walk itself: truths of a tile in id order, each with its predictions best first; the state is the list of used ones
_WALK = f"""{_PAIRS}, c AS (SELECT tile_id, i.truth_id, list(pred_id ORDER BY iou DESC, pred_id) AS wanted, list(iou ORDER BY iou DESC, pred_id) AS ious
  FROM (SELECT pred_id, truth_id, ovl / CAST(areas - ovl AS DOUBLE) AS iou FROM i) i JOIN v_truth USING (truth_id) WHERE iou >= 0.5 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY truth_id) AS step FROM c),
 w(tile_id, step, truth_id, pred_id, iou, used) AS (
  SELECT DISTINCT tile_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[]) FROM k
  UNION ALL SELECT tile_id, step, truth_id, pred_id, ious[list_position(wanted, pred_id)], CASE WHEN pred_id IS NULL THEN used ELSE list_append(used, pred_id) END
   FROM (SELECT k.*, used, list_filter(wanted, lambda p: NOT list_contains(used, p))[1] AS pred_id FROM w JOIN k ON k.tile_id = w.tile_id AND k.step = w.step + 1) n),
 m AS (SELECT truth_id, pred_id, iou FROM w WHERE pred_id IS NOT NULL)"""


@query("greedy_match", f"WITH RECURSIVE {_WALK} SELECT truth_id, pred_id, round(iou, 6) AS iou FROM m")
def greedy_match(t: Tables):
    return matching.greedy_match(_iou_pairs(t), 0.5).withColumn("iou", F.round("iou", 6))


@query("f1_polygons", f"""
WITH RECURSIVE {_WALK}, n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM v_detections) AS p, (SELECT count(*) FROM v_truth) AS t)
SELECT tp, p - tp AS fp, t - tp AS fn, round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (p + t), 6) AS f1 FROM n""")
def f1_polygons(t: Tables):
    counts = matching.f1(matching.greedy_match(_iou_pairs(t), 0.5), _det(t), _truth(t))
    return counts.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_COMP = f"""{_ADJ}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
 r(node, root) AS (SELECT det_id, det_id FROM v_detections UNION SELECT b.dst, r.root FROM r JOIN b ON r.node = b.src),
 c AS (SELECT node AS det_id, min(root) AS component FROM r GROUP BY node)"""


def _components(t: Tables, *more: str):
    det = _det(t, *more)
    return components.with_components(det, spatial.adjacent(_det(t), ["tile_id"], "det_id", 32), "det_id")


@query("connected_components", f"WITH RECURSIVE {_COMP} SELECT det_id, component FROM c")
def connected_components(t: Tables):
    return _components(t).select("det_id", "component")


@query("component_difference", f"WITH {_ADJ} SELECT det_id FROM v_detections WHERE det_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def component_difference(t: Tables):
    edges = spatial.adjacent(_det(t), ["tile_id"], "det_id", 32)
    visited = edges.select(F.explode(F.array("src", "dst")).alias("det_id"))
    return _det(t).select("det_id").join(visited, "det_id", "left_anti")


_CELLS = """SELECT {id}, CAST(ceil(x0 / 5.0 - 0.5) AS BIGINT) + i AS cx, CAST(ceil(y0 / 5.0 - 0.5) AS BIGINT) + j AS cy{more} FROM {src},
 (SELECT unnest(range(0, {n})) AS i), (SELECT unnest(range(0, {n})) AS j)
 WHERE ceil(x0 / 5.0 - 0.5) + i < ceil(x1 / 5.0 - 0.5) AND ceil(y0 / 5.0 - 0.5) + j < ceil(y1 / 5.0 - 0.5)"""
_DC = _CELLS.format(id="det_id", more=", tile_id", src="v_detections", n=8)
_MC = _CELLS.format(id="mask_id", more=", tile_id", src="(SELECT * FROM v_masks WHERE kind = 'forest')", n=16)


@query("region_union", f"""
WITH RECURSIVE {_COMP}, k AS ({_DC}) SELECT component, CAST(count(*) AS BIGINT) AS cells FROM
 (SELECT DISTINCT c.component, k.cx, k.cy FROM k JOIN c ON k.det_id = c.det_id) GROUP BY component""")
def region_union(t: Tables):
    grid = cells.from_boxes(_components(t), "component", 5)
    return cells.union(grid, "component").groupBy("component").agg(F.count("*").alias("cells"))


# unit cells of the boxes, whose corners are whole numbers: a side of a cell without its neighbour is part of the outline
_UNIT = """k AS (SELECT DISTINCT c.component, d.x0 + i AS x, d.y0 + j AS y FROM v_detections d JOIN c USING (det_id), (SELECT unnest(range(0, 24)) AS i),
  (SELECT unnest(range(0, 21)) AS j) WHERE d.x0 + i < d.x1 AND d.y0 + j < d.y1)"""


@query("region_outline", f"""
WITH RECURSIVE {_COMP}, {_UNIT}, s AS (SELECT component, x, y, unnest([1, -1, 0, 0]) AS i, unnest([0, 0, 1, -1]) AS j FROM k)
SELECT s.component, CAST(count(*) // 4 AS DOUBLE) AS area, CAST(count(*) - count(n.x) AS DOUBLE) AS perimeter
FROM s LEFT JOIN k n ON n.component = s.component AND n.x = s.x + s.i AND n.y = s.y + s.j GROUP BY s.component""")
def region_outline(t: Tables):
    """Dissolved components as polygons: their area and the length of all outlines."""
    shapes = _components(t).select("component", rings.rectangle(*[F.col(c) for c in BOX]).alias("shape"))
    whole = overlay.dissolve(shapes, ["component"], "shape")
    return whole.select("component", overlay.area(F.col("polygons")).alias("area"), overlay.perimeter(F.col("polygons")).alias("perimeter"))


_ELL_PAIRS = f"""SELECT d.det_id, m.mask_id, {_common('d', 'm')} AS common, 0.75 * ((d.x1 - d.x0) * (d.y1 - d.y0) + (m.x1 - m.x0) * (m.y1 - m.y0)) AS areas
 FROM v_detections d JOIN v_masks m ON d.tile_id = m.tile_id AND m.kind = 'forest' WHERE {_sql(_HIT, 'd', 'm')}"""


def _ell_pairs(t: Tables):
    """Detections and forest masks whose boxes meet, both as L-shaped rings."""
    pairs = spatial.intersecting(_det(t), _masks(t, "forest"), ["tile_id"], 64)
    return pairs.select("a.det_id", "b.mask_id", *[_ell(*[F.col(f"{side}.{c}") for c in BOX]).alias(name) for side, name in (("a", "s"), ("b", "m"))])


@query("geom_union", f"SELECT det_id, mask_id, round(areas - common, 6) AS area FROM ({_ELL_PAIRS})")
def geom_union(t: Tables):
    """Area of the united shape itself, built as polygons."""
    return _ell_pairs(t).select("det_id", "mask_id", F.round(overlay.area(overlay.union(F.col("s"), F.col("m"))), 6).alias("area"))


@query("overlay_polygons", f"""
SELECT det_id, mask_id, round(common, 6)::DOUBLE AS common, round(0.75 * own - common, 6)::DOUBLE AS rest FROM (SELECT det_id, mask_id, common, own FROM
 (SELECT d.det_id, m.mask_id, {_common('d', 'm')} AS common, (d.x1 - d.x0) * (d.y1 - d.y0) AS own FROM v_detections d JOIN v_masks m
  ON d.tile_id = m.tile_id AND m.kind = 'forest' WHERE {_sql(_HIT, 'd', 'm')})) WHERE common > 0""")
def overlay_polygons(t: Tables):
    """Detections cut by concave masks: the polygons inside and those outside, by their areas."""
    cut = _ell_pairs(t).select("det_id", "mask_id", overlay.intersection(F.col("s"), F.col("m")).alias("inside"), overlay.difference(F.col("s"), F.col("m")).alias("outside"))
    return cut.where(F.size("inside") > 0).select("det_id", "mask_id", F.round(overlay.area(F.col("inside")), 6).alias("common"),
                                                  F.round(overlay.area(F.col("outside")), 6).alias("rest"))


@query("geom_intersection_area", f"SELECT det_id, mask_id, round(common, 6)::DOUBLE AS area FROM ({_ELL_PAIRS})")
def geom_intersection_area(t: Tables):
    return _ell_pairs(t).select("det_id", "mask_id", F.round(polygons.intersection_area(F.col("s"), F.col("m")), 6).alias("area"))


@query("geom_buffer_1", f"""
WITH k AS ({_DC}), g AS (SELECT DISTINCT det_id, cx + i AS cx, cy + j AS cy FROM k, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))
SELECT det_id, count(*) AS cells FROM g GROUP BY 1""")
def geom_buffer_1(t: Tables):
    grid = cells.from_boxes(_det(t), "det_id", 5)
    return cells.dilate(grid, "det_id").groupBy("det_id").agg(F.count("*").alias("cells"))


@query("zone_assign_max_overlap", f"""
WITH m AS (SELECT t.truth_id, d.det_id, {_sql(_OVL, 't', 'd')} AS overlap, c.zone_id, c.image_date_previous
  FROM v_truth t JOIN v_detections d ON t.tile_id = d.tile_id JOIN v_clearcuts c ON c.id = d.det_id WHERE {_sql(_GAP, 't', 'd')} <= 25),
 r AS (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY overlap DESC, det_id) AS r,
  min(image_date_previous) OVER (PARTITION BY truth_id) AS p, count(*) OVER (PARTITION BY truth_id) AS n FROM m)
SELECT truth_id, zone_id, overlap, p AS image_date_previous, n AS matches FROM r WHERE r = 1""")
def zone_assign_max_overlap(t: Tables):
    pairs = spatial.within_distance(_truth(t), _det(t), ["tile_id"], 5, cell=32)
    matches = pairs.select(F.col("a.truth_id").alias("truth_id"), F.col("b.det_id").alias("old_id"),
                           spatial.box_overlap(F.col("a"), F.col("b")).alias("overlap"))
    old = t.view("clearcuts").select(F.col("id").alias("old_id"), "zone_id", "image_date_previous")
    return zones.assign_zone(matches.join(old, "old_id"), "truth_id")


@query("within_bound_join", """
SELECT d.det_id FROM v_detections d JOIN v_tiles t ON d.tile_id = t.tile_id WHERE d.x0 >= t.tile_id * 20 AND d.y0 >= 100 AND d.y1 <= 1800""")
def within_bound_join(t: Tables):
    bounds = t.view("tiles").select("tile_id", rings.rectangle(F.col("tile_id") * 20, F.lit(100), F.lit(1_000_000_000), F.lit(1800)).alias("bound"))
    det = _det(t).select("tile_id", "det_id", rings.rectangle(*[F.col(c) for c in BOX]).alias("shape"))
    return det.join(bounds, "tile_id").where(rings.within_bounds(F.col("shape"), F.col("bound"))).select("det_id")


def _shapes(t: Tables):
    return _det(t).select("det_id", rings.rectangle(*[F.col(c) for c in BOX]).alias("shape"))


@query("geom_area", "SELECT det_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM v_detections")
def geom_area(t: Tables):
    return _shapes(t).select("det_id", rings.area(F.col("shape")).alias("area"))


@query("geom_centroid", "SELECT det_id, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy FROM v_detections")
def geom_centroid(t: Tables):
    out = _shapes(t).select("det_id", rings.centroid(F.col("shape")).alias("c"))
    return out.select("det_id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query("geom_bounds", """
SELECT det_id, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax FROM v_detections""")
def geom_bounds(t: Tables):
    return _shapes(t).select("det_id", rings.bounds(F.col("shape")).alias("b")).select("det_id", "b.*")


def _mask_pairs(t: Tables):
    """Detections beside forest masks, both as rings; the join is padded so that near misses are included."""
    pairs = spatial.box_join(_det(t), _masks(t, "forest"), ["tile_id"], 64, pad=8)
    return pairs.select("a.det_id", "b.mask_id", rings.rectangle(*[F.col(f"a.{c}") for c in BOX]).alias("s"),
                        rings.rectangle(*[F.col(f"b.{c}") for c in BOX]).alias("m"))


_NEAR = """FROM v_detections d JOIN v_masks m ON d.tile_id = m.tile_id AND m.kind = 'forest'
WHERE d.x0 - 8 <= m.x1 AND m.x0 <= d.x1 + 8 AND d.y0 - 8 <= m.y1 AND m.y0 <= d.y1 + 8"""


@query("bounds_intersection", f"""
SELECT d.det_id, m.mask_id, CAST(greatest(d.x0, m.x0) AS DOUBLE) AS xmin, CAST(least(d.y1, m.y1) AS DOUBLE) AS ymax {_NEAR} AND {_sql(_HIT, 'd', 'm')}""")
def bounds_intersection(t: Tables):
    box = rings.bounds_intersection(rings.bounds(F.col("s")), rings.bounds(F.col("m")))
    out = _mask_pairs(t).select("det_id", "mask_id", box.alias("b")).where(F.col("b").isNotNull())
    return out.select("det_id", "mask_id", "b.xmin", "b.ymax")


@query("geom_intersects", f"SELECT d.det_id, m.mask_id, {_sql(_HIT, 'd', 'm')} AS hit {_NEAR}")
def geom_intersects(t: Tables):
    return _mask_pairs(t).select("det_id", "mask_id", rings.intersects(F.col("s"), F.col("m")).alias("hit"))


_NOTCH = "greatest(0, d.x1 - greatest(d.x0, (m.x0 + m.x1) / 2.0)) * greatest(0, d.y1 - greatest(d.y0, (m.y0 + m.y1) / 2.0))"


@query("geom_within", f"""
SELECT d.det_id, m.mask_id, d.x0 >= m.x0 AND d.x1 <= m.x1 AND d.y0 >= m.y0 AND d.y1 <= m.y1 AND {_NOTCH} = 0 AS inside {_NEAR}""")
def geom_within(t: Tables):
    """Boxes inside L-shaped masks: one that reaches into the notch is not inside."""
    shaped = _mask_pairs(t).withColumn("m", _ell(*[F.col("m")[0][i][c] for i, c in ((0, "x"), (0, "y"), (2, "x"), (2, "y"))]))
    return shaped.select("det_id", "mask_id", polygons.within(F.col("s"), F.col("m")).alias("inside"))


@query("geom_distance", f"SELECT d.det_id, m.mask_id, round(sqrt({_sql(_GAP, 'd', 'm')}), 6) AS metres {_NEAR}")
def geom_distance(t: Tables):
    return _mask_pairs(t).select("det_id", "mask_id", F.round(rings.distance(F.col("s"), F.col("m")), 6).alias("metres"))


def _bowties(t: Tables):
    """Four-corner rings; every third one has its last two corners swapped and crosses itself."""
    p = [F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in
         (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    ring = F.when(F.col("det_id") % 3 == 0, F.array(p[0], p[1], p[3], p[2], p[0])).otherwise(F.array(*p, p[0]))
    return _det(t).select("det_id", F.array(ring).alias("shape"))


@query("geom_is_valid", "SELECT det_id, det_id % 3 <> 0 AS valid FROM v_detections")
def geom_is_valid(t: Tables):
    return _bowties(t).select("det_id", rings.is_valid(F.col("shape")).alias("valid"))


@query("geom_repair", """
SELECT det_id, CASE WHEN det_id % 3 = 0 THEN 2 ELSE 1 END AS pieces, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / CASE WHEN det_id % 3 = 0 THEN 2 ELSE 1 END AS area,
 TRUE AS valid FROM v_detections""")
def geom_repair(t: Tables):
    """Rings that cross themselves come back as valid polygons of the same area, the others as they are."""
    fixed = _bowties(t).withColumn("p", polygons.repair(F.col("shape")))
    return fixed.select("det_id", F.size("p").alias("pieces"),
                        F.round(F.aggregate(F.transform("p", rings.area), F.lit(0.0), lambda x, y: x + y), 6).alias("area"),
                        F.forall("p", rings.is_valid).alias("valid"))


@query("geom_multipolygon", f"""
WITH RECURSIVE {_COMP} SELECT component, CAST(count(*) AS INTEGER) AS members, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area
FROM c JOIN v_detections d ON c.det_id = d.det_id GROUP BY component""")
def geom_multipolygon(t: Tables):
    """Each component's member rings in one multipolygon value."""
    members = _components(t).select("component", "det_id", rings.rectangle(*[F.col(c) for c in BOX]).alias("shape"))
    multi = members.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_id", "shape"))), lambda m: m["shape"]).alias("polygons"))
    area = F.aggregate(F.transform("polygons", rings.area), F.lit(0.0), lambda a, v: a + v)
    return multi.select("component", F.size("polygons").alias("members"), area.alias("area"))


@query("affine_pixel_world", """
SELECT det_id, CAST(x0 * 10 + 600000 AS DOUBLE) AS wx, CAST(y0 * -10 + 5500000 AS DOUBLE) AS wy FROM v_detections""")
def affine_pixel_world(t: Tables):
    wx, wy = rings.affine(F.col("x0"), F.col("y0"), (10.0, 0.0, 600000.0, 0.0, -10.0, 5500000.0))
    return _det(t).select("det_id", wx.alias("wx"), wy.alias("wy"))


@query("reproject", """
SELECT det_id, CAST(round(30 + x0 % 2000 * 0.003, 6) AS DOUBLE) AS lon, CAST(round(-60 + y0 * 0.06, 6) AS DOUBLE) AS lat FROM v_detections""")
def reproject(t: Tables):
    """Degrees -> UTM metres -> degrees; fixed points are checked in tests."""
    lon, lat = F.lit(30) + F.col("x0") % 2000 * 0.003, F.lit(-60) + F.col("y0") * 0.06
    north = F.col("lat") >= 0
    there = _det(t).select("det_id", lon.alias("lon"), lat.alias("lat")).select(
        "det_id", north.alias("n"), crs.to_utm(F.col("lon"), F.col("lat"), F.lit(36), north).alias("u"))
    back = there.select("det_id", crs.to_lonlat(F.col("u.x"), F.col("u.y"), F.lit(36), F.col("n")).alias("g"))
    return back.select("det_id", F.round("g.x", 6).alias("lon"), F.round("g.y", 6).alias("lat"))


@query("cloud_union", """
SELECT mask_id, 'current' AS source, x0, y0 FROM v_masks WHERE kind = 'cloud' UNION ALL
SELECT mask_id, 'previous' AS source, x0 + 7, y0 FROM v_masks WHERE kind = 'cloud'""")
def cloud_union(t: Tables):
    from arborscan.plans import detection
    current = _masks(t, "cloud").select("mask_id", "x0", "y0")
    previous = current.withColumn("x0", F.col("x0") + 7)
    return detection.cloud_union(current, previous)


@query("area_by_state", "SELECT state, CAST(sum(area) AS BIGINT) AS area FROM v_markup GROUP BY 1")
def area_by_state(t: Tables):
    return t.view("markup").groupBy("state").agg(F.sum("area").alias("area"))


@query("median_instance_area", """
SELECT tile_id, round(median((x1 - x0) * (y1 - y0) / 100), 6) AS median_area FROM v_detections GROUP BY 1""")
def median_instance_area(t: Tables):
    areas = _det(t).select("tile_id", (spatial.box_area({c: F.col(c) for c in BOX}) / 100).alias("area"))
    return stats.quantiles(areas, "area", [0.5], ["tile_id"]).select("tile_id", F.round(F.col("q")[0], 6).alias("median_area"))


@query("area_quartile_label", """
WITH q AS (SELECT quantile_cont(area, 0.25) AS a, quantile_cont(area, 0.5) AS b, quantile_cont(area, 0.75) AS c FROM v_markup)
SELECT markup_id, CASE WHEN area < a THEN 0 WHEN area < b THEN 1 WHEN area < c THEN 2 ELSE 3 END AS label FROM v_markup, q""")
def area_quartile_label(t: Tables):
    return stats.quartile_label(t.view("markup").select("markup_id", "area"), "area").select("markup_id", "label")


@query("array_apply", """
SELECT chip_id, CAST(list_position(cells, list_max(cells)) - 1 AS INTEGER) AS argmax FROM v_chips""")
def array_apply(t: Tables):
    from arborscan.functions import probs
    return t.view("chips").select("chip_id", probs.argmax(F.col("cells")).alias("argmax"))
