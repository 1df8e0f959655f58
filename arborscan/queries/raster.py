"""Pixel, chip and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan.functions import bands, chips as chip_fn, probs, rings
from arborscan.operators import cells, histogram, rasters, regions, scoring, segments, tiling
from arborscan.plans import detection
from arborscan.queries.registry import Tables, query
from arborscan.session import work_folder
from arborscan.sources import raster_table

CHIP = ["chip_id"]
BAND_NAMES = [f"b{i}" for i in range(9)]


def _chips(t: Tables):
    return t.view("chips").repartition("chip_id")  # work per chip is heavy, files are few


def _cells_of(df, column: str = "cells", *keep: str):
    """Long form of an array column: chip_id, x, y, v."""
    return rasters.to_cells(df.select("chip_id", *keep, "w", "h", F.col(column).alias("v")), ["v"])


def _scene(t: Tables):
    """Each band's chips side by side as one raster: band, x, y, v."""
    flat = _cells_of(_chips(t), "cells", "band", "scene")
    return flat.select("band", (F.col("scene") * 8 + F.col("x")).alias("x"), F.col("y").cast("long").alias("y"), "v")


_R = "r AS (SELECT band, scene * 8 + x AS x, CAST(y AS BIGINT) AS y, v FROM v_pixels)"


def _pass(fn: str, source: str, name: str, keys: str, radius: int) -> str:
    """Two CTEs for one separable window pass over columns x, y, v."""
    return f"""{name}x AS (SELECT {keys}, x, y, {fn}(v) OVER (PARTITION BY {keys}, y ORDER BY x RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {source}),
 {name} AS (SELECT {keys}, x, y, {fn}(v) OVER (PARTITION BY {keys}, x ORDER BY y RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {name}x)"""


@query("raster_scan_window", """
SELECT chip_id, CAST(x // 3 AS BIGINT) AS chip_x, CAST(y // 3 AS BIGINT) AS chip_y, x % 3 AS cx, y % 3 AS cy, CAST(v AS DOUBLE) AS v FROM v_pixels WHERE x < 6 AND y < 6""")
def raster_scan_window(t: Tables):
    """A window of every raster in a stored table, both ranges pushed to the scan, cut into chips."""
    folder = work_folder(t.spark, "raster")
    raster_table.write(_cells_of(_chips(t), "cells", "band"), folder, ["band"])
    window = raster_table.read_window(t.spark, folder, 0, 0, 6, 6)
    return tiling.chip_keys(window, 8, 8, 3, 3).select("chip_id", "chip_x", "chip_y", "cx", "cy", "v")


_PROB = "least(1, greatest(0, (v - 50) / 100.0))"


def _prob(cells_column: str = "cells"):
    return F.transform(cells_column, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - 50) / 100.0)))


@query("raster_write", f"SELECT chip_id, x, y, round({_PROB}, 4) AS v, 'EPSG:32636' AS crs, 1 AS bands FROM v_pixels")
def raster_write(t: Tables):
    """Probability rasters stored with their metadata, partitioned by band, and read back."""
    folder = work_folder(t.spark, "raster")
    scored = _chips(t).withColumn("cells", _prob())
    raster_table.write(raster_table.with_metadata(_cells_of(scored, "cells", "band"), crs="EPSG:32636", bands=1), folder, ["band"])
    return t.spark.read.parquet(folder).select("chip_id", "x", "y", F.round("v", 4).alias("v"), "crs", "bands")


@query("band_type_cast", "SELECT chip_id, x, y, CAST(least(255, greatest(0, floor(v * 2.5 - 100 + 0.5))) AS INTEGER) AS v FROM v_pixels")
def band_type_cast(t: Tables):
    return _cells_of(_chips(t)).withColumn("v", bands.to_type(F.col("v") * 2.5 - 100, "Byte"))


@query("chip_coverage_filter", """
SELECT scene, count(*) FILTER (WHERE v > 80) AS filled, count(*) AS cells FROM v_pixels WHERE band < 3 GROUP BY scene
HAVING count(*) FILTER (WHERE v > 80) > count(*) * 0.9""")
def chip_coverage_filter(t: Tables):
    first = _cells_of(_chips(t).where("band < 3"), "cells", "scene").withColumn("v", F.when(F.col("v") > 80, F.col("v")).otherwise(0))
    return tiling.covered_chips(first, ["scene"])


_TRUTH = "m AS (SELECT chip_id - 1 AS chip_id, x, y, CASE WHEN v > 100 THEN 1 ELSE 0 END AS t FROM v_pixels)"


def _with_truth(t: Tables):
    """Chips with ``truth``: the next chip's cells above 100 as 0/1."""
    chips = _chips(t)
    truth = chips.select((F.col("chip_id") - 1).alias("chip_id"), F.transform("cells", lambda v: (v > 100).cast("double")).alias("truth"))
    return chips.join(truth, "chip_id")


@query("chip_border_filter", f"""
WITH {_TRUTH}, c AS (SELECT chip_id, sum(t) AS n, sum(CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN t ELSE 0 END) AS i FROM m WHERE chip_id >= 0 GROUP BY 1)
SELECT chip_id, CAST(n AS INTEGER) AS mask_cells, CAST(i AS INTEGER) AS centre_cells FROM c WHERE n > 64 * 0.001 AND i > n - i""")
def chip_border_filter(t: Tables):
    from arborscan.operators import datasets
    return datasets.border_filter(_with_truth(t).withColumn("mask", F.col("truth")), inset=1).select("chip_id", "mask_cells", "centre_cells")


@query("chip_mask_counts", f"""
WITH {_TRUTH} SELECT chip_id, CAST(sum(t) AS INTEGER) AS mask_cells, CAST(sum(CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN t ELSE 0 END) AS INTEGER) AS centre_cells
FROM m WHERE chip_id >= 0 GROUP BY 1""")
def chip_mask_counts(t: Tables):
    from arborscan.operators import datasets
    return datasets.mask_counts(_with_truth(t).withColumn("mask", F.col("truth")), inset=1).select("chip_id", "mask_cells", "centre_cells")


@query("chip_mask_filter", f"""
WITH {_TRUTH}, c AS (SELECT chip_id, sum(t) * 255 AS s FROM m GROUP BY 1), k AS (SELECT p_partkey * 2 AS chip_id FROM part)
SELECT c.chip_id FROM c WHERE chip_id >= 0 AND ((c.chip_id * 2654435761) % 4294967296 < 0.1 * 4294967296 OR (s >= 255 * 20 AND chip_id IN (SELECT chip_id FROM k)))""")
def chip_mask_filter(t: Tables):
    from arborscan.operators import datasets
    components = t.table("part").select((F.col("p_partkey") * 2).alias("chip_id"), F.col("p_partkey").alias("component"))
    masks = _with_truth(t).select("chip_id", F.transform("truth", lambda v: v * 255).alias("mask"))
    return datasets.mask_filter(masks, components, "chip_id", pass_chance=0.1).select("chip_id")


@query("prob_threshold", f"SELECT chip_id, x, y FROM v_pixels WHERE {_PROB} > 0.3")
def prob_threshold(t: Tables):
    return _cells_of(_chips(t).withColumn("cells", _prob())).where(F.col("v") > detection.PROBABILITY).select("chip_id", "x", "y")


@query("cloud_threshold", f"""
WITH c AS (SELECT chip_id, x, y, greatest(0, v - 90) AS v FROM v_pixels), {_pass('max', 'c', 'a', 'chip_id', 2)}, {_pass('min', 'a', 'b', 'chip_id', 2)}, {_pass('max', 'b', 'd', 'chip_id', 1)}
SELECT chip_id, x, y FROM d WHERE v > 15""")
def cloud_threshold(t: Tables):
    clouds = _chips(t).withColumn("cells", F.transform("cells", lambda v: F.greatest(v - 90, F.lit(0.0))))
    clean = clouds.withColumn("cells", chip_fn.close5_dilate3(F.col("cells"), F.col("w"), F.col("h")))
    return _cells_of(clean).where(F.col("v") > detection.CLOUD).select("chip_id", "x", "y")


def _wide(t: Tables):
    return rasters.align_bands(_chips(t), ["scene"], list(range(9)), BAND_NAMES)


_WIDE = "w AS (SELECT scene, x, y, " + ", ".join(f"CAST(max(CASE WHEN band = {i} THEN v END) AS DOUBLE) AS b{i}" for i in range(9)) + \
        " FROM v_pixels GROUP BY ALL HAVING count(*) = 9)"


@query("band_align_join", f"WITH {_WIDE} SELECT scene, x, y, b0, b3, b4, b5 FROM w")
def band_align_join(t: Tables):
    wide = rasters.align_bands(_chips(t), ["scene"], list(range(9)), BAND_NAMES)
    return rasters.to_cells(wide, BAND_NAMES).select("scene", "x", "y", "b0", "b3", "b4", "b5")


@query("band_stack", f"WITH {_WIDE} SELECT scene, x, y, concat_ws(',', b0::INT, b1::INT, b2::INT, b3::INT, b4::INT, b5::INT, b6::INT, b7::INT, b8::INT) AS stack FROM w")
def band_stack(t: Tables):
    flat = rasters.to_cells(_wide(t), BAND_NAMES)
    return flat.select("scene", "x", "y", F.concat_ws(",", *[F.col(b).cast("int").cast("string") for b in BAND_NAMES]).alias("stack"))


@query("channel_select", f"WITH {_WIDE} SELECT scene, x, y, b7 AS first, b0 AS second, b2 AS last FROM w")
def channel_select(t: Tables):
    stacked = _wide(t).select("scene", "w", "h", F.array(*BAND_NAMES).alias("stack"))
    chosen = bands.select_channels(F.col("stack"), ["ndvi", "rgb"])
    named = stacked.select("scene", "w", "h", chosen[0].alias("first"), chosen[1].alias("second"), chosen[3].alias("last"))
    return rasters.to_cells(named, ["first", "second", "last"])


@query("channel_count", "SELECT scene, 10 AS channels FROM v_pixels GROUP BY scene HAVING count(DISTINCT band) = 9")
def channel_count(t: Tables):
    stacked = _wide(t).select("scene", F.array(*BAND_NAMES).alias("stack"), )
    twice = F.concat("stack", "stack")
    names = ["rgb", "b8", "ndmi"]
    assert bands.channel_count(names) == 5
    return stacked.select("scene", F.size(bands.select_channels(twice, names, 2)).alias("channels"))


@query("ndvi", f"WITH {_WIDE} SELECT scene, x, y, round((b3 - b0) / (b0 + b3 + 0.001), 6) AS ndvi FROM w")
def ndvi(t: Tables):
    flat = rasters.to_cells(_wide(t).select("scene", "w", "h", "b0", "b3"), ["b0", "b3"])
    return flat.select("scene", "x", "y", F.round(bands.ndvi(F.col("b0"), F.col("b3")), 6).alias("ndvi"))


@query("ndmi", f"WITH {_WIDE} SELECT scene, x, y, round((b4 - b5) / (b5 + b4 + 0.001), 6) AS ndmi FROM w")
def ndmi(t: Tables):
    flat = rasters.to_cells(_wide(t).select("scene", "w", "h", "b4", "b5"), ["b4", "b5"])
    return flat.select("scene", "x", "y", F.round(bands.ndmi(F.col("b5"), F.col("b4")), 6).alias("ndmi"))


@query("band_statistics", """
SELECT band, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM v_pixels GROUP BY band""")
def band_statistics(t: Tables):
    return rasters.statistics(_chips(t), ["band"]).select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("sigma_clip_scale", """
WITH s AS (SELECT band, greatest(min(v), avg(v) - 2 * stddev_pop(v)) AS lo, least(max(v), avg(v) + 2 * stddev_pop(v)) AS hi FROM v_pixels GROUP BY band)
SELECT chip_id, x, y, CAST(least(255, greatest(0, floor((v - lo) / (hi - lo) * 255 + 0.5))) AS INTEGER) AS v FROM v_pixels p JOIN s ON p.band = s.band""")
def sigma_clip_scale(t: Tables):
    return _cells_of(rasters.sigma_scaled(_chips(t), ["band"]))


@query("max_scale", "SELECT chip_id, x, y, round(v / max(v) OVER (PARTITION BY chip_id) * 255.0, 4) AS v FROM v_pixels")
def max_scale(t: Tables):
    return _cells_of(rasters.max_scaled(_chips(t), CHIP, 255.0)).withColumn("v", F.round("v", 4))


# scenes with a gap after every five: the previous one is the latest there is, not number - 1
_PREV = """px AS (SELECT *, scene + scene // 5 AS step FROM v_pixels),
 st AS (SELECT band, step, lag(step) OVER (PARTITION BY band ORDER BY step) AS before FROM (SELECT DISTINCT band, step FROM px)),
 q AS (SELECT c.chip_id, c.x, c.y, c.v AS cur, p.v AS prev FROM px c JOIN st ON st.band = c.band AND st.step = c.step
  JOIN px p ON p.band = c.band AND p.step = st.before AND c.x = p.x AND c.y = p.y)"""


def _steps(t: Tables):
    return _chips(t).withColumn("step", F.expr("scene + scene DIV 5"))


@query("norm_difference", f"WITH {_PREV} SELECT chip_id, x, y, CAST(floor(((cur - prev) / CAST(cur + prev AS DOUBLE) + 1) * 127) AS INTEGER) AS d FROM q")
def norm_difference(t: Tables):
    pairs = rasters.previous_chip(_steps(t), ["band"], "step").select("chip_id", "w", "h", "cells", "previous")
    flat = rasters.to_cells(pairs, ["cells", "previous"])
    return flat.select("chip_id", "x", "y", bands.difference_byte(F.col("cells"), F.col("previous")).alias("d"))


_MATCH = f"""{_PREV}, s AS (SELECT chip_id, prev AS v, count(*) AS n FROM q GROUP BY ALL), g AS (SELECT chip_id, cur AS v, count(*) AS n FROM q GROUP BY ALL),
 sc AS (SELECT chip_id, v, sum(n) OVER (PARTITION BY chip_id ORDER BY v) AS r FROM s),
 gc AS (SELECT chip_id, v, sum(n) OVER (PARTITION BY chip_id ORDER BY v) AS r FROM g),
 j AS (SELECT sc.chip_id, sc.v, sc.r, max(CASE WHEN gc.r <= sc.r THEN gc.r END) AS r0, max(CASE WHEN gc.r <= sc.r THEN gc.v END) AS v0,
   min(CASE WHEN gc.r >= sc.r THEN gc.r END) AS r1, min(CASE WHEN gc.r >= sc.r THEN gc.v END) AS v1 FROM sc JOIN gc ON sc.chip_id = gc.chip_id GROUP BY ALL),
 mt AS (SELECT chip_id, v, CASE WHEN r0 IS NULL THEN v1 WHEN r1 = r0 THEN v0 ELSE v0 + (r - r0) * (v1 - v0) / CAST(r1 - r0 AS DOUBLE) END AS matched FROM j)"""


@query("histogram_match", f"WITH {_MATCH} SELECT q.chip_id, q.x, q.y, round(mt.matched, 4) AS v FROM q JOIN mt ON q.chip_id = mt.chip_id AND q.prev = mt.v")
def histogram_match(t: Tables):
    pairs = rasters.previous_chip(_steps(t), ["band"], "step")
    return _cells_of(histogram.match(pairs, CHIP), "previous").withColumn("v", F.round("v", 4))


@query("cdf_match", """
WITH h AS (SELECT chip_id, v, count(*) AS n FROM v_pixels GROUP BY ALL)
SELECT chip_id, CAST(v AS DOUBLE) AS v, n, CAST(sum(n) OVER (PARTITION BY chip_id ORDER BY v) AS BIGINT) AS rank FROM h""")
def cdf_match(t: Tables):
    return histogram.cumulative(histogram.counts(_chips(t), CHIP), CHIP).select("chip_id", "v", "n", "rank")


@query("pair_feature_stack", f"""
WITH {_MATCH}, f AS (SELECT q.chip_id, q.x, q.y, q.cur, mt.matched AS p FROM q JOIN mt ON q.chip_id = mt.chip_id AND q.prev = mt.v)
SELECT chip_id, x, y, CAST(floor(round(((cur - p) / (cur + p) + 1) * 127, 6)) AS INTEGER) AS diff, CAST(cur AS INTEGER) AS cur, CAST(floor(p) AS INTEGER) AS prev FROM f""")
def pair_feature_stack(t: Tables):
    stacked = detection.pair_features(_steps(t), ["band"], CHIP, "step")
    return rasters.to_cells(stacked, ["diff", "cur", "prev"]).select("chip_id", "x", "y", "diff", "cur", "prev")


@query("softmax_argmax", f"""
WITH {_WIDE}, e AS (SELECT scene, x, y, exp((b0 - 100) / 20) AS e0, exp((b1 - 100) / 20) AS e1, exp((b2 - 100) / 20) AS e2 FROM w)
SELECT scene, x, y, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS class, round((e1 + e2) / (e0 + e1 + e2), 6) AS clear FROM e""")
def softmax_argmax(t: Tables):
    scored = _class_scores(t)
    return scored.select("scene", "x", "y", probs.argmax(F.col("p")).alias("class"), F.round(F.col("p")[1] + F.col("p")[2], 6).alias("clear"))


def _class_scores(t: Tables):
    """Three class scores per cell from the first three bands, their softmax and a truth class from the fourth."""
    flat = rasters.to_cells(_wide(t).select("scene", "w", "h", "b0", "b1", "b2", "b3"), ["b0", "b1", "b2", "b3"])
    scores = F.array(*[(F.col(b) - 100) / 20 for b in ("b0", "b1", "b2")])
    truth = F.when(F.col("b3") < 95, 0).when(F.col("b3") < 105, 1).otherwise(2)
    return flat.select("scene", "x", "y", scores.alias("z"), truth.alias("t")).withColumn("p", probs.softmax(F.col("z")))


@query("one_hot", f"WITH {_WIDE} SELECT scene, x, y, CASE WHEN b3 < 95 THEN '100' WHEN b3 < 105 THEN '010' ELSE '001' END AS hot FROM w")
def one_hot(t: Tables):
    hot = probs.one_hot(F.col("t"), 3)
    return _class_scores(t).select("scene", "x", "y", F.array_join(F.transform(hot, lambda v: v.cast("int").cast("string")), "").alias("hot"))


@query("mask_scale", f"SELECT chip_id, x, y, CAST(CASE WHEN {_PROB} * 255 / 255 > 0.5 THEN 255 ELSE 0 END AS INTEGER) AS v FROM v_pixels")
def mask_scale(t: Tables):
    scaled = _cells_of(_chips(t).withColumn("cells", F.transform(_prob(), lambda p: p * 255)))
    return scaled.withColumn("v", ((F.col("v") / 255 > 0.5).cast("int") * 255).alias("v"))


@query("raster_calc", f"""
WITH {_WIDE} SELECT scene, x, y, CASE WHEN b0 = 100 OR b3 = 90 THEN 65535 ELSE CAST(greatest(0, floor((b0 + b3) / 2 * (CASE WHEN b0 > 80 THEN 1 ELSE 0 END) + 0.5)) AS INTEGER) END AS result FROM w""")
def raster_calc(t: Tables):
    wide = _wide(t).select("scene", "w", "h", F.col("b0").alias("A"), F.col("b3").alias("B"))
    out = rasters.calc(rasters.to_cells(wide, ["A", "B"]), "(A + B) / 2 * CAST(A > 80 AS INT)", ["A", "B"],
                       nodata={"A": 100, "B": 90}, kinds={"A": "Byte", "B": "UInt16"})
    return out.select("scene", "x", "y", "result")


@query("user_expression", f"""
WITH {_WIDE}, m AS (SELECT p.scene, p.band, p.x, p.y, p.v AS a, w.b0 AS b FROM v_pixels p JOIN w ON p.scene = w.scene AND p.x = w.x AND p.y = w.y)
SELECT scene, band, x, y, round(a * 2.0 / (b + 1), 6) AS result FROM m""")
def user_expression(t: Tables):
    """One formula over every band of a scene against its first band."""
    complete = _wide(t).select("scene", F.col("b0").alias("cells"))
    out = rasters.calc_all_bands(_chips(t), complete, ["scene"], "A * 2.0 / (B + 1)")
    return out.select("scene", "band", "x", "y", F.round("result", 6).alias("result"))


@query("mosaic", """
WITH s AS (SELECT scene * 8 + x + band * 4 AS x, y, v, band FROM v_pixels WHERE v <> 100)
SELECT x, y, CAST(arg_max(v, band) AS DOUBLE) AS v FROM s GROUP BY x, y""")
def mosaic(t: Tables):
    """Nine sources, each shifted by half a chip, laid over each other."""
    flat = _cells_of(_chips(t), "cells", "band", "scene")
    sources = [flat.where(F.col("band") == b).select((F.col("scene") * 8 + F.col("x") + b * 4).alias("x"), "y", "v") for b in range(9)]
    return rasters.mosaic(sources, [], nodata=100)


@query("mosaic_grids", """
WITH s AS (SELECT 0 AS n, scene * 8 + x AS x, CAST(y AS BIGINT) + 4 AS y, v FROM v_pixels WHERE band = 0
 UNION ALL SELECT 1, (scene * 8 + x) * 2 + i + 3, y * 2 + j, v FROM v_pixels, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE band = 1
 UNION ALL SELECT 2, (scene * 8 + x) // 2 + 1, y // 2 + 6, v FROM v_pixels WHERE band = 2 AND x % 2 = 1 AND y % 2 = 1)
SELECT x, y, CAST(arg_max(v, n) AS DOUBLE) AS v FROM s WHERE v <> 100 GROUP BY x, y""")
def mosaic_grids(t: Tables):
    """Bands with cells of 10, 20 and 5 metres on one lattice of 10 metres."""
    scene = _scene(t)
    width = 8 * (t.view("chips").agg(F.max("scene")).first()[0] + 1)
    grids = [rasters.Grid(0, 120, width, 8, 10, 10), rasters.Grid(30, 160, width, 8, 20, 20), rasters.Grid(10, 100, width, 8, 5, 5)]
    sources = [(scene.where(F.col("band") == b).select("x", "y", "v"), grid) for b, grid in enumerate(grids)]
    return rasters.mosaic_grids(sources, [], nodata=100, aligned=True)[0]


@query("resample_nearest", """
SELECT chip_id, x * 2 + i AS x, y * 2 + j AS y, CAST(v AS DOUBLE) AS v FROM v_pixels, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""")
def resample_nearest(t: Tables):
    fine = _chips(t).withColumn("cells", chip_fn.resample(F.col("cells"), F.col("w"), F.col("h"), 2))
    return _cells_of(fine.withColumns({"w": F.col("w") * 2, "h": F.col("h") * 2}))


@query("chip_tiling", """
SELECT concat('S', scene, '_', y // 4, '_', x // 4, '.tiff') AS piece_image, CAST(600005 + x // 4 * 40 AS DOUBLE) AS left_x, CAST(5499995 - y // 4 * 40 AS DOUBLE) AS top_y,
 CAST(1600 AS DOUBLE) AS area FROM v_pixels WHERE band = 0 AND x % 4 = 0 AND y % 4 = 0""")
def chip_tiling(t: Tables):
    scenes = _chips(t).where("band = 0").select(F.concat(F.lit("S"), F.col("scene").cast("string")).alias("image"), "w", "h")
    index = tiling.chip_index(scenes, 4, 4)
    ring = tiling.footprint(*[F.col(c) for c in ("start_x", "start_y", "width", "height")], (10.0, 0.0, 600000.0, 0.0, -10.0, 5500000.0))
    placed = index.select("piece_image", F.array(ring).alias("shape"))
    return placed.select("piece_image", F.col("shape")[0][0]["x"].alias("left_x"), F.col("shape")[0][0]["y"].alias("top_y"), rings.area(F.col("shape")).alias("area"))


@query("mask_split_join", f"""
WITH {_R} SELECT band, CAST(x // 4 * 4 AS BIGINT) AS start_x, CAST(y // 4 * 4 AS BIGINT) AS start_y, count(*) FILTER (WHERE v > 100) AS mask_cells FROM r GROUP BY ALL""")
def mask_split_join(t: Tables):
    return tiling.cut_mask(_scene(t), 4, 4).groupBy("band", "start_x", "start_y").agg(F.count_if(F.col("v") > 100).alias("mask_cells"))


@query("erode3_close5", f"""
WITH p AS (SELECT chip_id, x, y, v FROM v_pixels), {_pass('min', 'p', 'a', 'chip_id', 1)}, {_pass('max', 'a', 'b', 'chip_id', 2)}, {_pass('min', 'b', 'c', 'chip_id', 2)}
SELECT chip_id, x, y, CAST(v AS DOUBLE) AS v FROM c""")
def erode3_close5(t: Tables):
    return _cells_of(_chips(t).withColumn("cells", chip_fn.erode3_close5(F.col("cells"), F.col("w"), F.col("h"))))


@query("close5_dilate3", f"""
WITH {_R}, {_pass('max', 'r', 'a', 'band', 2)}, {_pass('min', 'a', 'b', 'band', 2)}, {_pass('max', 'b', 'c', 'band', 1)}
SELECT band, x, y, CAST(v AS DOUBLE) AS v FROM c""")
def close5_dilate3(t: Tables):
    """Across the whole raster of each band, beyond the chip borders."""
    return rasters.scene_morphology(_scene(t), ["band"], chip_fn.close5_dilate3, chip_fn.CLOUD_REACH, 32)


@query("mask_accumulate", f"WITH {_R} SELECT x, y, CAST(sum(v) AS DOUBLE) AS v FROM r GROUP BY x, y")
def mask_accumulate(t: Tables):
    return rasters.accumulate(_scene(t), [])


_REG = f"""{_R}, m AS (SELECT band, x, y, x * 8 + y AS k FROM r WHERE v > 112),
 g(band, k, root) AS (SELECT band, k, k FROM m UNION SELECT n.band, n.k, g.root FROM g JOIN m o ON o.band = g.band AND o.k = g.k
  JOIN m n ON n.band = o.band AND abs(n.x - o.x) <= 1 AND abs(n.y - o.y) <= 1),
 c AS (SELECT band, k, min(root) AS region FROM g GROUP BY ALL)"""


@query("polygonize", f"WITH RECURSIVE {_REG} SELECT band, min(k) AS first_cell, CAST(count(*) AS DOUBLE) AS area FROM c GROUP BY band, region")
def polygonize(t: Tables):
    """Regions of the mask as polygons with holes; a region is named by its first cell."""
    mask = _scene(t).where("v > 112").select("band", "x", "y")
    labelled = regions.label_regions(mask, ["band"], 32)
    first = labelled.groupBy("band", "region").agg(F.min(F.col("x") * 8 + F.col("y")).alias("first_cell"))
    shapes = regions.polygonize(labelled, ["band"], holes="ring")
    return shapes.join(first, ["band", "region"]).select("band", "first_cell", rings.area(F.col("shape")).alias("area"))


def _patches(t: Tables):
    """Rectangles on the band rasters, spread farther along with more parts."""
    p = t.table("part")
    x0, y0 = (F.col("p_partkey") * 7919) % 440 + F.floor(F.col("p_partkey") / 2000) * 160, F.col("p_partkey") % 6
    shape = rings.rectangle(x0, y0, x0 + F.col("p_size") % 7 + 1, y0 + F.col("p_size") % 2 + 1)
    state = F.when(F.col("p_size") % 3 == 0, "overgrown").otherwise("open")
    return p.select((F.col("p_partkey") % 9).alias("band"), F.col("p_partkey").alias("pk"), state.alias("state"), shape.alias("shape"))


_PATCH = """t AS (SELECT p_partkey % 9 AS band, CASE WHEN p_size % 3 = 0 THEN 'overgrown' ELSE 'open' END AS state, (p_partkey * 7919) % 440 + p_partkey // 2000 * 160 + i AS x, p_partkey % 6 + j AS y
 FROM part, (SELECT unnest(range(0, 7)) AS i), (SELECT unnest(range(0, 2)) AS j) WHERE i <= p_size % 7 AND j <= p_size % 2)"""


@query("rasterize_polygons", f"WITH {_PATCH} SELECT DISTINCT band, x, y FROM t")
def rasterize_polygons(t: Tables):
    return regions.rasterize(_patches(t), ["band"], "pk", "shape")


@query("polygon_raster_mask", f"""
WITH {_R}, {_PATCH}, d AS (SELECT DISTINCT band, x, y FROM t)
SELECT r.band, r.x, r.y, CAST(CASE WHEN d.x IS NULL THEN 0 ELSE v END AS DOUBLE) AS v FROM r LEFT JOIN d ON r.band = d.band AND r.x = d.x AND r.y = d.y""")
def polygon_raster_mask(t: Tables):
    return regions.mask_by_polygons(_scene(t), _patches(t), ["band"], "pk", "shape")


@query("state_color_series", f"""
WITH {_R}, {_PATCH}, d AS (SELECT DISTINCT state, x, y FROM t), k AS (SELECT d.state, r.band, r.x // 8 AS scene, r.v FROM r JOIN d ON r.x = d.x AND r.y = d.y WHERE r.band < 3 AND v <> 0)
SELECT scene, state, round(avg(CASE WHEN band = 0 THEN v END) / 255, 6) AS red, round(avg(CASE WHEN band = 1 THEN v END) / 255, 6) AS green,
 round(avg(CASE WHEN band = 2 THEN v END) / 255, 6) AS blue FROM k GROUP BY ALL""")
def state_color_series(t: Tables):
    from arborscan.operators import series
    colours = series.state_colors(_scene(t).where("band < 3").withColumn("scene", F.floor(F.col("x") / 8)), _patches(t).drop("band"), "scene")
    return colours.select("scene", "state", *[F.round(c, 6).alias(c) for c in ("red", "green", "blue")])


@query("laplacian_sharpen", """
WITH n AS (SELECT chip_id, x, y, v, CASE WHEN x + i < 0 THEN 1 WHEN x + i > 7 THEN 6 ELSE x + i END AS nx, CASE WHEN y + j < 0 THEN 1 WHEN y + j > 7 THEN 6 ELSE y + j END AS ny
  FROM v_pixels, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))
SELECT n.chip_id, n.x, n.y, CAST(least(255, greatest(0, 10 * n.v - sum(p.v))) AS DOUBLE) AS v FROM n JOIN v_pixels p ON p.chip_id = n.chip_id AND p.x = n.nx AND p.y = n.ny GROUP BY n.chip_id, n.x, n.y, n.v""")
def laplacian_sharpen(t: Tables):
    return _cells_of(_chips(t).withColumn("cells", chip_fn.laplacian_sharpen(F.col("cells"), F.col("w"), F.col("h"))))


_OTSU = """h AS (SELECT chip_id, v, count(*) AS n FROM v_pixels GROUP BY ALL),
 s AS (SELECT chip_id, v, sum(n) OVER a AS w0, sum(v * n) OVER a AS s0, sum(n) OVER (PARTITION BY chip_id) AS w, sum(v * n) OVER (PARTITION BY chip_id) AS s
  FROM h WINDOW a AS (PARTITION BY chip_id ORDER BY v)),
 b AS (SELECT chip_id, v, CASE WHEN w = w0 THEN 0 ELSE CAST(w0 AS DOUBLE) * (w - w0) * (CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / (w - w0)) ** 2 END AS score FROM s),
 otsu AS (SELECT chip_id, CAST(v AS DOUBLE) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY round(score, 6) DESC, v) AS r FROM b) q WHERE r = 1)"""


@query("otsu_threshold", f"WITH {_OTSU} SELECT chip_id, threshold FROM otsu")
def otsu_threshold(t: Tables):
    return histogram.chip_otsu(_chips(t)).select("chip_id", "threshold")


# chamfer distances from the closed form: the steps to the nearest background cell, diagonal ones first
_DISTANCE = f"""{_OTSU}, m AS (SELECT p.chip_id, x, y, p.v > threshold AS marked FROM v_pixels p JOIN otsu USING (chip_id)),
 k AS (SELECT m.*, min(CASE WHEN NOT m.marked THEN 0 ELSE {segments.STRAIGHT} * abs(abs(m.x - b.x) - abs(m.y - b.y)) + {segments.DIAGONAL} * least(abs(m.x - b.x), abs(m.y - b.y)) END) AS d
  FROM m LEFT JOIN m b ON b.chip_id = m.chip_id AND NOT b.marked GROUP BY ALL),
 dist AS (SELECT chip_id, x, y, CASE WHEN max(d) OVER c > min(d) OVER c THEN (coalesce(d, 0) - min(d) OVER c) / (max(d) OVER c - min(d) OVER c) ELSE 0 END AS d
  FROM k WINDOW c AS (PARTITION BY chip_id))"""


@query("distance_transform", f"WITH {_DISTANCE} SELECT chip_id, x, y, round(d, 6) AS v FROM dist")
def distance_transform(t: Tables):
    """Normalised chamfer distance of the Otsu mask per chip."""
    from arborscan.plans import instances
    return _cells_of(instances.distances(_chips(t), CHIP), "distance").withColumn("v", F.round("v", 6))


@query("watershed_segments")
def watershed_segments(t: Tables):
    from arborscan.plans import instances
    return _cells_of(instances.watershed(_chips(t), CHIP), "instance")


@query("raster_reproject", f"""
WITH {_R} SELECT a.band, a.x, a.y, CAST(COALESCE(b.v, 0) AS DOUBLE) AS v FROM r a LEFT JOIN r b ON a.band = b.band
 AND b.x = CAST(floor((a.x + 0.5) * 0.75 + 2) AS BIGINT) AND b.y = CAST(floor((a.y + 0.5) * 1.5 - 1) AS BIGINT)""")
def raster_reproject(t: Tables):
    """Nearest-cell regridding; the target grid is a scaled and shifted one."""
    scene = _scene(t)
    return rasters.with_reprojection(scene, scene.select("band", "x", "y"), ["band"],
                                     lambda x, y: ((x + 0.5) * 0.75 + 2, (y + 0.5) * 1.5 - 1), nodata=0.0)


_SCORE = f"""{_MATCH}, f AS (SELECT q.chip_id, q.x, q.y, q.cur, floor(round(mt.matched, 9)) AS p FROM q JOIN mt ON q.chip_id = mt.chip_id AND q.prev = mt.v),
 k AS (SELECT chip_id, x, y, least(1.0, greatest(0.0, (p - cur) / greatest(p, 1) + 0.5)) AS v FROM f)"""


@query("score_chips", f"WITH {_SCORE} SELECT chip_id, x, y, round(v, 6) AS v FROM k")
def score_chips(t: Tables):
    """Difference, current and previous images of every chip through the stand-in scorer."""
    scored = scoring.score_chips(detection.model_input(_steps(t), ["band"], CHIP, "step"))
    return _cells_of(scored).withColumn("v", F.round("v", 6))


@query("multi_model_score", f"""
WITH {_SCORE} SELECT 'drop' AS model, chip_id, round(max(v), 6) AS top FROM k GROUP BY chip_id UNION ALL SELECT 'gain', chip_id, round(max(1 - v), 6) FROM k GROUP BY chip_id""")
def multi_model_score(t: Tables):
    stacks = detection.model_input(_steps(t), ["band"], CHIP, "step")
    inverse = lambda: (lambda batch: [1 - g for g in scoring.mean_drop(batch)])
    scored = scoring.score_with_models(stacks, {"drop": lambda: scoring.mean_drop, "gain": inverse})
    return scored.groupBy("model", "chip_id").agg(F.round(F.max(F.array_max("cells")), 6).alias("top"))
