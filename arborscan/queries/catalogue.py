"""Catalogue queries: listings, quality, states, names and scene pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborscan import schemas
from arborscan.functions import names, rings
from arborscan.operators import catalog
from arborscan.queries.registry import Tables, query
from arborscan.session import work_folder
from arborscan.sources import chips as chip_files, geojson, kml

MARKS_PER_FILE = 100_000  # placemarks of a KML file


@query("scene_listing", "SELECT scene_id, path FROM v_scenes WHERE path LIKE 'L2/tiles/36/U/YA/%'")
def scene_listing(t: Tables):
    return catalog.scenes_of_tile(t.view("scenes").select("scene_id", "path"), "36UYA")


@query("scene_metadata_xml", """
SELECT scene_id, CAST(regexp_extract(xml, 'NODATA_PIXEL_PERCENTAGE>([0-9.]+)<', 1) AS DOUBLE) AS nodata_pixel,
       CAST(regexp_extract(xml, 'CLOUDY_PIXEL_PERCENTAGE>([0-9.]+)<', 1) AS DOUBLE) AS cloud_coverage FROM v_scenes""")
def scene_metadata_xml(t: Tables):
    nodata, cloud = catalog.metadata_percentages(F.col("xml"))
    return t.view("scenes").select("scene_id", nodata.alias("nodata_pixel"), cloud.alias("cloud_coverage"))


@query("granule_first_child", """
SELECT l_orderkey AS scene_id,
       rtrim(min(concat('S', CAST(l_orderkey AS STRING), '/GRANULE/L2A_', CAST(l_linenumber AS STRING), '_',
                        CAST(l_partkey AS STRING), '/')), '/') AS tile_uri
FROM lineitem GROUP BY l_orderkey""")
def granule_first_child(t: Tables):
    path = F.concat(F.lit("S"), F.col("l_orderkey").cast("string"), F.lit("/GRANULE/L2A_"),
                    F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("/"))
    return catalog.first_granule(t.table("lineitem").select(F.col("l_orderkey").alias("scene_id"), path.alias("path")))


@query("band_manifest", """
SELECT scene_id,
       max(CASE WHEN file LIKE '%B04%' THEN file END) AS b04_path, max(CASE WHEN file LIKE '%B08%' THEN file END) AS b08_path,
       max(CASE WHEN file LIKE '%TCI%' THEN file END) AS tci_path, max(CASE WHEN file LIKE '%B11%' THEN file END) AS b11_path,
       max(CASE WHEN file LIKE '%B12%' THEN file END) AS b12_path, max(CASE WHEN file LIKE '%B8A%' THEN file END) AS b8a_path,
       max(CASE WHEN file LIKE '%CLDPRB%' THEN file END) AS clouds_path,
       CAST(CASE WHEN count(DISTINCT CASE WHEN file LIKE '%R10m%' THEN 1 WHEN file LIKE '%R20m%' THEN 2 ELSE 3 END) < 3 THEN -1
            ELSE count(DISTINCT CASE WHEN file NOT LIKE '%WVP%' AND file NOT LIKE '%SNW%' THEN file END) END AS INTEGER) AS is_downloaded
FROM v_files GROUP BY scene_id""")
def band_manifest(t: Tables):
    return catalog.band_manifest(t.view("files"), ["scene_id"])


@query("scene_upsert", """
WITH k AS (SELECT tile_id, image_date, min(cloud_tenths * 1000 + nodata_tenths) AS c, max(is_new) AS n FROM v_scenes GROUP BY ALL),
     i AS (SELECT tile_id, image_date, min(cloud_tenths * 1000 + nodata_tenths) AS c FROM v_incoming
           WHERE nodata_tenths < 50 AND cloud_tenths < 500 GROUP BY ALL)
SELECT COALESCE(k.tile_id, i.tile_id) AS tile_id, COALESCE(k.image_date, i.image_date) AS image_date,
       COALESCE(k.c, i.c) // 1000 AS cloud_tenths, COALESCE(k.c, i.c) % 1000 AS nodata_tenths,
       CAST(CASE WHEN i.tile_id IS NOT NULL THEN 1 ELSE k.n END AS INTEGER) AS is_new
FROM k FULL JOIN i ON k.tile_id = i.tile_id AND k.image_date = i.image_date""")
def scene_upsert(t: Tables):
    good = catalog.within_quality(F.col("nodata_tenths"), F.col("cloud_tenths"), 50, 500)
    return catalog.upsert_scenes(t.view("scenes"), t.view("incoming").where(good), ["cloud_tenths", "nodata_tenths"])


@query("geojson_read", """
SELECT markup_id AS pk, state, img_date, CAST(area AS DOUBLE) AS area FROM v_markup""")
def geojson_read(t: Tables):
    """Markup written as feature files, read back with its properties."""
    lines = t.view("markup").select(geojson.feature_text(
        geojson.rectangle(F.lit(0), F.lit(0), F.col("side"), F.col("side")),
        pk=F.col("markup_id"), state=F.col("state"), img_date=F.date_format("img_date", "yyyy/MM/dd")).alias("value"))
    folder = work_folder(t.spark, "markup")
    lines.write.text(folder)
    rows = geojson.read_features(t.spark, folder, schemas.MARKUP_PROPERTIES)
    return rows.select("pk", "state", F.to_date("img_date", "yyyy/MM/dd").alias("img_date"),
                       geojson.area_of("geometry").alias("area"))


@query("geojson_write", """
SELECT concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', x0, '.0,', y0, '.0],[', x1, '.0,', y0, '.0],[', x1, '.0,', y1, '.0],[',
 x0, '.0,', y1, '.0],[', x0, '.0,', y0, '.0]]]},"properties":{"det_id":', det_id, ',"forest":', forest, ',"clouds":', clouds, '}}') AS value FROM v_detections""")
def geojson_write(t: Tables):
    """Detections written as feature files; the lines as they stand in the files."""
    folder = work_folder(t.spark, "features")
    shape = rings.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    geojson.write_features(t.view("detections").select("det_id", "forest", "clouds", shape.alias("geometry")), folder)
    return t.spark.read.text(folder)


@query("tile_bounds_read", """
SELECT concat('T', CAST(mask_id AS STRING), kind) AS name, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin,
       CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax FROM v_masks""")
def tile_bounds_read(t: Tables):
    """Outlines written as KML files of placemarks, read back as boxes."""
    corner = [F.concat_ws(",", x, y, F.lit("0")) for x, y in
              (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]
    ring = F.struct(F.struct(F.struct(F.concat_ws(" ", *corner).alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs"))
    marks = t.view("masks").select(F.concat(F.lit("T"), F.col("mask_id").cast("string"), "kind").alias("name"), ring.alias("Polygon"))
    folder = work_folder(t.spark, "kml")
    # a KML file is read by one task: files of bounded length, however much one task writes
    marks.write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").option("maxRecordsPerFile", MARKS_PER_FILE).save(folder)
    return kml.read_tile_bounds(t.spark, folder)


@query("landcover_cache", """
SELECT m.mask_id, m.tile_id FROM v_masks m WHERE m.kind = 'forest' AND EXISTS
  (SELECT 1 FROM v_tiles t WHERE t.tile_id = m.tile_id AND t.is_tracked = 1)
  AND m.tile_id NOT IN (SELECT tile_id FROM v_tiles WHERE last_date IS NULL)""")
def landcover_cache(t: Tables):
    """A cache that holds some tiles already is refreshed; what comes back are the tiles added."""
    from arborscan.sources import landcover
    tiles = t.view("tiles")
    forest = t.view("masks").where("kind = 'forest'")
    cached = tiles.where(F.col("last_date").isNull()).select("tile_id")
    wanted = tiles.where("is_tracked = 1").select("tile_id")
    folder = work_folder(t.spark, "landcover")
    landcover.refresh_cache(t.spark, folder, forest, cached)
    held = landcover.refresh_cache(t.spark, folder, forest, wanted)
    return held.join(cached, "tile_id", "left_anti").select("mask_id", "tile_id")


@query("chip_index_csv", """
SELECT concat('S', scene, '.tif') AS original_image, concat('S', scene, '_', y // 4, '_', x // 4, '.tiff') AS piece_image,
       concat('S', scene, '_', y // 4, '_', x // 4, '.geojson') AS piece_geojson, CAST(x // 4 * 4 AS BIGINT) AS start_x,
       CAST(y // 4 * 4 AS BIGINT) AS start_y, CAST(4 AS BIGINT) AS width, CAST(4 AS BIGINT) AS height
FROM v_pixels WHERE band = 0 AND x % 4 = 0 AND y % 4 = 0""")
def chip_index_csv(t: Tables):
    from arborscan.operators import tiling
    scenes = t.view("chips").where("band = 0").select(F.concat(F.lit("S"), F.col("scene").cast("string")).alias("image"), "w", "h")
    folder = work_folder(t.spark, "chip-index")
    chip_files.write_index(tiling.chip_index(scenes, 4, 4), folder)
    return chip_files.read_index(t.spark, folder)


@query("db_table_io", """
SELECT o.o_orderkey AS id, o.o_custkey % 25 AS tile_id,
       COALESCE('r' || CAST(u.n AS STRING), CASE WHEN o.o_orderstatus = 'F' THEN 'done' END) AS result
FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) u ON o.o_orderkey = u.l_orderkey""")
def db_table_io(t: Tables):
    tasks = t.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("tile_id"),
                                     F.when(F.col("o_orderstatus") == "F", "done").alias("result"))
    updates = (t.table("lineitem").groupBy(F.col("l_orderkey").alias("id"))
               .agg(F.concat(F.lit("r"), F.max("l_linenumber").cast("string")).alias("result")))
    return catalog.apply_updates(tasks, updates, "id", ["result"])


@query("scene_pair_results_scan", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS image_date_1 FROM orders WHERE o_orderstatus = 'F'""")
def scene_pair_results_scan(t: Tables):
    from arborscan.sources import tables
    tasks = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("image_date_1"),
                                     F.when(F.col("o_orderstatus") == "F", F.lit("p")).alias("result"))
    return tables.finished_tasks(tasks).select("id", "image_date_1")


@query("tile_seed", """
SELECT DISTINCT concat(CAST(30 + c_nationkey AS STRING), 'U', chr(65 + c_nationkey % 8), chr(65 + CAST(c_custkey % 5 AS INTEGER))) AS tile_index,
       1 AS is_tracked, CAST(NULL AS DATE) AS first_date, CAST(NULL AS DATE) AS last_date
FROM customer WHERE tile_index NOT IN (SELECT tile_index FROM v_tiles)""")
def tile_seed(t: Tables):
    listed = t.table("customer").select(F.expr(
        "concat(CAST(30 + c_nationkey AS STRING), 'U', chr(65 + c_nationkey % 8), chr(65 + c_custkey % 5), ', ')").alias("tiles"))
    return catalog.seed_tiles(listed, t.view("tiles"))


@query("tiles_backfill", "SELECT tile_id, tile_index FROM v_tiles WHERE is_tracked = 1 AND first_date IS NULL")
def tiles_backfill(t: Tables):
    return catalog.tiles_to_backfill(t.view("tiles")).select("tile_id", "tile_index")


@query("tiles_incremental", "SELECT tile_id, tile_index FROM v_tiles WHERE is_tracked = 1 AND first_date IS NOT NULL")
def tiles_incremental(t: Tables):
    return catalog.tiles_to_update(t.view("tiles")).select("tile_id", "tile_index")


@query("scene_quality_filter", """
SELECT scene_id, tile_id, image_date FROM v_scenes WHERE nodata_tenths < 50 AND cloud_tenths < 500""")
def scene_quality_filter(t: Tables):
    good = catalog.within_quality(F.col("nodata_tenths"), F.col("cloud_tenths"), 50, 500)
    return t.view("scenes").where(good).select("scene_id", "tile_id", "image_date")


@query("scene_since_start", "SELECT scene_id, image_date FROM v_scenes WHERE image_date > DATE '1998-05-01'")
def scene_since_start(t: Tables):
    return catalog.since_start(t.view("scenes"), "1998-05-01").select("scene_id", "image_date")


@query("scene_since_last", """
SELECT s.scene_id, s.tile_id, s.image_date FROM v_scenes s JOIN v_tiles t ON s.tile_id = t.tile_id
WHERE s.image_date >= t.last_date""")
def scene_since_last(t: Tables):
    return catalog.since_last(t.view("scenes"), t.view("tiles")).select("scene_id", "tile_id", "image_date")


@query("scenes_ready", "SELECT scene_id, image_date FROM v_scenes WHERE is_downloaded = 7 AND is_new = 1 AND path IS NOT NULL")
def scenes_ready(t: Tables):
    return catalog.ready_scenes(t.view("scenes"), ["path"]).select("scene_id", "image_date").orderBy("image_date")


@query("scenes_to_download", """
SELECT s.scene_id, t.tile_index, s.image_date FROM v_scenes s JOIN v_tiles t ON s.tile_id = t.tile_id WHERE s.is_new = 1""")
def scenes_to_download(t: Tables):
    return (t.view("scenes").where("is_new = 1").join(t.view("tiles").select("tile_id", "tile_index"), "tile_id")
            .select("scene_id", "tile_index", "image_date").orderBy("image_date"))


@query("prepared_all", "SELECT scene_id, tile_id, image_date FROM v_scenes WHERE success = 1")
def prepared_all(t: Tables):
    return catalog.prepared_scenes(t.view("scenes")).select("scene_id", "tile_id", "image_date")


@query("prepared_new", "SELECT scene_id, tile_id, image_date FROM v_scenes WHERE success = 1 AND is_new = 1")
def prepared_new(t: Tables):
    return catalog.prepared_scenes(t.view("scenes"), only_new=True).select("scene_id", "tile_id", "image_date")


_INFO = """SELECT scene_id, s.tile_id, t.tile_index FROM v_scenes s JOIN v_tiles t ON s.tile_id = t.tile_id
WHERE t.is_tracked = 1 AND s.is_downloaded = 7 AND s.is_new = {flag} AND s.path LIKE '%MSIL2A%' AND s.path LIKE '%T36%'"""


@query("convertible_tiles", _INFO.format(flag=1))
def convertible_tiles(t: Tables):
    scenes = t.view("scenes").select("scene_id", "tile_id", "is_downloaded", "is_new", "path", F.col("path").alias("tci"))
    out = catalog.state_filter(scenes, t.view("tiles"), {"is_downloaded": 7, "is_new": 1}, {"path": "MSIL2A", "tci": "T36"})
    return out.select("scene_id", "tile_id", "tile_index")


@query("uploadable_tiles", _INFO.format(flag=0))
def uploadable_tiles(t: Tables):
    scenes = t.view("scenes").select("scene_id", "tile_id", "is_downloaded", "is_new", "path", F.col("path").alias("tci"))
    out = catalog.state_filter(scenes, t.view("tiles"), {"is_downloaded": 7, "is_new": 0}, {"path": "MSIL2A", "tci": "T36"})
    return out.select("scene_id", "tile_id", "tile_index")


_DAILY = """d AS (SELECT tile_id, image_date, min(scene_id) AS scene_id FROM v_scenes WHERE success = 1 GROUP BY ALL)"""


def _daily(t: Tables):
    return catalog.scene_per_day(t.view("scenes").where("success = 1"), ["scene_id"])


@query("scene_pairs", f"""
WITH {_DAILY}, p AS (SELECT tile_id, image_date AS image_date_0, scene_id AS scene_id_0,
  lead(image_date) OVER w AS image_date_1, lead(scene_id) OVER w AS scene_id_1 FROM d WINDOW w AS (PARTITION BY tile_id ORDER BY image_date))
SELECT * FROM p WHERE image_date_1 IS NOT NULL""")
def scene_pairs(t: Tables):
    return catalog.scene_pairs(_daily(t), ["scene_id"])


@query("baseline_carry", f"""
WITH {_DAILY} SELECT tile_id, image_date, scene_id,
  CASE WHEN image_date < max(image_date) OVER (PARTITION BY tile_id) THEN 0 ELSE 1 END AS is_new FROM d""")
def baseline_carry(t: Tables):
    return catalog.carry_baseline(_daily(t).withColumn("is_new", F.lit(1)))


@query("pair_skip_done", f"""
WITH {_DAILY}, p AS (SELECT tile_id, image_date AS image_date_0,
  lead(image_date) OVER (PARTITION BY tile_id ORDER BY image_date) AS image_date_1 FROM d)
SELECT p.tile_id, p.image_date_0, p.image_date_1 FROM p WHERE image_date_1 IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM v_incoming i WHERE i.tile_id = p.tile_id AND i.image_date = p.image_date_0)""")
def pair_skip_done(t: Tables):
    pairs = catalog.scene_pairs(_daily(t), [])
    done = t.view("incoming").select("tile_id", F.col("image_date").alias("image_date_0")).distinct()
    results = pairs.join(done, ["tile_id", "image_date_0"], "left_semi")
    return catalog.skip_done(pairs, results)


@query("tile_fk_join", """
SELECT s.scene_id, t.tile_index, s.image_date FROM v_scenes s JOIN v_tiles t ON s.tile_id = t.tile_id""")
def tile_fk_join(t: Tables):
    return t.view("scenes").join(t.view("tiles").select("tile_id", "tile_index"), "tile_id").select("scene_id", "tile_index", "image_date")


@query("tile_date_span", f"""
WITH {_DAILY}, s AS (SELECT tile_id, min(image_date) AS lo, max(image_date) AS hi, count(*) AS n FROM d GROUP BY 1)
SELECT t.tile_id, LEAST(t.first_date, s.lo) AS first_date, GREATEST(t.last_date, s.hi) AS last_date
FROM v_tiles t LEFT JOIN s ON t.tile_id = s.tile_id AND s.n > 1""")
def tile_date_span(t: Tables):
    tasks = catalog.scene_pairs(_daily(t), [])
    return catalog.extend_tile_dates(t.view("tiles"), tasks).select("tile_id", "first_date", "last_date")


@query("pending_count", """
SELECT o_custkey % 25 AS tile_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS pending,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1""")
def pending_count(t: Tables):
    tasks = t.table("orders").select((F.col("o_custkey") % 25).alias("tile_id"),
                                     F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("date_finished"))
    return catalog.pending_tasks(tasks)


@query("sorted_scan", "SELECT scene_id, tile_id, image_date FROM v_scenes")
def sorted_scan(t: Tables):
    return t.view("scenes").select("scene_id", "tile_id", "image_date").orderBy(F.desc("image_date"), "scene_id")


@query("scene_state_transitions", """
SELECT s.scene_id, CASE WHEN s.scene_id % 17 = 0 THEN -1 ELSE 1 END AS is_prepared,
       CASE WHEN s.is_downloaded = 7 THEN 1 ELSE 0 END AS is_downloaded FROM v_scenes s""")
def scene_state_transitions(t: Tables):
    scenes = t.view("scenes")
    stages = {"downloaded": scenes.where("is_downloaded = 7"), "prepared": scenes.where("success = 1")}
    failures = scenes.where("success = -1").select("scene_id", F.lit("prepared").alias("stage"))
    return catalog.derive_states(scenes, stages, failures)


@query("tile_name_to_uri", """
SELECT tile_index, CASE WHEN CAST(regexp_extract(tile_index, '^[0-9]+') AS INTEGER) BETWEEN 1 AND 60
  THEN concat(regexp_extract(tile_index, '^([0-9]+)', 1), '/', regexp_extract(tile_index, '^[0-9]+([C-Z])', 1), '/',
              regexp_extract(tile_index, '([A-Z][A-Z])$', 1)) END AS uri
FROM (SELECT concat(CAST(p_size + 20 AS STRING), chr(67 + CAST(p_partkey % 20 AS INTEGER)), chr(65 + CAST(p_partkey % 8 AS INTEGER)), 'A') AS tile_index FROM part)""")
def tile_name_to_uri(t: Tables):
    name = F.expr("concat(CAST(p_size + 20 AS STRING), chr(67 + p_partkey % 20), chr(65 + p_partkey % 8), 'A')")
    return t.table("part").select(name.alias("tile_index")).select("tile_index", names.tile_name_to_uri(F.col("tile_index")).alias("uri"))


@query("granule_date", "SELECT scene_id, image_date AS granule_date FROM v_scenes")
def granule_date(t: Tables):
    return t.view("scenes").select("scene_id", names.granule_date(F.col("path")).alias("granule_date"))


@query("uri_date", "SELECT scene_id, image_date AS uri_date FROM v_scenes")
def uri_date(t: Tables):
    uri = F.concat(F.lit("L2A_T36UYA_A012_"), F.date_format("image_date", "yyyyMMdd"), F.lit("T083601"))
    return t.view("scenes").select("scene_id", names.uri_date(uri).alias("uri_date"))


@query("scene_name_date", "SELECT scene_id, image_date AS name_date FROM v_scenes")
def scene_name_date(t: Tables):
    name = F.concat(F.date_format("image_date", "yyyyMMdd"), F.lit("_T36UYA"))
    return t.view("scenes").select("scene_id", names.scene_name_date(name).alias("name_date"))


@query("is_winter", """
SELECT scene_id, CAST(CASE WHEN month(image_date) IN (12, 1, 2) THEN 1 ELSE 0 END AS DOUBLE) AS winter FROM v_scenes""")
def is_winter(t: Tables):
    return t.view("scenes").select("scene_id", names.is_winter(F.col("image_date")).alias("winter"))


@query("name_position_split", """
SELECT scene_id, concat('T', CAST(tile_id AS STRING), '_', CAST(image_date AS STRING)) AS name,
       concat(CAST(cloud_tenths AS STRING), '_', CAST(nodata_tenths AS STRING)) AS position FROM v_scenes""")
def name_position_split(t: Tables):
    full = F.concat(F.lit("T"), F.concat_ws("_", *[F.col(c).cast("string") for c in ("tile_id", "image_date", "cloud_tenths", "nodata_tenths")]))
    name, position = names.split_chip_name(full)
    return t.view("scenes").select("scene_id", name.alias("name"), position.alias("position"))


@query("path_build", f"""
WITH {_DAILY}, p AS (SELECT tile_id, image_date, lead(image_date) OVER (PARTITION BY tile_id ORDER BY image_date) AS n FROM d)
SELECT p.tile_id, p.image_date AS image_date_0,
  concat('predicted_', t.tile_index, '_', CAST(p.image_date AS STRING), '_', CAST(p.n AS STRING), '.geojson') AS result_name,
  concat('data/', t.tile_index, '/', CAST(p.image_date AS STRING), '/B04_10m.jp2') AS band_path
FROM p JOIN v_tiles t ON p.tile_id = t.tile_id WHERE p.n IS NOT NULL""")
def path_build(t: Tables):
    pairs = catalog.scene_pairs(_daily(t), []).join(t.view("tiles").select("tile_id", "tile_index"), "tile_id")
    return pairs.select("tile_id", "image_date_0",
                        names.predicted_name(F.col("tile_index"), F.col("image_date_0"), F.col("image_date_1")).alias("result_name"),
                        names.scene_path("data", F.col("tile_index"), F.col("image_date_0"), "B04_10m.jp2").alias("band_path"))


@query("utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM v_scene_events")
def utc_text(t: Tables):
    return t.view("scene_events").select("event_id", names.utc_text(F.col("ts")).alias("ts_text"))


@query("decimal_to_double", "SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS area FROM orders")
def decimal_to_double(t: Tables):
    return t.table("orders").select(F.col("o_orderkey").alias("id"),
                                    names.decimal_to_double(F.col("o_totalprice").cast("decimal(18,2)")).alias("area"))


@query("lambda_column", """
SELECT markup_id, img_date AS img_day FROM v_markup""")
def lambda_column(t: Tables):
    """A per-row date parser of the markup, as a native expression."""
    text = t.view("markup").select("markup_id", F.date_format("img_date", "yyyy-MM-dd").alias("img_date"))
    return text.select("markup_id", F.to_date("img_date", "yyyy-MM-dd").alias("img_day"))
