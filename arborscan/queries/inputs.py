"""Views that give the shared test tables the shape of scenes, detections and chips.

One text serves both engines; where array syntax differs there are two. Positions grow
with the keys (one strip of ground per 15,000 orders), so that density, and with it the
number of spatial matches per row, stays the same at every scale factor.
"""

_DET = """o_custkey % 25 AS tile_id,
       (o_orderkey * 7919) % 1997 + o_orderkey - o_orderkey % 15000 AS x0,
       (o_orderkey * 104729) % 2003 AS y0"""

VIEWS: dict[str, str | dict[str, str]] = {
    "tiles": """
SELECT n_nationkey AS tile_id,
       concat(CAST(30 + n_nationkey AS STRING), chr(67 + n_nationkey % 20), chr(65 + n_nationkey % 8),
              chr(65 + n_nationkey % 5)) AS tile_index,
       CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END AS is_tracked,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST('1996-01-01' AS DATE) END AS first_date,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST('2000-01-01' AS DATE) END AS last_date
FROM {nation}""",
    "scenes": """
SELECT o_orderkey AS scene_id, o_custkey % 25 AS tile_id, CAST(o_orderdate AS DATE) AS image_date,
       (o_orderkey * 37) % 1000 AS cloud_tenths, (o_orderkey * 13) % 100 AS nodata_tenths,
       CASE WHEN o_orderkey % 11 = 0 THEN 6 ELSE 7 END AS is_downloaded,
       o_orderkey % 2 AS is_new,
       CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END AS success,
       concat('L2/tiles/36/U/YA/S2A_MSIL2A_', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''),
              'T083601_N0214_R064_T36UYA') AS path,
       concat('<m><NODATA_PIXEL_PERCENTAGE>', CAST((o_orderkey * 13) % 100 AS STRING),
              '</NODATA_PIXEL_PERCENTAGE><CLOUDY_PIXEL_PERCENTAGE>', CAST((o_orderkey * 37) % 100 AS STRING),
              '</CLOUDY_PIXEL_PERCENTAGE></m>') AS xml
FROM {orders}""",
    "incoming": """
SELECT l_partkey % 25 AS tile_id, CAST(l_shipdate AS DATE) AS image_date,
       (l_partkey * 37 + l_suppkey) % 1000 AS cloud_tenths, (l_partkey * 13) % 100 AS nodata_tenths
FROM {lineitem}""",
    "files": """
SELECT l_orderkey AS scene_id,
       CASE l_partkey % 9
         WHEN 0 THEN 'IMG_DATA/R10m/T36UYA_B04_10m.jp2' WHEN 1 THEN 'IMG_DATA/R10m/T36UYA_B08_10m.jp2'
         WHEN 2 THEN 'IMG_DATA/R10m/T36UYA_TCI_10m.jp2' WHEN 3 THEN 'IMG_DATA/R20m/T36UYA_B11_20m.jp2'
         WHEN 4 THEN 'IMG_DATA/R20m/T36UYA_B12_20m.jp2' WHEN 5 THEN 'IMG_DATA/R20m/T36UYA_B8A_20m.jp2'
         WHEN 6 THEN 'QI_DATA/MSK_CLDPRB_20m.jp2' WHEN 7 THEN 'IMG_DATA/R10m/T36UYA_WVP_10m.jp2'
         ELSE 'QI_DATA/MSK_SNWPRB_20m.jp2' END AS file
FROM {lineitem}""",
    "clearcuts": """
SELECT o_orderkey AS id, o_custkey AS zone_id,
       CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey % 25 END AS tile_id,
       CAST(o_orderdate - INTERVAL 30 DAY AS DATE) AS image_date_previous,
       CAST(o_orderdate AS DATE) AS image_date_current,
       CAST(round(o_totalprice * 100) AS BIGINT) AS area,
       CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS forest,
       CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS clouds
FROM {orders}""",
    "detections": f"""
SELECT o_orderkey AS det_id, {_DET},
       o_orderkey % 8 AS task_no,
       CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS forest,
       CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS clouds,
       (o_orderkey * 7919) % 1997 + o_orderkey - o_orderkey % 15000 + 5 + o_orderkey % 20 AS x1,
       (o_orderkey * 104729) % 2003 + 5 + (o_orderkey * 3) % 17 AS y1
FROM {{orders}}""",
    "truth": """
SELECT truth_id, tile_id, x0, y0, x0 + 5 + truth_id % 20 AS x1, y0 + 5 + (truth_id * 3) % 17 AS y1
FROM (SELECT o_orderkey AS truth_id, o_custkey % 25 AS tile_id,
             (o_orderkey * 7919) % 1997 + o_orderkey - o_orderkey % 15000 + o_orderkey % 4
               + CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE 0 END AS x0,
             (o_orderkey * 104729) % 2003 + o_orderkey % 3 AS y0
      FROM {orders}) t""",
    "masks": """
SELECT c_custkey AS mask_id, c_custkey % 25 AS tile_id, 'forest' AS kind,
       (c_custkey * 6151) % 1997 + (c_custkey - c_custkey % 1500) * 10 AS x0, (c_custkey * 12289) % 2003 AS y0,
       (c_custkey * 6151) % 1997 + (c_custkey - c_custkey % 1500) * 10 + 60 AS x1,
       (c_custkey * 12289) % 2003 + 60 AS y1
FROM {customer}
UNION ALL
SELECT p_partkey, p_partkey % 25, 'cloud',
       (p_partkey * 24593) % 1997 + CAST((p_partkey - p_partkey % 2000) * 7.5 AS BIGINT), (p_partkey * 49157) % 2003,
       (p_partkey * 24593) % 1997 + CAST((p_partkey - p_partkey % 2000) * 7.5 AS BIGINT) + p_size,
       (p_partkey * 49157) % 2003 + p_size
FROM {part}""",
    "markup": """
SELECT p_partkey AS markup_id, CASE WHEN p_size % 3 = 0 THEN 'overgrown' ELSE 'open' END AS state,
       CAST(CAST('2016-01-01' AS DATE) + INTERVAL 1 DAY * CAST(p_partkey % 900 AS INTEGER) AS DATE) AS img_date,
       p_size AS side, p_size * p_size AS area
FROM {part}""",
    "epochs": """
SELECT s_suppkey AS run_id, s_suppkey % 20 AS epoch, CAST(round(s_acctbal) AS BIGINT) AS dice_score
FROM {supplier}""",
    "scene_events": """
SELECT event_id, ts, user_id % 25 AS tile_id, CAST(ts AS DATE) AS image_date, event_type,
       CAST(round(value * 100) AS BIGINT) AS cloud_hundredths
FROM {events}""",
    "pixels": {
        "spark": """
SELECT vec_id AS chip_id, vec_id % 9 AS band, vec_id DIV 9 AS scene, label, pos % 8 AS x, pos DIV 8 AS y,
       CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS INT) AS v
FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS pos, e""",
        "duckdb": """
SELECT vec_id AS chip_id, vec_id % 9 AS band, vec_id // 9 AS scene, label, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
       CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS INT) AS v
FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM {embeddings})""",
    },
    "chips": {
        "spark": """
SELECT vec_id AS chip_id, vec_id % 9 AS band, vec_id DIV 9 AS scene, label, 8 AS w, 8 AS h,
       transform(embedding, e -> CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS DOUBLE)) AS cells
FROM {embeddings}""",
        "duckdb": """
SELECT vec_id AS chip_id, vec_id % 9 AS band, vec_id // 9 AS scene, label, 8 AS w, 8 AS h,
       list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) + 1) * 100)) AS cells
FROM {embeddings}""",
    },
}
