"""Table schemas as StructTypes."""

from pyspark.sql import types as T

_S, _I, _L, _D, _SH = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.ShortType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


POINT = T.StructType([T.StructField("x", _D), T.StructField("y", _D)])
RING = T.ArrayType(POINT)
GEOMETRY = T.StructType([T.StructField("gtype", _S), T.StructField("rings", T.ArrayType(RING))])

TILE = _table(
    ("id", _I, False), ("tile_index", _S, False), ("is_tracked", _SH, False),
    ("first_date", T.DateType(), True), ("last_date", T.DateType(), True),
)
ZONE = _table(("id", _S, False), ("tile_id", _I, True))
CLEARCUT = _table(
    ("id", _L, False), ("image_date_previous", T.DateType(), True), ("image_date_current", T.DateType(), True),
    ("area", _D, False), ("forest", _I, False), ("clouds", _I, False), ("centroid", POINT, False),
    ("zone_id", _S, False), ("mpoly", GEOMETRY, False), ("status", _SH, False),
)
NOT_CLEARCUT = T.StructType([f for f in CLEARCUT.fields if f.name != "status"])
SCENE = _table(
    ("tile_id", _I, False), ("image_date", T.DateType(), False), ("tile_uri", _S, False),
    ("cloud_coverage", _D, False), ("nodata_pixel", _D, False),
    ("source_b04_location", _S, True), ("source_b08_location", _S, True), ("source_b8a_location", _S, True),
    ("source_b11_location", _S, True), ("source_b12_location", _S, True), ("source_tci_location", _S, True),
    ("source_clouds_location", _S, True),
    ("is_downloaded", _SH, False), ("is_new", _SH, False), ("check_date", T.TimestampType(), True),
)
PREPARED = _table(
    ("tile_id", _I, False), ("image_date", T.DateType(), False), ("model_tiff_location", _S, True),
    ("cloud_tiff_location", _S, True), ("success", _SH, False), ("is_new", _SH, False),
    ("prepare_date", T.TimestampType(), True),
)
UPDATE_TASK = _table(
    ("id", _L, False), ("tile_id", _I, False), ("path_type", _SH, False), ("path_img_0", _S, False),
    ("path_img_1", _S, False), ("image_date_0", T.DateType(), False), ("image_date_1", T.DateType(), False),
    ("path_clouds_0", _S, False), ("path_clouds_1", _S, False), ("result", _S, True),
    ("date_created", T.TimestampType(), True), ("date_started", T.TimestampType(), True),
    ("date_finished", T.TimestampType(), True),
)
TILE_INFORMATION = _table(
    ("tile_name", _S, False), ("tile_index_id", _I, False), ("tile_date", T.DateType(), False),
    ("source_tci_location", _S, True), ("model_tiff_location", _S, True), ("metadata_hash", _S, True),
    ("cloud_coverage", _D, True), ("mapbox_tile_id", _S, True), ("mapbox_tile_name", _S, True),
    ("mapbox_tile_layer", _S, True), ("coordinates", GEOMETRY, True), ("is_downloaded", _SH, False),
    ("is_prepared", _SH, False), ("is_converted", _SH, False), ("is_uploaded", _SH, False),
    ("is_predicted", _SH, False),
)
CHIP_INDEX = _table(
    ("original_image", _S, False), ("piece_image", _S, False), ("piece_geojson", _S, False),
    ("start_x", _L, False), ("start_y", _L, False), ("width", _L, False), ("height", _L, False),
)
SPLIT_INDEX = _table(("dataset_folder", _S, False), ("name", _S, False), ("position", _S, False))
EVAL_RECORD = _table(
    ("img_height", _L, False), ("img_width", _L, False), ("dice_score", _D, False), ("metric", _D, False),
    ("img_raw", T.BinaryType(), False), ("mask_raw", T.BinaryType(), False), ("pred_raw", T.BinaryType(), False),
    ("img_name", _S, False), ("msk_name", _S, False), ("pred_name", _S, False),
)
GEOJSON_GEOMETRY = T.StructType([
    T.StructField("type", _S),
    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(_D)))),
])
MARKUP_PROPERTIES = T.StructType([
    T.StructField("pk", _L), T.StructField("color", _I), T.StructField("forest_typ", _S),
    T.StructField("type", _S), T.StructField("state", _S), T.StructField("img_date", _S),
    T.StructField("scene", _S), T.StructField("comment", _S),
])
DETECTION_PROPERTIES = T.StructType([T.StructField("forest", _D), T.StructField("clouds", _D)])


def feature(properties: T.StructType) -> T.StructType:
    """Schema of one GeoJSON feature."""
    return T.StructType([
        T.StructField("type", _S), T.StructField("geometry", GEOJSON_GEOMETRY),
        T.StructField("properties", properties),
    ])
