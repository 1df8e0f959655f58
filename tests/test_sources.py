import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from arborscan import schemas
from arborscan.functions import names, rings
from arborscan.operators import catalog, zones
from arborscan.sources import chips, geojson, kml, landcover, raster_table, tables


def test_geojson_files(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"pk": 7, "state": "open", "img_date": "2019/07/11"}},
                {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"pk": 8, "state": "overgrown"}},
                {"type": "Feature", "geometry": None, "properties": {"pk": 9}}]
    (tmp_path / "in.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = geojson.read_collection(spark, str(tmp_path / "in.json"), schemas.MARKUP_PROPERTIES)
    assert rows.count() == 3
    valid = geojson.valid_only(rows).select("pk", "state", "geometry")
    assert [(r["pk"], r["state"]) for r in valid.collect()] == [(7, "open")]
    geojson.write_features(valid, str(tmp_path / "out"))
    back = geojson.parse_markup(spark.read.text(str(tmp_path / "out")))
    assert back.select(rings.area(F.col("geometry")).alias("a")).first()["a"] == 6.0


def test_kml_file(spark, tmp_path):
    mark = "<Placemark><name>{}</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>"
    text = mark.format("36UYA", "30.5,49,0 31,49,0 31,50.25,0 30.5,49,0") + mark.format("36UXA", "1,2,0 3,4,0 1,2,0")
    (tmp_path / "tiles.kml").write_text(f"<kml><Document>{text}</Document></kml>")
    got = {r["name"]: (r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in kml.read_tile_bounds(spark, str(tmp_path / "tiles.kml")).collect()}
    assert got == {"36UYA": (30.5, 49.0, 31.0, 50.25), "36UXA": (1.0, 2.0, 3.0, 4.0)}


def test_indexes_records_and_rasters(spark, tmp_path):
    index = spark.createDataFrame([("S.tif", "S_0_1.tiff", "S_0_1.geojson", 4, 0, 4, 4)], schemas.CHIP_INDEX)
    chips.write_index(index, str(tmp_path / "index"))
    assert chips.read_index(spark, str(tmp_path / "index")).collect() == index.collect()
    record = spark.createDataFrame([(1, 2, 0.5, 0.0, b"\x00\xff", b"\x01\x02", b"\x03\x04", "a", "a", "a")], schemas.EVAL_RECORD)
    chips.write_records(record, str(tmp_path / "records"))
    row = chips.read_records(spark, str(tmp_path / "records")).select(chips.from_bytes(F.col("img_raw")).alias("c"), "dice_score").first()
    assert (row["c"], row["dice_score"]) == ([0, 255], 0.5)
    cells = spark.createDataFrame([(t, x, y, float(x * y)) for t in (1, 2) for x in range(6) for y in range(6)], "tile_id int, x int, y int, v double")
    raster_table.write(raster_table.with_metadata(cells, crs="EPSG:32636"), str(tmp_path / "raster"), ["tile_id"])
    window = raster_table.read_window(spark, str(tmp_path / "raster"), 2, 3, 2, 2).where("tile_id = 2")
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == 4 and "GreaterThanOrEqual(x,2)" in plan and "PartitionFilters: [isnotnull(tile_id" in plan


def test_listing_and_metadata_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "MTD.xml").write_text("<m>\n<NODATA_PIXEL_PERCENTAGE>1.5</NODATA_PIXEL_PERCENTAGE><CLOUDY_PIXEL_PERCENTAGE unit='%'> 2.25 </CLOUDY_PIXEL_PERCENTAGE>"
                                            "<CLOUDY_PIXEL_PERCENTAGE>9</CLOUDY_PIXEL_PERCENTAGE></m>")
    assert tables.list_paths(spark, str(tmp_path), "*.xml").count() == 1
    nodata, cloud = catalog.metadata_percentages(F.col("xml"))
    row = tables.read_metadata_text(spark, str(tmp_path)).select(nodata.alias("n"), cloud.alias("c")).first()
    assert (row["n"], row["c"]) == (1.5, 2.25)


def test_landcover_cache_is_filled_once(spark, tmp_path):
    forest = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "mask_id int, tile_id int")
    folder = str(tmp_path / "cache")
    tiles = lambda *ids: spark.createDataFrame([(i,) for i in ids], "tile_id int")
    assert landcover.refresh_cache(spark, folder, forest, tiles(1)).count() == 1
    assert landcover.refresh_cache(spark, folder, forest, tiles(1, 2)).count() == 3
    assert spark.read.parquet(folder).count() == 3


def test_tile_names_and_dates(spark):
    rows = spark.createDataFrame([("36UYA",), ("1CCV",), ("61UYA",), ("36AYA",), ("36UY",), ("0UYA",)], "t string")
    got = {r["t"]: r["u"] for r in rows.select("t", names.tile_name_to_uri(F.col("t")).alias("u")).collect()}
    assert got == {"36UYA": "36/U/YA", "1CCV": "1/C/CV", "61UYA": None, "36AYA": None, "36UY": None, "0UYA": None}
    row = spark.range(1).select(names.granule_date(F.lit("x_20190712T083601_20190713T000000")).alias("a"), names.granule_date(F.lit("none")).alias("b"),
                                names.uri_date(F.lit("a_b_20190712T083601")).alias("c"), names.scene_name_date(F.lit("20190712_x.tif")).alias("d"),
                                *[v.alias(n) for n, v in zip("ef", names.split_chip_name(F.lit("a_b_3_4")))],
                                *[v.alias(n) for n, v in zip("gh", names.image_info(F.lit("a_b_rgb_3_4.png")))]).first()
    day = dt.date(2019, 7, 12)
    assert tuple(row) == (day, None, day, day, "a_b", "3_4", "a_b", "3_4")


def test_quality_limits_are_strict(spark):
    rows = spark.createDataFrame([(4.99, 49.99), (5.0, 1.0), (1.0, 50.0)], "n double, c double")
    assert rows.where(catalog.within_quality(F.col("n"), F.col("c"))).count() == 1


def test_pairs_need_two_scenes_and_area_limit_is_strict(spark):
    day = dt.date(2020, 1, 1)
    one = spark.createDataFrame([(1, day), (2, day), (2, day + dt.timedelta(3))], "tile_id int, image_date date")
    pairs = catalog.scene_pairs(one, []).collect()
    assert [(p["tile_id"], p["image_date_0"]) for p in pairs] == [(2, day)]
    carried = {(r["tile_id"], r["image_date"]): r["is_new"] for r in catalog.carry_baseline(one.withColumn("is_new", F.lit(1))).collect()}
    assert carried == {(1, day): 1, (2, day): 0, (2, day + dt.timedelta(3)): 1}
    areas = spark.createDataFrame([(1, 1.0), (1, 9.0), (1, 5.0)], "task int, area double")
    assert sorted(r["area"] for r in zones.above_mean_area(areas, ["task"]).collect()) == [5.0, 9.0]


def test_period_and_review_rules(spark):
    for bad in ("2020-1-1", "2020-01-01x", "today"):
        with pytest.raises(ValueError):
            zones.check_period(bad, "2020-01-01")
    zones.check_period("2020-01-01T00", "2020-01-01", prefix=True)
    day = dt.date(2020, 1, 1)
    cuts = spark.createDataFrame([(1, 5, 1, day, 10.0, 1, 0, 0), (2, 5, 1, day, 20.0, 1, 0, 0), (3, 5, 1, day, 20.0, 1, 0, 0)],
                                 "id int, zone_id int, tile_id int, image_date_current date, area double, forest int, clouds int, status int")
    assert zones.newest(cuts, []).first()["id"] == 2  # larger area, then smaller id
    chart = zones.area_chart(cuts, 3, "2020-01-01", "2020-01-01").collect()
    assert [(r["zone_id"], r["zone_area"]) for r in chart] == [(5, 50.0)] and zones.area_chart(cuts, 99, "2020-01-01", "2020-01-01").count() == 0
    reviews = spark.createDataFrame([(1, 1, 1), (1, -1, 2), (2, 7, 1)], "id int, status int, review_no int")
    updated, rejected = zones.review(cuts, reviews)
    assert {r["id"]: r["status"] for r in updated.collect()} == {1: -1, 2: 0, 3: 0} and rejected.count() == 1


def test_manifest_error_when_a_folder_is_empty(spark):
    files = spark.createDataFrame([(1, "IMG_DATA/R10m/x_B04_10m.jp2"), (1, "IMG_DATA/R20m/x_B11_20m.jp2"), (1, "QI_DATA/other.jp2"), (2, "IMG_DATA/R10m/x_B04_10m.jp2")], "scene_id int, file string")
    got = {r["scene_id"]: r["is_downloaded"] for r in catalog.band_manifest(files, ["scene_id"]).collect()}
    assert got == {1: 2, 2: -1}


def test_kml_files_are_bounded(spark, tmp_path, monkeypatch):
    from arborscan.queries import QUERIES, catalogue
    monkeypatch.setattr(catalogue, "MARKS_PER_FILE", 10)
    monkeypatch.setattr(catalogue, "work_folder", lambda *_: str(tmp_path / "kml"))
    spark.range(1, 46).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 26).selectExpr("id AS p_partkey", "5 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["tile_bounds_read"](spark, str(tmp_path)).count() == 70
    marks = [f.read_text().count("<Placemark>") for f in (tmp_path / "kml").glob("part-*")]
    assert sum(marks) == 70 and max(marks) <= 10
