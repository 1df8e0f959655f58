import datetime as dt

from arborscan.session import work_folder
from arborscan.streaming import pairs


def test_late_scene_and_repeated_day(spark):
    """Three arrivals: a first scene, two later ones, then one in between and one repeated."""
    day = lambda n: dt.date(2020, 1, n)
    source, table, offsets = (work_folder(spark, n) for n in ("in", "out", "offsets"))
    for rows in ([(1, day(5))], [(1, day(9)), (1, day(7)), (2, day(1))], [(1, day(6)), (1, day(9)), (1, day(11))]):
        spark.createDataFrame(rows, "tile_id long, image_date date").write.mode("append").parquet(source)
        stream = spark.readStream.schema("tile_id long, image_date date").parquet(source)
        pairs.write_pairs(stream, table, offsets).awaitTermination()
    got = sorted((r["tile_id"], r["kind"], r["image_date_0"].day, r["image_date_1"].day) for r in spark.read.parquet(table).collect())
    assert got == [(1, "pair", 5, 6), (1, "pair", 5, 7), (1, "pair", 6, 7), (1, "pair", 7, 9), (1, "pair", 9, 11), (1, "retracted", 5, 7)]
    held = sorted((r["image_date_0"].day, r["image_date_1"].day) for r in pairs.standing(spark.read.parquet(table)).collect())
    assert held == [(5, 6), (6, 7), (7, 9), (9, 11)]


def test_unreadable_files_stop_the_job(spark):
    """A broken file is never taken for an empty table, and nothing committed is touched."""
    import glob
    import os

    import pytest

    from arborscan.plans import zone_merge
    from arborscan.sources import landcover
    from arborscan.streaming import ingest

    def spoil(folder):
        path = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/part-99999.parquet", "wb") as file:
            file.write(b"not parquet")

    def state(folder):
        path = folder.removeprefix("file://").removeprefix("file:")
        return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}

    store = work_folder(spark, "store")
    for _ in range(2):
        zone_merge.Store(spark, store).commit(spark.createDataFrame([(1, 2)], "tile_id long, task_id long"))
    assert zone_merge.Store(spark, store).batch == 3
    spoil(f"{store}/tasks/batch=2")
    before = state(store)
    with pytest.raises(Exception):
        zone_merge.Store(spark, store)
    assert state(store) == before

    cache = work_folder(spark, "cache")
    polygons = spark.createDataFrame([(1, 5), (2, 6)], "tile_id long, shape long")
    assert landcover.refresh_cache(spark, cache, polygons, polygons.where("tile_id = 1")).count() == 1
    assert landcover.refresh_cache(spark, cache, polygons, polygons).count() == 2
    spoil(f"{cache}/tile_id=1")
    before = state(cache)
    with pytest.raises(Exception):
        landcover.refresh_cache(spark, cache, polygons, polygons)
    assert state(cache) == before

    table = work_folder(spark, "catalogue")
    like = spark.createDataFrame([], "tile_id long, image_date date, cloud int")
    assert ingest.catalogue(spark, table, like).count() == 0
    spoil(f"{table}/batch=0")
    with pytest.raises(Exception):
        ingest.catalogue(spark, table, like).collect()
