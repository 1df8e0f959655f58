"""The set-based zone merge against a sequential walk over cell sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arborscan.plans import zone_merge

DAY = dt.date(2020, 1, 1)
NEW = "id long, seq long, tile_id long, image_date_0 date, image_date_1 date, area double, x0 double, y0 double, x1 double, y1 double"


def gap_sq(a, b):
    dx = max(0, a[0] - b[2], b[0] - a[2])
    dy = max(0, a[1] - b[3], b[1] - a[3])
    return dx * dx + dy * dy


def cell_set(boxes):
    return {(x, y) for b in boxes for x in range(int(b[0]), int(b[2])) for y in range(int(b[1]), int(b[3]))}


def one_piece(cells):
    todo, seen = [next(iter(cells))], set()
    while todo:
        x, y = todo.pop()
        if (x, y) in seen:
            continue
        seen.add((x, y))
        todo += [n for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if n in cells]
    return len(seen) == len(cells)


def walk(new, reach, multipart):
    rows, rejected = [], set()
    for i, seq, tile, d0, d1, area, *box in sorted(new, key=lambda r: r[1]):
        near = [r for r in rows if r["tile"] == tile and min(gap_sq(box, b) for b in r["boxes"]) <= reach * reach]
        if not near:
            rows.append(dict(id=i, tile=tile, zone=f"{tile}/{i}", boxes=[box], prev=d0, cur=d1))
            continue
        mine = cell_set([box])
        areas = [len(mine & cell_set(r["boxes"])) for r in near]
        union = [box] + [b for r in near for b in r["boxes"]]
        if multipart == "drop" and not one_piece(cell_set(union)):
            rejected.add(i)
            continue
        rows.append(dict(id=i, tile=tile, zone=near[areas.index(max(areas))]["zone"], boxes=union, prev=d0, cur=min(r["prev"] for r in near)))
    return {r["id"]: (r["zone"], r["prev"], r["cur"], len(cell_set(r["boxes"]))) for r in rows}, rejected


def fixture(seed, count=60):
    rnd, out = random.Random(seed), []
    for i in range(count):
        x, y = rnd.randrange(60), rnd.randrange(60)
        w, h = rnd.randint(2, 7), rnd.randint(2, 7)
        d0 = DAY + dt.timedelta(days=5 * (i // 30))
        out.append((i, i, i % 2, d0, d0 + dt.timedelta(days=5), float(w * h), float(x), float(y), float(x + w), float(y + h)))
    return out


def collect(result, boxes):
    members = {}
    for r in result.members.collect():
        members.setdefault(r["row_id"], []).append(boxes[r["member"]])
    return {r["id"]: (r["zone_id"], r["image_date_previous"], r["image_date_current"], len(cell_set(members[r["id"]])))
            for r in result.stored.collect()}


@pytest.mark.parametrize("multipart,together", [("drop", zone_merge.TOGETHER), ("keep", zone_merge.TOGETHER), ("drop", 12)])
def test_against_sequential_walk(spark, multipart, together):
    new = fixture(7)
    want, rejected = walk(new, 3, multipart)
    boxes = {r[0]: r[6:] for r in new}

    def empty(ddl):
        return spark.createDataFrame([], ddl)

    half = [r for r in new if r[0] < 35]
    rows = empty("id long, seq long, tile_id long, zone_id string, image_date_previous date")
    members, shapes = empty("row_id long, member long"), empty("id long, tile_id long, x0 double, y0 double, x1 double, y1 double")
    first = zone_merge.merge(spark.createDataFrame(half, NEW), rows, members, shapes, reach=3.0, multipart=multipart, together=together)
    got = collect(first, boxes)
    kept_shapes = spark.createDataFrame(half, NEW).join(first.stored.select("id"), "id", "left_semi").select("id", "tile_id", "x0", "y0", "x1", "y1")
    second = zone_merge.merge(spark.createDataFrame([r for r in new if r[0] >= 35], NEW), first.stored, first.members, kept_shapes,
                              reach=3.0, multipart=multipart, together=together)
    got.update(collect(second, boxes))
    assert got == want
    assert {r["id"] for r in first.rejected.unionByName(second.rejected).collect()} == rejected
    assert len({v[0] for v in want.values()}) < len(want) and (multipart == "keep" or rejected)


def test_a_spot_revisited_many_times(spark, monkeypatch):
    """A long history of one spot settles in one walk."""
    cuts = []
    monkeypatch.setattr(zone_merge, "cut_lineage", lambda df, cut=zone_merge.cut_lineage: cuts.append(1) or cut(df))
    new = [(i, i, 0, DAY + dt.timedelta(i), DAY + dt.timedelta(i + 1), 25.0, 0.0 + i % 3, 0.0, 5.0 + i % 3, 5.0) for i in range(60)]
    args = [spark.createDataFrame([], s) for s in ("id long, seq long, tile_id long, zone_id string, image_date_previous date",
                                                   "row_id long, member long", "id long, tile_id long, x0 double, y0 double, x1 double, y1 double")]
    result = zone_merge.merge(spark.createDataFrame(new, NEW), *args, reach=3.0)
    want = {i: ("0/0", DAY + dt.timedelta(i), DAY if i else DAY + dt.timedelta(1)) for i in range(60)}
    assert {r["id"]: (r["zone_id"], r["image_date_previous"], r["image_date_current"]) for r in result.stored.collect()} == want
    assert result.members.count() == 60 * 61 / 2
    assert len(cuts) < 20


def test_fixed_dates(spark):
    new = [(1, 1, 0, DAY, DAY + dt.timedelta(5), 4.0, 0.0, 0.0, 2.0, 2.0), (2, 2, 0, DAY + dt.timedelta(5), DAY + dt.timedelta(10), 4.0, 1.0, 1.0, 3.0, 3.0)]
    args = [spark.createDataFrame([], s) for s in ("id long, seq long, tile_id long, zone_id string, image_date_previous date",
                                                   "row_id long, member long", "id long, tile_id long, x0 double, y0 double, x1 double, y1 double")]
    rows = {r["id"]: r for r in zone_merge.merge(spark.createDataFrame(new, NEW), *args, dates="fixed").stored.collect()}
    assert rows[2]["zone_id"] == rows[1]["zone_id"] == "0/1"
    assert (rows[2]["image_date_previous"], rows[2]["image_date_current"]) == (DAY, DAY + dt.timedelta(10))


def test_repeated_batch_changes_nothing(spark):
    from arborscan.session import work_folder
    folder = work_folder(spark, "zones-test")
    ddl = NEW.replace("seq long", "seq struct<day: date, id: long>") + ", task_id long, forest int, clouds int"
    data = [(i, (DAY, i), 0, DAY, DAY, 9.0, float(10 * i), 0.0, 10.0 * i + 3, 3.0, i % 2, 1, 0) for i in range(6)]
    detections = spark.createDataFrame(data, ddl)
    for _ in range(2):
        zone_merge.save_tasks(spark, folder, detections, reach=2.0)
    assert spark.read.parquet(f"{folder}/clearcuts").count() == 6
    assert spark.read.parquet(f"{folder}/tasks").count() == 2


def test_bad_option(spark):
    with pytest.raises(ValueError):
        zone_merge.merge(None, None, None, None, multipart="maybe")


def test_replay_and_stream_agree_on_the_tables(spark):
    from arborscan.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    batch, stream = ({tuple(r) for r in QUERIES[name](spark, folder).collect()} for name in ("replay_results", "stream_zone_merge"))
    assert batch == stream and len(batch) > 100
