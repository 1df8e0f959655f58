"""The zone merge of true shapes against a sequential walk over cell sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arborscan.plans import shape_merge

DAY = dt.date(2020, 1, 1)
RINGS = "array<array<struct<x:double,y:double>>>"
NEW = f"id long, seq long, tile_id long, image_date_0 date, image_date_1 date, area double, rings {RINGS}"
ROWS = f"id long, seq long, tile_id long, zone_id string, image_date_previous date, rings {RINGS}"


def ring(*corners):
    return [(float(x), float(y)) for x, y in (*corners, corners[0])]


def box(x, y, w, h):
    return [ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))], {(i, j) for i in range(x, x + w) for j in range(y, y + h)}


def ell(x, y, w, h):
    """A box without its upper right part."""
    m, n = x + (w + 1) // 2, y + (h + 1) // 2
    return [ring((x, y), (x + w, y), (x + w, n), (m, n), (m, y + h), (x, y + h))], {c for c in box(x, y, w, h)[1] if c[0] < m or c[1] < n}


def frame(x, y, w, h):
    """A box with a hole."""
    hole = box(x + 1, y + 1, w - 2, h - 2)
    return box(x, y, w, h)[0] + [hole[0][0][::-1]], box(x, y, w, h)[1] - hole[1]


def gap_sq(a, b):
    return min(max(0, abs(p[0] - q[0]) - 1) ** 2 + max(0, abs(p[1] - q[1]) - 1) ** 2 for p in a for q in b)


def one_piece(cells):
    todo, seen = [next(iter(cells))], set()
    while todo:
        x, y = todo.pop()
        if (x, y) not in seen:
            seen.add((x, y))
            todo += [n for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if n in cells]
    return len(seen) == len(cells)


def walk(new, cells, reach, multipart):
    rows, rejected = [], set()
    for i, _, tile, d0, d1, _, _ in sorted(new, key=lambda r: r[1]):
        near = [r for r in rows if r["tile"] == tile and gap_sq(cells[i], r["cells"]) <= reach * reach]
        union = cells[i].union(*[r["cells"] for r in near])
        if near and multipart == "drop" and not one_piece(union):
            rejected.add(i)
            continue
        common = [len(cells[i] & r["cells"]) for r in near]
        rows.append(dict(id=i, tile=tile, cells=union, zone=near[common.index(max(common))]["zone"] if near else f"{tile}/{i}",
                         prev=d0, cur=min(r["prev"] for r in near) if near else d1))
    return {r["id"]: (r["zone"], r["prev"], r["cur"], len(r["cells"])) for r in rows}, rejected


def fixture(seed, count=70):
    rnd, out, cells = random.Random(seed), [], {}
    for i in range(count):
        kind = rnd.choice([box, ell, ell, frame])
        shape, cells[i] = kind(rnd.randrange(45), rnd.randrange(45), rnd.randint(3, 8), rnd.randint(3, 8))
        d0 = DAY + dt.timedelta(days=5 * (i // 30))
        out.append((i, i, i % 2, d0, d0 + dt.timedelta(days=5), float(len(cells[i])), shape))
    return out, cells


def size(shape):
    return abs(sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) for r in shape)) / 2


def collected(stored):
    return {r["id"]: (r["zone_id"], r["image_date_previous"], r["image_date_current"], round(size(r["rings"]))) for r in stored.collect()}


@pytest.mark.parametrize("multipart,together", [("drop", 2000), ("drop", 5), ("keep", 2000)])
def test_against_sequential_walk(spark, multipart, together):
    new, cells = fixture(5)
    want, rejected = walk(new, cells, 2, multipart)
    options = dict(reach=2.0, multipart=multipart, together=together)
    first = shape_merge.merge(spark.createDataFrame(new[:40], NEW), spark.createDataFrame([], ROWS), **options)
    second = shape_merge.merge(spark.createDataFrame(new[40:], NEW), first.stored, **options)
    got = collected(first.stored) | collected(second.stored)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    if multipart == "drop":
        assert got == want  # the stored unions have the areas of the cell sets
    assert {r["id"] for r in first.rejected.unionByName(second.rejected).collect()} == rejected
    assert len({v[0] for v in want.values()}) < len(want) and (multipart == "keep" or rejected)


def test_notches_holes_and_corners(spark):
    notch = ell(0, 0, 20, 20)
    shapes = [notch, box(15, 15, 4, 4), box(18, 8, 4, 4), frame(40, 0, 20, 20), box(48, 8, 4, 4), box(20, -5, 5, 5)]
    new = [(i, i, 0, DAY, DAY, 1.0, shape) for i, (shape, _) in enumerate(shapes)] + [(9, 9, 0, DAY, DAY, 0.0, None), (10, 10, 0, DAY, DAY, 0.0, [])]
    result = shape_merge.merge(spark.createDataFrame(new, NEW), spark.createDataFrame([], ROWS), reach=1.0)
    zones = {r["id"]: r["zone_id"] for r in result.stored.collect()}
    # 1 lies in the notch of 0 and 4 in the hole of 3, out of reach; 2 overlaps 0; 5 touches 0 in a corner only
    assert zones == {0: "0/0", 1: "0/1", 2: "0/0", 3: "0/3", 4: "0/4", 9: "0/9", 10: "0/10"}
    assert [r["id"] for r in result.rejected.collect()] == [5]
    with pytest.raises(ValueError):
        shape_merge.merge(None, None, multipart="maybe")


def test_a_spot_revisited_many_times(spark):
    new = [(i, i, 0, DAY + dt.timedelta(i), DAY + dt.timedelta(i + 1), 1.0, ell(i % 3, 0, 6, 6)[0]) for i in range(60)]
    result = shape_merge.merge(spark.createDataFrame(new, NEW), spark.createDataFrame([], ROWS), reach=3.0, together=25)
    got = {r["id"]: (r["zone_id"], r["image_date_previous"], r["image_date_current"]) for r in result.stored.collect()}
    assert got == {i: ("0/0", DAY + dt.timedelta(i), DAY if i else DAY + dt.timedelta(1)) for i in range(60)}


def test_store_reads_its_own_tiles(spark, tmp_path):
    store = shape_merge.Store(spark, str(tmp_path / "zones"))
    new, cells = fixture(8, 40)
    df = spark.createDataFrame(new, NEW)
    for batch, part in enumerate((df.where("id < 20"), df.where("id >= 20"), df.where("id >= 20"))):
        store.save(part, min(batch, 1), reach=2.0)  # the last batch is repeated
    want, _ = walk(new, cells, 2, "drop")
    assert collected(store.rows()) == want
    few = store.rows(df.where("tile_id = 1"))
    assert {r["tile_id"] for r in few.collect()} == {1}
    plan = few._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "tile_id" in filters and "= 1" in filters
    assert store.rows(df.limit(0)).count() == 0


def test_walks_ask_for_their_unions_together(monkeypatch):
    asked = []
    real = shape_merge.combine_many
    monkeypatch.setattr(shape_merge, "combine_many", lambda pairs, kind: asked.append(len(pairs)) or real(pairs, kind))
    square = lambda x: [[x, 0.0, x + 2, 0.0, x + 2, 2.0, x, 2.0, x, 0.0]]
    entry = lambda k, x: {"id": k, "image_date_0": 0, "image_date_1": 1, "zone_id": str(k), "flat": square(x)}
    walks = [shape_merge._walk([entry(0, 0.0), entry(1, 1.0)], [], [{"p": 1, "q": 0}], "drop", "reference") for _ in range(20)]
    found = shape_merge._side_by_side(walks)
    assert asked == [20, 20, 0] and [r[0] for r in found].count("stored") == 40
    assert all(len(r[6]) == 1 for r in found if r[1] == 1)
