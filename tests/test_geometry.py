import pytest
from pyspark.sql import functions as F

from arborscan.functions import crs, rings
from arborscan.operators import cells, spatial
from arborscan.operators.components import connected_components


def square(x, y, size=1):
    return rings.rectangle(F.lit(x), F.lit(y), F.lit(x + size), F.lit(y + size))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ring(*points):
    return F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points]))


def test_edge_and_corner_contact(spark):
    assert value(spark, rings.intersects(square(0, 0), square(1, 0)))
    assert value(spark, rings.intersects(square(0, 0), square(1, 1)))
    assert not value(spark, rings.intersects(square(0, 0), square(2, 0)))
    assert value(spark, rings.intersects(square(0, 0, 9), square(2, 2)))
    assert value(spark, rings.distance(square(0, 0), square(4, 5))) == pytest.approx(5.0)


def test_area_with_hole_and_centroid(spark):
    shape = F.concat(square(0, 0, 4), F.transform(square(1, 1, 2), lambda r: F.reverse(r)))
    assert value(spark, rings.area(shape)) == 12.0
    centre = value(spark, rings.centroid(shape))
    assert (centre["x"], centre["y"]) == (2.0, 2.0)
    assert not value(spark, rings.contains_point(shape, F.lit(2.0), F.lit(2.0)))
    assert value(spark, rings.contains_point(shape, F.lit(0.5), F.lit(2.0)))


def test_validity(spark):
    assert value(spark, rings.is_valid(square(0, 0)))
    assert not value(spark, rings.is_valid(ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))))
    assert not value(spark, rings.is_valid(ring((0, 0), (1, 0), (1, 1))))


def test_clip_triangle(spark):
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((0.0, "xmin"), (0.0, "ymin"), (2.0, "xmax"), (2.0, "ymax"))])
    assert value(spark, rings.area(rings.clip_to_box(ring((0, 0), (4, 0), (0, 4), (0, 0)), box))) == pytest.approx(4.0)
    assert value(spark, rings.clip_to_box(square(5, 5), box)) is None


def test_utm_fixed_points(spark):
    # on the central meridian easting is 500 km; one degree of latitude is known from the meridian arc
    p = value(spark, crs.to_utm(F.lit(33.0), F.lit(50.0), F.lit(36), F.lit(True)))
    assert p["x"] == pytest.approx(500000.0, abs=1e-6) and p["y"] == pytest.approx(5538630.7028, abs=1e-3)
    south = value(spark, crs.to_utm(F.lit(33.0), F.lit(-50.0), F.lit(36), F.lit(False)))
    assert south["y"] == pytest.approx(10000000 - p["y"], abs=1e-6)
    back = value(spark, crs.to_lonlat(F.lit(p["x"] + 100000), F.lit(p["y"]), F.lit(36), F.lit(True)))
    again = value(spark, crs.to_utm(F.lit(back["x"]), F.lit(back["y"]), F.lit(36), F.lit(True)))
    assert again["x"] == pytest.approx(600000.0, abs=1e-4)
    with pytest.raises(ValueError):
        crs.reproject(square(0, 0), F.lit(36), F.lit(True), "mercator")


def test_cells_match_boxes_and_rings(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 4, 3), (2, 3, 2, 6, 6)], "id int, x0 int, y0 int, x1 int, y1 int")
    a = cells.from_boxes(boxes, "id")
    b = cells.from_rings(boxes.select("id", rings.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("s")), "id", "s")
    assert a.count() == 24 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    union = cells.union(a.withColumn("id", F.lit(0)), "id").count()
    common = cells.overlay(a.where("id = 1"), a.where("id = 2").withColumnRenamed("id", "other"), "id", "other").first()["cells"]
    assert union == 24 - common and common == 1


def boxes(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, x0 double, y0 double, x1 double, y1 double")


def test_box_join_is_complete_for_any_size(spark):
    """Tiny boxes, one huge box and a crowd in one cell; every pair once."""
    import random
    rnd = random.Random(5)
    rows = [(i % 2, i, x, y, x + rnd.choice([0, 1, 5]), y + rnd.choice([0, 1, 5])) for i in range(120)
            for x, y in [(rnd.choice([-3.0, 7.5, rnd.uniform(-50, 50)]), rnd.uniform(-50, 50))]]
    rows += [(k, 200 + k, -500.0, -500.0, 500.0, 500.0) for k in (0, 1)]
    df = boxes(spark, rows)
    pad = 2.0
    got = sorted((r[0], r[1]) for r in spatial.box_join(df, df, ["k"], 4.0, pad=pad).select("a.id", "b.id").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] - pad <= b[4] and b[2] <= a[4] + pad
                  and a[3] - pad <= b[5] and b[3] <= a[5] + pad)
    assert got == want


def test_small_boxes_do_not_meet_at_the_class_of_a_huge_one(spark):
    """One box over everything adds a candidate per box, not all pairs of small ones."""
    small = [(0, i, 20.0 * i, 0.0, 20.0 * i + 5, 5.0) for i in range(2000)]
    df = boxes(spark, small)
    huge = df.unionByName(boxes(spark, [(0, 9999, -1e5, -1e5, 1e5, 1e5)]))
    pairs = spatial.box_join(df, huge, ["k"], 8.0)
    assert pairs.count() == 4000
    candidates = spatial.box_join(df, huge, ["k"], 8.0, on=lambda a, b: a["id"] == b["id"])
    assert candidates.count() == 2000


def test_k_nearest_with_few_targets(spark):
    points = boxes(spark, [(0, 1, 0.0, 0.0, 2.0, 2.0), (0, 2, 900.0, 900.0, 900.0, 900.0)])
    targets = boxes(spark, [(0, i, 10.0 * i, 0.0, 10.0 * i, 0.0) for i in range(5)]).withColumnRenamed("id", "t")
    near = spatial.k_nearest(points, targets, ["k"], "id", "t", 3, 4.0).collect()
    assert sorted((r["id"], r["rank"], r["t"]) for r in near) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 4), (2, 2, 3), (2, 3, 2)]
    every = spatial.k_nearest(points, targets, ["k"], "id", "t", 10, 4.0)
    assert every.count() == 10


def test_knn_flag_needs_the_mask_among_the_nearest(spark):
    poly = boxes(spark, [(0, 1, 0.0, 0.0, 2.0, 2.0)])
    # a large mask touches the polygon, but its centre is farther than three small ones
    masks = boxes(spark, [(0, 9, 1.0, 1.0, 41.0, 41.0)] + [(0, i, 4.0 + i, 4.0, 5.0 + i, 5.0) for i in range(3)]).withColumnRenamed("id", "m")
    flag = lambda k: spatial.knn_mask_flag(poly, masks, ["k"], "id", "m", 8.0, k=k).first()["flag"]
    assert (flag(3), flag(4), flag(None)) == (0, 1, 1)


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 601


def _star(draw, corners, holes):
    """A jagged ring round the origin, with a hole if asked for; corners at any fraction."""
    import math

    def ring(scale):
        points = []
        for k in range(corners):
            a, r = 2 * math.pi * k / corners, scale * draw.uniform(0.4, 1.0)
            points.append((r * math.cos(a), r * math.sin(a)))
        return points + points[:1]

    return [ring(14.0)] + ([ring(3.0)] if holes else [])


def test_scanlines_cover_what_the_even_odd_rule_covers(spark):
    import random

    draw = random.Random(5)
    shapes = [_star(draw, draw.choice([3, 7, 40]), k % 2) for k in range(20)] + [[[(0, 0), (6, 0), (6, 4), (0, 4), (0, 0)]]] * 2
    rows = [(k, k % 3, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in shape]) for k, shape in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id long, g int, s array<array<struct<x:double,y:double>>>")

    def inside(shape, px, py):
        odd = False
        for ring in shape:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                    odd = not odd
        return odd

    want = {(k, x, y) for k, s in enumerate(shapes) for x in range(-16, 16) for y in range(-16, 16) if inside(s, x + 0.5, y + 0.5)}
    got = [tuple(r) for r in cells.from_rings(df, "id", "s").select("id", "cx", "cy").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    runs = cells.runs(df, ["g"], "id", "s", tile=5).collect()
    assert all(r.c0 // 5 == (r.c1 - 1) // 5 == r.tile and r.c0 < r.c1 for r in runs)
    covered = [(r.g, x, r.cy) for r in runs for x in range(r.c0, r.c1)]
    assert len(covered) == len(set(covered)) and set(covered) == {(k % 3, x, y) for k, x, y in want}
    coarse = {tuple(r) for r in cells.from_rings(df, "id", "s", 2.5).select("id", "cx", "cy").collect()}
    assert coarse == {(k, x, y) for k, s in enumerate(shapes) for x in range(-8, 8) for y in range(-8, 8) if inside(s, (x + 0.5) * 2.5, (y + 0.5) * 2.5)}
    assert cells.from_rings(df.limit(0), "id", "s").count() == 0


def test_a_large_shape_is_cut_into_runs(spark):
    side = 100_000.0
    shape = [[(0.0, 0.0), (side, 0.0), (side, 40.0), (0.0, 40.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in shape])], "id long, s array<array<struct<x:double,y:double>>>")
    runs = cells.runs(df, [], "id", "s")
    assert runs.count() == 40 * -(-100_000 // cells.TILE) and runs.agg({"c1": "max"}).first()[0] == 100_000


def test_nearest_by_homes_against_all_pairs(spark):
    import random

    from arborscan.operators import spatial
    draw = random.Random(3)
    spot = lambda: (draw.randrange(-3000, 3000), draw.randrange(-3000, 3000)) if draw.random() < 0.4 else (draw.randrange(40), draw.randrange(40))
    boxes = lambda n, ids: [(draw.choice(["a", "b", "c"]), ids(i), *(p := spot()), p[0] + 2, p[1] + 4) for i in range(n)]
    points, targets = boxes(120, lambda i: draw.choice([i, i, 5, None])), boxes(300, lambda i: i // 2)
    targets = [t for t in targets if t[0] != "c"] + [("c", 1000, 0, 0, 2, 4)]
    want = []
    for id in {p[1] for p in points}:
        met = sorted(((p[2] + p[4] - t[2] - t[4]) ** 2 + (p[3] + p[5] - t[3] - t[5]) ** 2, t[1]) for p in points if p[1] == id for t in targets if t[0] == p[0])
        want += [(id, m, d, r) for r, (d, m) in enumerate(met[:4], 1)]
    p, t = (spark.createDataFrame(x, f"key string, {name} long, x0 long, y0 long, x1 long, y1 long") for x, name in ((points, "id"), (targets, "target")))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    for together in (512, 16):  # homes with one array and with several
        got = spatial.k_nearest(p, t, ["key"], "id", "target", 4, 8, together=together).collect()
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert spatial.k_nearest(p, t.limit(0), ["key"], "id", "target", 4, 8).count() == 0


def test_dilation_over_block_borders_shuffles_blocks(spark):
    from arborscan.operators import cells
    given = {("a", 0, 0), ("a", 7, 7), ("a", -1, 20), ("b", -9, -8), (None, 3, 3)}
    df = cells.dilate(spark.createDataFrame(sorted(given, key=str) * 2, "region string, cx long, cy long"), "region", 9)
    want = {(r, x + i, y + j) for r, x, y in given for i in range(-9, 10) for j in range(-9, 10)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "bit_or" in df._jdf.queryExecution().toString()
