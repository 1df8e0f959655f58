"""Overlay and dissolve of polygons against exact areas and cell counts."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborscan.functions import overlay, polygons, rings

SHAPE = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [[x0, y0, x1, y0, x1, y1, x0, y1, x0, y0]]


def signed(ring):
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def area(found):
    return sum(signed(ring) for polygon in found for ring in polygon)


def star(draw, corners, cx, cy, size):
    points = [(cx + size * draw.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners), cy + size * draw.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners))
              for k in range(corners)]
    return [[c for p in points + points[:1] for c in p]]


@pytest.mark.parametrize("a,b,union,common,rest", [
    (box(0, 0, 2, 2), box(1, 1, 3, 3), [1, 7.0], [1, 1.0], [1, 3.0]),
    (box(0, 0, 1, 1), box(1, 1, 2, 2), [2, 2.0], [0, 0], [1, 1.0]),  # a common corner does not join
    (box(0, 0, 1, 1), box(1, 0, 2, 1), [1, 2.0], [0, 0], [1, 1.0]),  # a common side does
    (box(0, 0, 4, 4), box(1, 1, 2, 2), [1, 16.0], [1, 1.0], [1, 15.0]),
    (box(0, 0, 4, 4) + box(0, 0, 2, 2), box(5, 5, 6, 6), [2, 13.0], [0, 0], [1, 12.0]),
    (box(0, 0, 3, 3) + box(1, 1, 2, 2), box(1, 1, 2, 2), [1, 9.0], [0, 0], [1, 8.0]),  # the hole filled
    (box(0, 0, 5, 1), box(1, -1, 2, 2) + box(3, -1, 4, 2), [1, 9.0], [2, 2.0], [3, 3.0]),
    (box(0, 0, 1, 1), [], [1, 1.0], [0, 0], [1, 1.0]), ([], [], [0, 0], [0, 0], [0, 0])])
def test_overlays_by_hand(a, b, union, common, rest):
    for kind, want in (("union", union), ("intersection", common), ("difference", rest)):
        found = overlay.combine(a, b, kind)
        assert [len(found), area(found)] == want
        assert all(signed(p[0]) > 0 and all(signed(h) < 0 for h in p[1:]) and all((r[0] == r[-1]).all() for r in p) for p in found)


def test_a_hole_that_touches_its_ring_is_a_hole():
    found = overlay.combine(box(0, 0, 4, 4), [[2, 0, 3, 1, 2, 2, 1, 1, 2, 0]], "difference")
    assert [len(p) for p in found] == [2] and area(found) == 14.0


def test_random_overlays_have_exact_areas():
    draw = random.Random(1)
    for _ in range(120):
        a, b = star(draw, draw.choice([3, 5, 12, 30]), 0, 0, 10), star(draw, draw.choice([3, 5, 30]), draw.uniform(-8, 8), draw.uniform(-8, 8), 8)
        own, other, common = polygons.areas([a], [b])[0]
        for kind, want in (("union", own + other - common), ("intersection", common), ("difference", own - common)):
            assert abs(area(overlay.combine(a, b, kind)) - want) < 1e-4


def test_rings_of_many_corners_stay_small():
    wave = lambda cx, w: [[c for k in [*range(20_000), 0] for c in (
        cx + 1000 * (1 + 0.1 * math.sin(w * 2 * math.pi * k / 20_000)) * math.cos(2 * math.pi * k / 20_000),
        1000 * (1 + 0.1 * math.sin(w * 2 * math.pi * k / 20_000)) * math.sin(2 * math.pi * k / 20_000))]]
    a, b = wave(0, 50), wave(300, 70)
    tracemalloc.start()
    both = area(overlay.combine(a, b, "union")) + area(overlay.combine(a, b, "intersection"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    single = sum(signed(np.array(r[0]).reshape(-1, 2)) for r in (a, b))
    assert peak < 500e6 and abs(both / single - 1) < 1e-6


def rows(shapes):
    return [(*keys, [[{"x": float(x), "y": float(y)} for x, y in zip(r[::2], r[1::2])] for r in shape]) for *keys, shape in shapes]


def test_dissolving_is_a_tree_of_unions(spark):
    draw = random.Random(2)
    shapes, cells = [], {}
    for k in range(300):
        x, y, w, h = draw.randrange(-60, 60), draw.randrange(-60, 60), draw.randrange(1, 9), draw.randrange(1, 9)
        key = draw.choice(["a", "a", "b", None])
        shapes.append((key, box(x, y, x + w, y + h)))
        cells.setdefault(key, set()).update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    shapes += [("one", box(3, 3, 4, 5)), ("none", [])] + [("same", box(0, 0, 2, 2))] * 50
    cells |= {"one": {(3, 3), (3, 4)}, "same": {(0, 0), (0, 1), (1, 0), (1, 1)}}
    df = spark.createDataFrame(rows(shapes), f"key string, shape {SHAPE}")
    got = overlay.dissolve(df, ["key"], "shape", cell=8.0, together=4)
    found = {r.key: (r.a, r.p, r.n) for r in got.select("key", overlay.area(F.col("polygons")).alias("a"), overlay.perimeter(F.col("polygons")).alias("p"),
                                                        F.size("polygons").alias("n")).collect()}
    assert set(found) == set(cells)
    for key, own in cells.items():
        assert found[key][:2] == (len(own), sum((x + i, y + j) not in own for x, y in own for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    assert overlay.dissolve(df.limit(0), ["key"], "shape").count() == 0


def test_overlay_columns_of_nulls_and_several_polygons(spark):
    df = spark.createDataFrame(rows([(1, box(0, 0, 4, 1)), (2, box(9, 9, 9, 9))]), f"id long, a {SHAPE}").withColumn(
        "b", F.when(F.col("id") == 1, rings.rectangle(F.lit(1), F.lit(-1), F.lit(2), F.lit(3))))
    got = {r.id: r for r in df.select("id", "b", overlay.difference(F.col("a"), F.col("b")).alias("d")).withColumn(
        "back", overlay.union(F.flatten("d"), F.col("b"))).withColumn("size", overlay.area(F.col("back"))).collect()}
    assert len(got[1].d) == 2 and got[1].size == 7.0 and got[2].d is None and got[2].back is None


def near(ring, px, py):
    """Distance of points to a ring of corners."""
    best = np.full(px.shape, np.inf)
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        along = np.clip(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        best = np.minimum(best, np.hypot(px - ax - along * (bx - ax), py - ay - along * (by - ay)))
    return best


def holds(rings_, px, py):
    inside = np.zeros(px.shape, bool)
    for ring in rings_:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if ay != by:
                inside ^= ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))
    return inside


def test_offset_against_distances(spark):
    notched = [(0, 0), (9, 0), (9, 6), (5.5, 6), (5.5, 1.5), (4, 1.5), (4, 6), (0, 6), (0, 0)]
    skew = [(0, 0), (8, 3), (3, 9), (2.5, 4), (0, 0)]
    framed = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    window = [(4, 4), (4, 5.5), (5.5, 5.5), (5.5, 4), (4, 4)]
    shapes = {1: [notched], 2: [skew], 3: [framed, window]}
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in shape]) for k, shape in shapes.items()] + [(4, []), (None, None)]
    df = spark.createDataFrame(rows, f"id int, shape {SHAPE}")
    draw = np.random.default_rng(8)
    px, py = draw.uniform(-3, 13, 4000), draw.uniform(-3, 13, 4000)
    for distance in (1.0, -1.0):
        found = {r["id"]: [[(p["x"], p["y"]) for p in ring] for polygon in r["polygons"] for ring in polygon] for r in overlay.offset(df, ["id"], "shape", distance).collect()}
        assert found.pop(4) == [] and found.pop(None) == [] and set(found) == set(shapes)
        for k, shape in shapes.items():
            away = np.min([near(ring, px, py) for ring in shape], axis=0)
            inside = holds(shape, px, py)
            expected = inside | (away < 1) if distance > 0 else inside & (away > 1)
            clear = abs(away - 1) > 0.01  # a circle of 64 sides stays within a hundredth
            assert (holds(found[k], px, py) == expected)[clear].all()
    # a gap of one and a half closes when both sides grow by one, a window too; shrunk by five the frame is gone
    grown = {r["id"]: r["polygons"] for r in overlay.offset(df.where("id < 4"), ["id"], "shape", 1.0).collect()}
    assert [len(polygon) for polygon in grown[3]] == [1]
    assert overlay.offset(df.where("id = 3"), ["id"], "shape", -6.0).first()["polygons"] == []
    assert len(overlay.offset(df.where("id = 3"), ["id"], "shape", 0.0).first()["polygons"][0]) == 2


def test_many_pairs_go_through_the_steps_together():
    draw = random.Random(4)
    pairs = [(star(draw, draw.choice([3, 5, 12]), 0, 0, 10), box(*(sorted(draw.sample(range(-9, 9), 2))[i] for i in (0, 0, 1, 1)))) for _ in range(400)]
    pairs[7] = (box(math.nan, 0, 1, 1), box(0, 0, 1, 1))  # unknown corners disturb no other pair
    pairs[8] = ([], [])
    for kind in ("union", "intersection", "difference"):
        together = overlay.combine_many(pairs, kind)
        for (a, b), found in zip(pairs, together):
            one = overlay.combine(a, b, kind)
            assert [[ring.tolist() for ring in polygon] for polygon in one] == [[ring.tolist() for ring in polygon] for polygon in found]


def test_overlay_columns_keep_nulls_and_empty_shapes(spark):
    ring = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]]
    df = spark.createDataFrame([(1, ring, ring), (2, None, ring), (3, [], ring), (4, [], [])], f"id int, a {SHAPE}, b {SHAPE}")
    got = {r["id"]: r["u"] for r in df.select("id", overlay.union(F.col("a"), F.col("b")).alias("u")).collect()}
    assert [len(got[1]), got[2], len(got[3]), got[4]] == [1, None, 1, []]


def test_keys_of_one_shape_take_no_part_in_the_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(overlay, "cut_lineage", lambda df: rounds.append(df.count()) or df.localCheckpoint())
    df = spark.createDataFrame(rows([(k, box(5000 * k, 0, 5000 * k + 1, 1)) for k in range(50)] + [(0, box(90_000, 0, 90_001, 1))]), f"key int, shape {SHAPE}")
    assert overlay.dissolve(df, ["key"], "shape").count() == 50
    assert rounds.count(51) == 1 and rounds.count(50) == 1  # what comes in and what goes out
