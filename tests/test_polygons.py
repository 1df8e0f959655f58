"""Exact areas and repairs of notched, holed and self-crossing shapes."""

import random

import pytest
from pyspark.sql import functions as F

from arborscan.functions import polygons, rings


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


SQUARE = [ring((0, 0), (4, 0), (4, 4), (0, 4))]
ELL = [ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))]
HOLED = [ring((0, 0), (6, 0), (6, 6), (0, 6)), ring((1, 1), (1, 5), (5, 5), (5, 1))]
BOW = [ring((0, 0), (2, 2), (2, 0), (0, 2))]
TRIANGLE = [ring((0, 0), (4, 0), (0, 4))]


def areas(a, b):
    return tuple(polygons.areas(*[[[[v for p in r for v in (p["x"], p["y"])] for r in shape]] for shape in (a, b)])[0])


def test_areas_by_hand():
    assert areas(SQUARE, ELL) == pytest.approx((16, 7, 7))
    assert areas(HOLED, SQUARE) == pytest.approx((20, 16, 7))
    assert areas(TRIANGLE, BOW) == pytest.approx((8, 2, 2))
    assert areas(TRIANGLE, [ring((4, 4), (1, 4), (4, 1))])[2] == pytest.approx(0)
    assert areas([ring((2, 2), (3, 2), (3, 3), (2, 3))], ELL) == pytest.approx((1, 7, 0))
    assert areas([], SQUARE) == pytest.approx((0, 16, 0))


def test_areas_against_sampling():
    draw = random.Random(3)
    for _ in range(5):
        a, b = ([ring(*[(draw.uniform(0, 10), draw.uniform(0, 10)) for _ in range(7)])] for _ in range(2))
        got = areas(a, b)
        hits = [0, 0, 0]
        for _ in range(20_000):
            x, y = draw.uniform(0, 10), draw.uniform(0, 10)
            inside = [sum((p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
                          for p, q in zip(s[0], s[0][1:])) % 2 == 1 for s in (a, b)]
            for i, hit in enumerate((*inside, all(inside))):
                hits[i] += hit
        assert got == pytest.approx([100 * h / 20_000 for h in hits], abs=2.5)


def test_columns_of_any_shape(spark):
    shapes = "array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([(1, SQUARE, ELL), (2, [ring((2, 2), (3, 2), (3, 3), (2, 3))], ELL), (3, None, ELL)], f"id int, a {shapes}, b {shapes}")
    got = {r.id: r for r in df.select("id", polygons.iou(F.col("a"), F.col("b")).alias("iou"), polygons.within(F.col("a"), F.col("b")).alias("inside"),
                                      polygons.within(F.col("b"), F.col("a")).alias("holds"), polygons.union_area(F.col("a"), F.col("b")).alias("u")).collect()}
    assert got[1].iou == pytest.approx(7 / 16) and got[1].holds and not got[1].inside and got[1].u == pytest.approx(16)
    assert not got[2].inside and got[3].iou is None


def test_repair_of_crossing_rings(spark):
    shapes = "array<array<struct<x:double,y:double>>>"
    twice = [ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (4, 4), (4, 6), (0, 6))]
    rows = [(1, BOW), (2, SQUARE), (3, HOLED), (4, [ring((0, 0), (1, 1), (2, 2))]), (5, twice)]
    df = spark.createDataFrame(rows, f"id int, s {shapes}").select("id", "s", F.explode_outer(polygons.repair(F.col("s"))).alias("p"))
    got = df.select("id", rings.is_valid(F.col("p")).alias("ok"), rings.area(F.col("p")).alias("area")).collect()
    assert all(r.ok for r in got if r.area is not None)
    size = {i: sorted(round(r.area, 9) for r in got if r.id == i and r.area is not None) for i in range(1, 6)}
    assert size[1] == [1, 1] and size[2] == [16] and size[3] == [20] and size[4] == []
    assert sum(size[5]) == pytest.approx(areas(twice, [])[0])
