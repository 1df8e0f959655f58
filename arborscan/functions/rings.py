"""Planar geometry on rings: array<array<struct<x,y>>>, outer ring first, rings closed.

All predicates are higher-order functions over the points, evaluated per row in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _segments(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
                      F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def _relative(ring: Column, origin: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] - origin["x"]).cast("double").alias("x"),
                                                (p["y"] - origin["y"]).cast("double").alias("y")))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, taken about the first corner so that large coordinates keep their digits."""
    return let(_relative(ring, ring[0]), lambda r: _total(F.transform(_segments(r), _cross)) / 2.0)


def area(shape: Column) -> Column:
    """Outer area minus holes."""
    sizes = F.transform(shape, lambda r: F.abs(ring_area(r)))
    return sizes[0] * 2.0 - _total(sizes)


def centroid(shape: Column) -> Column:
    """Area-weighted centroid, holes counted negative; moments are taken about the first corner."""

    def moments(ring: Column) -> Column:
        def of(segments: Column) -> Column:
            a = _total(F.transform(segments, _cross)) / 2.0
            mx = _total(F.transform(segments, lambda s: (s["a"]["x"] + s["b"]["x"]) * _cross(s))) / 6.0
            my = _total(F.transform(segments, lambda s: (s["a"]["y"] + s["b"]["y"]) * _cross(s))) / 6.0
            sign = F.signum(a)
            return F.struct((a * sign).alias("a"), (mx * sign).alias("mx"), (my * sign).alias("my"))

        return let(_segments(ring), of)

    def field(values: Column, name: str) -> Column:
        """Outer value minus those of the holes."""
        return values[0][name] * 2.0 - _total(F.transform(values, lambda m: m[name]))

    def combine(values: Column) -> Column:
        total = field(values, "a")
        return F.struct((field(values, "mx") / total).alias("x"), (field(values, "my") / total).alias("y"))

    origin = shape[0][0]
    relative = let(F.transform(shape, lambda ring: moments(_relative(ring, origin))), combine)
    return let(relative, lambda c: F.struct((c["x"] + origin["x"]).alias("x"), (c["y"] + origin["y"]).alias("y")))


def bounds(shape: Column) -> Column:
    """struct<xmin,ymin,xmax,ymax> of the outer ring."""
    xs = F.transform(shape[0], lambda p: p["x"])
    ys = F.transform(shape[0], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bounds_intersection(a: Column, b: Column) -> Column:
    """Overlap box of two bounds structs, null when they are apart."""
    box = F.struct(F.greatest(a["xmin"], b["xmin"]).alias("xmin"), F.greatest(a["ymin"], b["ymin"]).alias("ymin"),
                   F.least(a["xmax"], b["xmax"]).alias("xmax"), F.least(a["ymax"], b["ymax"]).alias("ymax"))
    return F.when((box["xmin"] <= box["xmax"]) & (box["ymin"] <= box["ymax"]), box)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rings of an axis-parallel rectangle."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]))


def contains_point(shape: Column, px: Column, py: Column) -> Column:
    """Even-odd test over all rings, so holes are outside."""

    def crossed(s: Column) -> Column:
        ay, by = s["a"]["y"], s["b"]["y"]
        at = (s["b"]["x"] - s["a"]["x"]) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + s["a"]["x"]
        return ((ay > py) != (by > py)) & (px < at)

    crossings = F.transform(shape, lambda r: F.size(F.filter(_segments(r), crossed)))
    return F.aggregate(crossings, F.lit(0), lambda acc, n: acc + n) % 2 == 1


def _turn(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _within_box(p: Column, q: Column, r: Column) -> Column:
    return (r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
            & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])))


def _segments_meet(s: Column, t: Column) -> Column:
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    proper = (_turn(a, b, c) != _turn(a, b, d)) & (_turn(c, d, a) != _turn(c, d, b))
    touch = [(_turn(p, q, r) == 0) & _within_box(p, q, r) for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
    return reduce(lambda m, n: m | n, touch, proper)


def sides(shape: Column) -> Column:
    """array<struct<a,b>>: the sides of all rings."""
    return _all_segments(shape)


def _all_segments(shape: Column) -> Column:
    return F.flatten(F.transform(shape, _segments))


def intersects(a: Column, b: Column) -> Column:
    """True when boundaries meet or one shape lies inside the other."""
    meet = F.exists(_all_segments(a), lambda s: F.exists(_all_segments(b), lambda t: _segments_meet(s, t)))
    start_a, start_b = a[0][0], b[0][0]
    return meet | contains_point(b, start_a["x"], start_a["y"]) | contains_point(a, start_b["x"], start_b["y"])


def within_bounds(a: Column, b: Column) -> Column:
    """``a`` inside the bounds of ``b`` (boundary contact allowed); ``polygons.within`` tests the shape itself."""
    box_a, box_b = bounds(a), bounds(b)
    return ((box_a["xmin"] >= box_b["xmin"]) & (box_a["xmax"] <= box_b["xmax"])
            & (box_a["ymin"] >= box_b["ymin"]) & (box_a["ymax"] <= box_b["ymax"]))


def is_valid(shape: Column) -> Column:
    """Closed rings of four or more points whose non-adjacent sides do not cross."""

    def ring_ok(ring: Column) -> Column:
        closed = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))
        numbered = F.transform(_segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
        last = F.size(ring) - 2
        crossing = F.exists(numbered, lambda s: F.exists(numbered, lambda t: (
            (t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == last)) & _segments_meet(s, t))))
        return closed & ~crossing & (ring_area(ring) != 0)

    return F.forall(shape, ring_ok)


def repair(shape: Column) -> Column:
    """Drop repeated points, close every ring and orient it (outer positive, holes negative).

    Rings that cross themselves stay as they are; ``polygons.repair`` takes them apart.
    """

    def clean(ring: Column, index: Column) -> Column:
        kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))
        closed = F.when(F.element_at(kept, 1) == F.element_at(kept, -1), kept).otherwise(
            F.concat(kept, F.slice(kept, 1, 1)))
        wants_positive = index == 0
        return let(closed, lambda r: F.when((ring_area(r) >= 0) == wants_positive, r).otherwise(F.reverse(r)))

    return F.transform(shape, clean)


def _point_segment_sq(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    length = dx * dx + dy * dy
    along = ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.nullif(length, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = p["x"] - s["a"]["x"] - t * dx, p["y"] - s["a"]["y"] - t * dy
    return ex * ex + ey * ey


def distance(a: Column, b: Column) -> Column:
    """Smallest distance between two shapes, 0 when they intersect."""

    def points_to(shape_p: Column, shape_s: Column) -> Column:
        return F.array_min(F.transform(F.flatten(shape_p), lambda p: F.array_min(
            F.transform(_all_segments(shape_s), lambda s: _point_segment_sq(p, s)))))

    apart = F.sqrt(F.least(points_to(a, b), points_to(b, a)))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(apart)


def clip_to_box(shape: Column, box: Column) -> Column:
    """Outer ring of ``shape`` clipped to a bounds struct (exact for convex shapes), null when empty."""

    def clip(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = (lambda p: p[axis] >= limit) if keep_above else (lambda p: p[axis] <= limit)

        def step(s: Column) -> Column:
            a, b = s["a"], s["b"]
            t = (limit - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
            cut = F.struct(*[(limit if c == axis else a[other] + t * (b[other] - a[other])).alias(c) for c in ("x", "y")])
            return (F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cut))
                    .when(inside(b), F.array(cut, b)).otherwise(F.slice(F.array(b), 1, 0)))

        return let(ring, lambda r: let(F.flatten(F.transform(_segments(r), step)), lambda points: F.when(
            F.size(points) > 0, F.concat(points, F.slice(points, 1, 1))).otherwise(points)))

    ring = shape[0]
    for axis, side, above in (("x", "xmin", True), ("x", "xmax", False), ("y", "ymin", True), ("y", "ymax", False)):
        ring = clip(ring, axis, box[side], above)
    return let(ring, lambda r: F.when(F.size(r) >= 4, F.array(r)))


def affine(col: Column, row: Column, transform: tuple, centre: bool = False) -> tuple[Column, Column]:
    """World position of a cell from the six affine coefficients (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    shift = 0.5 if centre else 0.0
    return a * (col + shift) + b * (row + shift) + c, d * (col + shift) + e * (row + shift) + f
