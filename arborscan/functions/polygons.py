"""Exact areas of common parts and unions of arbitrary polygons, and repair of crossing rings.

Shapes are rings as in ``rings``: holes, notches and self-crossing rings are read by the even-odd
rule. The plane is cut into vertical slabs at every corner and crossing; inside a slab no two sides
cross, so lengths change linearly and the middle line gives the exact area. Each row's shapes are
handled on their own, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_RINGS = "array<array<struct<x:double,y:double>>>"
_POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
_AREAS = T.StructType([T.StructField(name, T.DoubleType()) for name in ("a", "b", "common")])


def _sides(shape) -> np.ndarray:
    """(n, 4) sides x0, y0, x1, y1 of all rings, each a flat x, y, x, y, ...; upright ones bound no slab."""
    out = [np.zeros((0, 4))]  # for shapes without rings
    for ring in shape:
        points = np.asarray(ring, float).reshape(-1, 2)
        if len(points) > 1:
            out.append(np.hstack([points, np.concatenate([points[1:], points[:1]])]))
    sides = np.vstack(out)
    return sides[sides[:, 0] != sides[:, 2]]


def _stacked(sides: list[np.ndarray]) -> np.ndarray:
    """(shapes, most sides, 4), filled up with nan."""
    out = np.full((len(sides), max(map(len, sides)), 4), np.nan)
    for i, own in enumerate(sides):
        out[i, : len(own)] = own
    return out


def _crossings(sides: np.ndarray) -> np.ndarray:
    """(shapes, n * n) x of all points where two sides cross, nan elsewhere."""
    x0, y0, x1, y1 = np.moveaxis(sides, 2, 0)
    dx, dy = x1 - x0, y1 - y0
    cross = dx[:, :, None] * dy[:, None, :] - dy[:, :, None] * dx[:, None, :]
    ex, ey = x0[:, None, :] - x0[:, :, None], y0[:, None, :] - y0[:, :, None]
    t = (ex * dy[:, None, :] - ey * dx[:, None, :]) / cross
    u = (ex * dy[:, :, None] - ey * dx[:, :, None]) / cross
    met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return np.where(met, x0[:, :, None] + t * dx[:, :, None], np.nan).reshape(len(sides), -1)


def _areas_of(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    own = [_stacked(side) for side in (first, second)]
    sides = np.concatenate(own, axis=1)
    owner = np.repeat([0, 1], [s.shape[1] for s in own])
    if not sides.shape[1]:
        return np.zeros((len(first), 3))
    x0, y0, x1, y1 = np.moveaxis(sides, 2, 0)[:, :, None, :]
    xs = np.sort(np.concatenate([x0[:, 0], x1[:, 0], _crossings(sides)], axis=1), axis=1)
    xs = xs[:, : max(2, int((~np.isnan(xs)).sum(axis=1).max()))]
    low, high = xs[:, :-1, None], xs[:, 1:, None]
    middle = (low + high) / 2
    there = (np.minimum(x0, x1) <= low) & (np.maximum(x0, x1) >= high) & (high > low)
    y = np.where(there, y0 + (middle - x0) * ((y1 - y0) / (x1 - x0)), np.inf)
    order = np.argsort(y, axis=2, kind="stable")
    y, there = np.take_along_axis(y, order, axis=2), np.take_along_axis(there, order, axis=2)
    is_b = owner[order] == 1
    steps = np.where(there[:, :, 1:], y[:, :, 1:] - np.where(there[:, :, :-1], y[:, :, :-1], 0.0), 0.0) * np.nan_to_num(high - low)
    in_a = np.cumsum(there & ~is_b, axis=2)[:, :, :-1] % 2 == 1
    in_b = np.cumsum(there & is_b, axis=2)[:, :, :-1] % 2 == 1
    return np.stack([(steps * inside).sum(axis=(1, 2)) for inside in (in_a, in_b, in_a & in_b)], axis=1)


def areas(first: list, second: list, together: int = 1 << 19) -> np.ndarray:
    """(pairs, 3): areas of each shape of ``first``, of ``second`` and of their common part.

    Pairs are handled many at a time, as many as keep the work arrays at about ``together`` numbers.
    """
    a, b = [_sides(s) for s in first], [_sides(s) for s in second]
    out, start = np.zeros((len(a), 3)), 0
    with np.errstate(divide="ignore", invalid="ignore"):
        while start < len(a):
            stop, most = start, 0
            while stop < len(a):
                most = max(most, len(a[stop]) + len(b[stop]))
                if stop > start and (stop + 1 - start) * most * max(8, most) > together:
                    break
                stop += 1
            out[start:stop] = _areas_of(a[start:stop], b[start:stop])
            start = stop
    return out


@F.pandas_udf(_AREAS)
def _areas(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    known = first.notna() & second.notna()
    out = pd.DataFrame(np.nan, index=first.index, columns=["a", "b", "common"])
    if known.any():
        out.loc[known] = areas(first[known].tolist(), second[known].tolist())
    return out.astype(object).where(known, None)


def _flat(shape: Column) -> Column:
    """Rings as plain arrays of numbers, which cross to Python in bulk."""
    return F.transform(shape, lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))))


def measured(a: Column, b: Column) -> Column:
    """struct<a, b, common>: areas of two shapes and of their common part; null if a shape is null."""
    return _areas(_flat(a), _flat(b))


def intersection_area(a: Column, b: Column) -> Column:
    return measured(a, b)["common"]


def union_area(a: Column, b: Column) -> Column:
    m = measured(a, b)
    return m["a"] + m["b"] - m["common"]


def iou(a: Column, b: Column) -> Column:
    """Common area over united area; null for two shapes without area."""
    m = measured(a, b)
    return m["common"] / F.nullif(m["a"] + m["b"] - m["common"], F.lit(0.0))


def within(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """``a`` lies inside ``b`` (boundary contact allowed): nothing of its area is outside."""
    m = measured(a, b)
    return (m["a"] > 0) & (m["a"] - m["common"] <= tolerance * m["a"])


def _loops(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A closed walk cut into simple loops at the points it passes twice or crosses itself."""
    n, cut = len(points), []
    for i in range(n):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % n]
        found = [(0.0, (ax, ay))]
        for j in range(n):
            if j in (i, (i + 1) % n, (i - 1) % n):
                continue
            (cx, cy), (dx, dy) = points[j], points[(j + 1) % n]
            cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if cross:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / cross
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / cross
                if 0 <= t < 1 and 0 <= u < 1:
                    # the same point however the two sides are ordered
                    k, s = (i, t) if i < j else (j, u)
                    (px, py), (qx, qy) = points[k], points[(k + 1) % n]
                    found.append((t, (px + s * (qx - px), py + s * (qy - py))))
        cut += [p for _, p in sorted(found)]
    stack, seen, out = [], {}, []
    for point in [*cut, cut[0]]:
        if point in seen:
            at = seen[point]
            loop = stack[at:]
            for p in loop:
                seen.pop(p, None)
            stack = stack[:at]
            if len(loop) > 2:
                out.append(loop)
        seen[point] = len(stack)
        stack.append(point)
    return out


def repaired(shape) -> list[list[list[tuple[float, float]]]]:
    """Valid polygons, largest first, that cover what the even-odd rule gives a shape with crossing rings."""
    loops = []
    for ring in shape:
        points = [(float(p["x"]), float(p["y"])) for p in ring]
        points = [p for i, p in enumerate(points) if p != points[i - 1]] if len(points) > 1 else []
        loops += _loops(points) if len(points) > 2 else []
    signed = [(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(loop, loop[1:] + loop[:1])) / 2, loop) for loop in loops]
    signed = sorted(((abs(a), loop if a > 0 else loop[::-1]) for a, loop in signed if a), reverse=True)
    inside = [[k for k, (size, outer) in enumerate(signed) if size > own and _holds(outer, loop)] for own, loop in signed]
    out: dict[int, list] = {}
    for k, (_, loop) in enumerate(signed):
        if len(inside[k]) % 2 == 0:
            out[k] = [loop + loop[:1]]
        else:
            parent = min(inside[k], key=lambda j: signed[j][0])
            out.setdefault(parent, []).append((loop + loop[:1])[::-1])
    return list(out.values())


def _holds(outer: list[tuple[float, float]], inner: list[tuple[float, float]]) -> bool:
    """Whether the middle of an inner loop's first side, moved a little inward, lies in the outer loop."""
    (ax, ay), (bx, by) = inner[0], inner[1]
    px, py = (ax + bx) / 2 - (by - ay) * 1e-9, (ay + by) / 2 + (bx - ax) * 1e-9
    odd = False
    for (cx, cy), (dx, dy) in zip(outer, outer[1:] + outer[:1]):
        if (cy > py) != (dy > py) and px < (dx - cx) * (py - cy) / (dy - cy) + cx:
            odd = not odd
    return odd


@F.pandas_udf(_POLYGONS)
def _repaired(shapes: pd.Series) -> pd.Series:
    named = lambda polygons: [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in polygons]
    return pd.Series([None if s is None else named(repaired(s)) for s in shapes])


def repair(shape: Column) -> Column:
    """Valid polygons (outer ring first, holes after it, closed and oriented) of any shape, largest first; none without area."""
    return _repaired(shape.cast(_RINGS))
