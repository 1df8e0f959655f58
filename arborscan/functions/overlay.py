"""Union, common part and difference of polygons as polygons, and dissolving of many shapes.

Corners are put on a grid of 2**26 steps over the two shapes, so that all tests are exact in 64-bit
integers. Sides are cut where they meet (a sweep over x finds the pairs, in bounded portions), equal
pieces become one edge that knows which shapes it bounds, and a second sweep counts the edges
below each. Edges with the result on one side only are walked into rings. Every step handles many
pairs of shapes at a time; a pair's group number is the first part of all sort keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from arborscan.functions import rings
from arborscan.functions.polygons import _POLYGONS, _flat
from arborscan.session import cut_lineage

_BITS, _PAIRS = 26, 1 << 19  # steps of the grid over the extent; pairs of sides looked at together
_TOGETHER = 1 << 15  # corners of shapes that go through the steps together
_WIDER = 16  # cells of a round of dissolving that make one of the next, along an axis


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j in [low_i, high_i), portions of about ``_PAIRS``."""
    count = np.maximum(high - low, 0)
    total = np.cumsum(count)
    start = 0
    while start < len(count):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
        n = count[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        yield i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]
        start = stop


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _keys(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places on the grid that sort by group first."""
    return (group << 30) + x


def _meetings(s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(side, point) of all points strictly inside a side where it meets another one of its group; rounded to the grid."""
    left, right = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    low, high = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    order = np.argsort(_keys(group, left), kind="stable")
    places, points = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for i, j in _ranges(np.arange(1, len(s) + 1), np.searchsorted(_keys(group, left)[order], _keys(group, right)[order], "right")):
        i, j = order[i], order[j]
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        a, b, c, d = s[i, :2], s[i, 2:], s[j, :2], s[j, 2:]
        u, v, w = b - a, d - c, c - a
        turn = _cross(u[:, 0], u[:, 1], v[:, 0], v[:, 1])
        for_a, for_c = _cross(w[:, 0], w[:, 1], v[:, 0], v[:, 1]), _cross(w[:, 0], w[:, 1], u[:, 0], u[:, 1])
        sign = np.sign(turn)
        met = (turn != 0) & (for_a * sign >= 0) & (for_a * sign <= turn * sign) & (for_c * sign >= 0) & (for_c * sign <= turn * sign)
        t = for_a[met] / turn[met]
        at = a[met] + np.rint(t[:, None] * u[met]).astype(np.int64)
        found = [(i[met], at), (j[met], at)]
        line = (turn == 0) & (for_c == 0)
        found += [(i[line], c[line]), (i[line], d[line]), (j[line], a[line]), (j[line], b[line])]
        for side, point in found:
            end_a, end_b = s[side, :2], s[side, 2:]
            inside = ((point >= np.minimum(end_a, end_b)) & (point <= np.maximum(end_a, end_b))).all(axis=1)
            inside &= (point != end_a).any(axis=1) & (point != end_b).any(axis=1)
            places.append(side[inside])
            points.append(point[inside])
    return np.concatenate(places), np.concatenate(points)


def _pieces(s: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides cut until they meet at ends only; rounding a cut may make new ones meet, so groups with cuts are looked at again."""
    done = []
    while True:
        side, point = _meetings(s, group)
        again = np.zeros(int(group.max(initial=-1)) + 1, bool)
        again[group[side]] = True
        ready = ~again[group]
        done.append((s[ready], owner[ready], group[ready]))
        if ready.all():
            return tuple(np.concatenate(parts) for parts in zip(*done))
        along = ((point - s[side, :2]) * (s[side, 2:] - s[side, :2])).sum(axis=1)
        whole = np.flatnonzero(~ready)
        who = np.concatenate([whole, side, whole])
        where = np.concatenate([np.full(len(whole), -1), along, np.full(len(whole), np.iinfo(np.int64).max)])
        corner = np.concatenate([s[whole, :2], point, s[whole, 2:]])
        order = np.lexsort((where, who))
        who, corner = who[order], corner[order]
        joined = (who[1:] == who[:-1]) & (corner[1:] != corner[:-1]).any(axis=1)
        s, owner, group = np.hstack([corner[:-1], corner[1:]])[joined], owner[who[:-1][joined]], group[who[:-1][joined]]


def _point(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x << (_BITS + 2)) + y


def _edges(s: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces by group, lower left end first, and whether crossing them changes shape 0 and shape 1; those that change nothing go."""
    swap = (s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3]))
    s = np.where(swap[:, None], s[:, [2, 3, 0, 1]], s)
    order = np.lexsort((_point(s[:, 2], s[:, 3]), _point(s[:, 0], s[:, 1]), group))
    s, owner, group = s[order], owner[order], group[order]
    first = np.append(True, (s[1:] != s[:-1]).any(axis=1) | (group[1:] != group[:-1]))[: len(s)]
    number = np.cumsum(first) - 1
    flips = np.bincount(2 * number + owner, minlength=2 * int(first.sum())).reshape(-1, 2) % 2 == 1
    kept = flips.any(axis=1)
    return s[first][kept], flips[kept], group[first][kept]


def _below(e: np.ndarray, flips: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each shape lies just below every edge's middle, for upright edges just left of it."""
    upright = e[:, 0] == e[:, 2]
    mx, my = e[:, 0] + e[:, 2], e[:, 1] + e[:, 3]  # twice the middle
    out = np.zeros((len(e), 2), np.int64)
    wide = np.flatnonzero(~upright)
    size = np.frexp((e[wide, 2] - e[wide, 0]).astype(float))[1]
    for width in np.unique(size):  # edges of about one width: few lie near a middle without spanning it
        own = wide[size == width]
        left = _keys(group[own], 2 * e[own, 0])  # ascending, as edges are sorted
        most = int((e[own, 2] - e[own, 0]).max())
        for i, k in _ranges(np.searchsorted(left, _keys(group, np.maximum(mx - 2 * most, 0)), "left"), np.searchsorted(left, _keys(group, mx), "right")):
            f = e[own[k]]
            spans = np.where(upright[i], (2 * f[:, 0] < mx[i]) & (mx[i] <= 2 * f[:, 2]), (2 * f[:, 0] <= mx[i]) & (mx[i] < 2 * f[:, 2]))
            i, k, f = i[spans], k[spans], f[spans]
            above = _cross(f[:, 2] - f[:, 0], f[:, 3] - f[:, 1], mx[i] - 2 * f[:, 0], my[i] - 2 * f[:, 1]) > 0
            for shape in (0, 1):
                out[:, shape] += np.bincount(i[above & flips[own[k], shape]], minlength=len(e))
    return out % 2 == 1


def _rings(e: np.ndarray) -> list[np.ndarray]:
    """Simple closed walks over directed edges that have the result on their left."""
    order = np.lexsort((e[:, 1], e[:, 0]))
    e = e[order]
    corners, start = np.unique(e[:, :2], axis=0, return_index=True)
    stop = np.append(start[1:], len(e))
    place = {tuple(c): k for k, c in enumerate(corners.tolist())}
    ends = [place[tuple(c)] for c in e[:, 2:].tolist()]
    used, loops = np.zeros(len(e), bool), []
    rows = e.tolist()

    def turned(k: int, j: int) -> float:
        """How far to the left the walk turns from edge k to edge j."""
        ux, uy, vx, vy = rows[k][2] - rows[k][0], rows[k][3] - rows[k][1], rows[j][2] - rows[j][0], rows[j][3] - rows[j][1]
        return np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy)

    for first in range(len(rows)):
        path, seen, k = [], {}, first
        while not used[k]:
            used[k] = True
            corner = (rows[k][0], rows[k][1])
            if corner in seen:  # a loop closes here
                at = seen[corner]
                loops.append(np.array(path[at:]))
                for c in path[at:]:
                    del seen[c]
                path = path[:at]
            seen[corner] = len(path)
            path.append(corner)
            options = [j for j in range(start[ends[k]], stop[ends[k]]) if not used[j]]
            if not options:
                break
            k = options[0] if len(options) == 1 else max(options, key=lambda j: turned(k, j))
        if path:
            loops.append(np.array(path))
    return loops


def _circles(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member of every member's circle and the steps from there, by pointer doubling."""
    low, ahead = np.arange(len(following)), following
    while True:
        lower = np.minimum(low, low[ahead])
        if (lower == low).all():
            break
        low, ahead = lower, ahead[ahead]
    own = np.arange(len(following))
    before = np.empty_like(following)
    before[following] = own
    before = np.where(low == own, own, before)
    steps = (low != own).astype(np.int64)
    while (before[before] != before).any():
        steps, before = steps + steps[before], before[before]
    return low, steps


def _loops(e: np.ndarray, group: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((points, points per ring), group per ring) of the walks over each group's directed edges.

    Where one edge leaves every corner the walks are circles, found for all groups at once; groups with corners
    where rings touch are walked one by one.
    """
    order = np.lexsort((_point(e[:, 0], e[:, 1]), group))
    e, group = e[order], group[order]
    n = len(e)
    code = np.concatenate([_point(e[:, 0], e[:, 1]), _point(e[:, 2], e[:, 3])])
    both = np.concatenate([group, group])
    sort = np.lexsort((code, both))
    new = np.append(True, (code[sort][1:] != code[sort][:-1]) | (both[sort][1:] != both[sort][:-1]))[: 2 * n]
    corner = np.empty(2 * n, np.int64)
    corner[sort] = np.cumsum(new) - 1
    count = int(new.sum())
    out = np.bincount(corner[:n], minlength=count)
    touch = np.zeros(int(group.max(initial=-1)) + 1, bool)
    touch[group[out[corner[:n]] > 1]] = True
    simple = np.flatnonzero(~touch[group])
    leaving = np.full(count, -1)
    leaving[corner[:n][simple]] = np.arange(len(simple))
    head, steps = _circles(leaving[corner[n:][simple]])
    sort = np.lexsort((steps, head))
    points, firsts = e[simple][sort, :2], np.flatnonzero(steps[sort] == 0)
    sizes, owners = np.diff(np.append(firsts, len(simple))), group[simple][sort][firsts]
    for g in np.flatnonzero(touch):
        walked = _rings(e[group == g])
        points = np.concatenate([points, *walked])
        sizes = np.append(sizes, [len(r) for r in walked])
        owners = np.append(owners, np.full(len(walked), g))
    return _picked(points, sizes, np.argsort(owners, kind="stable")), np.sort(owners, kind="stable")


def _picked(points: np.ndarray, sizes: np.ndarray, rings_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of some rings, in that order, and the rings' sizes."""
    starts, n = (np.cumsum(sizes) - sizes)[rings_], sizes[rings_]
    return points[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)], n


def _neighbours(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the point before and after every point of closed walks."""
    stops = np.cumsum(sizes)
    own = np.arange(sizes.sum())
    before, after = own - 1, own + 1
    there = sizes > 0
    before[(stops - sizes)[there]], after[stops[there] - 1] = stops[there] - 1, (stops - sizes)[there]
    return before, after


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over each ring's values; no ring is empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, values.dtype)


def _straightened(points: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings without points on a straight way; those of fewer than three corners go."""
    before, after = _neighbours(sizes)
    u, v = points - points[before], points[after] - points
    bend = _cross(u[:, 0], u[:, 1], v[:, 0], v[:, 1]) != 0
    points, sizes = points[bend], _sums(bend.astype(np.int64), sizes)
    kept = np.flatnonzero(sizes > 2)
    return *_picked(points, sizes, kept), group[kept]


def _signed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    p = points - np.repeat(points[np.cumsum(sizes) - sizes], sizes, axis=0)
    q = p[_neighbours(sizes)[1]]
    return _sums(_cross(p[:, 0].astype(float), p[:, 1], q[:, 0].astype(float), q[:, 1]), sizes) / 2


def _holds(outer: np.ndarray, px: int, py: int) -> bool:
    """Even-odd test of a point given twice as large."""
    a, b = 2 * outer, 2 * np.roll(outer, -1, axis=0)
    up = b[:, 1] > a[:, 1]
    side = _cross(b[:, 0] - a[:, 0], b[:, 1] - a[:, 1], px - a[:, 0], py - a[:, 1])
    return bool((((a[:, 1] > py) != (b[:, 1] > py)) & ((side > 0) == up)).sum() % 2)


@dataclass
class _Shapes:
    """Shapes as plain arrays: points (n, 2), points per ring, rings per polygon, polygons per shape."""

    points: np.ndarray
    sizes: np.ndarray
    rings: np.ndarray
    polygons: np.ndarray

    @classmethod
    def none(cls, n: int) -> _Shapes:
        return cls(np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64))

    @classmethod
    def joined(cls, parts: list[_Shapes]) -> _Shapes:
        return cls(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)])


def _overlaid(points: np.ndarray, sizes: np.ndarray, pair: np.ndarray, owner: np.ndarray, n: int, kind: str) -> _Shapes:
    """The overlay of ``n`` pairs of shapes: rings by ``pair``, each of shape ``owner`` 0 or 1. All pairs go through every step together."""
    real = np.flatnonzero(sizes > 2)
    points, sizes = _picked(points, sizes, real)
    pair, owner = pair[real], owner[real]
    if not len(sizes):
        return _Shapes.none(n)
    group = np.repeat(pair, sizes)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
    with np.errstate(all="ignore"):
        wide = (high - low).max(axis=1)
        step = 2.0 ** (np.ceil(np.log2(np.maximum(wide, 1e-300))) - _BITS)
        origin = np.floor(low / step[:, None]) * step[:, None]
    steps, origins = np.ones(n), np.zeros((n, 2))
    steps[group[first]], origins[group[first]] = step, origin
    flat = np.ones(n, bool)  # shapes without extent or with unknown corners have no area
    flat[group[first]] = ~(np.isfinite(wide) & (wide > 0) & np.isfinite(origin).all(axis=1))
    where = ~flat[group]
    grid = np.zeros(points.shape, np.int64)
    grid[where] = np.rint((points[where] - origins[group[where]]) / steps[group[where], None]).astype(np.int64)
    sides = np.hstack([grid, grid[_neighbours(sizes)[1]]])
    real = (sides[:, :2] != sides[:, 2:]).any(axis=1)
    edges, flips, group = _edges(*_pieces(sides[real], np.repeat(owner, sizes)[real], group[real]))
    if not len(edges):
        return _Shapes.none(n)
    below = _below(edges, flips, group)
    above = below ^ flips
    test = {"union": lambda x: x[:, 0] | x[:, 1], "intersection": lambda x: x[:, 0] & x[:, 1], "difference": lambda x: x[:, 0] & ~x[:, 1]}[kind]
    before, after = test(below), test(above)
    upright = edges[:, 0] == edges[:, 2]
    kept = before != after
    # left of an edge that runs right is above, left of one that runs up is its left side
    forward = np.where(upright, before, after)[kept]
    directed = np.where(forward[:, None], edges[kept], edges[kept][:, [2, 3, 0, 1]])
    (points, sizes), group = _loops(directed, group[kept])
    points, sizes, group = _straightened(points, sizes, group)
    signed = _signed(points, sizes)
    outer = np.flatnonzero(signed > 0)
    outer = outer[np.lexsort((-outer, -signed[outer], group[outer]))]
    polygon = np.full(len(sizes), -1)
    polygon[outer] = np.arange(len(outer))
    starts = np.cumsum(sizes) - sizes
    for hole in np.flatnonzero(signed < 0):
        middle = points[starts[hole]] + points[starts[hole] + 1]
        own = outer[np.searchsorted(group[outer], group[hole], "left"): np.searchsorted(group[outer], group[hole], "right")]
        for k in own[signed[own] > -signed[hole]][::-1]:  # the smallest ring around it
            if _holds(points[starts[k]: starts[k] + sizes[k]], int(middle[0]), int(middle[1])):
                polygon[hole] = polygon[k]
                break
    placed = np.flatnonzero(polygon >= 0)
    placed = placed[np.lexsort((placed, signed[placed] < 0, polygon[placed]))]
    points, sizes = _picked(points, sizes, placed)
    stops = np.cumsum(sizes)
    closed = np.insert(points, stops, points[stops - sizes], axis=0)
    group, sizes = group[placed], sizes + 1
    scale = np.repeat(group, sizes)
    return _Shapes(closed * steps[scale, None] + origins[scale], sizes, np.bincount(polygon[placed], minlength=len(outer)),
                   np.bincount(group[np.flatnonzero(signed[placed] > 0)], minlength=n))


def _all(points: np.ndarray, sizes: np.ndarray, pair: np.ndarray, owner: np.ndarray, n: int, kind: str) -> _Shapes:
    """``_overlaid`` for any number of pairs, about ``_TOGETHER`` corners at a time."""
    corners = np.cumsum(np.bincount(pair, sizes, minlength=n)) if n else np.zeros(0)
    out, start, ring, point = [_Shapes.none(0)], 0, 0, 0
    while start < n:
        base = corners[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(corners, base + _TOGETHER, "right")))
        last = int(np.searchsorted(pair, stop, "left"))
        upto = point + int(sizes[ring:last].sum())
        out.append(_overlaid(points[point:upto], sizes[ring:last], pair[ring:last] - start, owner[ring:last], stop - start, kind))
        start, ring, point = stop, last, upto
    return _Shapes.joined(out)


def _given(shapes: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, sizes and shape numbers of the rings of shapes, each a list of flat rings."""
    rings_ = [(np.asarray(ring, float).reshape(-1, 2), k) for k, shape in enumerate(shapes) for ring in shape]
    return (np.concatenate([np.zeros((0, 2)), *[ring for ring, _ in rings_]]), np.array([len(ring) for ring, _ in rings_], np.int64),
            np.array([k for _, k in rings_], np.int64))


def combine_many(pairs: list[tuple[list, list]], kind: str) -> list[list[list[np.ndarray]]]:
    """``combine`` of every pair, many at a time."""
    points, sizes, number = _given([shape for pair in pairs for shape in pair])
    found = _all(points, sizes, number // 2, number % 2, len(pairs), kind)
    loops = np.split(found.points, np.cumsum(found.sizes)[:-1]) if len(found.sizes) else []
    polygons, at = [], 0
    for n in found.rings.tolist():
        polygons.append(loops[at: at + n])
        at += n
    stops = np.cumsum(found.polygons).tolist()
    return [polygons[stop - n: stop] for stop, n in zip(stops, found.polygons.tolist())]


def combine(a: list, b: list, kind: str) -> list[list[np.ndarray]]:
    """Polygons of the union, intersection or difference of two shapes, each a list of flat rings read by the even-odd rule.

    A polygon is its outer ring, anticlockwise, and its holes, clockwise, all closed; polygons that
    touch in a corner stay apart, and a hole that touches its outer ring is a hole. Largest first.
    """
    return combine_many([(a, b)], kind)[0]


def _read(shapes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, points per ring and shape per ring of a column of flat rings."""
    count = pc.fill_null(pc.list_value_length(shapes), 0).to_numpy(zero_copy_only=False)
    loops = shapes.flatten()
    sizes = pc.fill_null(pc.list_value_length(loops), 0).to_numpy(zero_copy_only=False) // 2
    values = pc.fill_null(loops.flatten(), math.nan).to_numpy(zero_copy_only=False)
    return values.reshape(-1, 2), sizes.astype(np.int64), np.repeat(np.arange(len(shapes)), count)


def _lists(sizes: np.ndarray, values: pa.Array, absent: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if absent is None else pa.array(absent))


def _column(kind: str):
    @F.arrow_udf(_POLYGONS)
    def overlaid(a: pa.Array, b: pa.Array) -> pa.Array:
        (p, size_p, row_p), (q, size_q, row_q) = _read(a), _read(b)
        row, owner = np.concatenate([row_p, row_q]), np.repeat([0, 1], [len(row_p), len(row_q)])
        order = np.lexsort((owner, row))
        points, sizes = _picked(np.concatenate([p, q]), np.concatenate([size_p, size_q]), order)
        found = _all(points, sizes, row[order], owner[order], len(a), kind)
        corners = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found.points[:, k])) for k in (0, 1)], ["x", "y"])
        absent = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return _lists(found.polygons, _lists(found.rings, _lists(found.sizes, corners)), absent)

    return overlaid


_UNION, _INTERSECTION, _DIFFERENCE = map(_column, ("union", "intersection", "difference"))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _united(groups: pa.Array) -> pa.Array:
    """The flat rings of the union of every row's shapes: neighbours first, then the unions of neighbours, until one is left."""
    own = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(groups)), own)  # of each shape
    points, sizes, shape = _read(groups.flatten())
    while (np.diff(group) == 0).any():
        place = np.arange(len(group)) - np.searchsorted(group, group, "left")
        pair = np.cumsum(place % 2 == 0) - 1
        found = _all(points, sizes, pair[shape], place[shape] % 2, int(pair[-1]) + 1, "union")
        group = group[place % 2 == 0]
        points, sizes = found.points, found.sizes
        shape = np.repeat(np.repeat(np.arange(len(group)), found.polygons), found.rings)
    return _lists(np.bincount(shape, minlength=len(groups)), _lists(2 * sizes, pa.array(points.ravel())))


def union(a: Column, b: Column) -> Column:
    """array<polygon>: the united shapes (rings, or the flattened rings of several polygons); null if one is null."""
    return _UNION(_flat(a), _flat(b))


def intersection(a: Column, b: Column) -> Column:
    """array<polygon>: the common part of two shapes, of any form and with holes."""
    return _INTERSECTION(_flat(a), _flat(b))


def difference(a: Column, b: Column) -> Column:
    """array<polygon>: what of ``a`` lies outside ``b``."""
    return _DIFFERENCE(_flat(a), _flat(b))


def area(polygons: Column) -> Column:
    """Area of an array of polygons, in the JVM."""
    return F.aggregate(F.transform(polygons, rings.area), F.lit(0.0), lambda s, x: s + x)


def perimeter(polygons: Column) -> Column:
    """Length of all outer rings and holes."""
    length = lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) ** 2 + (s["b"]["y"] - s["a"]["y"]) ** 2)
    return F.aggregate(F.transform(rings.sides(F.flatten(polygons)), length), F.lit(0.0), lambda s, x: s + x)


def dissolve(shapes: DataFrame, keys: list[str], shape: str, cell: float = 64.0, together: int = 32) -> DataFrame:
    """(keys, polygons): the union of all shapes of a key, as a tree of partial unions.

    Shapes of a key are united within the cell of their first corner, at most about ``together`` at
    a time, then within cells ``_WIDER`` times as wide, and so on until a key has one row: neighbours unite
    first, inner sides vanish early, and the shapes of one key are spread over tasks in every round but the last.
    Keys of one shape are set aside at once; rounds are for the others.
    """
    corner = F.col(shape)[0][0]
    given = shapes.where(F.size(shape) > 0).select(*keys, F.floor(corner["x"] / cell).alias("_cx"), F.floor(corner["y"] / cell).alias("_cy"), F.col(shape).alias("_rings"))
    place = [*keys, "_cx", "_cy"]
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]

    given = cut_lineage(given.withColumn("_rings", _flat(F.col("_rings"))).distinct())  # equal shapes are one
    several = given.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    several = cut_lineage(several)
    current = cut_lineage(given.alias("c").join(several.alias("s"), same("c", "s", keys), "left_semi"))
    alone = given.alias("c").join(several.alias("s"), same("c", "s", keys), "left_anti").select(*keys, "_rings")
    lowest = current.agg(F.min("_cx"), F.min("_cy")).first()
    if lowest[0] is not None:
        current = current.withColumns({c: F.col(c) - low for c, low in zip(("_cx", "_cy"), lowest)})
    while True:
        sized = current.groupBy(*place).agg(F.count("*").alias("_n"))
        most, places, wholes = sized.agg(F.max("_n"), F.count("*"), F.count_distinct(F.struct(F.lit(0), *keys))).first()
        if places and most > 1:
            parts = F.ceil(F.col("_n") / together).cast("int")
            counted = current.alias("c").join(sized.alias("s"), same("c", "s", place)).select("c.*", "s._n")
            many = (counted.where("_n > 1").withColumn("_part", F.pmod(F.xxhash64("_rings"), parts)).groupBy(*place, "_part")
                    .agg(F.sort_array(F.collect_list("_rings")).alias("_many")).select(*place, _united("_many").alias("_rings")))
            current = cut_lineage(counted.where("_n = 1").drop("_n").unionByName(many))
            if most > together:
                continue
        if places == wholes:
            break
        current = current.withColumns({c: F.floor(F.col(c) / _WIDER) for c in ("_cx", "_cy")})
    whole = alone.unionByName(current.select(*keys, "_rings"))
    return cut_lineage(whole.select(*keys, _UNION("_rings", "_rings").alias("polygons")))


def _capsule(side: Column, distance: float, quarter: int) -> Column:
    """Flat ring round a side: half a circle of ``2 * quarter`` steps about either end."""
    a, b = side["a"], side["b"]
    normal = F.atan2(b["y"] - a["y"], b["x"] - a["x"]) - math.pi / 2
    steps = F.sequence(F.lit(0), F.lit(2 * quarter))

    def half(centre: Column, turn: float) -> Column:
        def point(i: Column) -> Column:
            angle = normal + turn + i * (math.pi / (2 * quarter))
            return F.struct((centre["x"] + distance * F.cos(angle)).alias("x"), (centre["y"] + distance * F.sin(angle)).alias("y"))
        return F.transform(steps, point)

    return rings.let(F.concat(half(b, 0.0), half(a, math.pi)), lambda line: F.concat(line, F.slice(line, 1, 1)))


def offset(shapes: DataFrame, keys: list[str], shape: str, distance: float, quarter: int = 16) -> DataFrame:
    """(keys, polygons): every shape grown by ``distance`` with round corners, or shrunk if it is negative; one row per key.

    A circle swept along the outline is the union of a capsule per side, and that union is a ``dissolve``: sides of
    one shape spread over tasks, and outlines that cross themselves or close a notch come out clean. The band is
    then united with the shape or taken off it. A quarter of a circle has ``quarter`` steps. A shape that vanishes has no polygons; a null or empty shape stays empty.
    """
    whole = shapes.select(*keys, F.col(shape).alias("_shape"))
    if not distance:
        return whole.select(*keys, F.coalesce(union(F.col("_shape"), F.col("_shape")), F.array()).alias("polygons"))
    side = whole.select(*keys, F.explode(rings.sides(F.col("_shape"))).alias("_s")).where("_s.a <> _s.b")
    band = dissolve(side.select(*keys, F.array(_capsule(F.col("_s"), abs(distance), quarter)).alias("_c")), keys, "_c")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = whole.alias("w").join(band.alias("b"), same, "left").select(*[F.col(f"w.{k}").alias(k) for k in keys], "_shape", F.flatten("polygons").alias("_band"))
    made = union if distance > 0 else difference
    return met.select(*keys, F.coalesce(made(F.col("_shape"), F.col("_band")), F.array()).alias("polygons"))
