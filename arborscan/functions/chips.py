"""Neighbourhood operations on one chip: a row-major ``cells`` array with width ``w`` and height ``h``.

A chip is a fixed-size window, so these run map-side without a shuffle. Square kernels
are separable: a pass along the rows, a transpose, the same pass again. Cells outside the
chip do not take part; null cells stay null and are ignored by minima and maxima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from arborscan.functions.rings import let

Fold = Callable[[Column], Column]


def _at(cells: Column, index: Column) -> Column:
    return F.get(cells, index.cast("int"))


def transpose(cells: Column, w: Column, h: Column) -> Column:
    return let(cells, lambda c: F.transform(c, lambda _, i: _at(c, (i % h) * w + F.floor(i / h))))


def _along_rows(cells: Column, w: Column, radius: int, fold: Fold) -> Column:
    def over(c: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            row = i - i % w
            low = F.greatest(i - radius, row)
            high = F.least(i + radius, row + w - 1)
            return F.when(v.isNotNull(), fold(F.slice(c, low + 1, high - low + 1)))

        return F.transform(c, one)

    return let(cells, over)


def window(cells: Column, w: Column, h: Column, radius: int, fold: Fold) -> Column:
    """Fold over the square window of every cell; ``fold`` must be separable."""
    turned = transpose(_along_rows(cells, w, radius, fold), w, h)
    return transpose(_along_rows(turned, h, radius, fold), h, w)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def erode(cells: Column, w: Column, h: Column, size: int) -> Column:
    return window(cells, w, h, size // 2, F.array_min)


def dilate(cells: Column, w: Column, h: Column, size: int) -> Column:
    return window(cells, w, h, size // 2, F.array_max)


def close(cells: Column, w: Column, h: Column, size: int) -> Column:
    return erode(dilate(cells, w, h, size), w, h, size)


def erode3_close5(cells: Column, w: Column, h: Column) -> Column:
    """Clean-up of a scored window."""
    return close(erode(cells, w, h, 3), w, h, 5)


def close5_dilate3(cells: Column, w: Column, h: Column) -> Column:
    """Clean-up of a cloud probability raster."""
    return dilate(close(cells, w, h, 5), w, h, 3)


CLOUD_REACH = 5  # cells one output cell of close5_dilate3 depends on


def _mirror(i: Column, n: Column) -> Column:
    """Reflection without repeating the border cell."""
    j = F.abs(i)
    return F.when(j < n, j).otherwise(2 * (n - 1) - j)


def pad_mirrored(cells: Column, w: Column, h: Column, radius: int) -> Column:
    wide = w + 2 * radius
    index = F.sequence(F.lit(0), (wide * (h + 2 * radius) - 1).cast("int"))
    return F.transform(index, lambda i: _at(cells, _mirror(F.floor(i / wide) - radius, h) * w + _mirror(i % wide - radius, w)))


def crop(cells: Column, w: Column, radius_x: int, radius_y: int | None = None) -> Column:
    """Interior of a chip of width ``w``."""
    radius_y = radius_x if radius_y is None else radius_y

    def inner(c: Column) -> Column:
        rows = F.size(c) / w
        return F.filter(c, lambda _, i: (i % w).between(radius_x, w - radius_x - 1)
                        & F.floor(i / w).between(radius_y, rows - radius_y - 1))

    return let(cells, inner)


def laplacian_sharpen(cells: Column, w: Column, h: Column) -> Column:
    """v minus the 8-neighbour Laplacian, limited to 0..255; borders are mirrored."""

    def sharpen(c: Column) -> Column:
        boxes = crop(window(pad_mirrored(c, w, h, 1), w + 2, h + 2, 1, total), w + 2, 1)
        return F.zip_with(c, boxes, lambda v, s: F.least(F.greatest(10 * v - s, F.lit(0.0)), F.lit(255.0)))

    return let(cells, sharpen)


def resample(cells: Column, w: Column, h: Column, up: int, down: int = 1) -> Column:
    """Nearest cell on a grid ``up / down`` times as dense."""
    wide, high = F.floor(w * up / down), F.floor(h * up / down)
    index = F.sequence(F.lit(0), (wide * high - 1).cast("int"))
    return F.transform(index, lambda i: _at(cells, F.floor(F.floor(i / wide) * down / up) * w + F.floor((i % wide) * down / up)))


def inset_count(cells: Column, w: Column, inset: int) -> Column:
    """Non-zero cells at least ``inset`` cells away from the border."""
    return F.size(F.filter(crop(cells, w, inset), lambda v: v != 0))


def nonzero(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda v: v != 0))


def remap(cells: Column, w: Column, h: Column, source: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """New chip of the same size whose cell (x, y) comes from ``source(x, y)``."""

    def pick(_, i: Column) -> Column:
        sx, sy = source(i % w, F.floor(i / w))
        return _at(cells, sy * w + sx)

    return F.transform(cells, pick)
