"""Chip-bounded operations that walk over pixels: numpy inside Arrow batches, one chip per value.

The flood, the chamfer pass and labelling depend on the order in which cells of one chip
are visited, which no join or window expresses. A chip is a fixed-size window, so the
working set of a task stays one batch of chips.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

def _per_chip(df: DataFrame, inputs: list[str], output: str, kind: T.DataType, fn) -> DataFrame:
    """Add ``output`` computed from the named array columns, one Arrow batch of chips at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(kind))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{output: fn(*[frame[c] for c in inputs])})[schema.names]

    return df.mapInPandas(run, schema)


STRAIGHT, DIAGONAL = 0.955, 1.3693  # fixed values: 3x3 chamfer weights for L2


def _grids(cells: pd.Series, w: pd.Series):
    for values, width in zip(cells, w):
        yield np.asarray(values, dtype=float).reshape(-1, int(width))


def label_grid(mask: np.ndarray) -> np.ndarray:
    """8-connected labels 1..n in scan order, 0 for background."""
    high, wide = mask.shape
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(np.where(mask, labels, mask.size + 1), 1, constant_values=mask.size + 1)
        best = np.min([padded[dy:dy + high, dx:dx + wide] for dy in range(3) for dx in range(3)], axis=0)
        fresh = np.where(mask, best, 0)
        if np.array_equal(fresh, labels):
            break
        labels = fresh
    found = np.unique(labels[labels > 0])
    return np.where(mask, np.searchsorted(found, labels) + 1, 0)


def label_cells(chips: DataFrame, cells: str, output: str = "label") -> DataFrame:
    """Component label of every non-zero cell of a chip (0 elsewhere; null cells count as 0)."""

    def labels(values: pd.Series, w: pd.Series) -> list:
        return [label_grid(np.nan_to_num(grid) > 0).ravel().astype(int).tolist() for grid in _grids(values, w)]

    return _per_chip(chips, [cells, "w"], output, T.IntegerType(), labels)


def chamfer_grid(mask: np.ndarray) -> np.ndarray:
    """Distance of every foreground cell to the background; unbounded without background.

    Two passes over rows, downward and upward. Within a row the least of what came from the row
    before and of a walk along the row is a running minimum.
    """
    high, wide = mask.shape
    d = np.where(mask, np.inf, 0.0)
    along = STRAIGHT * np.arange(wide)
    for step in (1, -1):
        before = np.full(wide + 2, np.inf)
        for y in range(high)[::step]:
            row = np.minimum(d[y], np.minimum(before[1:-1] + STRAIGHT, np.minimum(before[:-2], before[2:]) + DIAGONAL))
            row = np.minimum(row, np.minimum.accumulate(row - along) + along)
            row = np.minimum(row, (np.minimum.accumulate((row + along)[::-1]))[::-1] - along)
            d[y] = np.round(row, 9)
            before[1:-1] = d[y]
    return d


def distance_to_background(chips: DataFrame, mask: str, output: str = "distance") -> DataFrame:
    """Chamfer distance per chip, normalised to 0..1 (0 everywhere when flat)."""

    def distances(values: pd.Series, w: pd.Series) -> list:
        out = []
        for grid in _grids(values, w):
            d = chamfer_grid(grid > 0)
            d = np.where(np.isfinite(d), d, 0.0)
            low, span = d.min(), d.max() - d.min()
            out.append(((d - low) / span if span > 0 else np.zeros_like(d)).ravel().tolist())
        return out

    return _per_chip(chips, [mask, "w"], output, T.DoubleType(), distances)


def flood_grid(image: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Marker flood in order of grey-value steps; cells where two floods meet become -1."""
    high, wide = image.shape
    labels = seeds.copy()
    queue, order = [], 0
    queued = labels != 0

    def around(y, x):
        return [(y + dy, x + dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= y + dy < high and 0 <= x + dx < wide]

    for y, x in zip(*np.nonzero(labels)):
        for ny, nx in around(y, x):
            if not queued[ny, nx]:
                queued[ny, nx] = True
                heapq.heappush(queue, (abs(image[ny, nx] - image[y, x]), order, ny, nx))
                order += 1
    while queue:
        _, _, y, x = heapq.heappop(queue)
        near = {labels[p] for p in around(y, x) if labels[p] > 0}
        labels[y, x] = near.pop() if len(near) == 1 else -1
        if labels[y, x] < 0:
            continue
        for ny, nx in around(y, x):
            if not queued[ny, nx]:
                queued[ny, nx] = True
                heapq.heappush(queue, (abs(image[ny, nx] - image[y, x]), order, ny, nx))
                order += 1
    return labels


BACKGROUND = 255  # fixed value of the output


def flood(chips: DataFrame, image: str, seeds: str, output: str = "instance") -> DataFrame:
    """Instances of a chip: seed components flood the image beside a background seed.

    The background seed is the disc of radius 3 around (5, 5). It comes out as 255; seed
    components are numbered from 1 and pass over that number.
    """

    def instances(images: pd.Series, markers: pd.Series, w: pd.Series) -> list:
        out = []
        for grid, seed in zip(_grids(images, w), _grids(markers, w)):
            start = label_grid(seed > 0).astype(int)
            start[start >= BACKGROUND] += 1
            y, x = np.ogrid[:grid.shape[0], :grid.shape[1]]
            start[(x - 5) ** 2 + (y - 5) ** 2 <= 9] = BACKGROUND
            out.append(flood_grid(grid, start).ravel().astype(int).tolist())
        return out

    return _per_chip(chips, [image, seeds, "w"], output, T.IntegerType(), instances)
