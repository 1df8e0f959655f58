"""Applying a trained scorer to chips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# model(batch of chips, each bands x h x w) -> probabilities, each h x w
Model = Callable[[list[np.ndarray]], list[np.ndarray]]


def mean_drop(batch: list[np.ndarray]) -> list[np.ndarray]:
    """Deterministic stand-in scorer: mean relative loss from the previous to the current image.

    The stack holds three images of equal depth: difference, current, previous.
    """
    out = []
    for chip in batch:
        depth = chip.shape[0] // 3
        current, previous = chip[depth:2 * depth].mean(axis=0), chip[2 * depth:].mean(axis=0)
        out.append(np.clip((previous - current) / np.maximum(previous, 1.0) + 0.5, 0.0, 1.0))
    return out


def score_with_models(chips: DataFrame, models: dict[str, Callable[[], Model]], stack: str = "stack",
                      batch: int = 64) -> DataFrame:
    """A probability grid ``cells`` per chip and configured model, tagged with its name in ``model``.

    ``stack`` is array<array<double>> (bands of row-major cells) beside ``w`` and ``h``. Each
    loader runs once per Python task, so weights are read from the cluster's own storage rather
    than shipped with every row; all models see a chip's stack in one pass.
    """
    others = [f for f in chips.schema.fields if f.name != stack]
    schema = T.StructType([*others, T.StructField("cells", T.ArrayType(T.DoubleType())), T.StructField("model", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {name: load() for name, load in models.items()}
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                tensors = [np.stack([np.asarray(b, dtype=float) for b in bands]).reshape(len(bands), int(h), int(w))
                           for bands, w, h in zip(part[stack], part["w"], part["h"])]
                for name, model in loaded.items():
                    grids = [np.asarray(g, dtype=float).ravel().tolist() for g in model(tensors)]
                    yield part.drop(columns=stack).assign(cells=grids, model=name)[schema.names]

    return chips.select(*[f.name for f in others], stack).mapInPandas(run, schema)


def score_chips(chips: DataFrame, load_model: Callable[[], Model] = lambda: mean_drop, stack: str = "stack") -> DataFrame:
    """Replace the band stack of each chip by the probability grid ``cells`` of one model."""
    return score_with_models(chips, {"": load_model}, stack).drop("model")
