"""Probabilities, class scores and their losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from arborscan.functions.rings import let


def softmax(scores: Column) -> Column:
    """Class probabilities of a score array, shifted by its maximum for stability."""

    def normalise(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda s: F.transform(e, lambda v: v / s))

    top = F.array_max(scores)
    return let(top, lambda m: let(F.transform(scores, lambda v: F.exp(v - m)), normalise))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x: Column, target: Column) -> Column:
    """Binary cross entropy of one logit, in the form that cannot overflow."""
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def bce(p: Column, target: Column) -> Column:
    """Binary cross entropy of one probability; logarithms are limited to -100."""
    log = lambda v: F.when(v > 0, F.greatest(F.log(F.nullif(v, F.lit(0.0))), F.lit(-100.0))).otherwise(F.lit(-100.0))
    return -(target * log(p) + (F.lit(1.0) - target) * log(F.lit(1.0) - p))


def bootstrapped_target(x: Column, target: Column, beta: float = 0.95) -> Column:
    return beta * target + (1.0 - beta) * sigmoid(x)
