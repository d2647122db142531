"""Losses and metrics over masked rows, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_mean(value: Column, valid: Column) -> Column:
    """Sum of the valid values over their number, which counts as at least 1."""
    return F.coalesce(F.sum(F.when(valid, value)), F.lit(0.0)) / F.greatest(F.count_if(valid), F.lit(1))


def accuracy(predicted: Column, label: Column) -> Column:
    """Share of right predictions among labels >= 0; 0 if there are none."""
    return F.coalesce(F.avg(F.when(label >= 0, (predicted == label).cast("double"))), F.lit(0.0))


def smooth_l1(difference: Column) -> Column:
    """Half the square below 1, beyond that the distance less a half."""
    a = F.abs(difference)
    return F.when(a < 1, 0.5 * a * a).otherwise(a - 0.5)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log of the label's softmax share; null for negative labels."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(label >= 0, top + F.ln(total) - F.get(logits, label))


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def axis_loss(cosine: Column) -> Column:
    return 1 - F.abs(cosine)


def weighted_total(seg: Column, axis: Column, origin: Column, kind: Column, valid: Column, limits: Column) -> Column:
    """The terms' sum with weights 1, 1, 1 and three halves."""
    return seg + axis + origin + 0.5 * kind + 0.5 * valid + 0.5 * limits


def gates(accuracy: Column, axis_degrees: Column, origin_mm: Column) -> Column:
    """Whether accuracy, axis and origin errors pass: 95 %, 2 degrees, 5 mm."""
    return (accuracy >= 0.95) & (axis_degrees < 2) & (origin_mm < 5)
