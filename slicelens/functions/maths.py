"""Numeric and array column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(value: Column, low, high) -> Column:
    """Bound a value; NULL stays NULL."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def ratio(up: Column, down: Column) -> Column:
    """Division that is 0 when undefined."""
    return F.coalesce(F.try_divide(up, down), F.lit(0.0))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)) - F.lit(1)


def one_hot(label: Column, classes) -> list[Column]:
    return [(label == F.lit(c)).cast("bigint").alias(f"is_{c}") for c in classes]


def cosine_rate(step: Column, steps: Column, start: float, floor: float) -> Column:
    """Cosine-annealed learning rate after ``step`` of ``steps``."""
    swing = (F.lit(1.0) + F.cos(F.lit(math.pi) * step / steps)) / 2
    return F.lit(floor) + F.lit(start - floor) * swing


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch of a timestamp column of either kind."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)
