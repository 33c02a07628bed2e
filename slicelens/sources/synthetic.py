"""Class-conditional synthetic feature rows, used when real captures fall short."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.functions.maths import clip
from slicelens.settings import CLASSES, FEATURES, LABEL, SYNTHETIC_BOUNDS, SYNTHETIC_NORMALS


def _uniform(digest: Column, part: int) -> Column:
    """A number in (0, 1) from one quarter of a hash."""
    whole = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint")
    return (whole + 1) / F.lit(4294967297.0)


def _normal(identity: Column, number: int, seed: int) -> Column:
    """The ``number``-th repeatable normal of a row.

    A hash gives four uniforms; the Box-Muller transform makes two normals of two.
    """
    digest = F.md5(F.concat_ws(":", identity.cast("string"), F.lit(str(number // 4)), F.lit(str(seed))))
    pair = number // 2 % 2 * 2
    radius = F.sqrt(-2.0 * F.ln(_uniform(digest, pair)))
    angle = 2.0 * math.pi * _uniform(digest, pair + 1)
    return radius * (F.cos(angle) if number % 2 == 0 else F.sin(angle))


def synthetic_rows(
    ids: DataFrame, label: Column, bounds=SYNTHETIC_BOUNDS, seed: int = 42
) -> DataFrame:
    """Eight clipped normals per ``id`` around the means of its class."""

    def parameter(feature: int, which: int) -> Column:
        value = F.lit(None).cast("double")
        for c in CLASSES:
            chosen = F.lit(float(SYNTHETIC_NORMALS[c][feature][which]))
            value = F.when(F.col(LABEL) == c, chosen).otherwise(value)
        return value

    made = [
        clip(parameter(i, 0) + parameter(i, 1) * _normal(F.col("id"), i, seed), *bounds[i]).alias(name)
        for i, name in enumerate(FEATURES)
    ]
    return ids.withColumn(LABEL, label).select("id", *made, LABEL)


def or_synthetic(features: DataFrame, rows: int, bounds=SYNTHETIC_BOUNDS) -> tuple[DataFrame, bool]:
    """The given windows, or ``rows`` synthetic ones if any class is missing."""
    if features.agg(F.count_distinct(LABEL)).first()[0] >= len(CLASSES):
        return features, False
    per_class = rows // len(CLASSES)
    ids = features.sparkSession.range(per_class * len(CLASSES))
    label = F.floor(F.col("id") / per_class)
    return synthetic_rows(ids, label, bounds), True
