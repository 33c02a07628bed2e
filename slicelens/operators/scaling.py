"""Feature scaling and label encoding."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelens.functions.maths import clip
from slicelens.operators.joins import attach
from slicelens.operators.ordering import range_buckets, running_totals


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column, applied as literals."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns) -> "Scaler":
        columns = list(columns)
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return cls({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)})

    def column(self, name: str) -> Column:
        mean, deviation = self.stats[name]
        return (F.col(name) - F.lit(mean)) / F.lit(deviation or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.stats})


def standardize(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0.

    ``fit_on`` takes the statistics from other rows, such as the train part.
    """
    return Scaler.fit(df if fit_on is None else fit_on, columns).transform(df)


def angle_clip(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), -math.pi, math.pi) for c in columns})


def value_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their zero-based sorted position."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    marked = range_buckets(values, [F.col(column)]).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(marked, [], "bucket", [F.col(column)], ["_one"])
    return ranked.select(column, (F.col("_one_cum") - 1).alias(f"{column}_index"))


def label_encode(df: DataFrame, columns=None) -> DataFrame:
    """Replace string columns by the index of their value in sorted order."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for column in strings if columns is None else columns:
        encoded = attach(df, value_index(df, column), [column], how="left")
        df = encoded.select(
            *[F.col(f"{c}_index").alias(c) if c == column else c for c in df.columns]
        )
    return df


def binary_label(label: Column) -> Column:
    return F.when(label == 0, -1.0).otherwise(1.0)


def first_features(df: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` columns and the last one, which is the label."""
    names = df.columns
    return df.select(*names[:-1][:n], names[-1])
