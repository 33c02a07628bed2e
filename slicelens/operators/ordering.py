"""Exact running totals and positions without putting a whole group in one task.

A group is cut into ordered buckets. Bucket totals are tiny, so their running
sum is cheap; inside a bucket an ordinary window adds the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicelens.operators.joins import stage


BUCKET_ROWS = 1 << 20


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_buckets(df: DataFrame, order: list[Column], bucket: str = "bucket") -> DataFrame:
    """Number contiguous key ranges of similar size, in ``order``.

    Spark samples the keys for the range bounds, so the buckets follow the
    data; there are as many as shuffle partitions. The result is staged, which
    freezes the numbering.
    """
    n = task_count(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn(bucket, F.spark_partition_id())
    return stage(ranged, "ranges")


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[Column],
    measures: list[str],
) -> DataFrame:
    """Add ``<m>_cum``, the sum of ``m`` up to and including each row of its group.

    Rows of one group must be ordered first by ``bucket``, then by ``order``.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.join(offsets, keys + [bucket]).select(
        *df.columns,
        *[(F.col(f"_{m}") + F.sum(m).over(inside)).alias(f"{m}_cum") for m in measures],
    )


def ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the one-based rank of every row in its group, by ``order``.

    Groups and rows are cut into ranges at sampled splitters; a range counts its
    own rows and starts at the number of rows in the group's earlier ranges.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranged = range_buckets(one, [*[F.col(k) for k in keys], *order], "_range")
    ranked = running_totals(ranged, keys, "_range", order, ["_one"])
    return ranked.withColumnRenamed("_one_cum", name).drop("_range", "_one")


def shuffle_key(identity: Column | list[Column], seed) -> Column:
    """A seeded random-looking sort key: the md5 of ``identity:seed``.

    It depends on the row alone, so any partitioning gives the same order.
    """
    parts = identity if isinstance(identity, list) else [identity]
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], seed.cast("string")))


def hash_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits of a hash key: ordered buckets of even size."""
    return F.substring(key, 1, digits)


def bucket_digits(rows: int) -> int:
    """Hex digits that keep a bucket of evenly spread keys near ``BUCKET_ROWS``."""
    return max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))


def positions(
    df: DataFrame, keys: list[str], key: str, name: str = "position", rows: int | None = None
) -> DataFrame:
    """One-based rank of every row by a hash key, per group."""
    digits = bucket_digits(df.count() if rows is None else rows)
    marked = df.withColumn("_bucket", hash_bucket(F.col(key), digits)).withColumn(
        "_one", F.lit(1).cast("bigint")
    )
    ranked = running_totals(marked, keys, "_bucket", [F.col(key)], ["_one"])
    return ranked.withColumnRenamed("_one_cum", name).drop("_bucket", "_one")
