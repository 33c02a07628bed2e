"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import threading
from collections.abc import Callable, Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicelens.operators.joins import scratch_path
from slicelens.operators.ordering import task_count

#: A word: a run of anything but space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


_scopes = threading.local()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    The open ``scratch`` removes it; without one it goes when the application ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in getattr(_scopes, "open", [])[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, in whatever store they are."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for name in _scopes.open.pop():
            _removed(spark, name)


def _removed(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Remove a table staged in the open ``scratch`` that nothing reads any more."""
    files = df.inputFiles()
    for paths in getattr(_scopes, "open", [])[-1:]:
        for name in [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in files)]:
            paths.remove(name)
            _removed(df.sparkSession, name)


def discard(df: DataFrame) -> None:
    """Remove a table staged outside any ``scratch`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _removed(df.sparkSession, folder)


def contained(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The table is staged when made, and what was staged on the way is removed.

    For tables that are small beside what they are made from.
    """

    @functools.wraps(make)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        outer = getattr(_scopes, "open", [])[-1:]
        with scratch(df.sparkSession):
            out = stage(make(df, *args, **kwargs), make.__name__)
            kept = _scopes.open[-1].pop()
        for paths in outer:
            paths.append(kept)
        return out

    return run


def release() -> None:
    """Give freed memory of a Python worker back, for the JVM beside it and the stages to come."""
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def released(parts: Iterator) -> Iterator:
    """The same parts; memory is given back at the end."""
    try:
        yield from parts
    finally:
        release()


def one(make: Callable, **settled) -> Callable:
    """``make`` as a function of one table, or of batches, the rest settled."""

    def run(rows):
        out = make(rows, **settled)
        return released(out) if isinstance(out, Iterator) else out

    return run


def two(make: Callable, **settled) -> Callable:
    """``make`` as a function of two tables, the rest settled."""
    return lambda left, right: make(left, right, **settled)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(identity: Column) -> Column:
    """Fold 0 to 4 of a row, from its id alone; fold 0 is held out (a null id counts as empty)."""
    return F.crc32(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")) % 5


def by_range(df: DataFrame, order: list[Column], bucket: str) -> DataFrame:
    """Number contiguous ranges of ``order``; the staged copy freezes the numbering."""
    n = task_count(df.sparkSession)
    return stage(
        df.repartitionByRange(n, *order).withColumn(bucket, F.spark_partition_id()), bucket
    )


def running(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], measures: list[str]
) -> DataFrame:
    """Add ``<m>_before``, the sum of ``m`` over the rows of the group that come earlier.

    Rows are ordered by ``bucket``, then ``order``. Only one row a group and
    bucket meets in the window over buckets; no group is gathered in one task.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col(bucket).alias("_o_bucket"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    same = F.col(bucket) == F.col("_o_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return df.join(offsets, same).select(
        *df.columns,
        *[
            (F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
    )
