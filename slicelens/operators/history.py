"""Training-history tables: one row per (run, epoch).

The windows below are per run, whose rows are its epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelens.functions.maths import cosine_rate
from slicelens.functions.text import duration_text
from slicelens.settings import FLOOR_RATE, LEARNING_RATE


def _so_far():
    frame = Window.partitionBy("run").orderBy("epoch")
    return frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def epoch_mean_loss(batches: DataFrame) -> DataFrame:
    """Loss and accuracy per epoch from batch ``loss``, ``n`` and ``correct``."""
    return batches.groupBy("run", "epoch").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("train_loss"),
        (F.sum("correct") / F.sum("n")).alias("train_acc"),
    )


def running_best(history: DataFrame) -> DataFrame:
    """Mark epochs whose validation accuracy equals the best so far."""
    return history.withColumn("is_best", F.col("val_acc") == F.max("val_acc").over(_so_far()))


def running_eta(history: DataFrame, epochs: int) -> DataFrame:
    """Mean epoch time so far times the epochs left, as seconds and as text."""
    eta = F.avg("epoch_sec").over(_so_far()) * (epochs - F.col("epoch"))
    return history.withColumn("eta_sec", eta).withColumn("eta", duration_text(F.col("eta_sec")))


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch of each run that reaches its maximum validation accuracy."""
    best = F.max(F.struct("val_acc", (-F.col("epoch")).alias("back"))).alias("best")
    return history.groupBy("run").agg(best).select(
        "run", (-F.col("best.back")).alias("best_epoch"), F.col("best.val_acc").alias("val_acc")
    )


def learning_rates(
    history: DataFrame, epochs, start: float = LEARNING_RATE, floor: float = FLOOR_RATE
) -> DataFrame:
    steps = epochs if not isinstance(epochs, int) else F.lit(epochs)
    return history.withColumn("lr", cosine_rate(F.col("epoch"), steps, start, floor))
