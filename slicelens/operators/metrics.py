"""Evaluation tables from a long prediction table ``model, y_true, y_pred``.

Everything after the confusion counts works on a handful of rows per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicelens.functions.maths import ratio
from slicelens.settings import CLASSES, CLASS_WEIGHTS


def join_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pair truth and per-model predictions by ``sample_id``, never by position."""
    return predictions.join(truth, "sample_id")


def confusion_matrix(pred: DataFrame, classes=CLASSES) -> DataFrame:
    """Counts per (model, true, predicted), empty cells included."""
    cells = pred.groupBy("model", "y_true", "y_pred").agg(F.count("*").alias("n"))
    side = F.array(*[F.lit(c).cast("bigint") for c in classes])
    empty = (
        cells.select("model").distinct()
        .withColumn("y_true", F.explode(side))
        .withColumn("y_pred", F.explode(side))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    return (
        cells.unionByName(empty).groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    )


def confusion_pct(cells: DataFrame) -> DataFrame:
    """Row-normalised percentages; a class without samples gives NULL."""
    row = F.sum("n").over(Window.partitionBy("model", "y_true"))
    return cells.select("model", "y_true", "y_pred", F.try_divide(100.0 * F.col("n"), row).alias("pct"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    )


def per_class_prf(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(none)
    as_true = cells.select(
        "model", F.col("y_true").alias("cls"), F.col("n").alias("support"),
        none.alias("predicted"), hit.alias("tp"),
    )
    as_pred = cells.select(
        "model", F.col("y_pred").alias("cls"), none.alias("support"),
        F.col("n").alias("predicted"), none.alias("tp"),
    )
    return (
        as_true.unionByName(as_pred)
        .groupBy("model", "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .select(
            "model", "cls",
            ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
            "support",
        )
    )


def macro_prf(per_class: DataFrame) -> DataFrame:
    """Unweighted class means; macro F1 is the mean of the F1 values."""
    return per_class.groupBy("model").agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """Per-class rows, accuracy, macro and support-weighted averages per model."""
    per_class = per_class_prf(cells)
    parts = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")

    def rows(name, df):
        return df.select("model", F.lit(name).alias("entry"), *parts, "support")

    hits = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    overall = cells.groupBy("model").agg(
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        ratio(hits, F.sum("n")).alias("f1"),
        F.sum("n").alias("support"),
    )
    macro = per_class.groupBy("model").agg(*[F.avg(c).alias(c) for c in parts], support)
    weighted = per_class.groupBy("model").agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in parts],
        support,
    )
    return (
        per_class.select("model", F.col("cls").cast("string").alias("entry"), *parts, "support")
        .unionByName(rows("accuracy", overall))
        .unionByName(rows("macro avg", macro))
        .unionByName(rows("weighted avg", weighted))
    )


def model_comparison(pred: DataFrame, classes=CLASSES) -> DataFrame:
    """One row per model: accuracy and macro scores in percent, from one pass."""
    cells = confusion_matrix(pred, classes)
    report = classification_report(cells)
    pick = lambda entry, c: F.max(F.when(F.col("entry") == entry, F.col(c))) * 100
    return report.groupBy("model").agg(
        pick("accuracy", "f1").alias("accuracy"),
        *[pick("macro avg", c).alias(c) for c in ("precision", "recall", "f1")],
    )


def class_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASS_WEIGHTS.items()), "y_true bigint, weight double")


def weighted_log_loss(pred: DataFrame, weighted: bool = True) -> DataFrame:
    """Cross entropy of ``p`` (class probabilities) per model, class-weighted or plain."""
    if weighted:
        pred = pred.join(F.broadcast(class_weights(pred.sparkSession)), "y_true")
    else:
        pred = pred.withColumn("weight", F.lit(1.0))
    loss = -F.ln(F.element_at("p", (F.col("y_true") + 1).cast("int")))
    return pred.groupBy("model").agg(
        (F.sum(F.col("weight") * loss) / F.sum("weight")).alias("log_loss")
    )


def squared_loss(df: DataFrame, predicted: str, target: str, by: list[str]) -> DataFrame:
    error = F.col(predicted) - F.col(target)
    return df.groupBy(*by).agg(F.avg(error * error).alias("squared_loss"))
