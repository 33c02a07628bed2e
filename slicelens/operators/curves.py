"""ROC curves, areas under them, and interpolation of one curve on another's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelens.functions.maths import ratio
from slicelens.operators.joins import attach
from slicelens.operators.ordering import range_buckets, running_totals, task_count

CURVE = ["model", "cls"]


def class_scores(pred: DataFrame, scores: str = "scores") -> DataFrame:
    """One row per (sample, class): score and whether that class is the truth."""
    return pred.select(
        "model", "y_true", F.posexplode(scores).alias("cls", "score")
    ).select(
        "model",
        F.col("cls").cast("bigint").alias("cls"),
        "score",
        (F.col("y_true") == F.col("cls")).alias("is_class"),
    )


def score_steps(scored: DataFrame) -> DataFrame:
    """Positives and negatives at every distinct score, in score-range buckets.

    Equal scores collapse before the shuffle; the rest is spread by score range,
    so one curve with many distinct scores uses many tasks.
    """
    counts = scored.groupBy(*CURVE, "score").agg(
        F.count_if("is_class").alias("pos"), F.count_if(~F.col("is_class")).alias("neg")
    )
    return range_buckets(counts, [F.col("model"), F.col("cls"), F.col("score").desc()])


def cumulative(steps: DataFrame) -> DataFrame:
    return running_totals(steps, CURVE, "bucket", [F.col("score").desc()], ["pos", "neg"])


def _with_next(steps: DataFrame, cumulated: DataFrame) -> DataFrame:
    """Add the counts of the next lower score, which may open the next bucket."""
    onward = Window.partitionBy(*CURVE).orderBy("bucket")
    inside = Window.partitionBy(*CURVE, "bucket").orderBy(F.desc("score"))
    heads = steps.groupBy(*CURVE, "bucket").agg(
        F.max_by(F.struct("pos", "neg"), "score").alias("head")
    )
    heads = heads.select(*CURVE, "bucket", F.lead("head").over(onward).alias("after"))
    following = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("after"))
    return cumulated.join(heads, CURVE + ["bucket"]).withColumn("next", following).drop("after")


def roc_curve(scored: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """Points of the one-vs-rest ROC per model and class, starting at (0, 0).

    ``drop_collinear`` removes an inner point when the next step has the same
    positives and negatives, i.e. when it lies on a straight line.
    """
    counted = score_steps(scored)
    totals = counted.groupBy(*CURVE).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    steps = cumulative(counted)
    if drop_collinear:
        first = (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))
        turns = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        steps = _with_next(counted, steps).filter(F.col("next").isNull() | first | turns)
    points = steps.select(
        *CURVE, "score", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp")
    )
    zero = F.lit(0).cast("bigint")
    origin = totals.select(
        *CURVE, F.lit(None).cast("double").alias("score"), zero.alias("tp"), zero.alias("fp")
    )
    return attach(points.unionByName(origin), totals, CURVE).select(
        *CURVE, "score", "tp", "fp",
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Trapezoid area per model and class, straight from the running totals."""
    strip = F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0)
    return cumulative(score_steps(scored)).groupBy(*CURVE).agg(
        ratio(F.sum(strip), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def interpolate(
    knots: DataFrame, grid: DataFrame, keys: list[str], bucket: Column
) -> DataFrame:
    """Linear interpolation of ``knots`` (keys, x, y) at every ``grid`` (keys, x).

    At a repeated x the last (highest) y counts, to its left the lowest; outside
    the knots the end values hold. ``bucket`` is a non-decreasing expression of
    ``x``; knots next to a bucket are carried into it.
    """
    ends = knots.groupBy(*keys, "x").agg(F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
    nothing = F.lit(None).cast("double")
    rows = (
        grid.select(*keys, "x", nothing.alias("y_lo"), nothing.alias("y_hi"), F.lit(True).alias("_g"))
        .unionByName(ends.withColumn("_g", F.lit(False)))
        .groupBy(*keys, "x")
        .agg(F.max("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi"), F.max("_g").alias("_g"))
        .withColumn("bucket", bucket)
    )
    low = F.when(F.col("y_lo").isNotNull(), F.struct("x", F.col("y_lo").alias("y")))
    high = F.when(F.col("y_hi").isNotNull(), F.struct("x", F.col("y_hi").alias("y")))
    knot_x = F.when(F.col("y_hi").isNotNull(), F.col("x"))
    edges = rows.groupBy(*keys, "bucket").agg(
        F.min(knot_x).alias("head_x"), F.min_by("y_lo", knot_x).alias("head_y"),
        F.max(knot_x).alias("tail_x"), F.max_by("y_hi", knot_x).alias("tail_y"),
    )
    head = F.when(F.col("head_x").isNotNull(), F.struct(F.col("head_x").alias("x"), F.col("head_y").alias("y")))
    tail = F.when(F.col("tail_x").isNotNull(), F.struct(F.col("tail_x").alias("x"), F.col("tail_y").alias("y")))
    # Looking ahead is looking back in descending order: a frame that ends
    # unbounded would be evaluated anew for every row.
    start = Window.unboundedPreceding
    buckets = Window.partitionBy(*keys)
    edges = edges.select(
        *keys, "bucket",
        F.last(tail, True).over(buckets.orderBy("bucket").rowsBetween(start, -1)).alias("carried"),
        F.last(head, True).over(buckets.orderBy(F.desc("bucket")).rowsBetween(start, -1)).alias("coming"),
    )
    inside = Window.partitionBy(*keys, "bucket")
    rising = inside.orderBy("x").rowsBetween(start, 0)
    falling = inside.orderBy(F.desc("x")).rowsBetween(start, 0)
    left, right = F.col("left"), F.col("right")
    slope = (right.y - left.y) / F.nullif(right.x - left.x, F.lit(0.0))
    value = (
        F.when(F.col("y_hi").isNotNull(), F.col("y_hi"))
        .when(left.isNull(), right.y)
        .when(right.isNull(), left.y)
        .otherwise(slope * (F.col("x") - left.x) + left.y)
    )
    return (
        rows.join(edges, keys + ["bucket"])
        .withColumn("left", F.coalesce(F.last(high, True).over(rising), F.col("carried")))
        .withColumn("right", F.coalesce(F.last(low, True).over(falling), F.col("coming")))
        .filter("_g")
        .select(*keys, "x", value.alias("y"))
    )


def rate_bucket(df: DataFrame, rate: str) -> Column:
    """Equal parts of [0, 1]; distinct rates are close to evenly spaced."""
    n = task_count(df.sparkSession)
    return F.least(F.floor(F.col(rate) * n), F.lit(n - 1))


def fpr_grid(points: DataFrame) -> DataFrame:
    """Distinct false-positive rates of all classes of a model."""
    return points.select("model", F.col("fpr").alias("x")).distinct()


def macro_roc_curve(points: DataFrame, classes) -> DataFrame:
    """Mean true-positive rate over the classes on the union of their grids."""
    every = F.array(*[F.lit(c).cast("bigint") for c in classes])
    grid = fpr_grid(points).withColumn("cls", F.explode(every))
    knots = points.select(*CURVE, F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    return (
        interpolate(knots, grid, CURVE, rate_bucket(points, "x"))
        .groupBy("model", F.col("x").alias("fpr"))
        .agg(F.avg("y").alias("tpr"))
    )


def macro_roc_auc(points: DataFrame, classes) -> DataFrame:
    """Trapezoid area under the macro curve, summed per range of the grid."""
    curve = macro_roc_curve(points, classes).withColumn("bucket", rate_bucket(points, "fpr"))
    inside = Window.partitionBy("model", "bucket").orderBy("fpr")
    width = F.col("fpr") - F.lag("fpr").over(inside)
    height = (F.col("tpr") + F.lag("tpr").over(inside)) / 2
    parts = (
        curve.withColumn("area", width * height)
        .groupBy("model", "bucket")
        .agg(
            F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"),
            F.min(F.struct("fpr", "tpr")).alias("head"),
            F.max(F.struct("fpr", "tpr")).alias("tail"),
        )
    )
    before = F.lag("tail").over(Window.partitionBy("model").orderBy("bucket"))
    gap = (F.col("head.fpr") - F.col("before.fpr")) * (F.col("head.tpr") + F.col("before.tpr")) / 2
    return (
        parts.withColumn("before", before)
        .groupBy("model")
        .agg(F.sum(F.col("area") + F.coalesce(gap, F.lit(0.0))).alias("macro_auc"))
    )
