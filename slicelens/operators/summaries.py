"""Tables that describe the loaded windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicelens.operators.joins import attach, stage
from slicelens.settings import FEATURES, LABEL, SLICE_NAMES

QUARTILES = (0.25, 0.5, 0.75)
BAND = 1e-4
SKETCH_ACCURACY = 100_000
#: Values around a rank that are put in order.
BAND_ROWS = 100_000


def slice_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SLICE_NAMES.items()), f"{LABEL} bigint, slice_name string")


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def load_summary(inventory: DataFrame, features: DataFrame) -> DataFrame:
    """Per application: files seen, files with windows, windows; empty ones included."""
    per_capture = features.groupBy("capture_id").agg(F.count("*").alias("windows"))
    return (
        inventory.join(per_capture, "capture_id", "left")
        .groupBy("category", "app", LABEL)
        .agg(
            F.count("*").alias("files"),
            F.count("windows").alias("files_used"),
            F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"),
        )
    )


def class_summary(per_app: DataFrame) -> DataFrame:
    return per_app.groupBy(LABEL).agg(
        F.sum("files_used").alias("files_used"), F.sum("windows").alias("windows")
    )


@dataclass
class _Rank:
    """Where the value at a zero-based rank of a column lies: between ``lo`` and ``hi``, both possible."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int  # values under lo
    upto: int  # values up to hi
    stuck: bool = False

    def half(self) -> float:
        return self.lo + (self.hi - self.lo) / 2

    def open(self, most: int) -> bool:
        """Still more than ``most`` values, and values between the ends."""
        return self.upto - self.below > most and self.lo < self.half() < self.hi

    def learn(self, cut: float, below: int, upto: int) -> None:
        """Counting found ``below`` values under the cut and ``upto`` up to it."""
        if below <= self.rank and cut > self.lo:
            self.lo, self.below = cut, below
        if upto > self.rank and cut < self.hi:
            self.hi, self.upto = cut, upto


def _near(df: DataFrame, ranks: list[_Rank]) -> list[tuple[str, float]]:
    """Cuts near the ranks: from a sketch of the values between the ends, or halfway after a round without gain."""
    spans: dict[tuple, list[float]] = {}
    for r in ranks:
        if not r.stuck:
            size = max(r.upto - r.below - 1, 1)
            at = (r.rank - r.below) / size
            spans.setdefault((r.column, r.lo, r.hi), []).extend([at - BAND, at + 1 / size + BAND])
    cuts = {(r.column, r.half()) for r in ranks if r.stuck}
    if spans:
        row = df.agg(*[
            F.percentile_approx(
                F.when(F.col(c).between(lo, hi), F.col(c).cast("double")),
                [min(max(x, 0.0), 1.0) for x in near], SKETCH_ACCURACY,
            ).alias(f"a{i}")
            for i, ((c, lo, hi), near) in enumerate(spans.items())
        ]).first()
        cuts |= {(c, x) for i, (c, _, _) in enumerate(spans) for x in row[i]}
    return sorted(cuts)


def _narrow(df: DataFrame, ranks: list[_Rank], most: int) -> None:
    """Narrow until few values are left around each rank; at least one round.

    A count over all rows proves every step. A poor sketch costs rounds, not
    results, and halving gets on where it gives nothing.
    """
    todo = [r for r in ranks if r.lo < r.hi]
    while todo:
        cuts = _near(df, todo)
        seen = df.agg(*[
            count.alias(f"{name}{i}")
            for i, (c, cut) in enumerate(cuts)
            for name, count in (
                ("b", F.count_if(F.col(c).cast("double") < cut)), ("u", F.count_if(F.col(c).cast("double") <= cut))
            )
        ]).first()
        for r in todo:
            before = r.lo, r.hi
            for i, (c, cut) in enumerate(cuts):
                if c == r.column:
                    r.learn(cut, seen[f"b{i}"], seen[f"u{i}"])
            r.stuck = before == (r.lo, r.hi)
        todo = [r for r in todo if r.open(most)]


def values_at(df: DataFrame, ranks: list[_Rank], most: int) -> dict[tuple[str, int], float]:
    """The exact value at each rank; only the values left around a rank are put in order."""
    _narrow(df, ranks, most)
    bands = sorted({(r.column, r.lo, r.hi, r.below) for r in ranks if r.lo < r.hi})
    found = {(r.column, r.rank): r.lo for r in ranks if r.lo == r.hi}
    if not bands:
        return found
    entries = [
        F.when(
            F.col(c).between(lo, hi), F.struct(F.lit(i).alias("band"), F.col(c).cast("double").alias("value"))
        )
        for i, (c, lo, hi, _) in enumerate(bands)
    ]
    in_order = Window.partitionBy("band").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.band", "e.value").agg(F.count("*").alias("same"))
        .withColumn("upto", F.sum("same").over(in_order))
    )
    left = [r for r in ranks if r.lo < r.hi]
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("at"), F.lit(bands.index((r.column, r.lo, r.hi, r.below))).alias("band"),
            F.lit(r.rank - r.below).cast("bigint").alias("rank"),
        )
        for i, r in enumerate(left)
    ])
    rows = (
        counted.withColumn("want", F.explode(wanted))
        .filter("want.band = band AND upto > want.rank").groupBy("want.at").agg(F.min("value").alias("value"))
    )
    found.update({(left[r["at"]].column, left[r["at"]].rank): r["value"] for r in rows.collect()})
    return found


def describe_features(df: DataFrame, columns=FEATURES, most: int = BAND_ROWS) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated quartiles per column.

    The quartiles' ranks are narrowed down by counting until at most ``most``
    values are left around each, or its neighbours have no value between them.
    """
    columns = list(columns)
    df = stage(df.select(*columns), "described")
    row = df.agg(
        *[
            expr
            for i, c in enumerate(columns)
            for expr in (
                F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"),
                F.stddev_samp(c).alias(f"std{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"),
            )
        ]
    ).first()
    empty = [c for i, c in enumerate(columns) if not row[f"n{i}"]]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    ranks = [
        _Rank(c, rank, float(row[f"min{i}"]), float(row[f"max{i}"]), 0, row[f"n{i}"])
        for i, c in enumerate(columns)
        for rank in sorted({
            min(int(q * (row[f"n{i}"] - 1)) + step, row[f"n{i}"] - 1) for q in QUARTILES for step in (0, 1)
        })
    ]
    value = values_at(df, ranks, most)
    rows = []
    for i, c in enumerate(columns):
        last = row[f"n{i}"] - 1
        quartiles = []
        for q in QUARTILES:
            at = int(q * last)
            lo, hi = value[c, at], value[c, min(at + 1, last)]
            quartiles.append(lo + (hi - lo) * (q * last - at))
        rows.append((c, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], float(row[f"min{i}"]), *quartiles,
                     float(row[f"max{i}"])))
    shown = ["mean", "std", "min", *[f"p{int(q * 100)}" for q in QUARTILES], "max"]
    schema = "feature string, n bigint, " + ", ".join(f"{c} double" for c in shown)
    return df.sparkSession.createDataFrame(rows, schema).select(
        "feature", "n", *[F.bround(c, 2).alias(c) for c in shown]
    )


def feature_correlation(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Pearson correlation of every pair, one row per cell.

    Each task folds its rows into one small matrix; columns must not be NULL.
    """
    columns = list(columns)
    staged = stage(df.select(*columns), "correlated")
    vectors = staged.select(array_to_vector(F.array(*columns)).alias("v"))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    cells = [
        (a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        cells, "feature_a string, feature_b string, correlation double"
    )


def class_histogram(df: DataFrame, value: str, label: str = LABEL, bins: int = 25) -> DataFrame:
    """Equal-width bins of a column over each class's own range; last bin closed."""
    flat = F.col("top") == F.col("bottom")
    ranges = stage(
        df.groupBy(label)
        .agg(F.min(value).cast("double").alias("bottom"), F.max(value).cast("double").alias("top"))
        .select(
            label,
            F.when(flat, F.col("bottom") - 0.5).otherwise(F.col("bottom")).alias("lo"),
            F.when(flat, F.col("top") + 0.5).otherwise(F.col("top")).alias("hi"),
        )
        .withColumn("step", (F.col("hi") - F.col("lo")) / bins),
        "ranges",
    )
    guess = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("step")), F.lit(bins - 1))
    early = F.col(value) < F.col("lo") + F.col("bin") * F.col("step")
    late = F.col(value) >= F.col("lo") + (F.col("bin") + 1) * F.col("step")
    counted = (
        attach(df.select(label, value), ranges, [label])
        .withColumn("bin", guess)
        .withColumn(
            "bin",
            F.when(early, F.col("bin") - 1)
            .when(late & (F.col("bin") < bins - 1), F.col("bin") + 1)
            .otherwise(F.col("bin")),
        )
        .groupBy(label, "bin")
        .agg(F.count("*").alias("n"))
    )
    empty = ranges.select(
        label, "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).withColumn("bin", F.col("bin").cast("bigint"))
    return empty.join(counted, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("step")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
