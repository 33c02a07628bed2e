"""Exact, repeatable sampling and splitting.

Every row gets a hash key that depends only on its identity. "The first n rows
in shuffled order" is then "keys up to the n-th smallest", so once that cut key
is known per class the sample is a filter: a class holding most of the data
costs no more than any other. Sizes, quotas and cuts are tables with one row a
class, joined to the rows by their class; rows without a class are in no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelens.operators.joins import attach, stage
from slicelens.operators.ordering import BUCKET_ROWS, hash_bucket, positions

CUT_DIGITS, KEY_DIGITS = 4, 32


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class: ``label, n``, evaluated once."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return stage(counts, "sizes")


def cut_keys(df: DataFrame, label: str, key: str, quotas: DataFrame) -> DataFrame:
    """``label, cut``: the ``quota``-th smallest key of each class with a quota above 0.

    ``quotas`` has ``label, quota``, at most the class's size. A histogram of key
    prefixes finds the bucket that holds the cut; while a bucket is still large
    it is cut by longer prefixes, and only the last one's rows are ranked. Keys
    must be unique: a cut between two equal keys is refused, since it could not
    give exactly ``quota`` rows.
    """
    wanted = quotas.filter("quota > 0").select(label, F.col("quota").cast("bigint"))
    rows, digits, large = df.select(label, key), 0, True
    upto = Window.partitionBy(label).orderBy("_bucket")
    while large and digits < KEY_DIGITS:
        digits += CUT_DIGITS
        bucket = hash_bucket(F.col(key), digits)
        counted = (
            rows.groupBy(label, bucket.alias("_bucket")).agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(upto))
        )
        crossing = stage(
            counted.join(wanted, label).filter("upto >= quota AND upto - n < quota")
            .select(label, "_bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("quota"), "n"),
            "crossing",
        )
        wanted = crossing.select(label, "quota")
        held = crossing.select(label, "_bucket")
        rows = df.select(label, key, bucket.alias("_bucket")).join(held, [label, "_bucket"]).drop("_bucket")
        large = not crossing.filter(F.col("n") > BUCKET_ROWS).isEmpty()
    ordered = Window.partitionBy(label).orderBy(key)
    cuts = stage(
        rows.withColumn("_r", F.row_number().over(ordered))
        .withColumn("_tied", F.coalesce(F.lead(key).over(ordered) == F.col(key), F.lit(False)))
        .join(wanted, label).filter("_r = quota").select(label, F.col(key).alias("cut"), "_tied"),
        "cuts",
    )
    if not cuts.filter("_tied").isEmpty():
        raise ValueError(f"{key} is not unique")
    return cuts.drop("_tied")


def marked(df: DataFrame, label: str, key: str, cuts: DataFrame, name: str) -> DataFrame:
    """Add ``name``: true for rows whose key is at or below the cut of their class."""
    joined = attach(df, cuts.withColumnRenamed("cut", "_cut"), [label], "left")
    chosen = F.coalesce(F.col(key) <= F.col("_cut"), F.lit(False))
    return joined.withColumn(name, chosen).select(*df.columns, name)


def _within(df: DataFrame, label: str, key: str, quotas: DataFrame) -> DataFrame:
    cuts = cut_keys(df, label, key, quotas)
    return marked(df, label, key, cuts, "_chosen").filter("_chosen").drop("_chosen")


def head_per_class(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each class in shuffled order."""
    sizes = class_sizes(df, label)
    return _within(df, label, key, sizes.select(label, F.least(F.lit(n), F.col("n")).alias("quota")))


def balance(
    df: DataFrame, label: str, key: str, cap: int | None = None, at_least: int = 30
) -> DataFrame:
    """Under-sample every class to the smallest one, or to ``cap`` if that is less."""
    sizes = class_sizes(df, label)
    n = sizes.agg(F.min("n")).first()[0] or 0
    n = n if cap is None else min(n, cap)
    if n < at_least:
        few = sizes.orderBy("n").limit(20).collect()
        raise ValueError(f"smallest class has {n} rows, {at_least} needed: {dict(map(tuple, few))}")
    return _within(df, label, key, sizes.select(label, F.lit(n).alias("quota")))


def split_quotas(sizes: DataFrame, label: str, fraction_num: int, fraction_den: int) -> DataFrame:
    """Test rows per class: ceil(fraction x all), the train part shared proportionally.

    Train seats left over by rounding down go to the largest remainders, then
    to the lower label.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    train = total - -(-total * fraction_num // fraction_den)
    share = f"(CAST({train} AS DECIMAL(19, 0)) * n)"
    parts = sizes.selectExpr(
        f"`{label}`", "n", f"{share} DIV {max(total, 1)} AS seats", f"{share} % {max(total, 1)} AS rest"
    )
    spare = train - (parts.agg(F.sum("seats")).first()[0] or 0)
    # One row a class meets in this window.
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), label))
    favoured = (turn <= int(spare)).cast("bigint")
    return parts.select(label, (F.col("n") - F.col("seats") - favoured).alias("quota"))


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: tuple[int, int] = (1, 4)
) -> DataFrame:
    """Add ``is_test``; every class keeps its share in both parts."""
    quotas = split_quotas(class_sizes(df, label), label, *fraction)
    return marked(df, label, key, cut_keys(df, label, key, quotas), "is_test")


def random_split(df: DataFrame, key: str, fraction: tuple[int, int] = (1, 5)) -> DataFrame:
    """Add ``is_test`` without strata; the test part has exactly ceil(fraction x n) rows."""
    whole = df.withColumn("_all", F.lit(0))
    num, den = fraction
    quota = whole.groupBy("_all").agg(F.expr(f"(count(*) * {num} + {den - 1}) DIV {den}").alias("quota"))
    return marked(whole, "_all", key, cut_keys(whole, "_all", key, quota), "is_test").drop("_all")


def epoch_batches(
    df: DataFrame, identity: Column, epochs: int, batch_size: int, seed: int = 42
) -> DataFrame:
    """Every row once per epoch in a fresh order, cut into full batches.

    Adds ``epoch`` (from 1) and ``batch`` (from 0). The incomplete last batch of
    an epoch is dropped.
    """
    per_epoch = df.count()
    full = per_epoch // batch_size
    key = F.md5(
        F.concat_ws(":", identity.cast("string"), F.col("epoch").cast("string"), F.lit(str(seed)))
    )
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(epochs).cast("bigint"))
    repeated = df.withColumn("epoch", F.explode(numbers)).withColumn("_key", key)
    placed = positions(repeated, ["epoch"], "_key", "_position", rows=per_epoch)
    batch = F.floor((F.col("_position") - 1) / batch_size)
    return placed.withColumn("batch", batch).filter(F.col("batch") < full).drop("_key", "_position")
