import math
import random

import pytest
from pyspark.sql import functions as F

from slicelens.operators import ordering, sampling, scaling, summaries


def labelled(spark, sizes, parts=4):
    rows = [(c * 100_000 + i, c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, y bigint").repartition(parts)
    return df.withColumn("key", ordering.shuffle_key(F.col("id"), 42))


def sizes_of(df):
    return {r["y"]: r["n"] for r in sampling.class_sizes(df, "y").collect()}


def test_balance_is_exact(spark):
    df = labelled(spark, {0: 70, 1: 500, 2: 31})
    counts = sizes_of(sampling.balance(df, "y", "key"))
    assert counts == {0: 31, 1: 31, 2: 31}
    assert set(sizes_of(sampling.balance(df, "y", "key", cap=30)).values()) == {30}


@pytest.mark.parametrize("floor", [30, 50])
def test_smallest_class_guard(spark, floor):
    assert sampling.balance(labelled(spark, {0: floor, 1: 90}), "y", "key", at_least=floor).count() == 2 * floor
    with pytest.raises(ValueError):
        sampling.balance(labelled(spark, {0: floor - 1, 1: 90}), "y", "key", at_least=floor)


def test_sample_is_the_head_of_the_shuffled_class(spark):
    df = labelled(spark, {0: 200, 1: 40})
    rows = sorted((r["y"], r["key"], r["id"]) for r in df.collect())
    want = {r[2] for c in (0, 1) for r in [x for x in rows if x[0] == c][:25]}
    for parts in (1, 7):
        head = sampling.head_per_class(df.repartition(parts), "y", "key", 25)
        assert {r["id"] for r in head.collect()} == want
    assert sampling.head_per_class(df, "y", "key", 100).count() == 140


def test_repeated_key_is_refused(spark):
    df = spark.createDataFrame([(i, 0, "aa") for i in range(40)], "id bigint, y bigint, key string")
    with pytest.raises(ValueError, match="unique"):
        sampling.head_per_class(df, "y", "key", 30)


def test_split_is_complete_disjoint_and_stratified(spark):
    df = sampling.stratified_split(labelled(spark, {0: 400, 1: 400, 2: 400}), "y", "key")
    counts = {(r["y"], r["is_test"]): r["count"] for r in df.groupBy("y", "is_test").count().collect()}
    assert counts == {(c, t): 100 if t else 300 for c in range(3) for t in (True, False)}


@pytest.mark.parametrize("sizes", [{0: 401, 1: 401, 2: 401}, {0: 7, 1: 100, 2: 3}, {8: 1, 9: 1}])
def test_split_sizes(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "y bigint, n bigint")
    quotas = {r["y"]: r["quota"] for r in sampling.split_quotas(table, "y", 1, 4).collect()}
    assert sum(quotas.values()) == math.ceil(sum(sizes.values()) / 4)
    assert all(abs(quotas[c] - n / 4) <= 1 for c, n in sizes.items())


def test_thousands_of_classes(spark):
    df = labelled(spark, {c: 4 + c % 3 for c in range(3000)}).withColumn(
        "y", F.when(F.col("y") != 7, F.col("y"))
    )
    sizes = sizes_of(df)
    assert len(sizes) == 2999 and None not in sizes
    head = sampling.head_per_class(df, "y", "key", 5)
    assert sizes_of(head) == {c: min(5, n) for c, n in sizes.items()}
    assert set(sizes_of(sampling.balance(df, "y", "key", at_least=4)).values()) == {4}
    split = sampling.stratified_split(df, "y", "key")
    assert split.count() == df.count()
    assert split.filter("is_test").count() == math.ceil(sum(sizes.values()) / 4)


def test_random_split_size(spark):
    df = sampling.random_split(labelled(spark, {0: 101}), "key")
    assert df.filter("is_test").count() == 21


def test_epoch_batches(spark):
    df = sampling.epoch_batches(spark.range(900), F.col("id"), epochs=2, batch_size=32)
    per = df.groupBy("epoch", "batch").count().collect()
    assert len(per) == 56 and all(r["count"] == 32 for r in per)
    assert df.groupBy("epoch", "id").count().filter("count > 1").count() == 0


def test_positions_are_a_permutation(spark):
    df = labelled(spark, {0: 300, 1: 17})
    ranked = ordering.positions(df, ["y"], "key").collect()
    for c, n in ((0, 300), (1, 17)):
        mine = sorted((r["key"], r["position"]) for r in ranked if r["y"] == c)
        assert [p for _, p in mine] == list(range(1, n + 1))


def test_constant_column_scales_to_zero(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"))
    rows = scaling.standardize(df, ["a", "b"]).collect()
    assert {r["b"] for r in rows} == {0.0}
    assert sum(r["a"] ** 2 for r in rows) / 10 == pytest.approx(1.0)


def test_label_encode_keeps_numbers_and_nulls(spark):
    df = spark.createDataFrame([("b", 5), ("a", 6), ("c", 7), ("a", 8), (None, 9)], "s string, n int")
    rows = {r["n"]: r["s"] for r in scaling.label_encode(df).collect()}
    assert rows == {5: 1, 6: 0, 7: 2, 8: 0, 9: None}


def quartiles(data):
    data, out = sorted(data), []
    for q in (0.25, 0.5, 0.75):
        at = q * (len(data) - 1)
        low = data[int(at)]
        out.append(low + (data[min(int(at) + 1, len(data) - 1)] - low) * (at - int(at)))
    return out


@pytest.mark.parametrize("most,accuracy", [(100_000, 100_000), (10, 100_000), (2, 2), (50, 5)])
def test_describe_matches_sorted_values(spark, monkeypatch, most, accuracy):
    # A sketch of accuracy 2 gives brackets that do not hold the ranks: counting finds out.
    monkeypatch.setattr(summaries, "SKETCH_ACCURACY", accuracy)
    rng = random.Random(5)
    values = [(rng.choice([1.0, 2.0, rng.random() * 100]), rng.gauss(0, 1), 10.0 ** rng.randint(-8, 8), 7.0)
              for _ in range(997)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double").repartition(6)
    for row in summaries.describe_features(df, ["a", "b", "c", "d"], most).collect():
        data = [v["abcd".index(row["feature"])] for v in values]
        shown = (row["p25"], row["p50"], row["p75"])
        assert shown == pytest.approx(quartiles(data), abs=0.006)
        assert row["n"] == 997 and row["min"] == pytest.approx(min(data), abs=0.006)


def test_first_bracket_that_misses_is_corrected(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("a"))
    tries = []

    def wrong(df, ranks):
        tries.append([(r.lo, r.hi) for r in ranks])
        return [("a", 1.0), ("a", 4.0)] if len(tries) == 1 else near(df, ranks)

    near = summaries._near
    monkeypatch.setattr(summaries, "_near", wrong)
    ranks = [summaries._Rank("a", r, 0.0, 4999.0**2, 0, 5000) for r in (0, 1249, 2500, 4999)]
    found = summaries.values_at(rows, ranks, 5)
    assert {r: found["a", r] for r in (0, 1249, 2500, 4999)} == {r: float(r * r) for r in (0, 1249, 2500, 4999)}
    assert len(tries) >= 2


def test_described_bands_hold_few_values(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 5.0).otherwise(F.col("id") * 1.5).alias("a"))
    ranks = [summaries._Rank("a", r, 5.0, 19_999 * 1.5, 0, 20_000) for r in (4999, 9999, 10_000, 14_999)]
    summaries._narrow(rows, ranks, 30)
    assert all(r.lo == r.hi or r.upto - r.below <= 30 for r in ranks)
    assert ranks[0].lo == ranks[0].hi == 5.0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_describe_few_rows(spark, n):
    data = [3.0, 1.0, 10.0][:n]
    row = summaries.describe_features(spark.createDataFrame([(x,) for x in data], "a double"), ["a"]).first()
    assert (row["p25"], row["p50"], row["p75"]) == pytest.approx(quartiles(data), abs=0.006)


def test_histogram_edges(spark):
    data = [(0, 0.0), (0, 25.0), (0, 24.9), (0, 1.0), (1, 4.0), (1, 4.0)]
    df = spark.createDataFrame(data, "traffic_class bigint, v double")
    bins = {(r["traffic_class"], r["bin"]): r["n"] for r in summaries.class_histogram(df, "v").collect()}
    assert len(bins) == 50 and sum(bins.values()) == 6
    assert bins[0, 0] == 1 and bins[0, 1] == 1 and bins[0, 24] == 2 and bins[1, 12] == 2


def test_cut_through_large_buckets(spark, monkeypatch):
    df = labelled(spark, {0: 700, 1: 500})
    quotas = spark.createDataFrame([(0, 123), (1, 500)], "y bigint, quota bigint")
    plain = sorted(map(tuple, sampling.cut_keys(df, "y", "key", quotas).collect()))
    assert len(plain) == 2
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 0)
    assert sorted(map(tuple, sampling.cut_keys(df, "y", "key", quotas).collect())) == plain
