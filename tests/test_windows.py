import random
from dataclasses import replace

import pytest
from brute import capture_windows
from pyspark.sql import functions as F

from slicelens.operators import joins, windows
from slicelens.settings import BY_STEM, FEATURES, LABEL, TREE

SCHEMA = f"capture_id string, pkt_no bigint, us bigint, len double, uplink boolean, {LABEL} bigint"
SECOND = 1_000_000


def capture(name, times, lengths=None, uplinks=None, label=0):
    return [
        (name, i, int(t * SECOND), float(lengths[i] if lengths else 100 + i),
         bool(uplinks[i]) if uplinks else i % 3 == 0, label)
        for i, t in enumerate(times)
    ]


def captures():
    rng = random.Random(3)
    rows = capture("nine", [i * 0.3 for i in range(9)])
    rows += capture("ten", [i * 0.3 for i in range(10)])
    rows += capture("zero", [i * 0.3 for i in range(12)], lengths=[0] * 5 + [50] * 7)
    rows += capture("late_start", [5.0, 4.0, 4.5] + [5 + i * 0.21 for i in range(1, 20)])
    gap = [0.1, 0.2, 0.5, 0.6, 0.9, 1.1, 1.2, 1.7, 4.5, 5.1, 5.2, 5.3, 6.4]
    rows += capture("gap", gap)
    rows += capture("uponly", [i * 0.1 for i in range(30)], uplinks=[1] * 30)
    rows += capture("downonly", [i * 0.1 for i in range(30)], uplinks=[0] * 30)
    rows += capture("same", [0.0] * 15 + [0.5] * 5 + [1.5])
    rows += capture("long", [i * 0.25 + rng.random() * 0.1 for i in range(900)], label=2)
    shuffled = [rng.random() * 40 for _ in range(400)]
    rows += capture("shuffled", shuffled, label=1)
    return rows


def expected(rows, spec):
    found = {}
    for name in {r[0] for r in rows}:
        packets = [dict(zip(("pkt_no", "us", "len", "uplink"), r[1:5])) for r in rows if r[0] == name]
        for k, values in capture_windows(packets, spec).items():
            found[name, k] = values
    return found


def got(df):
    return {(r["capture_id"], r["k"]): tuple(r[c] for c in FEATURES) for r in df.collect()}


def same(left, right):
    assert left.keys() == right.keys()
    for key in left:
        assert left[key] == pytest.approx(right[key], rel=1e-9, abs=1e-6), key


@pytest.mark.parametrize("spec", [
    TREE, replace(TREE, cap=7), replace(TREE, cap=None), BY_STEM, replace(BY_STEM, cap=5),
    replace(TREE, width_us=2_500_000, cap=None, rolling=3),
])
def test_features_match_plain_loops(spark, spec):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA)
    same(got(windows.window_features(df, spec)), expected(rows, spec))


def test_no_direction_gives_ratio_one(spark):
    rows = [(*r[:4], None, r[5]) for r in capture("a", [i * 0.1 for i in range(40)])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = windows.window_features(df, BY_STEM).collect()
    assert found and all(r["dl_ul_ratio"] == 1.0 for r in found)


@pytest.mark.parametrize("slice_packets", [1, 3, 50])
def test_slices_do_not_change_results(spark, monkeypatch, slice_packets):
    rows = captures()
    monkeypatch.setattr(windows, "SLICE_PACKETS", slice_packets)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "len")
    same(got(windows.window_features(df, TREE)), expected(rows, TREE))


@pytest.mark.parametrize("chunk", [1, 3, 64])
@pytest.mark.parametrize("cap", [None, 11])
def test_chunked_rolling_equals_plain(spark, chunk, cap):
    spec = replace(TREE, cap=cap)
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA)
    base = windows.base_windows(windows.place(df, spec), spec)
    found = windows.clip_features(windows.capped_rolling(base, spec, chunk), spec)
    same(got(found), expected(rows, spec))


def test_gaps_cross_slices(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICE_PACKETS", 2)
    df = spark.createDataFrame(captures(), SCHEMA)
    found = windows.packet_gaps(windows.place(df, TREE)).filter("capture_id = 'long'")
    rows = found.orderBy("us", "pkt_no").collect()
    last = {}
    for r in rows:
        assert r["gap_us"] == (r["us"] - last[r["k"]] if r["k"] in last else None)
        last[r["k"]] = r["us"]


@pytest.fixture(params=["10MB", "-1"])
def threshold(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot", [False, True])
def test_key_table_is_broadcast_by_its_bytes(spark, threshold, hot):
    key = F.col("id") % 7
    facts = spark.range(1000).select("id", F.when(F.lit(hot) & (F.col("id") % 3 == 0), 9).otherwise(key).alias("key"))
    dim = spark.range(11).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    joined = joins.attach(facts, dim, ["key"])
    assert ("BroadcastHashJoin" in plan(joined)) == (threshold != "-1")
    assert sorted(r["id"] for r in joined.filter("v = key * 10").collect()) == list(range(1000))
    kept = joins.attach(facts, dim.filter("key < 3"), ["key"], how="left")
    known = facts.filter("key < 3").count()
    assert kept.count() == 1000 and kept.filter("v = key * 10").count() == known


def test_features_with_many_captures(spark, threshold):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA)
    same(got(windows.window_features(df, TREE)), expected(rows, TREE))


def plan(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def bursts():
    """A long quiet capture with 3,000 packets in one millisecond, and equal times in another window."""
    rows = capture("quiet", [i * 0.2 for i in range(3000)])
    rows += [("quiet", 10_000 + i, 100 * SECOND + i // 3, 80.0, i % 2 == 0, 0) for i in range(3000)]
    rows += [("quiet", 20_000 + i, 200 * SECOND, 90.0, True, 0) for i in range(2000)]
    return rows + capture("short", [i * 0.2 for i in range(50)])


@pytest.mark.parametrize("slice_packets", [300, 64, 10_000])
def test_only_windows_with_many_packets_are_cut(spark, slice_packets):
    rows = bursts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    placed = windows.place(df, TREE, slice_packets=slice_packets)
    found = placed.groupBy("capture_id", "k", "slice").count().collect()
    slices = {}
    for r in found:
        slices.setdefault((r["capture_id"], r["k"]), []).append(r["count"])
    for key, sizes in slices.items():
        if sum(sizes) <= slice_packets:
            assert len(sizes) == 1, key
        else:  # the burst, and the packets of one instant
            assert len(sizes) > 0.6 * sum(sizes) / slice_packets
            assert max(sizes) < 3 * slice_packets
    assert (max(map(len, slices.values())) > 1) == (slice_packets < 3000)
    spec = replace(TREE, min_window_packets=2)
    cut = windows.base_windows(placed, spec).drop("dl_ul_ratio")
    whole = windows.base_windows(windows.place(df, TREE), spec).drop("dl_ul_ratio")
    for a, b in zip(*(sorted(map(tuple, d.collect())) for d in (cut, whole)), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-6)


def test_quiet_captures_are_not_read_for_cuts(spark):
    df = spark.createDataFrame(bursts(), SCHEMA)
    bounds = joins.stage(windows.capture_bounds(df, TREE), "bounds")
    cuts = windows.slice_cuts(df, bounds, TREE, 1 << 20)
    shown = plan(cuts)
    final = shown[shown.index("Final Plan"):shown.index("Initial Plan")] if "Initial Plan" in shown else shown
    assert cuts.count() == 0
    assert "ExistingRDD" not in final


def test_gaps_read_the_packets_once(spark, tmp_path):
    path = str(tmp_path / "packets")
    spark.createDataFrame(bursts(), SCHEMA).write.parquet(path)
    packets = spark.read.schema(spark.createDataFrame([], SCHEMA).schema).parquet(path)
    gaps = windows.packet_gaps(windows.place(packets, TREE, slice_packets=300))
    final = plan(gaps).split("Initial Plan")[0]
    assert sum("pkt_no#" in line for line in final.splitlines() if "FileScan" in line) == 1
    assert final.count("Exchange hashpartitioning") == 1
    last = {}
    for r in gaps.orderBy("capture_id", "us", "pkt_no").collect():
        key = r["capture_id"], r["k"]
        assert r["gap_us"] == (r["us"] - last[key] if key in last else None)
        last[key] = r["us"]


def test_gaps_of_repeated_packets(spark):
    rows = [("twice", i // 2, (i // 8) * 1000, 60.0, True, 0) for i in range(4000)] + capture("end", [0.0] * 12)
    rows.append(("twice", 9000, 2 * SECOND, 60.0, True, 0))
    gaps = windows.packet_gaps(windows.place(spark.createDataFrame(rows, SCHEMA), TREE, slice_packets=100))
    found = sorted(r["gap_us"] for r in gaps.filter("capture_id = 'twice'").collect() if r["gap_us"] is not None)
    assert found == [0] * (4000 - 500) + [1000] * 499


def test_packet_order_spreads_a_hot_window(spark):
    rows = [("hot", i, (i * 7919) % 5000, 60.0, True, 0) for i in range(20_000)]
    rows += capture("ten", [i * 0.3 for i in range(10)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    ordered = windows.packet_order(df).withColumn("task", F.spark_partition_id()).collect()
    for name in ("hot", "ten"):
        own = sorted((r for r in ordered if r["capture_id"] == name), key=lambda r: (r["us"], r["pkt_no"]))
        assert [r["packet_order"] for r in own] == list(range(1, len(own) + 1))
    from slicelens.operators.ordering import range_buckets

    parts = range_buckets(df, [F.col("capture_id"), F.col("us"), F.col("pkt_no")]).groupBy("bucket").count()
    assert parts.count() == 8 and parts.agg(F.max("count")).first()[0] < 2 * len(rows) / 8


def test_broken_capture_is_rejected(spark):
    rows = [(*r, r[0] == "gap" and r[1] == 3) for r in captures()]
    df = spark.createDataFrame(rows, SCHEMA + ", broken boolean")
    names = {r[0] for r in windows.window_features(df, TREE).select("capture_id").collect()}
    assert "gap" not in names and "long" in names
