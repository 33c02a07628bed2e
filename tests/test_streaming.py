import random
from dataclasses import replace

import numpy as np
import pytest
from brute import capture_windows
from pyspark.sql import functions as F

from slicelens.settings import TREE
from slicelens.plans.stream_queries import PARTS, replay
from slicelens.streaming.run import PROVIDER, ROCKSDB, drain
from slicelens.streaming.windows import Moments, end_mark, stream_rolling, stream_windows

SECOND = 1_000_000
BASE = 1_664_284_111_250_000
PLAIN = tuple((None, None) for _ in range(8))
SPEC = replace(TREE, cap=None, min_capture_packets=0, feature_bounds=PLAIN)
SCHEMA = "capture_id bigint, pkt_no bigint, us bigint, len double, uplink boolean"
NAMES = ("throughput_kbps", "avg_pkt_size_bytes", "inter_arrival_mean_us", "inter_arrival_std_us",
         "flow_pkt_count", "dl_ul_ratio")


def packets():
    rows = []
    for c in (1, 2):
        for i in range(120):
            at = BASE + c * 333_000 + int(i * 0.17 * SECOND) + (i * i * 7919) % 40_000
            rows.append((c, i, at, float(60 + (i * 37) % 900), i % 3 == 0))
    return rows


def streamed(spark, folder, batches, after_us=10 * SECOND):
    """One file a batch, the end mark last (unless ``after_us`` is None)."""
    frames = [spark.createDataFrame(b, SCHEMA).withColumn("ts", F.timestamp_micros("us")) for b in batches]
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    if after_us is not None:
        whole = frames[0]
        for df in frames[1:]:
            whole = whole.union(df)
        end_mark(whole, after_us).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def clock_windows(rows):
    want = {}
    for c in {r[0] for r in rows}:
        first = min(r[2] for r in rows if r[0] == c) // SECOND * SECOND
        mine = [dict(pkt_no=-1, us=first, len=0.0, uplink=None)]
        mine += [dict(zip(("pkt_no", "us", "len", "uplink"), r[1:])) for r in rows if r[0] == c]
        # A packet far behind makes every window a whole one; its own stays alone and is dropped.
        mine.append(dict(pkt_no=10**9, us=max(r["us"] for r in mine) + 5 * SECOND, len=1.0, uplink=True))
        for k, v in capture_windows(mine, SPEC).items():
            want[c, first + k * SECOND] = v[:6]
    return want


def found_windows(spark, stream, **kwargs):
    rows = drain(stream_windows(stream, SPEC, "2 seconds", **kwargs).drop("window_time"), "b").collect()
    got = {(r["capture_id"], r["start_us"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(got) == len(rows)
    return got


def agree(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("slices,lanes", [(1, 1), (8, 3)])
def test_all_clock_windows_come_once_the_end_is_marked(spark, tmp_path, slices, lanes):
    rows = packets()
    stream = streamed(spark, str(tmp_path), [[r for r in rows if r[1] < 60], [r for r in rows if r[1] >= 60]])
    agree(found_windows(spark, stream, slices=slices, lanes=lanes), clock_windows(rows))


def test_rows_out_of_order_within_the_delay(spark, tmp_path):
    rows = packets()
    random.Random(3).shuffle(rows)
    # Every batch reaches 1.5 s ahead of the next one's first packets: less than the delay.
    rows.sort(key=lambda r: r[2] + random.Random(r[2]).randint(0, 3 * SECOND // 2))
    stream = streamed(spark, str(tmp_path), [rows[i : i + 30] for i in range(0, len(rows), 30)])
    agree(found_windows(spark, stream, slices=4, lanes=2), clock_windows(rows))


def test_late_rows_are_dropped(spark, tmp_path):
    rows = packets()
    late = [(1, 500 + i, BASE + 400_000 + i, 50.0, True) for i in range(3)]
    early, rest = [r for r in rows if r[1] < 60], [r for r in rows if r[1] >= 60]
    stream = streamed(spark, str(tmp_path), [early, rest[:60], late + rest[60:]])
    agree(found_windows(spark, stream, slices=4, lanes=2), clock_windows(rows))


def test_windows_stay_open_without_the_end_mark(spark, tmp_path):
    rows = packets()
    got = found_windows(spark, streamed(spark, str(tmp_path), [rows], after_us=None), slices=2)
    last = max(r[2] for r in rows) - 2 * SECOND
    agree(got, {k: v for k, v in clock_windows(rows).items() if k[1] + SECOND <= last})


@pytest.mark.parametrize("named", [True, False])
def test_captures_share_keys(spark, tmp_path, named):
    # Names or numbers, more captures than keys, packets without a capture or a direction.
    rows = [(c + 10 * k, *rest) for c, *rest in packets() for k in range(20)]
    frames = [spark.createDataFrame([r for r in rows if half == (r[1] < 60)], SCHEMA) for half in (True, False)]
    lost = (F.col("pkt_no") % 11 == 3) & (F.col("pkt_no") % 7 != 2)
    for df in frames:
        name = F.concat(F.lit("capture "), "capture_id") if named else F.col("capture_id") + 2**60
        df = df.withColumn("capture_id", F.when(F.col("pkt_no") % 7 != 2, name)).withColumn("uplink", F.when(~lost, F.col("uplink")))
        df = df.withColumn("ts", F.timestamp_micros("us"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    end_mark(spark.read.parquet(str(tmp_path)), 10 * SECOND).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = found_windows(spark, stream, slices=4, lanes=3, buckets=5)
    # A packet of unknown direction is none of the uplink; those without a capture are one capture.
    rows = [(None, *r[1:]) if r[1] % 7 == 2 else (*r[:4], r[4] and r[1] % 11 != 3) for r in rows]
    names = {c: None if c is None else f"capture {c}" if named else c + 2**60 for c in {r[0] for r in rows}}
    agree(got, {(names[c], start): v for (c, start), v in clock_windows(rows).items()})


def test_calls_follow_buckets_not_captures(spark, tmp_path):
    rows = [(c, i, BASE + i * SECOND // 3, 100.0, True) for c in range(400) for i in range(6)]
    stream = stream_windows(streamed(spark, str(tmp_path / "in"), [rows]), SPEC, "2 seconds", buckets=8, lanes=1)
    folder = str(tmp_path / "out")
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = (
            stream.writeStream.format("parquet").option("path", f"{folder}/rows").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start()
        )
        running.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER)
    held = [op["numRowsTotal"] for p in running.recentProgress for op in p["stateOperators"]]
    assert 8 <= max(held) <= 4 * 8  # packets, timers and their index: before, 400 of each
    assert spark.read.parquet(f"{folder}/rows").select("capture_id").distinct().count() == 400


def test_slices_must_divide_the_window(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    with pytest.raises(ValueError, match="do not divide"):
        stream_windows(df, SPEC, "2 seconds", slices=7)


def anchored_windows(rows, spec):
    want = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        t0 = min(own, key=lambda r: r[1])[2]
        mine = [dict(zip(("pkt_no", "us", "len", "uplink"), r[1:])) for r in own]
        for k, v in capture_windows(mine, spec).items():
            want[c, t0 + k * SECOND] = (v[0], v[6], v[7])
    return want


def rolled(spark, stream, spec=SPEC, **kwargs):
    rows = drain(stream_rolling(stream, spec, "2 seconds", **kwargs), "t").collect()
    got = {
        (r["capture_id"], r["start_us"]): (r["throughput_kbps"], r["bitrate_mean_kbps"], r["bitrate_std_kbps"])
        for r in rows
    }
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("rolling", [1, 2, 5])
def test_anchored_rolling_windows(spark, tmp_path, rolling):
    rows, spec = packets(), replace(SPEC, rolling=rolling)
    stream = streamed(spark, str(tmp_path), [[r for r in rows if i <= r[1] < i + 40] for i in (0, 40, 80)])
    want = anchored_windows(rows, spec)
    assert len(want) > 30
    got = rolled(spark, stream, spec)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9)
    if rolling == 1:
        assert all(v[0] == v[1] and v[2] == 0 for v in got.values())


def test_a_batch_of_the_replay_is_one_range_of_time(spark, tmp_path):
    # Four files of consecutive times: the ranges meet two, three and two of them.
    at = F.when(F.col("id") < 1000, F.col("id")).otherwise(F.col("id") + 200) * SECOND
    df = spark.range(0, 2000, 1, 4).select(
        (F.col("id") % 3).alias("capture_id"), F.col("id").alias("pkt_no"), (at + BASE).alias("us"),
        F.lit(100.0).alias("len"), F.lit(True).alias("uplink"),
    )
    df = df.withColumn("ts", F.timestamp_micros("us"))
    last = 2199
    sizes = [sum(k <= (s + 200 * (s >= 1000)) * PARTS / last < k + 1 for s in range(2000)) for k in range(PARTS)]
    sizes[-1] = 2000 - sum(sizes[:-1])
    running = (
        replay(spark, None, df, 10 * SECOND).writeStream.format("parquet").option("path", str(tmp_path / "rows"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert [p["numInputRows"] for p in running.recentProgress if p["numInputRows"]] == [*sizes, 1]


def test_idle_capture_is_forgotten(spark, tmp_path):
    rows = [r for r in packets() if r[0] == 1]
    again = [(c, n + 1000, us + 60 * SECOND + 123_456, size, up) for c, n, us, size, up in rows]
    other = [(2, i, BASE + i * SECOND // 2, 100.0, True) for i in range(200)]
    batches = [rows + [r for r in other if r[2] < BASE + 40 * SECOND], [r for r in other if r[2] >= BASE + 40 * SECOND]]
    # The other capture moves the watermark on; the first comes back after its state has gone.
    late = [(2, 900 + i, BASE + 75 * SECOND + i * SECOND // 2, 100.0, True) for i in range(60)]
    batches.append(again + late)
    got = rolled(spark, streamed(spark, str(tmp_path), batches), idle_us=10 * SECOND)
    want = {**anchored_windows(rows, SPEC), **anchored_windows(again, SPEC)}
    mine = {k: v for k, v in got.items() if k[0] == 1}
    assert mine.keys() == want.keys()  # the second part starts anew, at its own first packet
    for key in want:
        assert mine[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9)
    kept = rolled(spark, streamed(spark, str(tmp_path / "kept"), batches), idle_us=1000 * SECOND)
    assert {k for k in kept if k[0] == 1} != want.keys()  # one start for both parts


def test_moments_append_exactly():
    rng = np.random.default_rng(1)
    us = np.sort(rng.integers(0, 10**9, 500)) + BASE
    size, up = rng.integers(40, 1500, 500).astype(float), rng.choice([0.0, 1.0, np.nan], 500)
    whole = Moments.of(us, size, up)
    cuts = [0, 1, 2, 100, 101, 350, 500]
    runs = [Moments.of(us[a:b], size[a:b], up[a:b]) for a, b in zip(cuts, cuts[1:])]
    total = runs[0]
    for run in runs[1:]:
        total = total.then(run)
    assert (total.n, total.directed, total.first, total.last) == (500, whole.directed, us[0], us[-1])
    assert (total.bytes, total.up) == pytest.approx((whole.bytes, whole.up))
    gaps = np.diff(us)
    assert total.m2 == pytest.approx(((gaps - gaps.mean()) ** 2).sum(), rel=1e-12)


def test_end_mark_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    assert end_mark(df, 5).count() == 0
