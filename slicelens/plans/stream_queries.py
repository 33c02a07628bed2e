"""Streaming queries: ``events`` replayed as time-ordered files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slicelens.operators.joins import scratch_path
from slicelens.plans import inputs as I
from slicelens.plans import sql as S
from slicelens.plans.registry import query, rounded
from slicelens.streaming.run import drain
from slicelens.streaming.windows import BUCKETS, end_mark, stream_rolling, stream_windows

SPEC = replace(I.EVENTS, width_us=I.DAY_US // 4)
PARTS = 3
DELAY = "1 hour"
#: Of one batch, about.
BUCKET_PACKETS = 50_000
#: Behind the last packet by more than a window, the delay and the idle limit.
AFTER_US = 50 * I.DAY_US


def replay(spark, folder, packets, after_us):
    """Packets written as consecutive time ranges, then the end mark; read back one range per batch."""
    path = scratch_path(spark, "replay")
    first, last = packets.agg(F.min("us"), F.max("us")).first()
    # Every packet falls in a part: they follow the data and the outer ones are open.
    part = F.floor((F.col("us") - first) * PARTS / F.lit(max(last - first, 1)))
    # A task writes a file or none. Files without rows make up for those, so that a batch is a range:
    # with some files of the next one, it would move the watermark past the others' packets.
    files = packets.rdd.getNumPartitions()
    packets.limit(0).write.parquet(f"{path}-none")
    for i in range(PARTS):
        low = F.lit(True) if i == 0 else part >= i
        high = F.lit(True) if i == PARTS - 1 else part < i + 1
        packets.filter(low & high).coalesce(files).write.mode("append").parquet(f"{path}/part={i}")
        _fill(spark, f"{path}/part={i}", files, f"{path}-none")
    end_mark(packets, after_us).coalesce(1).write.parquet(f"{path}/part={PARTS}")
    return spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", files).parquet(path)


def _fill(spark, folder, files, none):
    """Copies the file in ``none`` until ``folder`` holds ``files`` files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    store = hadoop.Path(folder).getFileSystem(conf)

    def written(at):
        return [s.getPath() for s in store.listStatus(hadoop.Path(at)) if s.getPath().getName().startswith("part-")]

    empty = written(none)[0]
    for i in range(files - len(written(folder))):
        hadoop.FileUtil.copy(store, empty, store, hadoop.Path(f"{folder}/none-{i}.parquet"), False, conf)


def _aligned(width: int) -> str:
    return f"""
WITH {S.PACKETS},
g AS (SELECT *, us // {width} AS w, us - lag(us) OVER (PARTITION BY capture_id, us // {width} ORDER BY us, pkt_no) AS gap
      FROM pk WHERE len > 0),
a AS (SELECT capture_id, w * {width} AS start_us, sum(len) * 8.0 / 1000 AS tput, avg(len) AS size, avg(gap) AS iat,
             CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0.0 END AS jitter, CAST(count(*) AS DOUBLE) AS n,
             sum(CASE WHEN uplink THEN len ELSE 0 END) AS up, sum(CASE WHEN uplink THEN 0 ELSE len END) AS down
      FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT capture_id, start_us, round(tput, 6) AS throughput_kbps, round(size, 6) AS avg_pkt_size_bytes,
       round(iat, 1) AS inter_arrival_mean_us, round(jitter, 0) AS inter_arrival_std_us, n AS flow_pkt_count,
       round(least(greatest(CASE WHEN up > 0 THEN down / up ELSE down + 1 END, 0.01), 1000), 6) AS dl_ul_ratio
FROM a"""


@query("stream_window_features", _aligned(SPEC.width_us))
def stream_window_features(spark, folder):
    packets = I.packets(spark, folder).withColumn("ts", F.timestamp_micros("us"))
    stream = replay(spark, folder, packets, AFTER_US)
    buckets = max(BUCKETS, packets.count() // (PARTS * BUCKET_PACKETS))
    windows = stream_windows(stream, SPEC, DELAY, slices=4, lanes=1, buckets=buckets).drop("window_time")
    digits = {c: d for c, d in S.DIGITS.items() if not c.startswith("bitrate")}
    return rounded(drain(windows, "windows"), **digits)


@query("stream_rolling_bitrate", f"""
WITH {S.PACKETS}, t AS (
  SELECT capture_id, arg_min(us, pkt_no) AS t0, max(us) FILTER (WHERE len > 0) AS t_last FROM pk GROUP BY 1),
p AS (SELECT pk.*, t0, t_last, (us - t0) // {SPEC.width_us} AS k
      FROM pk JOIN t USING (capture_id) WHERE us >= t0 AND len > 0),
a AS (SELECT capture_id, any_value(t0) + k * {SPEC.width_us} AS start_us, sum(len) * 8.0 / 1000 AS tput
      FROM p WHERE t0 + (k + 1) * {SPEC.width_us} <= t_last GROUP BY capture_id, k HAVING count(*) >= 2)
SELECT capture_id, start_us, round(tput, 6) AS throughput_kbps, round(avg(tput) OVER f, 6) AS bitrate_mean_kbps,
       round(coalesce(stddev_samp(tput) OVER f, 0), 5) AS bitrate_std_kbps
FROM a WINDOW f AS (PARTITION BY capture_id ORDER BY start_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def stream_rolling_bitrate(spark, folder):
    packets = I.packets(spark, folder).withColumn("ts", F.timestamp_micros("us"))
    # The idle limit spans the table, so that every capture keeps its start.
    rolled = stream_rolling(replay(spark, folder, packets, AFTER_US), SPEC, DELAY, idle_us=40 * I.DAY_US)
    return rounded(
        drain(rolled, "rolling"), throughput_kbps=6, bitrate_mean_kbps=6, bitrate_std_kbps=5
    )
