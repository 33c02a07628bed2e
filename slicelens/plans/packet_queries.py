"""Packet, window and feature queries over ``events`` (and ``orders``, ``lineitem``)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slicelens.functions import text
from slicelens.functions.maths import clip, epoch_micros
from slicelens.operators import packets as P
from slicelens.operators import windows as W
from slicelens.operators.joins import attach, stage
from slicelens.plans import inputs as I
from slicelens.plans import sql as S
from slicelens.plans.registry import query, rounded
from slicelens.settings import FEATURES, LABEL

SPEC = I.EVENTS


def placed(spark, folder, spec=SPEC):
    return W.place(I.packets(spark, folder), spec)


def base(spark, folder):
    return W.base_windows(placed(spark, folder), SPEC, (LABEL,))


def features(spark, folder):
    return W.window_features(I.packets(spark, folder), SPEC)


@query("parse_packet_time", f"""
WITH {S.RAW}
SELECT event_id AS pkt_no, epoch_us(try_cast(time_text AS TIMESTAMP)) AS us
FROM raw WHERE try_cast(time_text AS TIMESTAMP) IS NOT NULL""")
def parse_packet_time(spark, folder):
    return P.typed_packets(I.raw_packets(spark, folder)).select("pkt_no", "us")


@query("relative_time", f"""
WITH {S.PACKETS}, b AS (SELECT capture_id, arg_min(us, pkt_no) AS t0 FROM pk GROUP BY 1)
SELECT capture_id, pkt_no, us - t0 AS rel_us FROM pk JOIN b USING (capture_id)""")
def relative_time(spark, folder):
    pk = I.packets(spark, folder)
    first = pk.groupBy("capture_id").agg(F.min_by("us", "pkt_no").alias("t0"))
    return attach(pk, first, ["capture_id"]).select(
        "capture_id", "pkt_no", (F.col("us") - F.col("t0")).alias("rel_us")
    )


@query("relative_time_earliest", f"""
WITH {S.PACKETS}, b AS (SELECT capture_id, min(us) AS t0 FROM pk GROUP BY 1)
SELECT capture_id, pkt_no, us - t0 AS rel_us FROM pk JOIN b USING (capture_id)""")
def relative_time_earliest(spark, folder):
    pk = I.packets(spark, folder)
    first = pk.groupBy("capture_id").agg(F.min("us").alias("t0"))
    return attach(pk, first, ["capture_id"]).select(
        "capture_id", "pkt_no", (F.col("us") - F.col("t0")).alias("rel_us")
    )


@query("coerce_length", f"""
WITH {S.RAW}
SELECT event_id AS pkt_no, coalesce(try_cast(length_text AS DOUBLE), 0) AS len
FROM raw WHERE coalesce(try_cast(length_text AS DOUBLE), 0) > 0""")
def coerce_length(spark, folder):
    raw = I.raw_packets(spark, folder)
    return raw.select(
        F.col("pkt_no").cast("bigint").alias("pkt_no"),
        text.packet_length(F.col("Length")).alias("len"),
    ).filter("len > 0")


@query("coerce_length_drop", f"""
WITH {S.RAW}
SELECT event_id AS pkt_no, try_cast(length_text AS DOUBLE) AS len
FROM raw WHERE try_cast(length_text AS DOUBLE) IS NOT NULL""")
def coerce_length_drop(spark, folder):
    raw = I.raw_packets(spark, folder)
    return raw.select(
        F.col("pkt_no").cast("bigint").alias("pkt_no"),
        text.number(F.col("Length")).alias("len"),
    ).dropna(subset=["len"])


@query("min_packets_gate", f"""
WITH {S.PACKETS}, {S.bounds()}
SELECT capture_id, t0, t_last, n_packets FROM b""")
def min_packets_gate(spark, folder):
    return W.capture_bounds(I.packets(spark, folder), SPEC)


@query("is_private_ip", f"""
WITH {S.RAW}, o AS (SELECT source, string_split(source, '.') AS p FROM raw)
SELECT source, count(*) AS packets,
       any_value(len(p) = 4 AND (p[1] IN ('10', '127') OR (p[1] = '172' AND CAST(p[2] AS INT) BETWEEN 16 AND 31)
                 OR (p[1] = '192' AND p[2] IN ('0', '168')))) AS private
FROM o GROUP BY source""")
def is_private_ip(spark, folder):
    return (
        I.raw_packets(spark, folder)
        .groupBy(F.col("Source").alias("source"))
        .agg(F.count("*").alias("packets"))
        .withColumn("private", text.is_private_ip(F.col("source")))
    )


@query("uplink_flag", f"""
WITH {S.RAW}
SELECT event_id AS pkt_no, user_id % 6 <> 5 AS uplink
FROM raw WHERE try_cast(time_text AS TIMESTAMP) IS NOT NULL""")
def uplink_flag(spark, folder):
    return P.typed_packets(I.raw_packets(spark, folder)).select("pkt_no", "uplink")


@query("parse_dst_port", f"""
WITH {S.RAW}
SELECT event_id AS pkt_no,
       CAST(regexp_extract(info, '(\\d+)\\s*[>→]\\s*(\\d+)', 2) AS BIGINT) AS dst_port
FROM raw""")
def parse_dst_port(spark, folder):
    return I.raw_packets(spark, folder).select(
        F.col("pkt_no").cast("bigint").alias("pkt_no"),
        text.dst_port(F.col("Info")).alias("dst_port"),
    )


@query("port_direction", """
WITH p AS (SELECT user_id AS capture_id, value, (user_id * 97 + event_id) % 2048 AS dst_port FROM events),
s AS (SELECT capture_id, sum(CASE WHEN dst_port < 1024 THEN value ELSE 0 END) AS up,
             sum(CASE WHEN dst_port >= 1024 THEN value ELSE 0 END) AS down FROM p GROUP BY 1)
SELECT capture_id, round(up, 4) AS up, round(down, 4) AS down,
       round(least(greatest(CASE WHEN up > 0 THEN down / up ELSE down END, 0.1), 100.0), 6) AS dl_ul_ratio
FROM s""")
def port_direction(spark, folder):
    raw = I.table(spark, folder, "events").select(
        F.col("user_id").alias("capture_id"),
        F.col("event_id").alias("pkt_no"),
        F.date_format("ts", "ss.SSSSSS").alias("time"),
        F.col("value").cast("string").alias("length"),
        F.pmod(F.col("user_id") * 97 + F.col("event_id"), F.lit(2048)).cast("string").alias("dst_port"),
        F.lit(True).alias("has_port"),
    )
    low, high = I.EVENTS_BY_STEM.ratio_bounds
    up = F.sum(F.when(F.col("uplink"), F.col("len")).otherwise(0.0)).alias("up")
    down = F.sum(F.when(~F.col("uplink"), F.col("len")).otherwise(0.0)).alias("down")
    quotient = F.when(F.col("up") > 0, F.try_divide("down", "up")).otherwise(F.col("down"))
    sums = P.typed_port_packets(raw).groupBy("capture_id").agg(up, down)
    return rounded(
        sums.withColumn("dl_ul_ratio", clip(quotient, low, high)), up=4, down=4, dl_ul_ratio=6
    )


@query("tumbling_window", f"""
WITH {S.PACKETS}, {S.bounds()}
SELECT capture_id, pkt_no, (us - t0) // {S.DAY} AS k
FROM pk JOIN b USING (capture_id) WHERE len > 0 AND us >= t0""")
def tumbling_window(spark, folder):
    every = W.place(I.packets(spark, folder), SPEC, whole_only=False)
    return every.select("capture_id", "pkt_no", "k")


@query("whole_windows_only", f"""
WITH {S.PLACED}
SELECT capture_id, k, count(*) AS packets FROM placed GROUP BY 1, 2""")
def whole_windows_only(spark, folder):
    return placed(spark, folder).groupBy("capture_id", "k").agg(F.count("*").alias("packets"))


@query("min_window_packets", f"""
WITH {S.PLACED}
SELECT capture_id, k, count(*) AS packets FROM placed GROUP BY 1, 2 HAVING count(*) >= 2""")
def min_window_packets(spark, folder):
    counts = placed(spark, folder).groupBy("capture_id", "k").agg(F.count("*").alias("packets"))
    return counts.filter(F.col("packets") >= SPEC.min_window_packets)


@query("iat_lag", f"""
WITH {S.PLACED}, {S.GAPS}
SELECT capture_id, pkt_no, k, gap AS gap_us FROM gaps""")
def iat_lag(spark, folder):
    return W.packet_gaps(placed(spark, folder)).select("capture_id", "pkt_no", "k", "gap_us")


@query("sort_packets", f"""
WITH {S.PLACED}
SELECT capture_id, pkt_no,
       row_number() OVER (PARTITION BY capture_id ORDER BY us, pkt_no) AS packet_order
FROM placed""")
def sort_packets(spark, folder):
    return W.packet_order(placed(spark, folder)).select("capture_id", "pkt_no", "packet_order")


def _window_column(name: str, column: str):
    digits = S.DIGITS[column]
    sql = f"WITH {S.BASE} SELECT capture_id, k, round({column}, {digits}) AS {column} FROM base"

    @query(name, sql)
    def run(spark, folder):
        return rounded(base(spark, folder).select("capture_id", "k", column), **{column: digits})

    return run


_window_column("win_throughput", "throughput_kbps")
_window_column("win_avg_size", "avg_pkt_size_bytes")
_window_column("win_iat_mean", "inter_arrival_mean_us")
_window_column("win_iat_std", "inter_arrival_std_us")
_window_column("win_pkt_count", "flow_pkt_count")
_window_column("win_dl_ul_ratio", "dl_ul_ratio")


def _rolled(name: str, column: str):
    digits = S.DIGITS[column]
    sql = f"WITH {S.ROLL} SELECT capture_id, k, round({column}, {digits}) AS {column} FROM roll"

    @query(name, sql)
    def run(spark, folder):
        rolled = W.capped_rolling(base(spark, folder), SPEC)
        return rounded(rolled.select("capture_id", "k", column), **{column: digits})

    return run


_rolled("rolling_mean_5", "bitrate_mean_kbps")
_rolled("rolling_std_5", "bitrate_std_kbps")


@query("rolling_uncapped", f"""
WITH {S.BASE}, {S.rolling()}
SELECT capture_id, k, window_no, round(bitrate_mean_kbps, 6) AS bitrate_mean_kbps,
       round(bitrate_std_kbps, 5) AS bitrate_std_kbps FROM roll""")
def rolling_uncapped(spark, folder):
    rolled = W.capped_rolling(base(spark, folder), SPEC, chunk_windows=8)
    shown = rolled.select("capture_id", "k", "window_no", "bitrate_mean_kbps", "bitrate_std_kbps")
    return rounded(shown, bitrate_mean_kbps=6, bitrate_std_kbps=5)


@query("cap_windows", f"WITH {S.BASE}, {S.rolling(20)} SELECT capture_id, k, window_no FROM kept")
def cap_windows(spark, folder):
    return W.capped_rolling(base(spark, folder), replace(SPEC, cap=20)).select("capture_id", "k", "window_no")


@query("clip_features", f"""
WITH {S.FEATURES}
SELECT capture_id, k, {S.SHOWN} FROM feat""")
def clip_features(spark, folder):
    rolled = W.capped_rolling(base(spark, folder), SPEC)
    clipped = W.clip_features(rolled, SPEC).select("capture_id", "k", *FEATURES)
    return rounded(clipped, **S.DIGITS)


@query("project_features", f"WITH {S.FEATURES} SELECT {S.SHOWN}, traffic_class FROM feat")
def project_features(spark, folder):
    return rounded(features(spark, folder).select(*FEATURES, LABEL), **S.DIGITS)


@query("window_features", f"""
WITH {S.FEATURES} SELECT capture_id, k, {S.SHOWN}, traffic_class FROM feat""")
def window_features(spark, folder):
    return rounded(features(spark, folder), **S.DIGITS)


@query("window_features_by_stem", f"""
WITH {",".join([S.PACKETS, S.bounds("min(us)", "true"), S.placed("true"), S.GAPS,
                S.base(0.0, 0.1, 100.0), S.rolling(), S.features(0.1, 0.05, 200.0)])}
SELECT capture_id, k, {S.SHOWN}, traffic_class FROM feat""")
def window_features_by_stem(spark, folder):
    found = W.window_features(I.packets(spark, folder), I.EVENTS_BY_STEM)
    return rounded(found, **S.DIGITS)


@query("window_features_from_text", f"""
WITH {S.RAW},
pk AS (
  SELECT capture_id, event_id AS pkt_no, epoch_us(try_cast(time_text AS TIMESTAMP)) AS us,
         coalesce(try_cast(length_text AS DOUBLE), 0) AS len, user_id % 6 <> 5 AS uplink,
         user_id % 3 AS traffic_class
  FROM raw WHERE try_cast(time_text AS TIMESTAMP) IS NOT NULL
), {",".join([S.bounds(), S.placed(), S.GAPS, S.base(), S.rolling(), S.features()])}
SELECT capture_id, k, {S.SHOWN}, traffic_class FROM feat""")
def window_features_from_text(spark, folder):
    label = F.pmod("capture_id", F.lit(3)).cast("bigint")
    raw = I.raw_packets(spark, folder).withColumn(LABEL, label)
    # Text is parsed once; the windows read the typed columns more than once.
    packets = stage(P.typed_packets(raw, (LABEL,)), "packets")
    return rounded(W.window_features(packets, SPEC), **S.DIGITS)


@query("slice_scatter", f"""
WITH {S.FEATURES}
SELECT traffic_class, round(throughput_kbps, 6) AS throughput_kbps,
       round(inter_arrival_mean_us, 1) AS inter_arrival_mean_us FROM feat""")
def slice_scatter(spark, folder):
    points = features(spark, folder).select(LABEL, "throughput_kbps", "inter_arrival_mean_us")
    return rounded(points, throughput_kbps=6, inter_arrival_mean_us=1)


@query("path_keys", f"""
WITH {S.RAW}
SELECT DISTINCT path, lower(replace(string_split(path, '/')[-3], '-', '_')) AS category,
       string_split(path, '/')[-2] AS app FROM raw""")
def path_keys(spark, folder):
    from slicelens.sources.captures import with_path_keys

    paths = I.raw_packets(spark, folder).select("path").distinct()
    return with_path_keys(paths, "root").select("path", "category", "app")


_CATEGORY_SQL = """
m(category, traffic_class) AS (VALUES ('stored_streaming', 0), ('live_streaming', 0),
  ('video_conferencing', 0), ('game_streaming', 1), ('online_game', 1), ('metaverse', 2)),
inv AS (
  SELECT DISTINCT capture_id, lower(replace(string_split(path, '/')[-3], '-', '_')) AS category,
         string_split(path, '/')[-2] AS app FROM raw
)"""


@query("join_category_label", f"""
WITH {S.RAW}, {_CATEGORY_SQL}
SELECT capture_id, category, app, CAST(traffic_class AS BIGINT) AS traffic_class
FROM inv JOIN m USING (category)""")
def join_category_label(spark, folder):
    return inventory(spark, folder)


def inventory(spark, folder):
    from slicelens.sources.captures import label_categories, with_path_keys

    paths = I.raw_packets(spark, folder).select("capture_id", "path").distinct()
    return label_categories(with_path_keys(paths, "root")).select(
        "capture_id", "category", "app", LABEL
    )


@query("load_summary", f"""
WITH {S.RAW}, {_CATEGORY_SQL}, {S.FEATURES},
w AS (SELECT capture_id, count(*) AS windows FROM feat GROUP BY 1)
SELECT category, app, CAST(m.traffic_class AS BIGINT) AS traffic_class, count(*) AS files,
       count(windows) AS files_used, CAST(coalesce(sum(windows), 0) AS BIGINT) AS windows
FROM inv JOIN m USING (category) LEFT JOIN w USING (capture_id) GROUP BY 1, 2, 3""")
def load_summary(spark, folder):
    from slicelens.operators.summaries import load_summary

    return load_summary(inventory(spark, folder), features(spark, folder))


@query("load_summary_by_class", f"""
WITH {S.RAW}, {_CATEGORY_SQL}, {S.FEATURES},
w AS (SELECT capture_id, count(*) AS windows FROM feat GROUP BY 1)
SELECT CAST(m.traffic_class AS BIGINT) AS traffic_class, count(windows) AS files_used,
       CAST(coalesce(sum(windows), 0) AS BIGINT) AS windows
FROM inv JOIN m USING (category) LEFT JOIN w USING (capture_id) GROUP BY 1""")
def load_summary_by_class(spark, folder):
    from slicelens.operators import summaries

    return summaries.class_summary(
        summaries.load_summary(inventory(spark, folder), features(spark, folder))
    )


@query("join_stem_label", """
WITH f AS (SELECT DISTINCT c_mktsegment AS segment FROM customer),
stems(stem, traffic_class) AS (VALUES ('NaverNOW', 0), ('AfreecaTV', 0), ('YouTube', 0), ('Zoom', 0),
  ('MSteams', 0), ('GoogleMeet', 0), ('Cloudgaming', 1), ('Mobilegame', 1), ('Zepeto', 2), ('Roblox', 2)),
paths AS (SELECT CASE segment WHEN 'BUILDING' THEN 'root/Zoom.csv' WHEN 'AUTOMOBILE' THEN 'root/sub/zepeto.csv'
  WHEN 'MACHINERY' THEN 'root/ROBLOX.csv' WHEN 'HOUSEHOLD' THEN 'root/sub/YOUTUBE.csv'
  ELSE 'root/deep/er/MSteams.csv' END AS path FROM f)
SELECT s.stem, CAST(s.traffic_class AS BIGINT) AS traffic_class,
       (SELECT max(p.path) FROM paths p
        WHERE p.path IN ('root/' || s.stem || '.csv', 'root/' || lower(s.stem) || '.csv',
                         'root/' || upper(s.stem) || '.csv', 'root/sub/' || s.stem || '.csv',
                         'root/sub/' || lower(s.stem) || '.csv')) AS path
FROM stems s""")
def join_stem_label(spark, folder):
    from slicelens.sources.captures import find_stems

    place = {"BUILDING": "Zoom.csv", "AUTOMOBILE": "sub/zepeto.csv", "MACHINERY": "ROBLOX.csv",
             "HOUSEHOLD": "sub/YOUTUBE.csv"}
    segment = F.col("c_mktsegment")
    name = F.lit("deep/er/MSteams.csv")
    for value, file in place.items():
        name = F.when(segment == value, file).otherwise(name)
    paths = I.table(spark, folder, "customer").select(F.concat(F.lit("root/"), name).alias("path"))
    return find_stems(paths.distinct(), "root")


@query("join_slice_name", f"""
WITH {S.FEATURES}
SELECT traffic_class, CASE traffic_class WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice_name,
       count(*) AS windows FROM feat GROUP BY 1""")
def join_slice_name(spark, folder):
    from slicelens.operators.summaries import slice_names

    counted = features(spark, folder).groupBy(LABEL).agg(F.count("*").alias("windows"))
    return counted.join(F.broadcast(slice_names(spark)), LABEL).select(LABEL, "slice_name", "windows")


@query("union_captures", f"""
WITH {S.PACKETS}, o AS (
  SELECT o_custkey AS capture_id, o_orderkey AS pkt_no, epoch_us(o_orderdate) AS us, o_totalprice AS len FROM orders),
u AS (SELECT 'events' AS source, capture_id, pkt_no, us, len FROM pk
      UNION ALL SELECT 'orders', capture_id, pkt_no, us, len FROM o)
SELECT source, capture_id, count(*) AS packets, min(us) AS first_us, max(us) AS last_us,
       round(sum(len), 2) AS bytes FROM u GROUP BY 1, 2""")
def union_captures(spark, folder):
    orders = I.table(spark, folder, "orders")
    second = orders.select(
        F.lit("orders").alias("source"),
        F.col("o_custkey").alias("capture_id"),
        F.col("o_orderkey").alias("pkt_no"),
        epoch_micros(orders, "o_orderdate").alias("us"),
        F.col("o_totalprice").alias("len"),
    )
    first = I.packets(spark, folder).select(
        F.lit("events").alias("source"), "capture_id", "pkt_no", "us", "len"
    )
    both = first.unionByName(second).groupBy("source", "capture_id").agg(
        F.count("*").alias("packets"), F.min("us").alias("first_us"),
        F.max("us").alias("last_us"), F.sum("len").alias("bytes"),
    )
    return rounded(both, bytes=2)


@query("fmt_duration", f"""
WITH {S.PACKETS}, d AS (SELECT capture_id, (max(us) - min(us)) // 1000000 AS seconds FROM pk GROUP BY 1)
SELECT capture_id, seconds,
       CASE WHEN seconds >= 3600 THEN printf('%dh%02dm%02ds', seconds // 3600, seconds % 3600 // 60, seconds % 60)
            ELSE printf('%02dm%02ds', seconds % 3600 // 60, seconds % 60) END AS duration
FROM d""")
def fmt_duration(spark, folder):
    span = F.floor((F.max("us") - F.min("us")) / 1_000_000).alias("seconds")
    spans = I.packets(spark, folder).groupBy("capture_id").agg(span)
    return spans.withColumn("duration", text.duration_text(F.col("seconds")))
