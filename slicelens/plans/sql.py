"""Shared common table expressions of the checking SQL.

They are written the plain way, one window per capture, on purpose: they check
the distributed formulation against an independent one.
"""

from __future__ import annotations

DAY = 86_400_000_000

PACKETS = """
pk AS (
  SELECT user_id AS capture_id, event_id AS pkt_no, epoch_us(ts) AS us, value AS len,
         event_type IN ('click', 'signup', 'purchase') AS uplink, user_id % 3 AS traffic_class
  FROM events
)"""

RAW = """
raw AS (
  SELECT user_id AS capture_id, CAST(event_id AS VARCHAR) AS pkt_no,
         CASE WHEN event_id % 41 = 7 THEN 'n/a'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS time_text,
         concat((['10.20', '127.0', '172.16', '192.168', '192.0', '8.8'])[user_id % 6 + 1],
                '.1.', event_id % 256) AS source,
         CASE WHEN event_id % 37 = 5 THEN '?' ELSE CAST(value AS VARCHAR) END AS length_text,
         concat(event_id % 65536, '  >  ', (user_id * 97) % 2048, ' [ACK]') AS info,
         concat('root/', (['Stored-Streaming', 'Live_Streaming', 'Video-Conferencing',
                'Game-Streaming', 'Online_Game', 'Metaverse', 'Other'])[user_id % 7 + 1],
                '/App_', user_id % 5, '/', user_id, '.csv') AS path,
         ts, value, user_id, event_id
  FROM events
)"""


def bounds(anchor: str = "arg_min(us, pkt_no)", valid: str = "len > 0") -> str:
    return f"""
b AS (
  SELECT capture_id, {anchor} AS t0, max(us) FILTER (WHERE {valid}) AS t_last,
         count(*) FILTER (WHERE {valid}) AS n_packets
  FROM pk GROUP BY capture_id HAVING count(*) FILTER (WHERE {valid}) >= 10
)"""


def placed(valid: str = "len > 0") -> str:
    return f"""
placed AS (
  SELECT pk.*, us - t0 AS rel_us, (us - t0) // {DAY} AS k
  FROM pk JOIN b USING (capture_id)
  WHERE {valid} AND us >= t0 AND ((us - t0) // {DAY} + 1) * {DAY} <= t_last - t0
)"""


GAPS = """
gaps AS (
  SELECT *, us - lag(us) OVER (PARTITION BY capture_id, k ORDER BY us, pkt_no) AS gap
  FROM placed
)"""


def base(bonus: float = 1.0, low: float = 0.01, high: float = 1000.0) -> str:
    up = "sum(CASE WHEN uplink THEN len ELSE 0 END)"
    down = "sum(CASE WHEN NOT uplink THEN len ELSE 0 END)"
    return f"""
base AS (
  SELECT capture_id, k, any_value(traffic_class) AS traffic_class,
         sum(len) * 8.0 / 1000.0 AS throughput_kbps, avg(len) AS avg_pkt_size_bytes,
         avg(gap) AS inter_arrival_mean_us,
         CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0.0 END AS inter_arrival_std_us,
         CAST(count(*) AS DOUBLE) AS flow_pkt_count,
         least(greatest(CASE WHEN {up} > 0 THEN {down} / {up} ELSE {down} + {bonus} END,
                        {low}), {high}) AS dl_ul_ratio
  FROM gaps GROUP BY capture_id, k HAVING count(*) >= 2
)"""


def rolling(cap: int | None = None) -> str:
    cut = "" if cap is None else f"QUALIFY window_no <= {cap}"
    return f"""
kept AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY k) AS window_no FROM base
  {cut}
),
roll AS (
  SELECT *,
         avg(throughput_kbps) OVER f AS bitrate_mean_kbps,
         coalesce(stddev_samp(throughput_kbps) OVER f, 0.0) AS bitrate_std_kbps
  FROM kept
  WINDOW f AS (PARTITION BY capture_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
)"""


def features(iat: float = 0.01, low: float = 0.01, high: float = 1000.0) -> str:
    return f"""
feat AS (
  SELECT capture_id, k, traffic_class,
         greatest(throughput_kbps, 1.0) AS throughput_kbps,
         least(greatest(avg_pkt_size_bytes, 20.0), 1500.0) AS avg_pkt_size_bytes,
         greatest(inter_arrival_mean_us, {iat}) AS inter_arrival_mean_us,
         greatest(inter_arrival_std_us, 0.0) AS inter_arrival_std_us,
         greatest(flow_pkt_count, 1.0) AS flow_pkt_count,
         least(greatest(dl_ul_ratio, {low}), {high}) AS dl_ul_ratio,
         greatest(bitrate_mean_kbps, 0.1) AS bitrate_mean_kbps,
         greatest(bitrate_std_kbps, 0.0) AS bitrate_std_kbps
  FROM roll
)"""


PLACED = ",".join([PACKETS, bounds(), placed()])
BASE = ",".join([PLACED, GAPS, base()])
ROLL = ",".join([BASE, rolling()])
FEATURES = ",".join([ROLL, features()])
KEYED = FEATURES + """,
keyed AS (SELECT *, md5(concat_ws(':', capture_id, k, 42)) AS shuffle_key FROM feat)"""

DIGITS = {
    "throughput_kbps": 6,
    "avg_pkt_size_bytes": 6,
    "inter_arrival_mean_us": 1,
    "inter_arrival_std_us": 0,
    "flow_pkt_count": 6,
    "dl_ul_ratio": 6,
    "bitrate_mean_kbps": 6,
    "bitrate_std_kbps": 5,
}
SHOWN = ", ".join(f"round({c}, {d}) AS {c}" for c, d in DIGITS.items())
