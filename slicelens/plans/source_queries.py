"""Source and sink queries: ``events`` and others are written out as files and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.functions.maths import epoch_micros
from slicelens.operators import curves, metrics, summaries
from slicelens.operators import packets as P
from slicelens.operators import windows as W
from slicelens.operators.joins import scratch_path, stage
from slicelens.plans import inputs as I
from slicelens.plans import metric_queries as M
from slicelens.plans import sql as S
from slicelens.plans.packet_queries import features
from slicelens.plans.registry import query, rounded
from slicelens.settings import FEATURES, LABEL
from slicelens.sources import captures, sinks, tabular

_TREE_SQL = f"""
WITH {S.RAW},
m(category, traffic_class) AS (VALUES ('stored_streaming', 0), ('live_streaming', 0),
  ('video_conferencing', 0), ('game_streaming', 1), ('online_game', 1), ('metaverse', 2)),
pk AS (
  SELECT concat(category, '/', app) AS capture_id, category, app, event_id AS pkt_no,
         epoch_us(try_cast(time_text AS TIMESTAMP)) AS us,
         coalesce(try_cast(length_text AS DOUBLE), 0) AS len, user_id % 6 <> 5 AS uplink,
         CAST(traffic_class AS BIGINT) AS traffic_class
  FROM (SELECT *, lower(replace(string_split(path, '/')[-3], '-', '_')) AS category,
               concat('App_', user_id) AS app FROM raw) JOIN m USING (category)
  WHERE try_cast(time_text AS TIMESTAMP) IS NOT NULL
)"""


def write_tree(spark, folder) -> str:
    """``events`` as a tree of capture files ``category/app/*.csv``, one per user."""
    root = scratch_path(spark, "tree")
    raw = I.raw_packets(spark, folder)
    rows = raw.select(
        F.col("pkt_no").alias(" No. "), F.col("Time").alias("Time "), "Source",
        "Destination", "Protocol", F.col("Length").alias(" Length"), "Info",
        F.element_at(F.split("path", "/"), -3).alias("category"),
        F.concat(F.lit("App_"), F.col("capture_id").cast("string")).alias("app"),
    )
    captures.write_capture_files(rows, root, ["category", "app"], [F.col("` No. `").cast("bigint")])
    return root


def typed_tree(spark, folder):
    """File inventory and staged packets: the text is parsed once, then read as columns."""
    root = write_tree(spark, folder)
    files = captures.capture_files(spark, root)
    raw = captures.scan_capture_tree(spark, root, files)
    return files, stage(P.typed_packets(raw, (LABEL,)), "packets")


@query("scan_capture_tree", f"""
{_TREE_SQL}
SELECT category, app, traffic_class, count(*) AS packets, min(us) AS first_us, max(us) AS last_us,
       round(sum(len), 2) AS bytes, count(*) FILTER (WHERE uplink) AS uplinks FROM pk GROUP BY 1, 2, 3""")
def scan_capture_tree(spark, folder):
    files, packets = typed_tree(spark, folder)
    found = packets.groupBy("capture_id", LABEL).agg(
        F.count("*").alias("packets"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.sum("len").alias("bytes"), F.count_if("uplink").alias("uplinks"),
    )
    named = captures.with_capture_names(found, files).drop("capture_id", "path")
    return rounded(named, bytes=2)


@query("scan_to_features", f"""
{_TREE_SQL}, {",".join([S.bounds(), S.placed(), S.GAPS, S.base(), S.rolling(), S.features()])},
names AS (SELECT DISTINCT capture_id, category, app FROM pk)
SELECT category, app, k, {S.SHOWN}, traffic_class FROM feat JOIN names USING (capture_id)""")
def scan_to_features(spark, folder):
    files, packets = typed_tree(spark, folder)
    found = W.window_features(packets, I.EVENTS)
    named = captures.with_capture_names(found, files).drop("capture_id", "path")
    return rounded(named, **S.DIGITS)


@query("scan_packet_csv", f"""
WITH {S.RAW}
SELECT time_text, source, length_text, info
FROM raw WHERE string_split(path, '/')[-3] <> 'Other'""")
def scan_packet_csv(spark, folder):
    root = write_tree(spark, folder)
    raw = captures.scan_capture_tree(spark, root, captures.capture_files(spark, root))
    return raw.select(
        F.col("Time").alias("time_text"), F.col("Source").alias("source"),
        F.col("Length").alias("length_text"), F.col("Info").alias("info"),
    )


#: Header styles of capture files: what each leaves out.
LACKING = ((), ("Length",), ("Source", "Destination"), ("Time", "Length"))

_STYLES = """
f AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT user_id, (['', 'Length', 'Source,Destination', 'Time,Length'])[user_id % 4 + 1] AS lacking,
             (['No.|Time|Source|Destination|Protocol|Length|Info', 'No.|Time|Source|Destination|Protocol|Info',
               'No.|Time|Protocol|Length|Info', 'No.|Source|Destination|Protocol|Info'])[user_id % 4 + 1] AS header
      FROM f)"""


def write_lacking(spark, folder) -> str:
    """``events`` as capture files of which three in four lack columns, ``metaverse/style=<n>/app=<user>``."""
    root = scratch_path(spark, "lacking")
    raw = I.raw_packets(spark, folder)
    names = ["pkt_no", "Time", "Source", "Destination", "Protocol", "Length", "Info"]
    for style, lacking in enumerate(LACKING):
        rows = raw.filter(F.pmod("capture_id", F.lit(len(LACKING))) == style).select(
            *[F.col(n).alias(" No. " if n == "pkt_no" else n) for n in names if n not in lacking],
            F.col("capture_id").alias("app"),
        )
        captures.write_capture_files(rows, f"{root}/Metaverse/style{style}", ["app"])
    return root


@query("header_inventory", f"""
WITH {_STYLES}
SELECT 'metaverse' AS category, CAST(user_id AS VARCHAR) AS app, header,
       len(string_split(lacking, ',')) - CASE WHEN lacking = '' THEN 1 ELSE 0 END AS missing, lacking = '' AS usable FROM s""")
def header_inventory(spark, folder):
    files = captures.capture_files(spark, write_lacking(spark, folder))
    missing = F.size(captures.missing_columns(F.col("header"))).cast("bigint")
    return files.select(
        "category", "app", F.array_join("header", "|").alias("header"), missing.alias("missing"), "usable"
    )


@query("missing_columns", f"""
WITH {_STYLES}, r AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT lacking AS missing, count(*) AS files, CAST(sum(CASE WHEN lacking = '' THEN n ELSE 0 END) AS BIGINT) AS packets_read
FROM (SELECT user_id, CASE lacking WHEN 'Time,Length' THEN 'Time,Length' ELSE lacking END AS lacking FROM s)
JOIN r USING (user_id) GROUP BY 1""")
def missing_columns(spark, folder):
    """Which required columns files lack, and the packets read of those that lack none."""
    root = write_lacking(spark, folder)
    files = captures.capture_files(spark, root)
    read = captures.scan_capture_tree(spark, root, files).groupBy("capture_id").agg(F.count("*").alias("n"))
    return (
        files.withColumn("missing", F.array_join(captures.missing_columns(F.col("header")), ","))
        .join(read, "capture_id", "left").groupBy("missing")
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("packets_read"))
    )


HEADERS = (("Time_S", " Pkt_Len", "dport"), ("timestamp", "IP_LEN ", "dst port"), ("time", "length", "note"))


def write_aliased(spark, folder) -> str:
    """``events`` as one file per user, in three header styles."""
    root = scratch_path(spark, "aliased")
    events = I.table(spark, folder, "events")
    seconds = epoch_micros(events, "ts") / 1e6
    for style, (time, length, port) in enumerate(HEADERS):
        rows = events.filter(F.pmod("user_id", F.lit(3)) == style).select(
            F.col("event_type").alias("kind"), seconds.cast("decimal(20,6)").alias(time),
            F.col("value").alias(length),
            F.pmod("event_id", F.lit(2048)).alias(port), "user_id",
        )
        captures.write_capture_files(rows, f"{root}/style{style}", ["user_id"])
    return root


@query("alias_columns", """
WITH f AS (SELECT DISTINCT user_id FROM events)
SELECT 1::BIGINT AS at_time, 2::BIGINT AS at_length,
       CASE WHEN user_id % 3 = 2 THEN -1 ELSE 3 END::BIGINT AS at_dst_port, count(*) AS files
FROM f GROUP BY 1, 2, 3""")
def alias_columns(spark, folder):
    files = captures.header_inventory(captures.list_files(spark, write_aliased(spark, folder)))
    header = F.col("header")
    names = ("time", "length", "dst_port")
    found = [captures.alias_position(header, n).cast("bigint").alias(f"at_{n}") for n in names]
    return files.select(*found).groupBy(*[f"at_{n}" for n in names]).agg(F.count("*").alias("files"))


STEMS = ("NaverNOW", "afreecatv", "YOUTUBE", "Zoom", "msteams", "GoogleMeet", "CLOUDGAMING",
         "Mobilegame", "zepeto", "Roblox")


def write_stems(spark, folder) -> str:
    """``events`` as one CSV table per application stem, some in a sub-folder."""
    root = scratch_path(spark, "stems")
    events = I.table(spark, folder, "events")
    seconds = (epoch_micros(events, "ts") - 1_704_067_200_000_000) / 1e6
    for i, name in enumerate(STEMS):
        place = f"{root}/extra/{name}.csv" if name == "zepeto" else f"{root}/{name}.csv"
        (
            events.filter(F.pmod("user_id", F.lit(len(STEMS))) == i)
            .select(
                seconds.cast("decimal(20,6)").alias("Time_S"),
                F.col("value").alias("pkt_len"),
                F.pmod("event_id", F.lit(2048)).alias("dport"),
            )
            .write.option("header", True).csv(place)
        )
    return root


_STEM_DIGITS = {**S.DIGITS, "inter_arrival_mean_us": -1, "inter_arrival_std_us": -1}


@query("scan_by_stem", f"""
WITH pk AS (
  SELECT (['NaverNOW', 'AfreecaTV', 'YouTube', 'Zoom', 'MSteams', 'GoogleMeet', 'Cloudgaming', 'Mobilegame',
           'Zepeto', 'Roblox'])[user_id % 10 + 1] AS capture_id, event_id AS pkt_no, epoch_us(ts) AS us, value AS len,
         event_id % 2048 < 1024 AS uplink,
         (CASE WHEN user_id % 10 < 6 THEN 0 WHEN user_id % 10 < 8 THEN 1 ELSE 2 END)::BIGINT AS traffic_class
  FROM events
), {",".join([S.bounds("min(us)", "true"), S.placed("true"), S.GAPS, S.base(0.0, 0.1, 100.0),
              S.rolling(), S.features(0.1, 0.05, 200.0)])}
SELECT capture_id, k, {", ".join(f"round({c}, {d}) AS {c}" for c, d in _STEM_DIGITS.items())}, traffic_class FROM feat""")
def scan_by_stem(spark, folder):
    raw = captures.scan_by_stem(spark, write_stems(spark, folder))
    packets = stage(P.typed_port_packets(raw, (LABEL,)), "stem-packets")
    return rounded(W.window_features(packets, I.EVENTS_BY_STEM), **_STEM_DIGITS)


@query("scan_tabular_csv", """
SELECT l_returnflag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity,
       round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""")
def scan_tabular_csv(spark, folder):
    path = scratch_path(spark, "table")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    written = I.table(spark, folder, "lineitem").select(*columns)
    written.write.option("header", True).csv(path)
    back = tabular.scan_tabular_csv(spark, path)
    totals = back.groupBy(back.columns[-1]).agg(
        F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
    )
    return rounded(totals, quantity=2, price=2)


_REPORT = {
    "history": "SELECT val_acc AS v FROM hist",
    "confusion": "SELECT n * (3 * y_true + y_pred + 1) AS v FROM cells",
    "roc": "SELECT fpr + tpr AS v FROM pts",
    "metrics": 'SELECT "precision" + recall + f1 AS v FROM prf',
    "correlation": " UNION ALL ".join(f"SELECT corr({a}, {b}) AS v FROM feat" for a in FEATURES for b in FEATURES),
    "histogram": "SELECT n * (bin + 1) AS v FROM hg",
}


@query("sink_report_tables", f"""
WITH {S.FEATURES}, {M.PRF}{M.LONG[len(M.PRED):]}, {M.HISTORY},
hr AS (SELECT traffic_class, min(avg_pkt_size_bytes) AS lo, max(avg_pkt_size_bytes) AS hi FROM feat GROUP BY 1),
hc AS (SELECT traffic_class, least(CAST(floor((avg_pkt_size_bytes - lo) / ((hi - lo) / 25)) AS BIGINT), 24) AS bin,
              count(*) AS n FROM feat JOIN hr USING (traffic_class) GROUP BY 1, 2),
hb AS (SELECT traffic_class, unnest(range(25)) AS bin FROM hr),
hg AS (SELECT hb.bin, coalesce(n, 0) AS n FROM hb LEFT JOIN hc ON hb.traffic_class = hc.traffic_class AND hb.bin = hc.bin)
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS report, count(*) AS rows, round(CAST(sum(v) AS DOUBLE), 3) AS total FROM ({sql})"
    for name, sql in _REPORT.items()
))
def sink_report_tables(spark, folder):
    """All six tables of a report, committed together and read back."""
    found = stage(features(spark, folder), "features")
    cells = M.cells(spark, folder)
    tables = {
        "history": M.epoch_history(spark, folder),
        "confusion": cells,
        "roc": curves.roc_curve(M.scored(spark, folder)),
        "metrics": metrics.per_class_prf(cells),
        "correlation": summaries.feature_correlation(found),
        "histogram": summaries.class_histogram(found, "avg_pkt_size_bytes"),
    }
    place = scratch_path(spark, "report")
    sinks.write_report(tables, place)
    value = {
        "history": F.col("val_acc"), "confusion": F.expr("n * (3 * y_true + y_pred + 1)"), "roc": F.expr("fpr + tpr"),
        "metrics": F.expr("precision + recall + f1"), "correlation": F.col("correlation"),
        "histogram": F.expr("n * (bin + 1)"),
    }
    shown = [
        df.agg(F.count("*").alias("rows"), F.round(F.sum(value[name]).cast("double"), 3).alias("total"))
        .select(F.lit(name).alias("report"), "rows", "total")
        for name, df in sinks.read_report(spark, place).items()
    ]
    return reduce(DataFrame.unionByName, shown)
