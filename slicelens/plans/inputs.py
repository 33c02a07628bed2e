"""The given tables read as the inputs of the library: packets, predictions, history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelens.functions.maths import epoch_micros
from slicelens.settings import BY_STEM, LABEL, TREE

DAY_US = 86_400_000_000
EVENTS = replace(TREE, width_us=DAY_US)
EVENTS_BY_STEM = replace(BY_STEM, width_us=DAY_US)
UPLINK_TYPES = ("click", "signup", "purchase")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as typed packets: one capture per user."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("capture_id"),
        F.col("event_id").alias("pkt_no"),
        epoch_micros(events, "ts").alias("us"),
        F.col("value").alias("len"),
        F.col("event_type").isin(*UPLINK_TYPES).alias("uplink"),
        F.pmod("user_id", F.lit(3)).cast("bigint").alias(LABEL),
    )


def raw_packets(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as the text rows of a packet capture, with some unreadable cells."""
    e = table(spark, folder, "events")
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("10.20", "127.0", "172.16", "192.168", "192.0", "8.8")]),
        (F.pmod("user_id", F.lit(6)) + 1).cast("int"),
    )
    tail = F.pmod("event_id", F.lit(256)).cast("string")
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(
        F.col("user_id").alias("capture_id"),
        F.col("event_id").cast("string").alias("pkt_no"),
        F.when(F.pmod("event_id", F.lit(41)) == 7, "n/a").otherwise(clock).alias("Time"),
        F.concat_ws(".", prefix, F.lit("1"), tail).alias("Source"),
        F.lit("8.8.4.4").alias("Destination"),
        F.col("event_type").alias("Protocol"),
        F.when(F.pmod("event_id", F.lit(37)) == 5, "?")
        .otherwise(F.col("value").cast("string")).alias("Length"),
        F.concat(
            F.pmod("event_id", F.lit(65536)).cast("string"), F.lit("  >  "),
            F.pmod(F.col("user_id") * 97, F.lit(2048)).cast("string"), F.lit(" [ACK]"),
        ).alias("Info"),
        F.concat(
            F.lit("root/"),
            F.element_at(
                F.array(*[F.lit(c) for c in (
                    "Stored-Streaming", "Live_Streaming", "Video-Conferencing",
                    "Game-Streaming", "Online_Game", "Metaverse", "Other",
                )]),
                (F.pmod("user_id", F.lit(7)) + 1).cast("int"),
            ),
            F.lit("/App_"), F.pmod("user_id", F.lit(5)).cast("string"), F.lit("/"),
            F.col("user_id").cast("string"), F.lit(".csv"),
        ).alias("path"),
    )
