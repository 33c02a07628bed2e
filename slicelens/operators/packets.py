"""From raw packet rows to typed packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.functions import text


def typed_packets(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed packets of the address-direction layout.

    ``raw`` holds text columns ``capture_id, pkt_no, Time, Source, Length``.
    Rows without a readable time are dropped; an unreadable length becomes 0
    and is dropped later, after the capture's first row has been found. A
    ``broken`` mark is kept, whatever its row holds, to reject its capture.
    """
    flag = ["broken"] if "broken" in raw.columns else []
    return raw.select(
        "capture_id",
        F.col("pkt_no").try_cast("bigint").alias("pkt_no"),
        text.packet_micros(F.col("Time")).alias("us"),
        text.packet_length(F.col("Length")).alias("len"),
        text.is_private_ip(F.col("Source")).alias("uplink"),
        *flag,
        *keep,
    ).filter("us IS NOT NULL OR broken" if flag else "us IS NOT NULL")


def typed_port_packets(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed packets of the port-direction layout (relative seconds as text).

    ``raw`` holds text columns ``time, length, dst_port`` and the flag
    ``has_port`` of the file. Any row with an unreadable cell is dropped, a zero
    length is kept. Without a port column ``uplink`` stays NULL.
    """
    flag = ["broken"] if "broken" in raw.columns else []
    port = text.number(F.col("dst_port"))
    readable = F.col("us").isNotNull() & F.col("len").isNotNull()
    readable &= ~F.col("has_port") | F.col("uplink").isNotNull()
    return (
        raw.select(
            "capture_id",
            F.col("pkt_no").try_cast("bigint").alias("pkt_no"),
            (text.number(F.col("time")) * 1e6).alias("us"),
            text.number(F.col("length")).alias("len"),
            (port < 1024).alias("uplink"),
            "has_port",
            *flag,
            *keep,
        )
        .filter(readable | F.col("broken") if flag else readable)
        .drop("has_port")
    )
