import pytest
from pyspark.sql import functions as F

from slicelens.functions import text

ADDRESSES = {
    "10.0.0.1": True, "127.0.0.1": True, "172.16.0.1": True, "172.31.9.9": True,
    "172.32.0.1": False, "172.15.0.1": False, "192.168.1.1": True, "192.0.5.5": True,
    "192.1.0.1": False, "169.254.1.1": False, "10.999.1.1": True, "10.0.0": False,
    "10.0.0.0.1": False, "::1": False, None: False, "": False, "a.b.c.d": False,
    "10.1e2.0.0": False, "10.0.0.x": False, " 10.0.0.1 ": True, "11.0.0.1": False,
    "10.99999999999999999999.1.1": True, "172.99999999999999999999.1.1": False,
}


def evaluate(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in df.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_private_addresses(spark):
    assert evaluate(spark, ADDRESSES, text.is_private_ip) == list(ADDRESSES.values())


def test_destination_port(spark):
    cases = {"58632  >  443 [SYN]": 443, "1→2": 2, "none": None, None: None, "a > b": None,
             "x 5 > 6 7 > 8": 6}
    assert evaluate(spark, cases, text.dst_port) == list(cases.values())


def test_packet_time(spark):
    cases = {
        "2022-09-27 13:08:31.564846": 1664284111564846, "2022-09-27 13:08:31": 1664284111000000,
        " 2022-09-27 13:08:31.5 ": 1664284111500000, "2022": None, "bad": None, None: None,
        "2022-02-30 00:00:00": None, "2022-03-13 02:30:00.000001": 1647138600000001,
    }
    assert evaluate(spark, cases, text.packet_micros) == list(cases.values())


def test_packet_time_ignores_session_zone(spark):
    cases = {
        "2022-03-13 02:30:00.000001": 1647138600000001, "2022/03/13 02:30:00.000001": 1647138600000001,
        "2022-3-13 02:30": 1647138600000000, "Mar 13, 2022 02:30:00.000001": 1647138600000001,
    }
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, cases, text.packet_micros) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_packet_length(spark):
    cases = {"60": 60.0, " 60 ": 60.0, "1.5": 1.5, "?": 0.0, None: 0.0, "nan": 0.0, "": 0.0, "7d": 0.0}
    assert evaluate(spark, cases, text.packet_length) == list(cases.values())


@pytest.mark.parametrize("seconds, shown", [
    (0, "00m00s"), (59.9, "00m59s"), (1831.0, "30m31s"), (39583.2, "10h59m43s"), (3600.0, "1h00m00s"),
])
def test_duration(spark, seconds, shown):
    assert evaluate(spark, [float(seconds)], text.duration_text, "double") == [shown]


def test_time_layouts(spark):
    base = 1_654_014_178_000_000  # 2022-05-31 16:22:58 UTC
    cases = {
        "2022-05-31 16:22:58.123456": base + 123_456, "2022-05-31T16:22:58.123456": base + 123_456,
        "2022-05-31 16:22:58.123456789": base + 123_456, "2022/05/31 16:22:58": base,
        "2022-5-31 16:22": base - 58_000_000, "2022-05-31": base - (16 * 3600 + 22 * 60 + 58) * 1_000_000,
        "2022-05-31T18:22:58+02:00": base, "2022-05-31T18:22:58.5+0200": base + 500_000,
        "2022-05-31T16:22:58Z": base, "  2022-05-31 16:22:58 UTC ": base,
        "May 31, 2022 16:22:58.123456000": base + 123_456, "May 31, 2022 16:22:58": base,
        "May 31, 2022 16:22:58.5 UTC": base + 500_000, "May 31, 2022 18:22:58.5 +02:00": base + 500_000,
        "Jun  1, 2022 16:22:58": base + 86_400_000_000, "June 1, 2022 16:22:58": base + 86_400_000_000,
        "31 May 2022 16:22:58.25": base + 250_000, "Foo 31, 2022 16:22:58": None, "May 31, 2022": None,
        "2022-05-31 16:22:58,123456": base + 123_456, "2022-05": None, "T16:22:58": None, "2022-05-31 16": None,
        "2022/5/31 16:22:58 +02:00": base - 7_200_000_000, "2022-05-31 6:22:58": base - 36_000_000_000,
        "2022-13-31 16:22:58": None, "n/a": None, "16:22:58": None, "": None, None: None, "2022-05-31 25:00": None,
    }
    assert evaluate(spark, cases, text.packet_micros) == list(cases.values())
