"""Column expressions over raw packet text. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicelens.settings import PORT_PAIR

FOUR_INTEGERS = r"^\s*[+-]?\d+\s*(\.\s*[+-]?\d+\s*){3}$"
#: Date, then optionally hours and minutes, seconds, a fraction and a zone.
PACKET_TIME = (
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|UTC|[+-]\d{2}:?\d{2})?)?$"
)
ZONED = r":.*(Z|UTC|[+-]\d{2}:?\d{2})$"
#: Layouts with the name of the month, as capture tools export absolute times.
NAMED_TIMES = (
    "MMM d, yyyy HH:mm:ss[.SSSSSSSSS][ ]z", "MMMM d, yyyy HH:mm:ss[.SSSSSSSSS][ ]z",
    "d MMM yyyy HH:mm:ss[.SSSSSSSSS][ ]z",
)


def packet_micros(time: Column) -> Column:
    """Microseconds of a wall-clock text; NULL when it does not parse.

    Year, month and day, with ``-`` or ``/``; after a blank or ``T`` also hours
    and minutes, seconds, a fraction and a zone. Or a date with the month's name
    and hours, minutes and seconds. A text without zone is read as UTC, so that
    neither the session time zone nor daylight saving can move a gap. Fractions
    are cut to microseconds. The usual layout is one typed cast; only texts
    that it refuses come to the other layouts.
    """
    text = F.trim(time)
    # A text with a zone of its own is refused here. Without the dash a bare clock time would pass.
    usual = F.when(F.substring(text, 5, 1) == "-", F.concat(text, F.lit("Z")).try_cast("timestamp"))
    single = F.replace(text, F.lit("  "), F.lit(" "))
    named = [
        F.try_to_timestamp(t, F.lit(layout))
        for layout in NAMED_TIMES for t in (F.concat(single, F.lit("Z")), single)
    ]
    iso = F.translate(text, "/,", "-.")
    local = F.concat(iso.try_cast("timestamp_ntz").cast("string"), F.lit("Z"))
    other = F.unix_micros(F.when(text.rlike(ZONED), iso).otherwise(local).try_cast("timestamp"))
    return F.coalesce(
        F.unix_micros(usual),
        F.when(text.rlike(r"[A-Za-z]{3} "), F.unix_micros(F.coalesce(*named))),
        F.when(text.rlike(PACKET_TIME), other),
    )


def number(text: Column) -> Column:
    """Double of a numeric text; NULL for anything else, including NaN."""
    value = F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def packet_length(text: Column) -> Column:
    """Packet length with unreadable text counted as 0."""
    return F.coalesce(number(text), F.lit(0.0))


def is_private_ip(ip: Column) -> Column:
    """True for four integer octets in 10/8, 127/8, 172.16/12, 192.168/16, 192.0/16."""
    octets = F.split(ip, r"\.")
    first = F.trim(octets[0]).try_cast("bigint")
    second = F.trim(F.get(octets, F.lit(1))).try_cast("bigint")
    inside = (
        first.isin(10, 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & second.isin(0, 168))
    )
    return F.coalesce(ip.rlike(FOUR_INTEGERS) & inside, F.lit(False))


def dst_port(info: Column) -> Column:
    """Second integer of ``a > b`` in a packet summary; NULL when absent."""
    return F.regexp_extract(info, PORT_PAIR, 2).try_cast("bigint")


def category_key(folder: Column) -> Column:
    return F.replace(F.lower(folder), F.lit("-"), F.lit("_"))


def duration_text(seconds: Column) -> Column:
    """``1h02m03s`` from seconds, without the hour part when it is zero."""
    whole = seconds.cast("bigint")
    hours = F.floor(whole / 3600)
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    rest = F.pmod(whole, F.lit(60))
    short = F.format_string("%02dm%02ds", minutes, rest)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), short)).otherwise(short)
