"""Per-capture feature windows.

Packets are shuffled once, on (capture, window, slice); everything after that
works on one row per slice or per window. A capture of any size is spread over
many tasks because its windows are separate groups, and a window with very many
packets is cut into slices at sampled packets, so that a burst is cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelens.functions.maths import clip
from slicelens.operators.joins import attach, stage
from slicelens.operators.ordering import ranks, running_totals
from slicelens.settings import FEATURES, LABEL, WindowSpec

#: Packets of a slice, about; a window with no more of them is one slice.
SLICE_PACKETS = 1 << 20
#: Sampled packets a slice: the cuts are that much finer than the slices.
SLICE_SAMPLE = 64
CHUNK_WINDOWS = 4096


def capture_bounds(packets: DataFrame, spec: WindowSpec) -> DataFrame:
    """Per capture: anchor time, last time, packet count.

    Short captures are dropped, and those with a row marked ``broken``.
    """
    valid = F.lit(True) if spec.keep_zero_length else F.col("len") > 0
    anchor = F.min_by("us", "pkt_no") if spec.anchor == "first_row" else F.min("us")
    marked = "broken" in packets.columns
    bounds = packets.groupBy("capture_id").agg(
        anchor.alias("t0"),
        F.max(F.when(valid, F.col("us"))).alias("t_last"),
        F.count_if(valid).alias("n_packets"),
        (F.bool_or("broken") if marked else F.lit(False)).alias("broken"),
    )
    enough = F.col("n_packets") >= spec.min_capture_packets
    return bounds.filter(enough & ~F.col("broken")).drop("broken")


def _numbered(packets: DataFrame, bounds: DataFrame, spec: WindowSpec, whole_only: bool) -> DataFrame:
    """Packets of the captures in ``bounds`` with their relative time and window ``k``."""
    width = spec.width_us
    numbered = (
        attach(packets, bounds, ["capture_id"])
        .withColumn("rel_us", F.col("us") - F.col("t0"))
        .filter("rel_us >= 0")
        .withColumn("k", F.floor(F.col("rel_us") / width))
    )
    if whole_only:
        numbered = numbered.filter((F.col("k") + 1) * width <= F.col("t_last") - F.col("t0"))
    return numbered.drop("t0", "t_last")


def slice_cuts(packets: DataFrame, bounds: DataFrame, spec: WindowSpec, slice_packets: int) -> DataFrame:
    """``capture_id, k, cuts``: where the windows with more than ``slice_packets`` packets are cut.

    ``cuts`` holds the first (time, number) of every slice but the first, from a
    sample of the window by hash. Only captures with that many packets are
    counted; where there is none, no packet is read.
    """
    large = bounds.filter(F.col("n_packets") > slice_packets)
    rate = max(1, slice_packets // SLICE_SAMPLE)
    at = F.struct("us", "pkt_no")
    drawn = F.pmod(F.xxhash64("us", "pkt_no"), F.lit(rate)) == 0
    counted = (
        _numbered(packets.select("capture_id", "us", "pkt_no"), large, spec, whole_only=False)
        .groupBy("capture_id", "k")
        .agg(F.count("*").alias("n"), F.collect_list(F.when(drawn, at)).alias("sample"))
        .filter(F.col("n") > slice_packets)
    )
    slices = F.ceil(F.col("n") / slice_packets).cast("int")
    size = F.size("sample")
    steps = F.sequence(F.lit(1), F.greatest(slices - 1, F.lit(1)))
    cuts = F.transform(steps, lambda i: F.get(F.array_sort("sample"), F.floor(i * size / slices).cast("int")))
    return counted.select("capture_id", "k", F.array_distinct(F.array_compact(cuts)).alias("cuts"))


def _slice_of(cuts: Column, at: Column) -> Column:
    """How many of the sorted ``cuts`` are not behind ``at``, by bisection; 0 without cuts."""
    size = F.size(cuts)
    bits = F.ceil(F.log2(size + 1)).cast("int")
    step = F.sequence(bits - 1, F.lit(0), F.lit(-1))

    def taken(found: Column, bit: Column) -> Column:
        try_at = found + F.call_function("shiftleft", F.lit(1), bit)
        held = (try_at <= size) & (F.get(cuts, try_at - 1) <= at)
        return F.when(held, try_at).otherwise(found)

    return F.when(cuts.isNull() | (size == 0), 0).otherwise(F.aggregate(step, F.lit(0), taken))


def place(
    packets: DataFrame, spec: WindowSpec, whole_only: bool = True, slice_packets: int | None = None
) -> DataFrame:
    """Give every packet its relative time, window ``k`` and slice.

    Windows start at the capture's own anchor. Packets before it, and those of
    the unfinished last window, belong to no window. A window of more than
    ``slice_packets`` packets is cut into slices that follow its packets in
    order of time and number, so that no sort group grows with it; ``opens``
    marks the packets at a cut.
    """
    limit = SLICE_PACKETS if slice_packets is None else slice_packets
    bounds = stage(capture_bounds(packets, spec), "bounds")
    if not spec.keep_zero_length:
        packets = packets.filter("len > 0")
    cuts = slice_cuts(packets, bounds, spec, limit)
    placed = attach(_numbered(packets, bounds, spec, whole_only), cuts, ["capture_id", "k"], "left")
    at = F.struct("us", "pkt_no")
    opens = (F.col("slice") > 0) & (F.get("cuts", F.col("slice") - 1) == at)
    return (
        placed.withColumn("slice", _slice_of(F.col("cuts"), at))
        .withColumn("opens", F.coalesce(opens, F.lit(False))).drop("cuts")
    )


def packet_gaps(placed: DataFrame) -> DataFrame:
    """Gap in microseconds to the previous packet of the same window, per packet.

    One scan and one shuffle, by slice. A packet that opens a slice also closes
    the one before: there it finds its gap, in its own slice it only gives the
    next packet one.
    """
    own = F.col("slice")
    copies = F.when(F.col("opens"), F.array(own - 1, own)).otherwise(F.array(own))
    slot = Window.partitionBy("capture_id", "k", "_in").orderBy("us", "pkt_no")
    return (
        placed.withColumn("_in", F.explode(copies))
        .withColumn("gap_us", F.col("us") - F.lag("us").over(slot))
        .filter(~F.col("opens") | (F.col("_in") < own)).drop("_in")
    )


def packet_order(placed: DataFrame) -> DataFrame:
    """Add ``packet_order``, the one-based rank of a packet in its capture by time and number.

    Ranges of (capture, time, number) come from sampled splitters, so a hot
    capture, window or burst is spread over as many tasks as its packets need.
    """
    ranked = ranks(placed, ["capture_id"], [F.col("us"), F.col("pkt_no")])
    return ranked.withColumnRenamed("rank", "packet_order")


def _slice_stats(placed: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    slot = Window.partitionBy("capture_id", "k", "slice").orderBy("rel_us", "pkt_no")
    gap = (F.col("rel_us") - F.lag("rel_us").over(slot)).cast("double")
    return (
        placed.withColumn("_gap", gap)
        .groupBy("capture_id", "k", "slice")
        .agg(
            F.count("*").alias("n"),
            F.sum("len").alias("bytes"),
            F.sum(F.when(F.col("uplink"), F.col("len")).otherwise(0.0)).alias("up"),
            F.sum(F.when(~F.col("uplink"), F.col("len")).otherwise(0.0)).alias("down"),
            F.count("uplink").alias("directed"),
            F.min("rel_us").alias("first"),
            F.max("rel_us").alias("last"),
            (F.coalesce(F.var_pop("_gap"), F.lit(0.0)) * F.count("_gap")).alias("spread"),
            *[F.any_value(c).alias(c) for c in carried],
        )
    )


def base_windows(
    placed: DataFrame, spec: WindowSpec, carried: tuple[str, ...] = ()
) -> DataFrame:
    """The six per-window features, before rolling, capping and clipping.

    Slice moments are merged exactly: each slice adds the spread of its own
    gaps, its distance from the window mean, and the gap that crosses into it.
    """
    slices = _slice_stats(placed, carried)
    window = Window.partitionBy("capture_id", "k")
    gaps = F.sum("n").over(window) - 1
    mean = (F.max("last").over(window) - F.min("first").over(window)) / F.nullif(gaps, F.lit(0))
    crossing = F.col("first") - F.lag("last").over(window.orderBy("slice"))
    own_mean = (F.col("last") - F.col("first")) / F.nullif(F.col("n") - 1, F.lit(0))
    off = F.coalesce((F.col("n") - 1) * F.pow(own_mean - F.col("mean"), F.lit(2)), F.lit(0.0))
    edge = F.coalesce(F.pow(F.col("crossing") - F.col("mean"), F.lit(2)), F.lit(0.0))
    merged = (
        slices.withColumns({"mean": mean, "crossing": crossing})
        .withColumn("m2", F.col("spread") + off + edge)
        .groupBy("capture_id", "k")
        .agg(
            F.sum("n").alias("n"),
            F.sum("bytes").alias("bytes"),
            F.sum("up").alias("up"),
            F.sum("down").alias("down"),
            F.sum("directed").alias("directed"),
            F.max("mean").alias("mean"),
            F.sum("m2").alias("m2"),
            *[F.any_value(c).alias(c) for c in carried],
        )
        .filter(F.col("n") >= spec.min_window_packets)
    )
    low, high = spec.ratio_bounds
    ratio = F.when(
        F.col("up") > 0, F.try_divide(F.col("down"), F.col("up"))
    ).otherwise(F.col("down") + spec.down_only_bonus)
    ratio = F.when(F.col("directed") > 0, ratio).otherwise(1.0)
    return merged.select(
        "capture_id",
        "k",
        (F.col("bytes") * 8.0 / 1000.0).alias("throughput_kbps"),
        (F.col("bytes") / F.col("n")).alias("avg_pkt_size_bytes"),
        F.col("mean").cast("double").alias("inter_arrival_mean_us"),
        F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("inter_arrival_std_us"),
        F.col("n").cast("double").alias("flow_pkt_count"),
        clip(ratio, low, high).alias("dl_ul_ratio"),
        *carried,
    )


def _rolling_columns(frame) -> dict[str, Column]:
    return {
        "bitrate_mean_kbps": F.avg("throughput_kbps").over(frame),
        "bitrate_std_kbps": F.coalesce(F.stddev_samp("throughput_kbps").over(frame), F.lit(0.0)),
    }


def capped_rolling(
    windows: DataFrame, spec: WindowSpec, chunk_windows: int = CHUNK_WINDOWS
) -> DataFrame:
    """Windows of each capture (the first ``cap``, if set) with the rolling bitrate columns.

    Captures are processed in chunks of consecutive windows, each preceded by
    the few windows its first frames reach back to, so no capture is one group.
    The windows are read several times and staged for that; packets are not.
    """
    reach = spec.rolling - 1
    chunked = stage(windows, "windows").withColumn(
        "chunk", F.floor(F.col("k") / chunk_windows)
    ).withColumn("one", F.lit(1).cast("bigint"))
    numbered = running_totals(chunked, ["capture_id"], "chunk", [F.col("k")], ["one"])
    numbered = numbered.withColumnRenamed("one_cum", "window_no").drop("one")
    if spec.cap is not None:
        numbered = numbered.filter(F.col("window_no") <= spec.cap)
    latest = Window.partitionBy("capture_id", "chunk").orderBy(F.desc("k"))
    tails = (
        numbered.select("capture_id", "chunk", "k", "throughput_kbps")
        .withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= reach)
        .groupBy("capture_id", "chunk")
        .agg(F.collect_list(F.struct("k", "throughput_kbps")).alias("tail"))
    )
    earlier = Window.partitionBy("capture_id").orderBy("chunk").rowsBetween(-reach, -1)
    reached = F.slice(F.sort_array(F.flatten(F.collect_list("tail").over(earlier)), False), 1, reach)
    halo = (
        tails.select("capture_id", "chunk", reached.alias("reached"))
        .select("capture_id", "chunk", F.explode("reached").alias("w"))
        .select("capture_id", "chunk", "w.k", "w.throughput_kbps", F.lit(True).alias("_halo"))
    )
    both = numbered.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    frame = Window.partitionBy("capture_id", "chunk").orderBy("k").rowsBetween(-reach, 0)
    return (
        both.withColumns(_rolling_columns(frame)).filter("NOT _halo").drop("_halo", "chunk")
    )


def clip_features(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Bound every feature; runs after rolling, which uses unbounded throughput."""
    return windows.withColumns(
        {name: clip(F.col(name), *bound) for name, bound in zip(FEATURES, spec.feature_bounds)}
    )


def window_features(
    packets: DataFrame, spec: WindowSpec, carried: tuple[str, ...] = (LABEL,)
) -> DataFrame:
    """Eight features per kept window, with ``capture_id``, ``k`` and ``carried``.

    ``carried`` columns must be constant within a capture.
    """
    windows = base_windows(place(packets, spec), spec, carried)
    clipped = clip_features(capped_rolling(windows, spec), spec)
    return clipped.select("capture_id", "k", *FEATURES, *carried)
