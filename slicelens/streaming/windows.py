"""Window features and rolling bitrate on a packet stream.

State is held as moments. Packets wait only until the watermark has passed
them; then they are folded, in time order, into the count, bytes, first and
last time and spread of gaps of their slice. Event-time timers close what the
watermark has passed, so a finite stream gives all its windows once
:func:`end_mark` has been read. Packets behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slicelens.functions.maths import clip
from slicelens.settings import WindowSpec

SLICES = 8
LANES = 8
BUCKETS = 256
#: Closed slices in one row between the two states.
PACK = 10_000
IDLE_US = 86_400_000_000
MOMENTS = "n bigint, bytes double, up double, directed bigint, first bigint, last bigint, m2 double"


def end_mark(packets: DataFrame, after_us: int) -> DataFrame:
    """One row without capture, ``after_us`` behind the last packet of a finite table.

    Written as the last file of its stream it moves the watermark past all open
    windows; it is no packet itself. An empty table gives no row.
    """
    last = packets.agg(F.max(F.unix_micros("ts")).alias("at")).filter("at IS NOT NULL")
    ts = F.timestamp_micros(F.col("at") + after_us)
    return last.select(
        *[(ts if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in packets.schema]
    )


@dataclass
class Moments:
    """Runs of packets in time order: all that appending another run needs.

    A value each for one run, or an array each for many.
    """

    n: int | np.ndarray
    bytes: float | np.ndarray
    up: float | np.ndarray
    directed: int | np.ndarray
    first: int | np.ndarray
    last: int | np.ndarray
    m2: float | np.ndarray

    @classmethod
    def each(cls, us: np.ndarray, size: np.ndarray, up: np.ndarray) -> Moments:
        """Every packet a run; ``up`` is 1, 0, or NaN where the direction is unknown."""
        return cls(np.ones(len(us), np.int64), size, np.where(up == 1, size, 0.0), (~np.isnan(up)).astype(np.int64),
                   us, us, np.zeros(len(us)))

    @classmethod
    def of(cls, us: np.ndarray, size: np.ndarray, up: np.ndarray) -> Moments:
        """Of sorted times, as one run."""
        return cls.each(us, size, up)._one()

    def then(self, later: Moments) -> Moments:
        """Both runs as one; ``later`` starts no earlier than this one ends."""
        return Moments(*(np.array(pair) for pair in zip(astuple(self), astuple(later))))._one()

    def _one(self) -> Moments:
        return Moments(*(column[0].item() for column in astuple(self.joined(np.zeros(1, np.int64)))))

    def joined(self, starts: np.ndarray) -> Moments:
        """The runs from each of ``starts`` to the next as one; they are in time order."""
        sizes = np.diff(np.append(starts, len(self.n)))
        n, first, last = np.add.reduceat(self.n, starts), self.first[starts], self.last[starts + sizes - 1]
        mean = np.repeat((last - first) / np.maximum(n - 1, 1), sizes)
        within = (self.last - self.first) / np.maximum(self.n - 1, 1)
        m2 = self.m2 + (self.n - 1) * (within - mean) ** 2
        between = (self.first[1:] - self.last[:-1] - mean[1:]) ** 2
        between[starts[1:] - 1] = 0.0  # from one run's last to another's first
        m2[1:] += between
        bytes_, up, directed, spread = (np.add.reduceat(c, starts) for c in (self.bytes, self.up, self.directed, m2))
        return Moments(n, bytes_, up, directed, first, last, spread)


_FIELDS = [f.name for f in fields(Moments)]


def _joined(runs: pd.DataFrame) -> pd.DataFrame:
    """Runs of many captures, in any order, with those of one capture and number ``at`` as one."""
    codes = pd.factorize(runs["capture_id"], use_na_sentinel=False)[0]
    order = np.lexsort((runs["first"].to_numpy(), codes))
    runs, codes = runs.iloc[order], codes[order]
    at = runs["at"].to_numpy()
    starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])))
    moments = Moments(*(runs[f].to_numpy() for f in _FIELDS)).joined(starts)
    return runs[["capture_id", "at"]].iloc[starts].assign(**vars(moments))


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.record_batch([pa.array(frame[c].to_numpy()) for c in frame], list(frame))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packs: Iterable[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(pack).read_all() for pack in packs]
    return pa.concat_tables(tables, promote_options="permissive").to_pandas()


def _instants(us) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us", utc=True)


class _Timed(StatefulProcessor):
    """Holds one event-time timer a key: when the first of what is open can close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, us: int | None) -> None:
        wake = None if us is None else -(-us // 1000)
        at = self.timer.get()[0] if self.timer.exists() else None
        if at == wake:
            return
        if at is not None:
            self.handle.deleteTimer(at)
        if wake is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wake)
            self.timer.update((wake,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # a timer that fired is gone
        yield self._advanced(key, None, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._counts(key):
            frame = pd.concat(list(rows), ignore_index=True)
            yield self._advanced(key, frame, timerValues.getCurrentWatermarkInMs() * 1000)

    def _counts(self, key) -> bool:
        return key[0] is not None  # the end mark has no capture

    def close(self) -> None:
        pass


class _Runs(_Timed):
    """Open runs of the captures of a bucket, as one packed table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "runs binary")

    def _counts(self, key) -> bool:
        return key[0] >= 0  # the end mark has no bucket

    def _held(self, state) -> list[pd.DataFrame]:
        return [_unpacked(state.get())] if state.exists() else []

    def _hold(self, state, frame: pd.DataFrame) -> None:
        if len(frame):
            state.update((_packed(frame),))
        elif state.exists():
            state.clear()

    def _closed(self, new: list[pd.DataFrame], passed: int) -> tuple[pd.DataFrame, list[int]]:
        """Adds runs to the open ones; those that the watermark has passed, and the first end of the others."""
        parts = self._held(self.open) + new
        if not parts:
            return pd.DataFrame(columns=["capture_id", "at", *_FIELDS]), []
        runs = _joined(pd.concat(parts, ignore_index=True))
        ends = (runs["at"] + 1) * self.width
        self._hold(self.open, runs[ends > passed])
        return runs[ends <= passed], [int(ends[ends > passed].min())] if (ends > passed).any() else []


class SliceMoments(_Runs):
    """Slices of one lane of a bucket; a slice leaves once the watermark has passed its end."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getValueState("waiting", "packets binary")

    def _advanced(self, key, frame: pd.DataFrame | None, passed: int) -> pd.DataFrame:
        parts = self._held(self.waiting)
        if frame is not None:
            kinds = {"us": np.int64, "len": np.float64, "up": np.float64}
            parts.append(frame[["capture_id", *kinds]].astype(kinds))
        new, wakes = [], []
        if parts:
            packets = pd.concat(parts, ignore_index=True)
            ripe = packets["us"] <= passed
            self._hold(self.waiting, packets[~ripe])
            wakes += [(int(us) // self.width + 1) * self.width for us in packets["us"][~ripe].nsmallest(1)]
            packets = packets[ripe]
            us, size, up = (packets[c].to_numpy() for c in ("us", "len", "up"))
            runs = packets[["capture_id"]].assign(at=us // self.width, **vars(Moments.each(us, size, up)))
            new += [runs] if len(runs) else []
        done, ends = self._closed(new, passed)
        self._wake(min(wakes + ends, default=None))
        cuts = range(0, len(done), PACK)
        # A pack is behind the last watermark, as each of its slices is.
        ends = [(int(done["at"].iloc[i : i + PACK].min()) + 1) * self.width for i in cuts]
        packs = [_packed(done.iloc[i : i + PACK]) for i in cuts]
        return pd.DataFrame({"bucket": key[0], "runs": packs, "closed": _instants(ends)})


class WindowMoments(_Runs):
    """Windows of the captures of a bucket, from closed slices; they arrive in time order, batch by batch."""

    def __init__(self, width: int, slices: int):
        self.width, self.slices = width, slices

    def _advanced(self, key, frame: pd.DataFrame | None, passed: int) -> pd.DataFrame:
        new = []
        if frame is not None:
            runs = _unpacked(frame["runs"])
            new.append(runs.assign(at=runs["at"] // self.slices))
        done, ends = self._closed(new, passed)
        self._wake(min(ends, default=None))
        start = done["at"].to_numpy(np.int64) * self.width
        out = done[["capture_id", *_FIELDS]].reset_index(drop=True)
        out.insert(0, "bucket", key[0])
        out.insert(2, "start_us", start)
        return out.assign(window_time=_instants(start + self.width))


def stream_windows(
    packets: DataFrame, spec: WindowSpec, delay: str, slices: int = SLICES, lanes: int = LANES, buckets: int = BUCKETS
) -> DataFrame:
    """Base features of clock-aligned windows of a packet stream, in append mode.

    ``packets`` has ``capture_id, ts, len, uplink``. Captures share ``buckets``
    keys, since each key costs calls of Python and of the state store in every
    batch; size them so that a task can hold a bucket's packets of one batch,
    and keep their number for the life of a checkpoint. A window is cut into
    ``slices`` that are dealt to ``lanes`` keys a bucket, so that neither a hot
    capture nor a hot window is one key. Closed slices leave packed, as one
    table of moments a bucket. State is one row of moments an open slice, and
    the packets of the last ``delay``. The gate on short captures needs whole captures and is not applied. Needs
    the RocksDB state store provider.
    """
    width = spec.width_us
    if slices < 1 or width % slices:
        raise ValueError(f"{slices} slices do not divide a window of {width} microseconds")
    keep = F.lit(True) if spec.keep_zero_length else (F.col("len") > 0) | F.col("capture_id").isNull()
    name = packets.schema["capture_id"].dataType.simpleString()
    us = F.unix_micros("ts")
    # Packets of the null capture have a bucket of their own: a null among other captures would turn
    # their numbers to floating ones on the way to Python. The end mark has neither capture nor length.
    bucket = F.when(F.col("capture_id").isNotNull(), F.pmod(F.hash("capture_id"), F.lit(buckets)))
    bucket = F.coalesce(bucket, F.when(F.col("len").isNotNull(), F.lit(buckets)), F.lit(-1))
    timed = packets.withWatermark("ts", delay).filter(keep).select(
        bucket.alias("bucket"), F.pmod(F.floor(us / (width // slices)), F.lit(lanes)).cast("int").alias("lane"),
        F.coalesce("capture_id", F.lit("0").try_cast(name)).alias("capture_id"),
        "ts", us.alias("us"), "len", F.col("uplink").cast("int").cast("double").alias("up"),
    )
    parts = timed.groupBy("bucket", "lane").transformWithStateInPandas(
        SliceMoments(width // slices),
        outputStructType="bucket int, runs binary, closed timestamp",
        outputMode="append", timeMode="EventTime", eventTimeColumnName="closed",
    )
    merged = parts.groupBy("bucket").transformWithStateInPandas(
        WindowMoments(width, slices),
        outputStructType=f"bucket int, capture_id {name}, start_us bigint, {MOMENTS}, window_time timestamp",
        outputMode="append", timeMode="EventTime", eventTimeColumnName="window_time",
    )
    gaps = (F.col("n") - 1).cast("double")
    down = F.col("bytes") - F.col("up")
    quotient = F.when(F.col("up") > 0, F.try_divide(down, F.col("up"))).otherwise(down + spec.down_only_bonus)
    quotient = F.when(F.col("directed") > 0, quotient).otherwise(1.0)
    return merged.filter(F.col("n") >= spec.min_window_packets).select(
        F.when(F.col("bucket") < buckets, F.col("capture_id")).alias("capture_id"), "start_us", "window_time",
        (F.col("bytes") * 8.0 / 1000.0).alias("throughput_kbps"),
        (F.col("bytes") / F.col("n")).alias("avg_pkt_size_bytes"),
        ((F.col("last") - F.col("first")) / gaps).alias("inter_arrival_mean_us"),
        F.sqrt(F.col("m2") / gaps).alias("inter_arrival_std_us"),
        F.col("n").cast("double").alias("flow_pkt_count"),
        clip(quotient, *spec.ratio_bounds).alias("dl_ul_ratio"),
    )


class RollingBitrate(_Timed):
    """Anchored windows of a capture and their rolling bitrate; forgets a capture that went idle."""

    def __init__(self, spec: WindowSpec, idle_us: int):
        self.spec, self.idle_us = spec, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.capture = handle.getValueState("capture", "t0 bigint, t_last bigint, t_seen bigint")
        self.open = handle.getValueState("open", "windows array<struct<k: bigint, n: bigint, bytes: double>>")
        self.recent = handle.getValueState("recent", "values array<double>")

    def _first(self, frame: pd.DataFrame) -> int:
        by = "pkt_no" if self.spec.anchor == "first_row" else "us"
        return int(frame.us.iloc[int(frame[by].to_numpy().argmin())])

    def _advanced(self, key, frame: pd.DataFrame | None, passed: int) -> pd.DataFrame:
        spec, width = self.spec, self.spec.width_us
        t0, t_last, t_seen = self.capture.get() if self.capture.exists() else (None, None, None)
        held = self.open.get()[0] if self.open.exists() else []
        windows = {r[0]: (r[1], r[2]) for r in held}
        if frame is not None:
            t0 = self._first(frame) if t0 is None else t0
            t_seen = max(int(frame.us.max()), t0 if t_seen is None else t_seen)
            frame = frame[(frame.us >= t0) & (spec.keep_zero_length | (frame.len > 0))]
            sums = frame.len.groupby((frame.us.to_numpy(np.int64) - t0) // width).agg(["size", "sum"])
            for k, n, total in sums.itertuples():
                had = windows.get(int(k), (0, 0.0))
                windows[int(k)] = (had[0] + int(n), had[1] + float(total))
            if len(frame):
                t_last = max(int(frame.us.max()), t0 if t_last is None else t_last)
        # Closed: nothing more can come, and a packet was seen at or behind the end.
        done = sorted(k for k in windows if t0 + (k + 1) * width <= min(passed, t_last))
        kept = [(k, windows.pop(k)) for k in done]
        out = self._rolled(key, t0, [(k, b) for k, (n, b) in kept if n >= spec.min_window_packets])
        if t_seen is None or t_seen + self.idle_us <= passed:
            for state in (self.capture, self.open, self.recent):
                state.clear()
            self._wake(None)
            return out
        self.capture.update((t0, t_last, t_seen))
        if windows:
            self.open.update(([(k, *windows[k]) for k in sorted(windows)],))
        else:
            self.open.clear()
        ends = [t0 + (k + 1) * width for k in windows if t0 + (k + 1) * width <= t_last]
        self._wake(min([t_seen + self.idle_us, *ends]))
        return out

    def _rolled(self, key, t0: int | None, closed: list[tuple[int, float]]) -> pd.DataFrame:
        before = list(self.recent.get()[0]) if self.recent.exists() else []
        own = [total * 8.0 / 1000.0 for _, total in closed]
        series = pd.Series(before + own, dtype="float64")
        frame = series.rolling(self.spec.rolling, min_periods=1)
        skip, reach = len(before), self.spec.rolling - 1
        if own and reach:
            self.recent.update((series.iloc[max(len(series) - reach, 0):].tolist(),))
        return pd.DataFrame({
            "capture_id": pd.Series([key[0]] * len(own), dtype=object),
            "start_us": np.array([t0 + k * self.spec.width_us for k, _ in closed], np.int64),
            "throughput_kbps": np.array(own, np.float64),
            "bitrate_mean_kbps": frame.mean().iloc[skip:].to_numpy(),
            "bitrate_std_kbps": frame.std().fillna(0.0).iloc[skip:].to_numpy(),
        })


def stream_rolling(packets: DataFrame, spec: WindowSpec, delay: str, idle_us: int = IDLE_US) -> DataFrame:
    """Rolling bitrate over the last kept windows of each capture, anchored at its start.

    ``packets`` has ``capture_id, pkt_no, ts, len``. The start is the first row
    (or earliest packet, by ``spec.anchor``) of the first batch that holds the
    capture; it is kept in state with one sum an open window and the last few
    throughputs. A window leaves once the watermark has passed it and a later
    packet shows that it is whole. A capture without packets for ``idle_us`` of
    event time is forgotten; if it comes back it starts anew. One capture is
    one key, since only its own state knows its start: a batch should hold no
    more of a capture than one task can sum up. Needs the RocksDB provider.
    """
    name = packets.schema["capture_id"].dataType.simpleString()
    timed = packets.withWatermark("ts", delay).select(
        "capture_id", "pkt_no", "ts", F.unix_micros("ts").alias("us"), F.col("len").cast("double").alias("len")
    )
    return timed.groupBy("capture_id").transformWithStateInPandas(
        RollingBitrate(spec, idle_us),
        outputStructType=f"capture_id {name}, start_us bigint, throughput_kbps double, "
        "bitrate_mean_kbps double, bitrate_std_kbps double",
        outputMode="append", timeMode="EventTime",
    )
