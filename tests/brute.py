"""Feature windows of one capture by plain loops, to check the Spark jobs against."""

from __future__ import annotations

import math
import statistics


def capture_windows(packets, spec):
    """``packets``: dicts pkt_no, us, len, uplink. Returns {k: feature tuple}."""
    packets = sorted(packets, key=lambda p: p["pkt_no"])
    if spec.anchor == "first_row":
        t0 = packets[0]["us"]
    else:
        t0 = min(p["us"] for p in packets)
    valid = [p for p in packets if spec.keep_zero_length or p["len"] > 0]
    if len(valid) < spec.min_capture_packets:
        return {}
    valid.sort(key=lambda p: (p["us"], p["pkt_no"]))
    t_last = valid[-1]["us"] - t0
    groups: dict[int, list] = {}
    for p in valid:
        rel = p["us"] - t0
        k = rel // spec.width_us
        if rel >= 0 and (k + 1) * spec.width_us <= t_last:
            groups.setdefault(k, []).append((rel, p["len"], p["uplink"]))
    rows, recent = {}, []
    for k in sorted(groups):
        rows_k = groups[k]
        if len(rows_k) < spec.min_window_packets:
            continue
        if spec.cap is not None and len(rows) == spec.cap:
            break
        gaps = [b[0] - a[0] for a, b in zip(rows_k, rows_k[1:])]
        up = sum(n for _, n, u in rows_k if u)
        down = sum(n for _, n, u in rows_k if u is False)
        if all(u is None for *_, u in rows_k):
            ratio = 1.0
        else:
            ratio = down / up if up > 0 else down + spec.down_only_bonus
        low, high = spec.ratio_bounds
        throughput = sum(n for _, n, _ in rows_k) * 8 / 1000
        recent = (recent + [throughput])[-spec.rolling:]
        rows[k] = [
            throughput,
            statistics.fmean(n for _, n, _ in rows_k),
            statistics.fmean(gaps),
            statistics.pstdev(gaps),
            float(len(rows_k)),
            min(max(ratio, low), high),
            statistics.fmean(recent),
            statistics.stdev(recent) if len(recent) > 1 else 0.0,
        ]
    bounded = {}
    for k, values in rows.items():
        bounded[k] = tuple(
            min(max(v, -math.inf if lo is None else lo), math.inf if hi is None else hi)
            for v, (lo, hi) in zip(values, spec.feature_bounds)
        )
    return bounded
