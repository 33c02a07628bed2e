"""Fixed vocabulary of the slice classification task and the window presets."""

from __future__ import annotations

from dataclasses import dataclass, field

# They must equal the published task definition for results to agree.
FEATURES = (
    "throughput_kbps",
    "avg_pkt_size_bytes",
    "inter_arrival_mean_us",
    "inter_arrival_std_us",
    "flow_pkt_count",
    "dl_ul_ratio",
    "bitrate_mean_kbps",
    "bitrate_std_kbps",
)
LABEL = "traffic_class"
SLICE_NAMES = {0: "eMBB", 1: "URLLC", 2: "mMTC"}
CLASSES = tuple(SLICE_NAMES)
CLASS_WEIGHTS = {0: 1.0, 1: 2.5, 2: 1.0}
CATEGORY_SLICES = {
    "stored_streaming": 0,
    "live_streaming": 0,
    "video_conferencing": 0,
    "game_streaming": 1,
    "online_game": 1,
    "metaverse": 2,
}
STEM_SLICES = {
    "NaverNOW": 0,
    "AfreecaTV": 0,
    "YouTube": 0,
    "Zoom": 0,
    "MSteams": 0,
    "GoogleMeet": 0,
    "Cloudgaming": 1,
    "Mobilegame": 1,
    "Zepeto": 2,
    "Roblox": 2,
}
PORT_PAIR = r"(\d+)\s*[>→]\s*(\d+)"
REQUIRED_COLUMNS = ("Time", "Length", "Source", "Destination")
COLUMN_ALIASES = {
    "time": ("time", "timestamp", "time_s", "relative_time"),
    "length": ("length", "len", "pkt_len", "frame_len", "ip_len", "packet_length"),
    "dst_port": ("dst_port", "dport", "dst port", "destination_port"),
}
# (mean, standard deviation) of each feature, one row per class.
SYNTHETIC_NORMALS = {
    0: ((14000, 4000), (1100, 200), (350, 120), (800, 250),
        (650, 180), (15.0, 4.0), (12000, 3500), (2800, 700)),
    1: ((5500, 1200), (380, 100), (80, 25), (45, 12),
        (220, 60), (1.6, 0.4), (4800, 1000), (900, 250)),
    2: ((180, 80), (160, 60), (22000, 8000), (15000, 5000),
        (12, 5), (2.5, 0.8), (120, 50), (30, 12)),
}
# (lower, upper) bound per feature, in FEATURES order; None leaves that side open.
FEATURE_BOUNDS = (
    (1.0, None), (20.0, 1500.0), (0.01, None), (0.0, None),
    (1.0, None), (0.01, 1000.0), (0.1, None), (0.0, None),
)
STEM_FEATURE_BOUNDS = (
    (1.0, None), (20.0, 1500.0), (0.1, None), (0.0, None),
    (1.0, None), (0.05, 200.0), (0.1, None), (0.0, None),
)
SYNTHETIC_BOUNDS = (
    (1, None), (20, 1500), (0.01, None), (0, None),
    (1, None), (0.01, None), (0.1, None), (0, None),
)
STEM_SYNTHETIC_BOUNDS = (
    (10, None), (40, 1500), (1, None), (1, None),
    (1, None), (0.1, None), (1, None), (0.1, None),
)
LEARNING_RATE, FLOOR_RATE = 0.004, 1e-4
# End of fixed values.


@dataclass(frozen=True)
class WindowSpec:
    """How one capture is cut into feature windows.

    ``anchor`` is ``first_row`` (time of the lowest packet number) or
    ``earliest`` (smallest time). ``down_only_bonus`` is added to the downlink
    bytes when a window has no uplink bytes. ``cap`` keeps the first windows of a
    capture only; none is left out by default.
    """

    width_us: int = 1_000_000
    cap: int | None = None
    min_capture_packets: int = 10
    min_window_packets: int = 2
    rolling: int = 5
    anchor: str = "first_row"
    keep_zero_length: bool = False
    down_only_bonus: float = 1.0
    ratio_bounds: tuple = (0.01, 1000.0)
    feature_bounds: tuple = field(default=FEATURE_BOUNDS)


TREE = WindowSpec()
BY_STEM = WindowSpec(
    anchor="earliest",
    keep_zero_length=True,
    down_only_bonus=0.0,
    ratio_bounds=(0.1, 100.0),
    feature_bounds=STEM_FEATURE_BOUNDS,
)
