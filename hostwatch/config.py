"""Settings and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Names, orders, thresholds and edges that results depend on.
# ---------------------------------------------------------------------------

STAGES = (
    "benign", "recon", "initial_access", "lateral_movement",
    "c2", "exfiltration", "impact",
)
UNCLASSIFIED = "unclassified"

PACKET_FIELDS = (
    "ttl_mean", "ttl_var", "tcp_win_mean", "tcp_win_var", "frag_flag_count",
    "payload_hist_0", "payload_hist_1", "payload_hist_2", "payload_hist_3",
    "payload_hist_4", "payload_hist_5", "payload_hist_6", "payload_hist_7",
    "distinct_dst_ports", "sequential_port_ratio", "port_entropy",
    "retransmission_count",
)
SENT_FIELDS = (
    "sent_bytes", "sent_pkts", "syn", "ack", "fin", "rst", "psh", "urg",
    "syn_win_mean", "server_port_ratio", "distinct_dst_ips",
)
ROLE_FIELDS = ("internal", "net24_bucket")
META_FIELDS = ("host", "window_id", "window_start", "day")
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")

PAYLOAD_EDGES = (0, 64, 128, 256, 512, 1024, 1460, 8192)
SERVER_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 993, 995, 3306, 3389, 8080)
INTERNAL_NETWORKS = ("172.31.0.0/16", "10.0.0.0/8", "192.168.0.0/16")
NET24_BUCKETS = 256

DROP_REASONS = ("short_frame", "ipv6", "non_ipv4_ethertype", "truncated_ip_header")

STAGE_RULES = {
    "exfiltration_sent_bytes_gt": 50000,
    "exfiltration_distinct_dst_ips_lte": 2,
    "exfiltration_syn_lt": 10,
    "scan_distinct_dst_ports_gt": 20,
    "scan_sequential_port_ratio_gt": 0.5,
    "initial_access_syn_gt": 30,
    "impact_sent_pkts_gt": 500,
}

# stage -> default technique, default name, ordered rules
# (feature -> threshold or "stage_rule:<key>", technique, name).
TECHNIQUES = {
    "benign": (None, "", ()),
    "recon": ("T1046", "", (
        ({"distinct_dst_ips_gt": 20}, "T1046", "Network Service Discovery"),
        ({"sequential_port_ratio_gt": "stage_rule:scan_sequential_port_ratio_gt"},
         "T1046", "Network Service Discovery (sequential port sweep)"),
    )),
    "initial_access": ("T1110", "", (
        ({"syn_gt": 50}, "T1110", "Brute Force (credential guessing)"),
    )),
    "lateral_movement": ("T1021", "Remote Services", (
        ({"distinct_dst_ports_gt": "stage_rule:scan_distinct_dst_ports_gt"},
         "T1046", "Network Service Discovery (internal sweep)"),
        ({"sequential_port_ratio_gt": "stage_rule:scan_sequential_port_ratio_gt"},
         "T1046", "Network Service Discovery (internal sequential sweep)"),
    )),
    "c2": ("T1071", "Command and Control", ()),
    "exfiltration": ("T1041", "", (
        ({"sent_bytes_gt": "stage_rule:exfiltration_sent_bytes_gt"},
         "T1048", "Exfiltration Over Alternative Protocol (large outbound transfer)"),
    )),
    "impact": ("T1498", "Network Denial of Service", ()),
    "unclassified": (None, "No stage rule matched - technique not determined", ()),
}

# canonical flow column -> raw column in flow-meter CSV exports
FLOW_COLUMNS = {
    "timestamp": "Timestamp", "src_ip": "Src IP", "dst_ip": "Dst IP",
    "src_port": "Src Port", "dst_port": "Dst Port", "protocol": "Protocol",
    "duration": "Flow Duration", "fwd_bytes": "TotLen Fwd Pkts",
    "bwd_bytes": "TotLen Bwd Pkts", "fwd_pkts": "Tot Fwd Pkts",
    "bwd_pkts": "Tot Bwd Pkts", "syn": "SYN Flag Cnt", "ack": "ACK Flag Cnt",
    "fin": "FIN Flag Cnt", "rst": "RST Flag Cnt", "psh": "PSH Flag Cnt",
    "urg": "URG Flag Cnt", "iat_mean": "Flow IAT Mean", "iat_std": "Flow IAT Std",
    "iat_max": "Flow IAT Max", "init_win_fwd": "Init Fwd Win Byts",
    "init_win_bwd": "Init Bwd Win Byts", "label": "Label",
}
NUMERIC_ADOPTION_RATIO = 0.9

FLOW_TIMEOUT_SECONDS = 120
MISSING_INIT_WIN = -1
SEQUENCE_WINDOWS = 48
HORIZONS = (1, 4, 8)
SOURCE_WINDOWS_PER_HOST = 12
FPR_BUDGETS = (0.001, 0.01)
ECE_BINS = 15
BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_LEVEL = 0.95
MIN_EPISODES_FOR_BAND = 8
SEED = 1337
PSEUDONYM_CHARS = 16
GENESIS = "0" * 64

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Sliding window grid: window w covers [w*stride, w*stride + window)."""

    window_seconds: int = 15
    stride_seconds: int = 5

    def __post_init__(self):
        if self.stride_seconds < 1 or self.window_seconds % self.stride_seconds:
            raise ValueError("window_seconds must be a whole multiple of stride_seconds")

    @property
    def n_bins(self) -> int:
        return self.window_seconds // self.stride_seconds

    @property
    def stride_us(self) -> int:
        return self.stride_seconds * 1_000_000

    @property
    def window_us(self) -> int:
        return self.window_seconds * 1_000_000


@dataclass(frozen=True)
class Settings:
    grid: Grid = field(default_factory=Grid)
    stage_rules: dict = field(default_factory=lambda: dict(STAGE_RULES))
    techniques: dict = field(default_factory=lambda: dict(TECHNIQUES))
    role_fields: tuple = ROLE_FIELDS
    flow_timeout_seconds: int = FLOW_TIMEOUT_SECONDS
    sequence_windows: int = SEQUENCE_WINDOWS
    horizons: tuple = HORIZONS

    def feature_columns(self) -> list[str]:
        """Ordered feature list: packet statistics, sent-side fields, role fields."""
        unknown = [c for c in self.role_fields if c not in ROLE_FIELDS]
        if unknown:
            raise ValueError(f"unknown role features {unknown}; known: {list(ROLE_FIELDS)}")
        return [*PACKET_FIELDS, *SENT_FIELDS, *(c for c in ROLE_FIELDS if c in self.role_fields)]


DEFAULTS = Settings()
