"""Default thresholds. Every operator takes them as keyword arguments, so nothing here is global state.

The numbers are fixed values: results only agree with published figures when they are these.
"""

FEATURES = ("duration_sec", "packets", "bytes")
SUPERVISED_FEATURES = (
    "duration_sec",
    "packets",
    "bytes",
    "bwd_packet_length_mean",
    "init_win_bytes_forward",
    "init_win_bytes_backward",
    "average_packet_size",
)
SCHEMA_VERSION = "2.0"

# Isolation forest
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.08
WARMUP_CONTAMINATION = 0.005
WARMUP_MIN_ROWS = 1000
SEED = 42

# Statistical detectors
ZSCORE_LIMIT = 3.0
MAD_LIMIT = 3.5
MAD_CONSISTENCY = 0.6745

# Cascade
MAX_HOPS = 3
DEFAULT_CRITICALITY = 0.5
CASCADE_CLAMP = 1.0
CASCADE_ITERATIONS = 1000
GATEWAY_THRESHOLD = 0.85
GATEWAY_CRITICALITY = 0.0

# Deception
TRIPWIRE_SCORE = -100.0
CONFIDENCE_BOTH = 0.99
CONFIDENCE_TRIPWIRE = 0.9
CONFIDENCE_VOLUME = 0.5
BREACH_PROBABILITY = 0.9
ZONE_CRITICALITY = 0.15
DETECTION_LATENCY_SEC = 1
UNKNOWN_PROBE = "Unknown_External_Probe"

# How far each channel's score is trusted by fusion
RELIABILITY = {
    "volumetric": 0.02,
    "tripwire": 1.0,
    "supervised": 0.90,
    "signature": 0.85,
    "beaconing": 0.50,
    "drift": 0.15,
}
BAND_SUSPICIOUS = 0.25
BAND_LIKELY = 0.55
BAND_CONFIRMED = 0.85

# Beaconing
BEACON_MIN_SAMPLES = 5
BEACON_HISTORY = 32
BEACON_MAX_CV = 0.25
BEACON_MIN_INTERVAL = 0.5
BEACON_MAX_INTERVAL = 3600.0

# Structural drift
DRIFT_WINDOW_SEC = 60
DRIFT_BASELINE_BATCHES = 10
DRIFT_MIN_ROWS = 8
DRIFT_REFIT_BATCHES = 100
DRIFT_MIN_DEGREE = 4
DRIFT_TRAINING_ROWS = 5000
DRIFT_FIRE = 0.7
DRIFT_CONTAMINATION = 0.1

SMALL_PAYLOAD_BYTES = 64
WELL_KNOWN_PORT_LIMIT = 1024

# Alerts and prevention
ALERT_SCORE_FLOOR = 0.9
ALERT_DEBOUNCE_SEC = 60
SNAPSHOT_DEBOUNCE_SEC = 30
MIN_CORROBORATING = 2
RATE_LIMIT_SCORE = 0.55
BLOCK_SCORE = 0.85
BLOCK_CRITICALITY = 0.5
QUARANTINE_CRITICALITY = 0.85
QUARANTINE_CII = 0.10
TTL_RATE_LIMIT = 900
TTL_BLOCK = 1800
TTL_QUARANTINE = 3600

# Risk index
RISK_WEIGHT_CRITICAL = 1.0
RISK_WEIGHT_WARNING = 0.35
RISK_WEIGHT_OTHER = 0.1
RISK_FULL_SCALE = 5.0

RETENTION_ROWS = 500_000
PAGE_SIZE = 100
SPLIT_FRACTION = 0.5
