"""Row contracts shared by sources, operators and streams."""

from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_asset_id", T.StringType()),
        T.StructField("destination_asset_id", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("payload_size", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("process_or_service", T.StringType()),
        T.StructField("attck_evidence", T.StringType()),
        T.StructField("raw_anomaly_score", T.DoubleType()),
        T.StructField("calibrated_alert_level", T.StringType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("signal_type", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("purdue_level", T.IntegerType()),
    ]
)
CANONICAL_COLUMNS = [f.name for f in CANONICAL]
SIGNAL_TYPES = ("network_flow", "financial_txn", "ics_reading", "deception_tripwire")
TRIMMED_COLUMNS = (
    "source_asset_id",
    "destination_asset_id",
    "protocol",
    "action",
    "zone",
    "process_or_service",
    "provenance",
)

FLOW = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("is_attack", T.BooleanType()),
        T.StructField("timing_provenance", T.StringType()),
        T.StructField("source_row_id", T.StringType()),
        T.StructField("bwd_packet_length_mean", T.DoubleType()),
        T.StructField("init_win_bytes_forward", T.LongType()),
        T.StructField("init_win_bytes_backward", T.LongType()),
        T.StructField("average_packet_size", T.DoubleType()),
        T.StructField("is_honeytoken_use", T.BooleanType()),
    ]
)

# What a detector may see: no label, no ground truth, no capture identity.
DETECTOR_VISIBLE = (
    "event_id",
    "ts",
    "source_ip",
    "source_port",
    "destination_ip",
    "destination_port",
    "protocol",
    "duration_sec",
    "packets",
    "bytes",
    "bwd_packet_length_mean",
    "init_win_bytes_forward",
    "init_win_bytes_backward",
    "average_packet_size",
    "is_honeytoken_use",
)

VERDICT = (
    "detector string, fired boolean, calibrated_score double, reliability double, "
    "certainty string, raw_score double"
)

PREVENTION_ORDER = ("observe", "alert", "rate_limit", "block", "quarantine")
ACTIVE_KINDS = ("rate_limit", "block", "quarantine")
ACTIVE_STATUSES = ("simulated", "enforced")
