"""Credential-use logs matched against planted decoys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.net import gateway_level
from ripplewatch.functions.partitions import broadcast_if_small


def honeytoken_events(auth_log: DataFrame, decoys: DataFrame, *, keep=(), zone: str | None = None) -> DataFrame:
    """Canonical tripwire rows for every use of a decoy credential; volumes are zero by contract.

    ``auth_log`` has ``ts`` and ``username``. The registry holds one decoy per zone, so it is broadcast.
    """
    if zone is not None:
        if decoys.filter(F.col("gateway_zone") == zone).isEmpty():
            raise KeyError(f"unknown gateway zone {zone!r}")
        decoys = decoys.filter(F.col("gateway_zone") == zone)
    table = decoys.select("username", F.col("gateway_zone").alias("_zone"), "credential_id", "emulated_protocol")
    hits = auth_log.select(*keep, "ts", "username").join(broadcast_if_small(table), "username")
    zero = F.lit(0.0)
    return hits.select(
        *keep,
        F.col("ts").alias("timestamp"),
        F.lit(S.UNKNOWN_PROBE).alias("source_asset_id"),
        F.col("_zone").alias("destination_asset_id"),
        F.col("emulated_protocol").alias("protocol"),
        zero.alias("payload_size"),
        F.lit("ALERT").alias("action"),
        F.col("_zone").alias("zone"),
        F.lit("HoneytokenTripwire").alias("process_or_service"),
        F.concat(F.lit("T1078_Valid_Accounts::"), "credential_id").alias("attck_evidence"),
        F.lit(1.0).alias("raw_anomaly_score"),
        F.lit("CRITICAL").alias("calibrated_alert_level"),
        F.lit("Deception").alias("provenance"),
        F.lit(1.0).alias("confidence"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit("deception_tripwire").alias("signal_type"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(S.DETECTION_LATENCY_SEC))).alias("observed_at"),
        gateway_level(F.col("_zone")).alias("purdue_level"),
        zero.alias("duration_sec"),
        F.lit(0).cast("bigint").alias("packets"),
        zero.alias("bytes"),
        F.lit(True).alias("is_honeytoken_use"),
    )
