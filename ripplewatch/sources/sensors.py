"""Wide sensor logs: one row per reading, one column per tag."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.clock import sensor_timestamp
from ripplewatch.schema import CANONICAL_COLUMNS
from ripplewatch.sources.flows import trimmed_header

_FIXED = ("Timestamp", "Normal/Attack")


def sensors_to_canonical(raw: DataFrame) -> DataFrame:
    """Canonical events that carry every sensor column along, numeric where it parses."""
    tags = [c for c in raw.columns if c not in _FIXED]
    attack = F.lower(F.trim(F.col("`Normal/Attack`"))) == "attack"
    null = F.lit(None)
    return raw.select(
        sensor_timestamp(F.col("Timestamp")).alias("timestamp"),
        F.lit("SWaT_System").alias("source_asset_id"),
        F.lit("SWaT_System").alias("destination_asset_id"),
        F.lit("OT_Telemetry").alias("protocol"),
        F.lit(1.0).alias("payload_size"),
        F.when(attack, "ALERT").otherwise("PASS").alias("action"),
        F.lit("ICS").alias("zone"),
        F.lit("SensorTelemetry").alias("process_or_service"),
        null.cast("string").alias("attck_evidence"),
        null.cast("double").alias("raw_anomaly_score"),
        null.cast("string").alias("calibrated_alert_level"),
        F.lit("SWaT").alias("provenance"),
        F.lit(1.0).alias("confidence"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit("ics_reading").alias("signal_type"),
        null.cast("timestamp").alias("observed_at"),
        F.lit(1).alias("purdue_level"),
        *[F.col(f"`{c}`").try_cast("double").alias(c) for c in tags],
    )


def read_sensor_wide(spark: SparkSession, path: str) -> DataFrame:
    return sensors_to_canonical(trimmed_header(spark.read.csv(path, header=True)))


def sensor_features(df: DataFrame) -> list[str]:
    """Every numeric column beyond the canonical ones."""
    numeric = ("double", "bigint", "int", "float")
    return [n for n, kind in df.dtypes if n not in CANONICAL_COLUMNS and kind in numeric]
