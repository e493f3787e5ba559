"""Named datasets behind one entry point."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch.operators.prepare import require_columns
from ripplewatch.sources.deception import honeytoken_events
from ripplewatch.sources.flows import (
    edges_to_canonical,
    flows_79_to_canonical,
    per_file_quota,
    read_flow_csv_79,
)
from ripplewatch.sources.payments import read_payments
from ripplewatch.sources.sensors import read_sensor_wide


def _flows(spark, path, registry, limit, **_):
    raw = read_flow_csv_79(spark, path)
    if limit:
        raw = raw.withColumn("_row", F.monotonically_increasing_id())
        attack = F.trim("Label") != "BENIGN"
        raw = per_file_quota(raw, limit=limit, key=["_file", "_row"], positive=attack).drop("_row")
    return flows_79_to_canonical(raw, registry)


def _payments(spark, path, registry, limit, *, fraud_only=False, **_):
    return read_payments(spark, path, registry, fraud_only=fraud_only, limit=limit)


def _earliest(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in time; ties are broken by a hash of the row."""
    return rows.orderBy("timestamp", F.xxhash64(*rows.columns)).limit(limit) if limit else rows


def _sensors(spark, path, registry, limit, **_):
    return _earliest(read_sensor_wide(spark, path), limit)


def _edges(spark, path, registry, limit, **_):
    return _earliest(edges_to_canonical(spark.read.parquet(path), registry), limit)


def _deception(spark, path, registry, limit, *, zone=None, **_):
    return _earliest(honeytoken_events(spark.read.parquet(path), inv.decoys(spark), zone=zone), limit)


READERS: dict[str, Callable[..., DataFrame]] = {
    "cic_ids2017": _flows,
    "paysim": _payments,
    "swat": _sensors,
    "synthetic": _edges,
    "deception": _deception,
}


def load_dataset(
    spark: SparkSession, name: str, path: str, *, limit: int | None = None, registry: DataFrame | None = None, **options
) -> DataFrame:
    """Read a named dataset as canonical events (plus its feature columns)."""
    key = name.strip().lower()
    if key not in READERS:
        raise ValueError(f"unknown dataset {name!r}; one of {sorted(READERS)}")
    registry = inv.registry(spark) if registry is None else registry
    return require_columns(READERS[key](spark, path, registry, limit, **options))
