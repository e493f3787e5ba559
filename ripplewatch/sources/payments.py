"""Payment logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.clock import step_timestamp
from ripplewatch.operators.prepare import payment_mapping
from ripplewatch.operators.resolve import resolve_assets

SCHEMA = (
    "step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, "
    "nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"
)


def payments_to_canonical(payments: DataFrame, registry: DataFrame, *, keep=()) -> DataFrame:
    """Payment rows as canonical events plus the three numeric features."""
    rows = resolve_assets(payment_mapping(payments), registry, source="nameOrig", destination="nameDest")
    amount = F.greatest(F.col("amount"), F.lit(0.0))
    return rows.select(
        *keep,
        step_timestamp(F.col("step")).alias("timestamp"),
        F.col("source_asset").alias("source_asset_id"),
        F.col("destination_asset").alias("destination_asset_id"),
        "protocol",
        amount.alias("payload_size"),
        "action",
        "zone",
        "process_or_service",
        "attck_evidence",
        F.lit(None).cast("double").alias("raw_anomaly_score"),
        "calibrated_alert_level",
        F.lit("PaySim").alias("provenance"),
        F.col("resolution_confidence").alias("confidence"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit("financial_txn").alias("signal_type"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        F.lit(4).alias("purdue_level"),
        F.lit(0.0).alias("duration_sec"),
        F.lit(1).cast("bigint").alias("packets"),
        amount.alias("bytes"),
    )


def only_fraud(payments: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Fraudulent rows only; the filter reaches the scan and ``limit`` stops it early."""
    out = payments.filter(F.col("isFraud") == 1)
    return out.limit(limit) if limit else out


def top_up_rare(
    rows: DataFrame, *, limit: int, positive, order, enough: int = 50
) -> DataFrame:
    """The first ``limit`` rows, or a shorter head plus positives from later rows when positives are too rare.

    ``order`` is the file order. The earliest positives of all later rows are taken, as many as a twentieth of ``limit``
    (500 at least), and the head gives up only as many rows as were found.
    """
    from ripplewatch.functions.partitions import with_rank

    ranked = with_rank(rows, order, "_row")
    head = ranked.filter(F.col("_row") <= limit)
    if head.filter(positive).count() >= enough:
        return head.drop("_row")
    extra = max(500, limit // 20)
    later = ranked.filter((F.col("_row") > limit) & positive).orderBy("_row").limit(extra)
    found = min(later.count(), limit)
    return ranked.filter(F.col("_row") <= limit - found).unionByName(later.limit(found)).drop("_row")


def read_payments(
    spark: SparkSession, path: str, registry: DataFrame, *, fraud_only: bool = False, limit: int | None = None
) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=SCHEMA)
    if fraud_only:
        raw = only_fraud(raw, limit=limit)
    elif limit:
        raw = raw.withColumn("_line", F.monotonically_increasing_id())
        raw = top_up_rare(raw, limit=limit, positive=F.col("isFraud") == 1, order=["_line"]).drop("_line")
    return payments_to_canonical(raw, registry)
