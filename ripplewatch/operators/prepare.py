"""Row-level preparation: lookups, defaults, validation, feature projection and filters.

Everything here is a narrow transformation. Nothing shuffles, and filters stay visible to the scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplewatch import inventory as inv
from ripplewatch.functions import net
from ripplewatch.functions.lookup import ladder, map_lookup
from ripplewatch.schema import (
    ACTIVE_KINDS,
    ACTIVE_STATUSES,
    CANONICAL_COLUMNS,
    DETECTOR_VISIBLE,
    SIGNAL_TYPES,
    TRIMMED_COLUMNS,
)


def label_evidence(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``attck_evidence`` and ``calibrated_alert_level`` for a capture label."""
    raw = F.trim(F.col(label))
    known = {name: i for i, (name, _, _) in enumerate(inv.ATTACK_LABELS)}
    levels = {name: level for name, _, level in inv.ATTACK_LABELS}
    evidence = {name: ev for name, ev, _ in inv.ATTACK_LABELS if ev is not None}
    is_known = map_lookup(known, raw).isNotNull()
    is_web = raw.rlike("(?i)web attack")
    upper = F.upper(raw)
    is_sql, is_xss = is_web & upper.contains("SQL"), is_web & upper.contains("XSS")
    return df.withColumn(
        "attck_evidence",
        ladder(
            (is_known, map_lookup(evidence, raw)),
            (is_sql, F.lit("WebAttack_SQLi")),
            (is_xss, F.lit("WebAttack_XSS")),
            (is_web, F.lit("WebAttack_BruteForce")),
            default=raw,
        ),
    ).withColumn(
        "calibrated_alert_level",
        ladder(
            (is_known, map_lookup(levels, raw)),
            (is_sql, F.lit("CRITICAL")),
            (is_xss, F.lit("MEDIUM")),
            (is_web, F.lit("HIGH")),
            default=F.lit("MEDIUM"),
        ),
    )


def payment_mapping(df: DataFrame, *, kind: str = "type", fraud: str = "isFraud") -> DataFrame:
    """Add action, service, protocol, evidence, level and zone of a payment; fraud overrides the action."""
    upper = F.upper(F.col(kind))
    is_fraud = F.col(fraud).cast("int") == 1

    def pick(i: int, default: str) -> Column:
        return F.coalesce(map_lookup({row[0]: row[i] for row in inv.PAYMENT_TYPES}, upper), F.lit(default))

    return df.select(
        "*",
        F.when(is_fraud, "ALERT").otherwise(pick(1, "PASS")).alias("action"),
        pick(2, "UnknownService").alias("process_or_service"),
        pick(3, "FINANCIAL_UNKNOWN").alias("protocol"),
        F.when(is_fraud, "TRANSFER_FRAUD").alias("attck_evidence"),
        F.when(is_fraud, "CRITICAL").otherwise("INFO").alias("calibrated_alert_level"),
        F.when(upper.isin(*inv.HIGH_RISK_PAYMENTS), "FINANCIAL_EXTERNAL")
        .otherwise("FINANCIAL_INTERNAL")
        .alias("zone"),
    )


def require_columns(df: DataFrame, columns=CANONICAL_COLUMNS) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def validate_canonical(df: DataFrame) -> DataFrame:
    """Rows that break the canonical contract, with the list of broken rules in ``violations``."""
    require_columns(df)

    def outside(name, low, high=None):
        c = F.col(name)
        bad = (c < low) if high is None else ((c < low) | (c > high))
        return F.when(bad, name)

    checks = [
        F.when(F.col("timestamp").isNull(), "timestamp"),
        *[
            F.when(F.col(c).isNull() | (F.length(c) < 1), c)
            for c in ("source_asset_id", "destination_asset_id")
        ],
        outside("payload_size", 0),
        outside("raw_anomaly_score", 0, 1),
        outside("confidence", 0, 1),
        outside("purdue_level", 0, 5),
        F.when(F.col("signal_type").isNull() | ~F.col("signal_type").isin(*SIGNAL_TYPES), "signal_type"),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*checks))).filter(F.size("violations") > 0)


def trim_text(df: DataFrame, columns=TRIMMED_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns if c in df.columns})


def is_alert() -> Column:
    return F.col("attck_evidence").isNotNull()


def filter_by_provenance(df: DataFrame, provenance: str) -> DataFrame:
    return df.filter(F.col("provenance") == provenance)


def to_ml_features(df: DataFrame) -> DataFrame:
    """Numeric features of canonical rows; a tripwire touch has no volume, so its features are zero."""
    payload = F.greatest(F.col("payload_size").cast("double"), F.lit(0.0))
    duration = F.col("duration_sec").cast("double") if "duration_sec" in df.columns else payload / 1e6
    packets = F.coalesce(F.col("packets").cast("bigint"), F.lit(1)) if "packets" in df.columns else F.lit(1)
    columns = {"duration_sec": duration, "packets": packets.cast("bigint"), "bytes": payload}
    if "signal_type" in df.columns:
        live = F.coalesce(F.col("signal_type") != "deception_tripwire", F.lit(True))
        columns = {n: F.when(live, c).otherwise(F.lit(0).cast(T.LongType() if n == "packets" else T.DoubleType()))
                   for n, c in columns.items()}
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def default_features(df: DataFrame) -> DataFrame:
    """Fill in whichever feature columns the input lacks; without any size there is nothing to analyse."""
    if not {"bytes", "payload_size"} & set(df.columns):
        raise ValueError("flows need a 'bytes' or 'payload_size' column")
    fallback = {
        "bytes": F.col("payload_size") if "payload_size" in df.columns else F.col("bytes"),
        "duration_sec": F.lit(1.0),
        "packets": F.lit(1),
    }
    return df.withColumns({n: c for n, c in fallback.items() if n not in df.columns})


def detector_view(df: DataFrame) -> DataFrame:
    """Only what a detector may look at: no label, no ground truth, no capture identity."""
    return df.select(*[c for c in DETECTOR_VISIBLE if c in df.columns])


def name_services(df: DataFrame, port: str = "destination_port") -> DataFrame:
    return df.withColumn("service", net.port_service(F.col(port)))


def flow_direction(df: DataFrame, registry: DataFrame, *, port: str = "destination_port") -> DataFrame:
    """Assign endpoints to flows that carry no addresses.

    An alerting flow runs from the watch-listed address to the asset serving the port; any other flow runs
    from that asset to the citizen portal. ``registry`` is looked up by exact address only.
    """
    names = registry.select("identifier", "name")
    ports = sorted(set(inv.PORT_ASSETS.values()) | {inv.DEFAULT_PORT_ASSET, inv.PORTAL_IP, inv.ATTACKER_IP})
    by_ip = names.filter(F.col("identifier").isin(ports))
    alert = F.col("action") == "ALERT"
    asset_ip = net.port_asset_ip(F.col(port))
    out = df.withColumns(
        {
            "_src": F.when(alert, inv.ATTACKER_IP).otherwise(asset_ip),
            "_dst": F.when(alert, asset_ip).otherwise(inv.PORTAL_IP),
        }
    )
    # At most len(ports) rows, so both lookups are broadcast.
    src = by_ip.select(F.col("identifier").alias("_src"), F.col("name").alias("source_asset_id"))
    dst = by_ip.select(F.col("identifier").alias("_dst"), F.col("name").alias("destination_asset_id"))
    return out.join(F.broadcast(src), "_src").join(F.broadcast(dst), "_dst").drop("_src", "_dst")


def truth_from_action(action: str = "action") -> Column:
    return F.col(action) == "ALERT"


def truth_from_label(label: str = "label") -> Column:
    return F.upper(F.trim(label)) != "BENIGN"


def is_notable() -> Column:
    return F.col("is_anomaly") | F.col("tripwire_fired") | (F.coalesce(F.col("fused_action"), F.lit("observe")) != "observe")


def event_severity() -> Column:
    return ladder(
        (F.col("tripwire_fired") | (F.col("band") == "confirmed"), F.lit("critical")),
        (F.col("is_anomaly") | (F.col("band") == "likely"), F.lit("warning")),
        default=F.lit("info"),
    )


def is_active_prevention() -> Column:
    return F.col("action").isin(*ACTIVE_KINDS) & F.col("status").isin(*ACTIVE_STATUSES)


def cii_tier(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return ladder(
        (c >= 0.2, F.lit("High")), (c >= 0.05, F.lit("Moderate")), (c > 0, F.lit("Low")), default=F.lit("None")
    )


def retarget(
    flows: DataFrame, assets: DataFrame, *, scenario: str, target: str, count: int, label: str = "label"
) -> DataFrame:
    """What-if rows: the first ``count`` flows of a scenario's label, re-sourced at a chosen asset."""
    if scenario not in inv.SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; one of {sorted(inv.SCENARIOS)}")
    wanted, decoy = inv.SCENARIOS[scenario]
    row = assets.filter((F.col("name") == target) & F.col("ip").isNotNull()).select("ip").first()
    if row is None:
        raise ValueError(f"unknown target asset {target!r}")
    picked = flows.filter(F.col(label) == wanted).orderBy("ts", "event_id").limit(count)
    return picked.withColumns(
        {
            "source_ip": F.lit(row["ip"]),
            "source_row_id": F.concat(F.lit(f"inject:{scenario}:{target}:"), F.col("event_id").cast("string")),
            "origin": F.lit("injected"),
            "is_honeytoken_use": F.lit(True) if decoy else F.col("is_honeytoken_use"),
        }
    )


def with_injected(flows: DataFrame, injected: DataFrame) -> DataFrame:
    """Base rows tagged ``replay`` plus the injected ones."""
    return flows.withColumn("origin", F.lit("replay")).unionByName(injected, allowMissingColumns=True)


def financial_flag(assets: DataFrame) -> DataFrame:
    return assets.withColumn("is_financial", F.col("type").isin(*inv.FINANCIAL_TYPES))


def replay_slice(flows: DataFrame, *, start_at=None, limit: int | None = None) -> DataFrame:
    """Rows from ``start_at`` (``HH:MM`` of the first day, or a full timestamp) in time order, at most ``limit``."""
    out = flows
    if start_at is not None:
        text = str(start_at)
        if len(text) <= 5:
            day = flows.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
            text = f"{day} {text}:00"
        out = out.filter(F.col("ts") >= F.lit(text).cast(flows.schema["ts"].dataType))
    out = out.orderBy("ts", "event_id")
    return out.limit(limit) if limit is not None else out


def json_payload(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def score_calibration(raw) -> Column:
    """Sigmoid of a signed decision value; lower (more anomalous) gives a higher score."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return 1.0 / (1.0 + F.exp(5.0 * c))


def finite(value: Column) -> Column:
    """The value as a double, null when it is missing, not a number or infinite."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
