"""Read queries over stored events, scores, alerts and actions.

Pages are top-k sorts; score rows are aggregated per event before they join the page.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import ladder
from ripplewatch.operators.prepare import is_active_prevention


def event_page(events: DataFrame, *, limit: int = S.PAGE_SIZE, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Newest ``limit`` events with ``has_more`` telling whether older ones exist."""
    page = events.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit + 1)
    # At most limit + 1 rows reach these windows.
    rank = F.row_number().over(Window.orderBy(F.col(ts).desc(), F.col(key).desc()))
    size = F.count(F.lit(1)).over(Window.partitionBy())
    return page.withColumns({"_r": rank, "has_more": size > limit}).filter(F.col("_r") <= limit).drop("_r")


def catch_up(events: DataFrame, *, since: int, limit: int | None = None, key: str = "event_id") -> DataFrame:
    """Everything after an id, in id order; the filter prunes row groups by their id range."""
    out = events.filter(F.col(key) > since).orderBy(key)
    return out.limit(limit) if limit else out


def alert_list(alerts: DataFrame, *, acknowledged: bool | None = None, limit: int = S.PAGE_SIZE) -> DataFrame:
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == acknowledged)
    return alerts.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(limit)


def action_list(
    actions: DataFrame, *, asset: str | None = None, active: bool | None = None, limit: int = S.PAGE_SIZE
) -> DataFrame:
    if asset is not None:
        actions = actions.filter(F.col("asset") == asset)
    if active is not None:
        actions = actions.filter(is_active_prevention() if active else ~is_active_prevention())
    return actions.orderBy(F.col("ts").desc(), F.col("action_id").desc()).limit(limit)


def events_with_scores(events: DataFrame, scores: DataFrame, *, key: str = "event_id") -> DataFrame:
    """Events with their score rows pivoted: channel columns, tripwire flag, fused score, fired list."""

    def of(detector: str, column: str):
        return F.max(F.when(F.col("detector") == detector, F.col(column)))

    pivot = scores.groupBy(key).agg(
        of("volumetric", "raw_score").alias("volumetric_raw"),
        of("volumetric", "calibrated_score").alias("volumetric_calibrated"),
        of("volumetric", "is_anomaly").alias("volumetric_anomaly"),
        F.coalesce(of("tripwire", "is_anomaly"), F.lit(False)).alias("tripwire_fired"),
        of("hybrid", "calibrated_score").alias("hybrid_score"),
        # One row per detector and event, so the list is at most as long as the detector registry.
        F.array_sort(
            F.collect_list(F.when(F.col("is_anomaly") & (F.col("detector") != "hybrid"), F.col("detector")))
        ).alias("fired_detectors"),
    )
    return events.join(pivot, key, "left")


def merge_history(
    history: DataFrame, live: DataFrame, *, key: str, ts: str, limit: int, live_wins: bool = True
) -> DataFrame:
    """History and live rows deduplicated by id, newest first, top ``limit``."""
    both = history.withColumn("_p", F.lit(1)).unionByName(live.withColumn("_p", F.lit(0 if live_wins else 2)))
    rest = [c for c in both.columns if c != key]
    one = both.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("_r")).select(key, "_r.*").drop("_p")
    return one.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def latest_series(events: DataFrame, value: str, *, n: int = 40, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest ``n`` values, oldest first."""
    newest = events.select(ts, key, value).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
    return newest.withColumn("position", F.row_number().over(Window.orderBy(ts, key)))


def last_resolved(alerts: DataFrame) -> DataFrame:
    """The newest acknowledged alert, by alert time."""
    return alerts.filter("acknowledged").orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(1)


def eligible_targets(nodes: DataFrame, *, need_ip: bool = True) -> DataFrame:
    """Assets a what-if may aim at: curated, not gateways, sorted by name."""
    out = nodes.filter(~F.col("is_gateway") & F.col("type").isNotNull() & (F.col("type") != "Synthesized Node"))
    if need_ip:
        out = out.filter(F.col("ip").isNotNull())
    return out.orderBy("name")


def acknowledge(alerts: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply acknowledgements (alert_id, ack_ts); the first time stays. Also returns the unknown ids."""
    first = acks.groupBy("alert_id").agg(F.min("ack_ts").alias("_ack"))
    out = alerts.join(first, "alert_id", "left").withColumns(
        {
            "acknowledged_at": F.coalesce("acknowledged_at", "_ack"),
            "acknowledged": F.col("acknowledged") | F.col("_ack").isNotNull(),
        }
    )
    return out.drop("_ack"), first.join(alerts, "alert_id", "left_anti").select("alert_id")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Counts by severity and acknowledgement, with subtotals (nulls mark a total)."""
    return alerts.rollup("severity", "acknowledged").agg(F.count(F.lit(1)).alias("n"))


def risk_index(
    alerts: DataFrame,
    criticality: DataFrame,
    *,
    critical: float = S.RISK_WEIGHT_CRITICAL,
    warning: float = S.RISK_WEIGHT_WARNING,
    other: float = S.RISK_WEIGHT_OTHER,
    full_scale: float = S.RISK_FULL_SCALE,
) -> DataFrame:
    """0..100 from the unacknowledged alerts. Counts per (severity, asset) are reduced before the join."""
    open_ = alerts.filter(~F.col("acknowledged")).groupBy("severity", "asset").agg(F.count(F.lit(1)).alias("n"))
    weight = ladder(
        (F.col("severity") == "critical", F.lit(critical)),
        (F.col("severity") == "warning", F.lit(warning)),
        default=F.lit(other),
    )
    total = F.coalesce(F.sum(weight * F.coalesce("criticality", F.lit(0.0)) * F.col("n")), F.lit(0.0))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * total / full_scale))
    return open_.join(criticality, "asset", "left").agg(F.bround(scaled).cast("int").alias("risk_index"))
