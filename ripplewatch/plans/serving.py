"""Read queries over stored events, scores, alerts and actions."""

from pyspark.sql import functions as F

from ripplewatch.operators import sequence, serve
from ripplewatch.operators.fusion import score_rows
from ripplewatch.operators.resolve import criticality_map, resolve_identifiers
from ripplewatch.plans.catalog import query
from ripplewatch.plans.channels import fused
from ripplewatch.plans.rollups import alerts


@query("event_page", "SELECT event_id, ts, TRUE AS has_more FROM flows ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_page(t):
    return serve.event_page(t.flows.select("event_id", "ts"))


@query("catch_up", "SELECT event_id, ts, event_type FROM flows WHERE event_id > 500")
def catch_up(t):
    return serve.catch_up(t.flows, since=500).select("event_id", "ts", "event_type")


@query(
    "open_alerts",
    "SELECT alert_id, asset, severity FROM alerts WHERE NOT acknowledged ORDER BY ts DESC, alert_id DESC LIMIT 100",
)
def open_alerts(t):
    return serve.alert_list(alerts(t), acknowledged=False).select("alert_id", "asset", "severity")


_ACTIONS = """(SELECT event_id AS action_id, ts, source_asset AS asset, CASE k % 4 WHEN 0 THEN 'alert' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'block' ELSE 'quarantine' END AS action,
   CASE k % 3 WHEN 0 THEN 'simulated' WHEN 1 THEN 'expired' ELSE 'enforced' END AS status FROM resolved WHERE value > 100)"""


def actions(t):
    return t.resolved.filter(F.col("value") > 100).select(
        F.col("event_id").alias("action_id"), "ts", F.col("source_asset").alias("asset"),
        F.expr("CASE k % 4 WHEN 0 THEN 'alert' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'block' ELSE 'quarantine' END").alias("action"),
        F.expr("CASE k % 3 WHEN 0 THEN 'simulated' WHEN 1 THEN 'expired' ELSE 'enforced' END").alias("status"),
    )


_ACTIVE = "action IN ('rate_limit','block','quarantine') AND status IN ('simulated','enforced')"


@query(
    "active_actions",
    f"SELECT action_id, asset, action, status FROM {_ACTIONS} WHERE {_ACTIVE} ORDER BY ts DESC, action_id DESC LIMIT 100",
)
def active_actions(t):
    return serve.action_list(actions(t), active=True).select("action_id", "asset", "action", "status")


@query(
    "inactive_actions_of_asset",
    f"SELECT action_id, action, status FROM {_ACTIONS} WHERE NOT ({_ACTIVE}) AND asset = 'Grid_SCADA' ORDER BY ts DESC, action_id DESC LIMIT 100",
)
def inactive_actions_of_asset(t):
    return serve.action_list(actions(t), asset="Grid_SCADA", active=False).select("action_id", "action", "status")


@query(
    "events_with_scores",
    """SELECT event_id, volumetric_score AS volumetric_calibrated, is_anomaly AS volumetric_anomaly, tripwire_fired, round(threat_score, 6) AS hybrid_score,
       concat_ws(',', CASE WHEN beacon_fired THEN 'beaconing' END, CASE WHEN signature_n > 0 THEN 'signature' END,
         CASE WHEN supervised_score >= 0.5 THEN 'supervised' END, CASE WHEN tripwire_fired THEN 'tripwire' END, CASE WHEN is_anomaly THEN 'volumetric' END) AS fired
       FROM fused""",
)
def events_with_scores(t):
    scores = score_rows(fused(t))
    out = serve.events_with_scores(t.flows.select("event_id"), scores)
    return out.select(
        "event_id", "volumetric_calibrated", "volumetric_anomaly", "tripwire_fired",
        F.round("hybrid_score", 6).alias("hybrid_score"), F.concat_ws(",", "fired_detectors").alias("fired"),
    )


def _two_copies(t):
    history = alerts(t).filter(F.col("acknowledged")).withColumn("severity", F.lit("stored"))
    return history, alerts(t)


_BOTH = """(SELECT a.alert_id, a.ts, CASE WHEN {rule} THEN 'stored' ELSE a.severity END AS severity FROM alerts a)"""


@query(
    "merged_alerts_live_first",
    "SELECT alert_id, severity FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 200",
)
def merged_alerts_live_first(t):
    history, live = _two_copies(t)
    return serve.merge_history(history, live, key="alert_id", ts="ts", limit=200).select("alert_id", "severity")


@query(
    "merged_alerts_stored_first",
    f"SELECT alert_id, severity FROM {_BOTH.format(rule='a.acknowledged')} ORDER BY ts DESC, alert_id DESC LIMIT 50",
)
def merged_alerts_stored_first(t):
    history, live = _two_copies(t)
    out = serve.merge_history(history, live, key="alert_id", ts="ts", limit=50, live_wins=False)
    return out.select("alert_id", "severity")


@query(
    "score_sparkline",
    """SELECT row_number() OVER (ORDER BY ts, event_id) AS position, volumetric_score FROM (SELECT * FROM flows ORDER BY ts DESC, event_id DESC LIMIT 40)""",
)
def score_sparkline(t):
    return serve.latest_series(t.flows, "volumetric_score").select("position", "volumetric_score")


@query("last_resolved", "SELECT alert_id, asset FROM alerts WHERE acknowledged ORDER BY ts DESC, alert_id DESC LIMIT 1")
def last_resolved(t):
    return serve.last_resolved(alerts(t)).select("alert_id", "asset")


def _acks(t):
    """Acknowledgements from the user clicks, some repeated and some for ids that are no alerts."""
    rows = t.flows.filter("event_type = 'click' AND k < 40").select(F.col("event_id").alias("alert_id"), F.col("ts").alias("ack_ts"))
    again = t.flows.filter("event_type = 'click' AND k < 10").select(
        F.col("event_id").alias("alert_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ack_ts")
    )
    base = alerts(t).withColumn("acknowledged_at", F.when(F.col("acknowledged"), F.col("ts")))
    return serve.acknowledge(base, rows.union(again))


@query(
    "acknowledged_alerts",
    """SELECT a.alert_id, a.acknowledged OR f.event_id IS NOT NULL AS acknowledged, CASE WHEN a.acknowledged THEN a.ts ELSE f.ts END AS acknowledged_at
       FROM alerts a LEFT JOIN (SELECT event_id, ts FROM flows WHERE event_type = 'click' AND k < 40) f ON f.event_id = a.alert_id""",
)
def acknowledged_alerts(t):
    return _acks(t)[0].select("alert_id", "acknowledged", "acknowledged_at")


@query(
    "unknown_acknowledgements",
    "SELECT event_id AS alert_id FROM flows WHERE event_type = 'click' AND k < 40 AND event_id NOT IN (SELECT alert_id FROM alerts)",
)
def unknown_acknowledgements(t):
    return _acks(t)[1]


@query(
    "alert_counts",
    "SELECT severity, acknowledged, count(*) AS n FROM alerts GROUP BY ROLLUP (severity, acknowledged)",
)
def alert_counts(t):
    return serve.alert_counts(alerts(t))


@query(
    "risk_index",
    """SELECT CAST(round_even(greatest(0, least(100, 100 * sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.35 ELSE 0.1 END::DOUBLE * coalesce(c.criticality, 0)) / 2000.0)), 0) AS INT) AS risk_index
       FROM alerts a LEFT JOIN (SELECT name, any_value(criticality) AS criticality FROM assets GROUP BY name) c ON c.name = a.asset WHERE NOT acknowledged""",
)
def risk_index(t):
    criticality = t.assets.select(F.col("name").alias("asset"), "criticality")
    return serve.risk_index(alerts(t), criticality, full_scale=2000.0)


@query(
    "risk_index_by_map",
    """SELECT CAST(round_even(greatest(0, least(100, 100 * sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.35 ELSE 0.1 END::DOUBLE * coalesce(c.criticality, 0)) / 5.0)), 0) AS INT) AS risk_index
       FROM alerts a LEFT JOIN (SELECT asset, max(criticality) AS criticality FROM (
         SELECT name AS asset, max_by(criticality, position) AS criticality FROM registry GROUP BY name
         UNION ALL SELECT r.asset, r.criticality FROM resolution r WHERE NOT r.is_known AND r.asset LIKE 'Unresolved!_%' ESCAPE '!') GROUP BY asset) c ON c.asset = a.asset
       WHERE NOT acknowledged""",
)
def risk_index_by_map(t):
    """With the default scale and a criticality map that includes discovered assets."""
    ids = t.flows.select(F.col("source_ip").alias("identifier")).distinct()
    table = criticality_map(t.registry, resolve_identifiers(ids, t.registry)).select("asset", "criticality")
    return serve.risk_index(alerts(t), table.dropDuplicates(["asset"]))


@query(
    "retention_victims",
    """SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, max(ts) OVER () AS newest FROM flows)
       WHERE r > 2000 OR ts < newest - INTERVAL 5 DAY""",
)
def retention_victims(t):
    rows = t.flows.select("event_id", "ts")
    return sequence.retention_victims(rows, max_rows=2000, max_age_sec=5 * 86_400).select("event_id")
