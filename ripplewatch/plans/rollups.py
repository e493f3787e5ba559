"""Queries over the console roll-ups."""

from pyspark.sql import functions as F

from ripplewatch.operators import prepare as P
from ripplewatch.operators import rollup, volumetric
from ripplewatch.plans.catalog import cte, query
from ripplewatch.plans.channels import fused


def flagged(t):
    return volumetric.tripwire(t.resolved)


cte(
    "flagged",
    "SELECT *, is_honeytoken_use AS tripwire_fired FROM resolved",
)
cte(
    "touched_subnets",
    """SELECT event_id, is_anomaly, is_honeytoken_use AS t, unnest(list_distinct([
        regexp_extract(source_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24', regexp_extract(destination_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'])) AS subnet FROM flows""",
)
cte(
    "subnet_stats",
    """SELECT subnet, count(*) AS events, count(*) FILTER (is_anomaly AND NOT t) AS anomalies, count(*) FILTER (t) AS tripwires
       FROM touched_subnets GROUP BY subnet""",
)
cte(
    "subnet_pairs",
    """SELECT source, target, count(*) AS events FROM (SELECT regexp_extract(source_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS source,
       regexp_extract(destination_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS target FROM flows) WHERE source <> target GROUP BY ALL""",
)
cte("top_subnets", "SELECT subnet FROM subnet_stats ORDER BY events DESC, subnet LIMIT 8")


@query(
    "detector_stats",
    """SELECT detector, count(*) AS scored, count(*) FILTER (fired) AS fired, round(avg(score), 6) AS mean_score FROM (
        SELECT 'volumetric' AS detector, volumetric_score AS score, is_anomaly AS fired FROM fused
        UNION ALL SELECT 'tripwire', 1.0, TRUE FROM fused WHERE tripwire_fired
        UNION ALL SELECT 'supervised', supervised_score, supervised_score >= 0.5 FROM fused
        UNION ALL SELECT 'signature', signature_score, signature_n > 0 FROM fused
        UNION ALL SELECT 'beaconing', beacon_score, beacon_fired FROM fused
        UNION ALL SELECT 'hybrid', threat_score, band <> 'benign' FROM fused) GROUP BY detector""",
)
def detector_stats(t):
    from ripplewatch.operators.fusion import score_rows

    stats = rollup.detector_stats(score_rows(fused(t)))
    return stats.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "top_anomaly_sources",
    """SELECT source_asset, count(*) AS anomalies FROM resolved WHERE is_anomaly GROUP BY source_asset ORDER BY anomalies DESC, source_asset LIMIT 10""",
)
def top_anomaly_sources(t):
    return rollup.top_sources(t.resolved)


@query(
    "score_histogram",
    """SELECT greatest(0, least(19, floor(volumetric_score * 20)))::INT AS bin, is_anomaly AS flagged, count(*) AS n FROM flows GROUP BY ALL""",
)
def score_histogram(t):
    return rollup.score_histogram(t.flows, score="volumetric_score")


@query(
    "network_risk",
    """SELECT count(*) AS total_connections, count(*) FILTER (is_anomaly) AS anomalies, 100 * avg(is_anomaly::INT) AS anomaly_percent,
       least(100, floor(300 * avg(is_anomaly::INT)))::BIGINT AS network_risk FROM flows""",
)
def network_risk(t):
    return volumetric.network_risk(t.flows)


@query(
    "asset_status",
    """SELECT name, CASE WHEN name IN (SELECT source_asset FROM resolved WHERE is_honeytoken_use UNION SELECT destination_asset FROM resolved WHERE is_honeytoken_use)
       THEN 'Threat Highlighted' ELSE 'Secure' END AS status FROM assets""",
)
def asset_status(t):
    return rollup.asset_status(t.resolved, t.assets, flag="is_honeytoken_use").select("name", "status")


@query(
    "anomalous_endpoints",
    "SELECT source_asset AS asset FROM resolved WHERE is_anomaly UNION SELECT destination_asset FROM resolved WHERE is_anomaly",
)
def anomalous_endpoints(t):
    return rollup.anomalous_endpoints(t.resolved)


@query("subnet_rollup", "SELECT * FROM subnet_stats")
def subnet_rollup(t):
    return rollup.subnet_rollup(volumetric.tripwire(t.flows))


@query("subnet_links", "SELECT * FROM subnet_pairs")
def subnet_links(t):
    return rollup.subnet_links(t.flows)


@query(
    "capped_subnets",
    """SELECT id, sum(events)::BIGINT AS events, sum(anomalies)::BIGINT AS anomalies, sum(tripwires)::BIGINT AS tripwires, count(*) AS subnets FROM (
         SELECT s.*, CASE WHEN t.subnet IS NULL THEN 'other' ELSE s.subnet END AS id FROM subnet_stats s LEFT JOIN top_subnets t USING (subnet)) GROUP BY id""",
)
def capped_subnets(t):
    return rollup.capped_subnets(volumetric.tripwire(t.flows), cap=8)[0]


@query(
    "capped_subnet_links",
    """SELECT source, target, sum(events)::BIGINT AS events FROM (
         SELECT CASE WHEN a.subnet IS NULL THEN 'other' ELSE p.source END AS source, CASE WHEN b.subnet IS NULL THEN 'other' ELSE p.target END AS target, events
         FROM subnet_pairs p LEFT JOIN top_subnets a ON a.subnet = p.source LEFT JOIN top_subnets b ON b.subnet = p.target)
       WHERE source <> target GROUP BY ALL""",
)
def capped_subnet_links(t):
    return rollup.capped_subnets(volumetric.tripwire(t.flows), cap=8)[1]


@query(
    "sector_activity",
    """SELECT sector, count(*) AS events, CASE max(lvl) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'normal' END AS worst_severity FROM (
         SELECT CASE WHEN r.is_honeytoken_use THEN 2 WHEN r.is_anomaly THEN 1 ELSE 0 END AS lvl, unnest(list_distinct([s.sector, d.sector])) AS sector
         FROM resolved r LEFT JOIN assets s ON s.name = r.source_asset LEFT JOIN assets d ON d.name = r.destination_asset)
       WHERE sector IS NOT NULL GROUP BY sector""",
)
def sector_activity(t):
    return rollup.sector_activity(flagged(t), t.assets)


@query(
    "asset_recency",
    """SELECT asset, last_tripwire, last_anomaly, CASE WHEN last_tripwire >= now - INTERVAL 2 DAY THEN 'critical'
         WHEN last_anomaly >= now - INTERVAL 2 DAY THEN 'warning' ELSE 'normal' END AS severity FROM (
       SELECT asset, max(ts) FILTER (is_honeytoken_use) AS last_tripwire, max(ts) FILTER (is_anomaly AND NOT is_honeytoken_use) AS last_anomaly,
         (SELECT max(ts) FROM flows) AS now FROM (
           SELECT source_asset AS asset, ts, is_anomaly, is_honeytoken_use FROM resolved
           UNION ALL SELECT destination_asset, ts, is_anomaly, is_honeytoken_use FROM resolved)
       WHERE asset IN (SELECT name FROM assets) GROUP BY asset)""",
)
def asset_recency(t):
    return rollup.asset_recency(flagged(t), t.assets, pulse_sec=172_800)


# Stored alerts: the loud events, severity by type, acknowledged when the key is even.
ALERTS = """SELECT event_id AS alert_id, ts, source_asset AS asset,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  k % 2 = 0 AS acknowledged FROM {resolved} WHERE value > 150"""
cte("alerts", ALERTS.format(resolved="resolved"))


def alerts(t):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning")
    return t.resolved.filter(F.col("value") > 150).select(
        F.col("event_id").alias("alert_id"), "ts", F.col("source_asset").alias("asset"),
        severity.otherwise("info").alias("severity"), (F.col("k") % 2 == 0).alias("acknowledged"),
    )


@query(
    "alert_trend",
    """SELECT least(23, floor((epoch_us(ts) - lo) / span * 24))::INT AS bucket, count(*) FILTER (severity = 'critical') AS high,
       count(*) FILTER (severity = 'warning') AS medium, count(*) FILTER (severity = 'info') AS low
       FROM alerts CROSS JOIN (SELECT epoch_us(min(ts)) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS span FROM alerts) GROUP BY ALL""",
)
def alert_trend(t):
    return rollup.alert_trend(alerts(t))


@query(
    "impact_summary",
    """SELECT user_id, count(DISTINCT asset) AS impacted_assets, count(DISTINCT a.sector) AS sectors FROM (
         SELECT user_id, source_asset AS asset FROM resolved UNION SELECT user_id, destination_asset FROM resolved) x
       LEFT JOIN assets a ON a.name = x.asset GROUP BY user_id""",
)
def impact_summary(t):
    pairs = t.resolved.select("user_id", F.array_distinct(F.array("source_asset", "destination_asset")).alias("impacted"))
    return rollup.impact_summary(pairs, t.assets, key="user_id")


@query(
    "session_tallies",
    """SELECT count(*) FILTER (tripwire) AS tripwire_hits, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (inj) AS injected FROM (
         SELECT is_honeytoken_use AS tripwire, is_anomaly, FALSE AS inj FROM flows
         UNION ALL SELECT TRUE, is_anomaly, TRUE FROM (SELECT * FROM flows WHERE label = 'Bot' ORDER BY ts, event_id LIMIT 50))""",
)
def session_tallies(t):
    extra = P.retarget(t.flows, t.assets, scenario="honeytoken", target="City_Operations_Center", count=50)
    return rollup.session_tallies(volumetric.tripwire(P.with_injected(t.flows, extra)))


@query(
    "batch_counters",
    """SELECT date_trunc('day', ts) AS day, count(*) AS received, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (tripwire_fired) AS tripwires,
       count(*) FILTER (fused_action = 'alert') AS escalated, count(*) FILTER (is_anomaly) AS volumetric_hits,
       count(*) FILTER (supervised_score >= 0.5) AS supervised_hits, count(*) FILTER (signature_n > 0) AS signature_hits,
       count(*) FILTER (beacon_fired) AS beaconing_hits FROM fused GROUP BY ALL""",
)
def batch_counters(t):
    day = fused(t).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return rollup.batch_counters(day, by=["day"])
