"""Queries over alert and prevention policy."""

from pyspark.sql import functions as F

from ripplewatch.functions.partitions import cut_lineage
from ripplewatch.operators import policy
from ripplewatch.operators.chains import debounce
from ripplewatch.operators.fusion import rationale
from ripplewatch.plans.catalog import cte, query
from ripplewatch.plans.channels import fused, half_up

POLICY = {"volumetric_enabled": True, "score_floor": 0.8, "hybrid_enabled": True}
HALF_DAY = 43_200
TTL = (6 * 3600, 12 * 3600, 24 * 3600)


def _greedy(source: str, key: str, gap: int) -> str:
    """Recursive SQL for 'accept if at least gap seconds after the last accepted row'."""
    return f"""ordered AS (SELECT {key} AS grp, event_id, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {source}),
      walk AS (SELECT grp, rn, event_id, ts AS last_ts, TRUE AS ok FROM ordered WHERE rn = 1
        UNION ALL SELECT o.grp, o.rn, o.event_id, CASE WHEN epoch_us(o.ts) - epoch_us(w.last_ts) >= {gap}000000 THEN o.ts ELSE w.last_ts END,
          epoch_us(o.ts) - epoch_us(w.last_ts) >= {gap}000000 FROM walk w JOIN ordered o ON o.grp = w.grp AND o.rn = w.rn + 1)"""


@query(
    "debounced_events",
    f"WITH {_greedy('flows', 'source_ip', HALF_DAY)} SELECT event_id, grp AS source_ip FROM walk WHERE ok",
)
def debounced_events(t):
    return debounce(t.flows, "source_ip", gap_sec=HALF_DAY).select("event_id", "source_ip")


cte(
    "alert_candidates",
    """SELECT *, CASE WHEN tripwire_fired THEN 'tripwire' WHEN is_anomaly AND volumetric_score >= 0.8 THEN 'volumetric'
        WHEN NOT is_anomaly AND fused_action = 'alert' THEN 'hybrid' END AS alert_kind FROM fused
        WHERE tripwire_fired OR (is_anomaly AND volumetric_score >= 0.8) OR (NOT is_anomaly AND fused_action = 'alert')""",
)


@query("alert_candidates", "SELECT event_id, alert_kind FROM alert_candidates")
def alert_candidates(t):
    return policy.alert_candidates(fused(t), **POLICY).select("event_id", "alert_kind")


def _alerts(t):
    return policy.alerts(fused(t), debounce_sec=HALF_DAY, **POLICY)


@query(
    "alerts",
    f"""WITH {_greedy('alert_candidates', 'source_asset', HALF_DAY)}
        SELECT c.event_id, c.source_asset, c.alert_kind, CASE c.alert_kind WHEN 'tripwire' THEN 'critical' ELSE 'warning' END AS severity,
          CASE c.alert_kind WHEN 'tripwire' THEN 'Honeytoken credential used' WHEN 'volumetric' THEN 'Anomalous traffic volume' ELSE 'Hybrid detection: correlated signal' END AS title
        FROM walk w JOIN alert_candidates c USING (event_id) WHERE ok""",
)
def alerts(t):
    out = policy.alert_content(rationale(_alerts(t)))
    return out.select("event_id", "source_asset", "alert_kind", "severity", "title")


_TOLD = "threat_score double, band string, action string, rationale string, verdicts array<struct<detector: string, fired: boolean>>"


@query(
    "alert_details",
    f"""WITH {_greedy('alert_candidates', 'source_asset', HALF_DAY)}
        SELECT c.event_id, round(c.threat_score, 6) AS threat_score, c.band, c.fused_action AS action, r.rationale,
          'volumetric:' || c.is_anomaly || ' tripwire:' || c.tripwire_fired || ' supervised:' || (c.supervised_score >= 0.5) ||
            ' signature:' || (c.signature_n > 0) || ' beaconing:' || c.beacon_fired AS verdicts,
          CASE c.alert_kind WHEN 'tripwire' THEN c.source_asset || ' took part in traffic that presented a planted credential. Nobody is ever given that credential, so its use proves an intrusion.'
            WHEN 'volumetric' THEN 'Traffic volume of ' || c.source_asset || ' is unusual: score ' || {half_up("c.volumetric_score", 3)} || '. Learned without labels.'
            ELSE 'Combined evidence puts ' || c.source_asset || ' in band ' || c.band || ' at threat score ' || {half_up("c.threat_score", 3)} || '. Channels: ' ||
              concat_ws(', ', CASE WHEN c.supervised_score >= 0.5 THEN 'supervised' END, CASE WHEN c.signature_n > 0 THEN 'signature' END,
                CASE WHEN c.beacon_fired THEN 'beaconing' END) || '. ' || r.rationale END AS detail
        FROM walk w JOIN alert_candidates c USING (event_id) JOIN rationales r USING (event_id) WHERE ok""",
)
def alert_details(t):
    """The detail text, and the JSON explanation read back into columns."""
    out = policy.alert_content(rationale(_alerts(t)))
    out = out.select("event_id", "detail", F.from_json("explanation", _TOLD).alias("told"))
    fired = F.transform("told.verdicts", lambda v: F.concat_ws(":", v["detector"], v["fired"].cast("string")))
    return out.select(
        "event_id", "detail", F.round("told.threat_score", 6).alias("threat_score"), "told.band", "told.action",
        "told.rationale", F.array_join(fired, " ").alias("verdicts"),
    )


@query(
    "impact_snapshots",
    f"WITH {_greedy('alert_candidates', 'source_asset', 6 * 3600)} SELECT event_id FROM walk WHERE ok",
)
def impact_snapshots(t):
    return policy.snapshots(policy.alert_candidates(fused(t), **POLICY), reuse_sec=6 * 3600).select("event_id")


@query(
    "alert_snapshots",
    f"""WITH {_greedy('alert_candidates', 'source_asset', HALF_DAY)},
        snap_ordered AS (SELECT *, row_number() OVER (PARTITION BY source_asset ORDER BY ts, event_id) AS rn FROM alert_candidates),
        snap_walk AS (SELECT source_asset, rn, event_id, ts AS last_ts, TRUE AS ok FROM snap_ordered WHERE rn = 1
          UNION ALL SELECT o.source_asset, o.rn, o.event_id,
            CASE WHEN epoch_us(o.ts) - epoch_us(w.last_ts) >= 21600000000 THEN o.ts ELSE w.last_ts END,
            epoch_us(o.ts) - epoch_us(w.last_ts) >= 21600000000 FROM snap_walk w JOIN snap_ordered o ON o.source_asset = w.source_asset AND o.rn = w.rn + 1)
        SELECT w.event_id, (SELECT max_by(s.event_id, s.last_ts) FROM snap_walk s WHERE s.ok AND s.source_asset = w.grp AND s.last_ts <= w.last_ts) AS snapshot_event_id
        FROM walk w WHERE w.ok""",
)
def alert_snapshots(t):
    candidates = policy.alert_candidates(fused(t), **POLICY).select(
        "event_id", "ts", "source_asset", "alert_kind"
    )
    candidates = cut_lineage(candidates)  # both branches below start here
    alert_rows = debounce(candidates, "source_asset", gap_sec=HALF_DAY)
    snaps = policy.snapshots(candidates, reuse_sec=6 * 3600)
    return policy.with_snapshot(alert_rows, snaps).select("event_id", "snapshot_event_id")


cte(
    "decisions",
    """SELECT *, CASE WHEN band IN ('benign', 'suspicious') THEN 'observe' WHEN NOT (tripwire_fired OR n_fired >= 2) THEN 'alert'
        WHEN threat_score >= 0.85 AND source_criticality >= 0.85 AND cii_median >= 0.1 THEN 'quarantine'
        WHEN threat_score >= 0.85 AND source_criticality >= 0.5 THEN 'block'
        WHEN threat_score >= 0.55 THEN 'rate_limit' ELSE 'alert' END AS prevention
       FROM (SELECT *, CASE WHEN k % 4 <> 0 THEN source_criticality * 0.15::DOUBLE END AS cii_median FROM fused)""",
)


def _decisions(t):
    rows = fused(t).withColumn("cii_median", F.when(F.col("k") % 4 != 0, F.col("source_criticality") * 0.15))
    return policy.prevention_decisions(rows, ttl=TTL)


@query(
    "prevention_decisions",
    f"""SELECT event_id, prevention, CASE prevention WHEN 'rate_limit' THEN {TTL[0]} WHEN 'block' THEN {TTL[1]} WHEN 'quarantine' THEN {TTL[2]} END AS ttl_sec FROM decisions""",
)
def prevention_decisions(t):
    return _decisions(t).select("event_id", "prevention", "ttl_sec")


_LIFE = f"CASE lvl WHEN 2 THEN {TTL[0]} WHEN 3 THEN {TTL[1]} WHEN 4 THEN {TTL[2]} END"


@query(
    "prevention_state",
    f"""WITH steps AS (SELECT source_asset, event_id, ts, epoch_us(ts) AS us, prevention, CASE prevention WHEN 'alert' THEN 1 WHEN 'rate_limit' THEN 2 WHEN 'block' THEN 3 ELSE 4 END AS lvl,
          row_number() OVER (PARTITION BY source_asset ORDER BY ts, event_id) AS rn FROM decisions WHERE prevention <> 'observe'),
        timed AS (SELECT *, us + ({_LIFE})::BIGINT * 1000000 AS ends FROM steps),
        state AS (SELECT source_asset, rn, event_id, us, lvl, ends, TRUE AS written, CASE WHEN lvl >= 2 THEN lvl ELSE 0 END AS cur, CASE WHEN lvl >= 2 THEN ends ELSE 0 END AS cur_ends FROM timed WHERE rn = 1
          UNION ALL SELECT t.source_asset, t.rn, t.event_id, t.us, t.lvl, t.ends, NOT (s.cur >= t.lvl AND s.cur_ends > t.us),
            CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur WHEN t.lvl >= 2 THEN t.lvl ELSE 0 END,
            CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur_ends WHEN t.lvl >= 2 THEN t.ends ELSE 0 END
          FROM state s JOIN timed t ON t.source_asset = s.source_asset AND t.rn = s.rn + 1),
        lives AS (SELECT event_id, ends, lead(us) OVER (PARTITION BY source_asset ORDER BY rn) AS next_us FROM state WHERE written AND lvl >= 2)
        SELECT s.event_id, CASE WHEN s.written THEN 'written' ELSE 'suppressed' END AS outcome,
          CASE WHEN NOT s.written THEN NULL WHEN s.lvl = 1 THEN 'simulated' WHEN l.next_us < l.ends THEN 'superseded'
               WHEN l.ends <= (SELECT max(us) FROM timed) THEN 'expired' ELSE 'simulated' END AS status
        FROM state s LEFT JOIN lives l USING (event_id)""",
)
def prevention_state(t):
    return policy.prevention_state(_decisions(t), ttl=TTL).select("event_id", "outcome", "status")


@query(
    "active_preventions",
    """SELECT event_id, prevention FROM decisions WHERE prevention IN ('rate_limit', 'block', 'quarantine')""",
)
def active_preventions(t):
    from ripplewatch.operators.prepare import is_active_prevention

    rows = _decisions(t).withColumns({"action": F.col("prevention"), "status": F.lit("simulated")})
    return rows.filter(is_active_prevention()).select("event_id", "prevention")
