"""Queries over the detection channels and their fusion."""

from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.quantile import exact_quantiles
from ripplewatch.operators import beacon, fusion, iforest, signature, volumetric
from ripplewatch.operators.resolve import resolve_assets
from ripplewatch.plans.catalog import cte, query

_FEATURES = S.FEATURES

# The drift queries live with the ordered queries; this module covers the per-row and per-pair channels.
BEACON = {"max_interval_sec": 864000.0}


@query(
    "scaler_statistics",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale,
            stddev_pop({f}) = 0 AS degenerate FROM flows"""
        for f in _FEATURES
    ),
)
def scaler_statistics(t):
    table = volumetric.scaler_table(t.flows)
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


cte(
    "mad",
    "SELECT " + ", ".join(
        f"m_{f}, (SELECT median(abs({f} - m_{f})) FROM flows) AS d_{f}" for f in _FEATURES
    ) + " FROM (SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in _FEATURES) + " FROM flows)",
)
cte(
    "sigma",
    "SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in _FEATURES
    ) + " FROM flows",
)


@query(
    "median_deviation",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, m_{f} AS median, CASE WHEN d_{f} = 0 THEN 1 ELSE d_{f} END AS mad FROM mad" for f in _FEATURES
    ),
)
def median_deviation(t):
    model = volumetric.fit_mad(t.flows)
    return t.spark.createDataFrame(
        [(m.name, m.centre, m.spread) for m in model], "feature string, median double, mad double"
    )


_Z = "greatest(" + ", ".join(f"abs(({f} - m_{f}) / s_{f})" for f in _FEATURES) + ")"
_M = "greatest(" + ", ".join(
    f"abs(0.6745 * (({f} - m_{f}) / CASE WHEN d_{f} = 0 THEN 1 ELSE d_{f} END))" for f in _FEATURES
) + ")"


@query(
    "zscore_detector",
    f"SELECT event_id, round({_Z}, 6) AS score, {_Z} > 3 AS fired FROM flows CROSS JOIN sigma",
)
def zscore_detector(t):
    scored = volumetric.score_zscore(t.flows, volumetric.fit_scaler(t.flows))
    return scored.select("event_id", F.round("score", 6).alias("score"), "fired")


@query("mad_detector", f"SELECT event_id, {_M} AS score, {_M} > 3.5 AS fired FROM flows CROSS JOIN mad")
def mad_detector(t):
    scored = volumetric.score_mad(t.flows, volumetric.fit_mad(t.flows))
    return scored.select("event_id", "score", "fired")


@query(
    "contamination_quantile",
    "SELECT quantile_cont(value, 0.08) AS low, quantile_cont(value, 0.95) AS high FROM flows",
)
def contamination_quantile(t):
    low, high = exact_quantiles(t.flows, "value", [S.FOREST_CONTAMINATION, 0.95])
    return t.spark.createDataFrame([(low, high)], "low double, high double")


_ZS = {f: f"(({f} - m_{f}) / s_{f})" for f in _FEATURES}


@query(
    "zscore_explanation",
    f"""SELECT event_id, top_feature, round(z, 6) AS top_z, CASE WHEN v > m THEN 'above' WHEN v < m THEN 'below' ELSE 'at' END AS direction
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(z) DESC, pos) AS rn FROM ("""
    + " UNION ALL ".join(
        f"SELECT event_id, '{f}' AS top_feature, {i} AS pos, {_ZS[f]} AS z, {f}::DOUBLE AS v, m_{f} AS m FROM flows CROSS JOIN sigma"
        for i, f in enumerate(_FEATURES)
    )
    + ")) WHERE rn = 1",
)
def zscore_explanation(t):
    rows = volumetric.explain(t.flows, volumetric.fit_scaler(t.flows))
    top = F.col("features")[0]
    return rows.select(
        "event_id", "top_feature", F.round(top["z"], 6).alias("top_z"), top["direction"].alias("direction")
    )


@query(
    "tripwire_flags",
    """SELECT event_id, is_honeytoken_use AS tripwire_fired, CASE WHEN is_honeytoken_use THEN -100.0 ELSE 0.0 END::DOUBLE AS tripwire_score FROM flows""",
)
def tripwire_flags(t):
    return volumetric.tripwire(t.flows).select("event_id", "tripwire_fired", "tripwire_score")


@query(
    "two_channel_confidence",
    """SELECT event_id, CASE WHEN is_anomaly AND is_honeytoken_use THEN 0.99 WHEN is_honeytoken_use THEN 0.9
       WHEN is_anomaly THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM flows""",
)
def two_channel_confidence(t):
    return volumetric.two_channel_confidence(volumetric.tripwire(t.flows)).select("event_id", "confidence")


_EXTERNAL_DST = "(destination_ip LIKE '8.8.%' OR destination_ip LIKE '185.%')"
cte(
    "signatures",
    f"""SELECT event_id, r1, r2, r4, r5, CASE WHEN r1 THEN 0.9 WHEN r5 THEN 0.65 WHEN r2 THEN 0.5 WHEN r4 THEN 0.4 ELSE 0 END::DOUBLE AS score,
     (r1::INT + r2::INT + r4::INT + r5::INT) AS n FROM (SELECT event_id,
       destination_ip = '185.220.101.5' AS r1,
       bytes <= 64 AND destination_port >= 1024 AND {_EXTERNAL_DST} AS r2,
       destination_port IN (21, 3389) AS r4, FALSE AS r5 FROM flows)""",
)


@query(
    "signature_rules",
    """SELECT event_id, n > 0 AS signature_fired, score AS signature_score, n::DOUBLE AS signature_raw,
       concat_ws(',', CASE WHEN r1 THEN 'SIG-001' END, CASE WHEN r2 THEN 'SIG-002' END, CASE WHEN r4 THEN 'SIG-004' END) AS rules
       FROM signatures""",
)
def signature_rules(t):
    out = signature.signature_verdicts(t.flows)
    rules = F.concat_ws(",", F.transform("matched_rules", lambda r: r["rule_id"]))
    return out.select("event_id", "signature_fired", "signature_score", "signature_raw", rules.alias("rules"))


@query(
    "custom_signature_rules",
    """SELECT event_id, k > 90 OR protocol = 'UDP' AS fired, CASE WHEN k > 90 THEN 0.8 WHEN protocol = 'UDP' THEN 0.1 ELSE 0 END::DOUBLE AS score FROM flows""",
)
def custom_signature_rules(t):
    rules = [
        signature.Rule("X-1", "late key", 0.8, F.col("k") > 90),
        signature.Rule("X-2", "datagram", 0.1, F.col("protocol") == "UDP"),
    ]
    out = signature.signature_verdicts(t.flows, rules)
    return out.select("event_id", F.col("signature_fired").alias("fired"), F.col("signature_score").alias("score"))


cte(
    "gaps",
    """SELECT *, abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_ip, destination_ip ORDER BY ts, event_id))) / 1e6 AS gap FROM flows""",
)
cte(
    "beacons",
    """SELECT *, CASE WHEN n >= 4 THEN dev / mean END AS cv FROM (
      SELECT *, count(u) OVER w AS n, avg(u) OVER w AS mean, stddev_samp(u) OVER w AS dev
      FROM (SELECT *, CASE WHEN gap BETWEEN 0.5 AND 864000 THEN gap END AS u FROM gaps)
      WINDOW w AS (PARTITION BY source_ip, destination_ip ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))""",
)


@query("pair_intervals", "SELECT event_id, gap AS interval_sec FROM gaps")
def pair_intervals(t):
    return beacon.intervals(t.flows).select("event_id", "interval_sec")


@query(
    "beaconing",
    """SELECT event_id, n AS usable_intervals, round(cv, 6) AS beacon_cv, coalesce(cv <= 0.25, FALSE) AS beacon_fired,
       round(CASE WHEN cv IS NULL THEN 0 ELSE greatest(0, 1 - cv / 0.25) END, 6) AS beacon_score FROM beacons""",
)
def beaconing(t):
    out = beacon.beaconing_verdicts(t.flows, **BEACON)
    return out.select(
        "event_id", "usable_intervals", F.round("beacon_cv", 6).alias("beacon_cv"), "beacon_fired",
        F.round("beacon_score", 6).alias("beacon_score"),
    )


def fused(t, *, source=None):
    """Flows with every exactly checkable channel, fused and resolved.

    The one shuffle (by pair, for beaconing) comes first, on the bare flow columns; the rest is narrow.
    """
    rows = beacon.beaconing_verdicts(t.flows if source is None else source, **BEACON)
    rows = volumetric.two_channel_confidence(volumetric.tripwire(rows))
    rows = signature.signature_verdicts(resolve_assets(rows, t.registry))
    return fusion.fuse(fusion.collect_verdicts(rows, drift=False))


cte(
    "channel_rows",
    """SELECT r.*, r.is_honeytoken_use AS tripwire_fired, s.score AS signature_score, s.n AS signature_n, b.cv AS beacon_cv,
      coalesce(b.cv <= 0.25, FALSE) AS beacon_fired, CASE WHEN b.cv IS NULL THEN 0 ELSE greatest(0, 1 - b.cv / 0.25) END AS beacon_score,
      CASE WHEN is_anomaly AND is_honeytoken_use THEN 0.99 WHEN is_honeytoken_use THEN 0.9 WHEN is_anomaly THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
      FROM resolved r JOIN signatures s USING (event_id) JOIN (SELECT event_id, cv FROM beacons) b USING (event_id)""",
)
cte(
    "fused",
    """SELECT *, CASE WHEN tripwire_fired OR threat_score >= 0.85 THEN 'confirmed' WHEN threat_score >= 0.55 THEN 'likely'
        WHEN threat_score >= 0.25 THEN 'suspicious' ELSE 'benign' END AS band,
      CASE WHEN tripwire_fired OR threat_score >= 0.55 THEN 'alert' ELSE 'observe' END AS fused_action,
      is_anomaly::INT + tripwire_fired::INT + (supervised_score >= 0.5)::INT + (signature_n > 0)::INT + beacon_fired::INT AS n_fired
     FROM (SELECT *, CASE WHEN tripwire_fired THEN 1.0::DOUBLE ELSE 1 -
        (1 - CASE WHEN is_anomaly THEN volumetric_score * 0.02::DOUBLE ELSE 0 END) *
        (1 - CASE WHEN supervised_score >= 0.5 THEN supervised_score::DOUBLE * 0.9::DOUBLE ELSE 0 END) *
        (1 - CASE WHEN signature_n > 0 THEN signature_score * 0.85::DOUBLE ELSE 0 END) *
        (1 - CASE WHEN beacon_fired THEN beacon_score * 0.5::DOUBLE ELSE 0 END) END AS threat_score FROM channel_rows)""",
)


@query("fused_six_channels")
def fused_six_channels(t):
    """All six channels in one fusion: drift verdicts by source node and bucket join the others; a forest scores them."""
    from ripplewatch.operators import drift
    from ripplewatch.plans.ordered import BUCKET, GAP

    features = drift.drift_features(t.flows, bucket_sec=BUCKET, gap_sec=GAP)
    scored = drift.score_drift(features, baseline_batches=5, refit_every=10)
    rows = beacon.beaconing_verdicts(drift.drift_verdicts(t.flows, scored, bucket_sec=BUCKET), **BEACON)
    rows = volumetric.two_channel_confidence(volumetric.tripwire(rows))
    rows = signature.signature_verdicts(resolve_assets(rows, t.registry))
    out = fusion.fuse(fusion.collect_verdicts(rows))
    return out.select("event_id", "threat_score", "band", "fired_detectors", "drift_fired", "drift_score")


@query(
    "fused_decisions",
    """SELECT event_id, round(threat_score, 6) AS threat_score, band, fused_action, n_fired, tripwire_fired AS has_confirmed FROM fused""",
)
def fused_decisions(t):
    return fused(t).select(
        "event_id", F.round("threat_score", 6).alias("threat_score"), "band", "fused_action", "n_fired", "has_confirmed"
    )


@query(
    "threat_bands_by_asset",
    "SELECT source_asset, band, count(*) AS events, round(max(threat_score), 6) AS worst FROM fused GROUP BY ALL",
)
def threat_bands_by_asset(t):
    return fused(t).groupBy("source_asset", "band").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.max("threat_score"), 6).alias("worst")
    )


def half_up(value: str, digits: int) -> str:
    """SQL for a number's text with so many decimals, ties away from zero as in the JVM's formatter."""
    return f"CAST(CAST(round({value}, 9) AS VARCHAR) AS DECIMAL(18, {digits}))::VARCHAR"


def _told(name: str, fired: str, score: str) -> str:
    return f"CASE WHEN {fired} THEN '{name} ' || {half_up(score, 2)} || ' x{S.RELIABILITY[name]:.2f}' END"


cte(
    "rationales",
    f"""SELECT *, CASE WHEN tripwire_fired THEN 'honeytoken credential used (confirmed)'
        WHEN n_fired = 0 THEN '5 detector(s) ran, none fired'
        ELSE concat_ws(', ', {_told("volumetric", "is_anomaly", "volumetric_score")}, {_told("supervised", "supervised_score >= 0.5", "supervised_score")},
          {_told("signature", "signature_n > 0", "signature_score")}, {_told("beaconing", "beacon_fired", "beacon_score")})
          || ' -> ' || {half_up("threat_score", 2)} END AS rationale FROM fused""",
)


@query("fusion_rationale", "SELECT event_id, rationale FROM rationales")
def fusion_rationale(t):
    return fusion.rationale(fused(t)).select("event_id", "rationale")


@query(
    "score_rows",
    """SELECT event_id, detector, round(score, 6) AS calibrated_score, fired AS is_anomaly, round(conf, 6) AS confidence FROM (
        SELECT event_id, 'volumetric' AS detector, volumetric_score AS score, is_anomaly AS fired, confidence AS conf FROM fused
        UNION ALL SELECT event_id, 'tripwire', 1.0, TRUE, confidence FROM fused WHERE tripwire_fired
        UNION ALL SELECT event_id, 'supervised', supervised_score, supervised_score >= 0.5, supervised_score FROM fused
        UNION ALL SELECT event_id, 'signature', signature_score, signature_n > 0, signature_score FROM fused
        UNION ALL SELECT event_id, 'beaconing', beacon_score, beacon_fired, beacon_score FROM fused
        UNION ALL SELECT event_id, 'hybrid', threat_score, band <> 'benign', threat_score FROM fused)""",
)
def score_rows(t):
    rows = fusion.score_rows(fused(t))
    return rows.select(
        "event_id", "detector", F.round("calibrated_score", 6).alias("calibrated_score"), "is_anomaly",
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "notable_events",
    """SELECT event_id, CASE WHEN tripwire_fired OR band = 'confirmed' THEN 'critical' WHEN is_anomaly OR band = 'likely' THEN 'warning' ELSE 'info' END AS severity
       FROM fused WHERE is_anomaly OR tripwire_fired OR fused_action <> 'observe'""",
)
def notable_events(t):
    from ripplewatch.operators import prepare as P

    return fused(t).filter(P.is_notable()).select("event_id", P.event_severity().alias("severity"))


@query("isolation_forest")
def isolation_forest(t):
    """Fit on every flow and score every flow; random trees have no SQL equivalent."""
    model = iforest.fit_iforest(t.flows)
    scored = iforest.score_iforest(t.flows, model)
    return scored.select("event_id", F.round("score", 6).alias("score"), "fired")


@query("warmup_scorer")
def warmup_scorer(t):
    """Fit once on benign flows, then transform-only scoring of all flows with kept z-scores."""
    model, scaler, _ = iforest.fit_warmup(t.flows.filter(~F.col("is_attack")))
    scored = iforest.score_iforest(volumetric.apply_scaler(t.flows, scaler), model)
    return scored.select("event_id", *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in _FEATURES], "score", "fired")


@query(
    "warmup_metadata",
    "SELECT count(*) AS rows, count(*) FILTER (is_attack) AS attacks, min(ts) AS first_ts, max(ts) AS last_ts FROM flows",
)
def warmup_metadata(t):
    return iforest.warmup_metadata(t.flows)
