"""Queries over row-level preparation."""

from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch.functions import clock, net
from ripplewatch.functions.lookup import noisy_or
from ripplewatch.operators import prepare as P
from ripplewatch.plans.catalog import cte, query
from ripplewatch.sources.payments import payments_to_canonical
from ripplewatch.sources.flows import edges_to_canonical

_KNOWN = ", ".join(
    f"({inv.sql_literal(a)}, {inv.sql_literal(b)}, {inv.sql_literal(c)})" for a, b, c in inv.ATTACK_LABELS
)
cte("label_map", f"SELECT * FROM (VALUES {_KNOWN}) AS t(label, evidence, level)")
cte(
    "labelled",
    """SELECT f.*,
  CASE WHEN m.label IS NOT NULL THEN m.evidence
       WHEN f.label ILIKE '%web attack%' AND upper(f.label) LIKE '%SQL%' THEN 'WebAttack_SQLi'
       WHEN f.label ILIKE '%web attack%' AND upper(f.label) LIKE '%XSS%' THEN 'WebAttack_XSS'
       WHEN f.label ILIKE '%web attack%' THEN 'WebAttack_BruteForce' ELSE f.label END AS attck_evidence,
  CASE WHEN m.label IS NOT NULL THEN m.level
       WHEN f.label ILIKE '%web attack%' AND upper(f.label) LIKE '%SQL%' THEN 'CRITICAL'
       WHEN f.label ILIKE '%web attack%' AND upper(f.label) LIKE '%XSS%' THEN 'MEDIUM'
       WHEN f.label ILIKE '%web attack%' THEN 'HIGH' ELSE 'MEDIUM' END AS calibrated_alert_level
  FROM flows f LEFT JOIN label_map m ON m.label = f.label""",
)


@query(
    "label_evidence",
    "SELECT event_id, label, attck_evidence, calibrated_alert_level FROM labelled",
)
def label_evidence(t):
    return P.label_evidence(t.flows).select("event_id", "label", "attck_evidence", "calibrated_alert_level")


# Orders as a payment log: priority is the payment type, urgent cancelled orders are the frauds.
PAYMENTS = [
    "o_orderkey",
    "CAST(o_orderkey % 744 AS INT) AS step",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'transfer' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'"
    " WHEN '4-NOT SPECIFIED' THEN 'DEBIT' ELSE 'OTHER' END AS type",
    "o_totalprice - 100000 AS amount",
    "concat('C', o_custkey) AS nameOrig",
    "CASE WHEN o_orderkey % 3 = 0 THEN concat('M', o_custkey % 97) ELSE concat('10.0.1.', o_orderkey % 80) END AS nameDest",
    "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS isFraud",
]
cte("payments", "SELECT " + ", ".join(PAYMENTS) + " FROM orders")


def payments(t):
    return t.read("orders").selectExpr(*PAYMENTS)


_PAYMENT_SQL = """
  CASE WHEN isFraud = 1 THEN 'ALERT' WHEN upper(type) IN ('PAYMENT','TRANSFER','CASH_OUT','DEBIT','CASH_IN')
       THEN upper(type) ELSE 'PASS' END AS action,
  CASE upper(type) WHEN 'PAYMENT' THEN 'PaymentService' WHEN 'TRANSFER' THEN 'TransferService'
       WHEN 'CASH_OUT' THEN 'CashOutService' WHEN 'DEBIT' THEN 'DebitService' WHEN 'CASH_IN' THEN 'CashInService'
       ELSE 'UnknownService' END AS process_or_service,
  CASE WHEN upper(type) IN ('PAYMENT','TRANSFER','CASH_OUT','DEBIT','CASH_IN')
       THEN concat('FINANCIAL_', upper(type)) ELSE 'FINANCIAL_UNKNOWN' END AS protocol,
  CASE WHEN isFraud = 1 THEN 'TRANSFER_FRAUD' END AS attck_evidence,
  CASE WHEN isFraud = 1 THEN 'CRITICAL' ELSE 'INFO' END AS calibrated_alert_level,
  CASE WHEN upper(type) IN ('TRANSFER','CASH_OUT') THEN 'FINANCIAL_EXTERNAL' ELSE 'FINANCIAL_INTERNAL' END AS zone
"""


@query("payment_mapping", f"SELECT o_orderkey, {_PAYMENT_SQL} FROM payments")
def payment_mapping(t):
    cols = ("action", "process_or_service", "protocol", "attck_evidence", "calibrated_alert_level", "zone")
    return P.payment_mapping(payments(t)).select("o_orderkey", *cols)


_NEAR = """
  SELECT host, name, criticality, d FROM (
    SELECT h.host, r.name, r.criticality, abs(h.host - r.host) AS d,
           row_number() OVER (PARTITION BY h.host ORDER BY abs(h.host - r.host), r.position) AS rn
    FROM (SELECT CAST(range AS INT) AS host FROM range(0, 256)) h
    JOIN (SELECT *, TRY_CAST(NULLIF(regexp_extract(identifier, '^10\\.0\\.1\\.(\\d+)$', 1), '') AS INT) AS host FROM registry) r
      ON abs(h.host - r.host) <= 5) WHERE rn = 1
"""
cte("near_hosts", _NEAR)


@query(
    "payments_to_canonical",
    f"""SELECT p.o_orderkey, TIMESTAMP '2021-01-01' + to_hours(step) AS timestamp,
  CASE WHEN regexp_matches(nameOrig, '^C\\d+$') THEN 'City_Payment_Gateway' ELSE 'Bank_Partner_API' END AS source_asset_id,
  CASE WHEN nameDest LIKE 'M%' THEN 'Bank_Partner_API' ELSE coalesce(x.name, n.name, concat('Unresolved_', replace(nameDest, '.', '_'))) END
    AS destination_asset_id,
  greatest(amount, 0::DOUBLE) AS payload_size, {_PAYMENT_SQL},
  (0.85::DOUBLE + CASE WHEN nameDest LIKE 'M%' THEN 0.85::DOUBLE WHEN x.name IS NOT NULL THEN 1.0::DOUBLE
     WHEN n.name IS NOT NULL THEN greatest(0.4::DOUBLE, 1.0::DOUBLE - n.d * 0.12::DOUBLE) ELSE 0.3::DOUBLE END) / 2 AS confidence
  FROM payments p LEFT JOIN registry x ON x.identifier = p.nameDest
  LEFT JOIN near_hosts n ON n.host = TRY_CAST(NULLIF(regexp_extract(p.nameDest, '^10\\.0\\.1\\.(\\d+)$', 1), '') AS INT)""",
)
def payments_canonical(t):
    out = payments_to_canonical(payments(t), t.registry, keep=["o_orderkey"])
    return out.select(
        "o_orderkey", "timestamp", "source_asset_id", "destination_asset_id", "payload_size", "action",
        "process_or_service", "protocol", "attck_evidence", "calibrated_alert_level", "zone", "confidence",
    )


# Orders dressed as canonical rows, some of them broken on purpose.
CANONICAL = [
    "o_orderkey",
    "o_orderdate AS timestamp",
    "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat(' C', o_custkey, ' ') END AS source_asset_id",
    "concat('M', o_custkey % 97) AS destination_asset_id",
    "concat(o_orderpriority, '  ') AS protocol",
    "o_totalprice - 60000 AS payload_size",
    "CASE o_orderstatus WHEN 'P' THEN ' ALERT' ELSE 'PASS ' END AS action",
    "' INTERNAL' AS zone",
    "'Orders' AS process_or_service",
    "CASE WHEN o_orderstatus = 'P' THEN 'TRANSFER_FRAUD' END AS attck_evidence",
    "o_totalprice / 400000 AS raw_anomaly_score",
    "CAST(NULL AS {string}) AS calibrated_alert_level",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'PaySim' ELSE 'live' END AS provenance",
    "0.5 + (o_orderkey % 11) / 18.0 AS confidence",
    "'2.0' AS schema_version",
    "CASE o_orderkey % 5 WHEN 0 THEN 'deception_tripwire' WHEN 1 THEN 'bogus' ELSE 'financial_txn' END AS signal_type",
    "o_orderdate AS observed_at",
    "CAST(o_orderkey % 8 AS INT) AS purdue_level",
]
cte("canonical", "SELECT " + ", ".join(c.format(string="VARCHAR") for c in CANONICAL) + " FROM orders")


def canonical(t):
    rows = t.read("orders").selectExpr(*[c.format(string="STRING") for c in CANONICAL])
    return rows.withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "canonical_violations",
    """SELECT o_orderkey, violations FROM (SELECT o_orderkey, concat_ws(',',
      CASE WHEN length(source_asset_id) < 1 THEN 'source_asset_id' END,
      CASE WHEN payload_size < 0 THEN 'payload_size' END,
      CASE WHEN raw_anomaly_score > 1 OR raw_anomaly_score < 0 THEN 'raw_anomaly_score' END,
      CASE WHEN confidence > 1 OR confidence < 0 THEN 'confidence' END,
      CASE WHEN purdue_level > 5 THEN 'purdue_level' END,
      CASE WHEN signal_type = 'bogus' THEN 'signal_type' END) AS violations FROM canonical) WHERE violations <> ''""",
)
def canonical_violations(t):
    bad = P.validate_canonical(canonical(t))
    return bad.select("o_orderkey", F.concat_ws(",", "violations").alias("violations"))


@query(
    "trimmed_canonical",
    """SELECT o_orderkey, trim(source_asset_id) AS source_asset_id, trim(protocol) AS protocol, trim(action) AS action,
       trim(zone) AS zone, process_or_service, provenance FROM canonical""",
)
def trimmed_canonical(t):
    return P.trim_text(canonical(t)).select(
        "o_orderkey", "source_asset_id", "protocol", "action", "zone", "process_or_service", "provenance"
    )


@query("alerts_by_evidence", "SELECT provenance, count(*) AS n FROM canonical WHERE attck_evidence IS NOT NULL GROUP BY provenance")
def alerts_by_evidence(t):
    return canonical(t).filter(P.is_alert()).groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))


@query("provenance_filter", "SELECT o_orderkey, payload_size FROM canonical WHERE provenance = 'PaySim'")
def provenance_filter(t):
    return P.filter_by_provenance(canonical(t), "PaySim").select("o_orderkey", "payload_size")


@query(
    "ml_features",
    """SELECT o_orderkey, CASE WHEN signal_type = 'deception_tripwire' THEN 0 ELSE greatest(payload_size, 0) / 1e6 END AS duration_sec,
       CASE WHEN signal_type = 'deception_tripwire' THEN 0 ELSE 1 END AS packets,
       CASE WHEN signal_type = 'deception_tripwire' THEN 0 ELSE greatest(payload_size, 0) END AS bytes FROM canonical""",
)
def ml_features(t):
    return P.to_ml_features(canonical(t)).select("o_orderkey", "duration_sec", "packets", "bytes")


@query(
    "default_features",
    "SELECT o_orderkey, payload_size AS bytes, 1.0::DOUBLE AS duration_sec, 1 AS packets FROM canonical",
)
def default_features(t):
    return P.default_features(canonical(t)).select("o_orderkey", "bytes", "duration_sec", "packets")


@query(
    "detector_view",
    """SELECT event_id, ts, source_ip, source_port, destination_ip, destination_port, protocol, duration_sec, packets, bytes,
       bwd_packet_length_mean, init_win_bytes_forward, init_win_bytes_backward, average_packet_size, is_honeytoken_use FROM flows""",
)
def detector_view(t):
    return P.detector_view(t.flows)


@query(
    "port_services",
    """SELECT event_id, CASE destination_port WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 22 THEN 'SSH' WHEN 21 THEN 'FTP'
       WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS' WHEN 3306 THEN 'MySQL' WHEN 3389 THEN 'RDP'
       ELSE concat('PORT_', destination_port) END AS service,
       CASE k % 20 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE concat('PROTO_', k % 20) END AS transport FROM flows""",
)
def port_services(t):
    rows = P.name_services(t.flows).withColumn("transport", net.protocol_name(F.col("k") % 20))
    return rows.select("event_id", "service", "transport")


@query(
    "flow_direction",
    """SELECT f.event_id, CASE WHEN f.is_attack THEN 'External_185.220.101.5' ELSE a.name END AS source_asset_id,
       CASE WHEN f.is_attack THEN a.name ELSE 'Citizen_Portal' END AS destination_asset_id
       FROM flows f JOIN assets a ON a.ip = CASE f.destination_port WHEN 22 THEN '10.0.1.16' WHEN 21 THEN '10.0.1.16'
         WHEN 3306 THEN '10.0.1.16' WHEN 3389 THEN '10.0.1.12' WHEN 53 THEN '10.0.1.14' ELSE '10.0.1.15' END""",
)
def flow_direction(t):
    rows = t.flows.withColumn("action", F.when(F.col("is_attack"), "ALERT").otherwise("PASS"))
    return P.flow_direction(rows, t.registry).select("event_id", "source_asset_id", "destination_asset_id")


@query(
    "edges_to_canonical",
    """SELECT event_id, source_asset AS source_asset_id, destination_asset AS destination_asset_id, CAST(bytes AS DOUBLE) AS payload_size,
       CASE WHEN is_attack THEN 'ALERT' ELSE 'PASS' END AS action, 'synthetic' AS provenance, CAST(0.5 AS DOUBLE) AS confidence,
       duration_sec, packets, CAST(bytes AS DOUBLE) AS bytes FROM resolved""",
)
def canonical_edges(t):
    rows = t.flows.withColumnRenamed("is_attack", "is_ground_truth_anomaly")
    out = edges_to_canonical(rows, t.registry, source="source_ip", target="destination_ip", keep=["event_id"])
    return out.select(
        "event_id", "source_asset_id", "destination_asset_id", "payload_size", "action", "provenance", "confidence",
        "duration_sec", "packets", "bytes",
    )


@query(
    "ground_truth",
    """SELECT event_id, action = 'ALERT' AS by_action, upper(label) <> 'BENIGN' AS by_label FROM
       (SELECT event_id, label, CASE WHEN is_attack THEN 'ALERT' ELSE 'PASS' END AS action FROM flows)""",
)
def ground_truth(t):
    rows = t.flows.withColumn("action", F.when(F.col("is_attack"), "ALERT").otherwise("PASS"))
    return rows.select(
        "event_id", P.truth_from_action().alias("by_action"), P.truth_from_label().alias("by_label")
    )


@query(
    "retargeted_flows",
    """SELECT event_id, ts, source_ip, destination_ip, is_honeytoken_use, origin, source_row_id FROM (
         SELECT event_id, ts, source_ip, destination_ip, is_honeytoken_use, 'replay' AS origin, NULL AS source_row_id FROM flows
         UNION ALL
         SELECT event_id, ts, '10.0.1.30', destination_ip, TRUE, 'injected', concat('inject:honeytoken:City_Operations_Center:', event_id)
         FROM (SELECT * FROM flows WHERE label = 'Bot' ORDER BY ts, event_id LIMIT 50))""",
)
def retargeted_flows(t):
    extra = P.retarget(t.flows, t.assets, scenario="honeytoken", target=inv.HUB_ASSET, count=50)
    return P.with_injected(t.flows, extra).select(
        "event_id", "ts", "source_ip", "destination_ip", "is_honeytoken_use", "origin", "source_row_id"
    )


@query(
    "financial_exposure",
    """SELECT a.name, a.type IN ('Financial Transaction System','External Financial Interface','Financial Market System',
       'Social Safety Net') AS is_financial, count(*) AS events FROM flows f JOIN assets a ON a.ip = f.source_ip GROUP BY ALL""",
)
def financial_exposure(t):
    flagged = P.financial_flag(t.assets).select(F.col("ip").alias("source_ip"), "name", "is_financial")
    return t.flows.join(F.broadcast(flagged), "source_ip").groupBy("name", "is_financial").agg(F.count(F.lit(1)).alias("events"))


@query(
    "replay_slice",
    """SELECT event_id, ts FROM flows WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 10 HOUR FROM flows)
       ORDER BY ts, event_id LIMIT 200""",
)
def replay_slice(t):
    return P.replay_slice(t.flows, start_at="10:00", limit=200).select("event_id", "ts")


@query(
    "scalar_functions",
    """SELECT event_id, TIMESTAMP '2021-01-01' + to_hours(CAST(event_id % 744 AS INT)) AS step_ts,
       greatest(value * 1000000 - 5000000, 0) / 1000000 AS micros_to_sec,
       CASE WHEN regexp_matches(destination_ip, '^\\d+\\.\\d+\\.\\d+\\.\\d+$')
            THEN concat(regexp_extract(destination_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1), '.0/24') END AS subnet,
       destination_ip LIKE '8.8.%' OR destination_ip LIKE '185.%' AS external,
       regexp_replace(destination_ip, '[^A-Za-z0-9_]', '_', 'g') AS safe_name,
       concat('Gateway_L', coalesce(CAST(CASE WHEN k % 7 < 6 THEN k % 7 END AS VARCHAR), 'unclassified')) AS gateway,
       CASE WHEN k % 7 < 6 THEN k % 7 END AS level_back,
       1 - (1 - k / 200.0::DOUBLE) * (1 - k / 300.0::DOUBLE) AS union_p,
       CASE WHEN k % 2 = 0 THEN source_ip ELSE concat('Asset_', k) END AS identity
       FROM flows""",
)
def scalar_functions(t):
    level = F.when(F.col("k") % 7 < 6, F.col("k") % 7)
    gateway = net.gateway_name(level)
    asset = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Unresolved_"), F.col("k").cast("string"))).otherwise(
        F.concat(F.lit("Asset_"), F.col("k").cast("string"))
    )
    return t.flows.select(
        "event_id",
        clock.step_timestamp(F.col("event_id") % 744).alias("step_ts"),
        (F.greatest(F.col("value") * 1000000 - 5000000, F.lit(0.0)) / 1000000).alias("micros_to_sec"),
        net.subnet24(F.col("destination_ip")).alias("subnet"),
        net.is_external(F.col("destination_ip")).alias("external"),
        net.sanitise(F.col("destination_ip")).alias("safe_name"),
        gateway.alias("gateway"),
        net.gateway_level(gateway).alias("level_back"),
        noisy_or(F.array(F.col("k") / 200.0, F.col("k") / 300.0)).alias("union_p"),
        net.display_identity(asset, F.col("source_ip")).alias("identity"),
    )


@query(
    "evidence_json",
    """SELECT event_id, concat('{"k":', k, ',"label":"', label, '"}') AS evidence, k AS k_back FROM flows""",
)
def evidence_json(t):
    rows = t.flows.withColumn("evidence", P.json_payload("k", "label"))
    return rows.select("event_id", "evidence", F.get_json_object("evidence", "$.k").cast("int").alias("k_back"))


@query(
    "calibrated_decision",
    "SELECT event_id, round(1 / (1 + exp(5 * (0.3::DOUBLE - value / 500))), 9) AS score FROM flows",
)
def calibrated_decision(t):
    raw = F.lit(0.3) - F.col("value") / 500
    return t.flows.select("event_id", F.round(P.score_calibration(raw), 9).alias("score"))
