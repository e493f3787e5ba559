"""Queries over asset resolution and the joins built on it."""

from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch import settings as S
from ripplewatch.operators import resolve as R
from ripplewatch.plans.catalog import query


@query(
    "exact_asset_match",
    """SELECT f.event_id, r.name, r.criticality FROM flows f LEFT JOIN registry r ON r.identifier = f.destination_ip""",
)
def exact_asset_match(t):
    reg = t.registry.select(F.col("identifier").alias("destination_ip"), "name", "criticality")
    return t.flows.join(F.broadcast(reg), "destination_ip", "left").select("event_id", "name", "criticality")


@query(
    "account_resolution",
    """SELECT o_orderkey, CASE WHEN regexp_matches(account, '^C\\d+$') THEN 'City_Payment_Gateway'
         WHEN regexp_matches(account, '^M\\d+$') THEN 'Bank_Partner_API'
         ELSE concat('Unresolved_', regexp_replace(account, '[^A-Za-z0-9_]', '_', 'g')) END AS asset,
       CASE WHEN regexp_matches(account, '^[CM]\\d+$') THEN 0.85::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
       regexp_matches(account, '^[CM]\\d+$') AS is_known
       FROM (SELECT o_orderkey, concat(CASE o_orderkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'M' ELSE 'X-' END, o_custkey) AS account
             FROM orders)""",
)
def account_resolution(t):
    rows = t.read("orders").selectExpr(
        "o_orderkey",
        "concat(CASE o_orderkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'M' ELSE 'X-' END, o_custkey) AS identifier",
    )
    table = R.resolve_identifiers(rows.select("identifier").distinct(), t.registry)
    return rows.join(table, "identifier").select("o_orderkey", "asset", "confidence", "is_known")


@query(
    "nearest_host_match",
    """SELECT event_id, n.name AS near_name, n.d AS distance FROM flows f
       JOIN near_hosts n ON n.host = CAST(regexp_extract(f.source_ip, '\\.(\\d+)$', 1) AS INT)""",
)
def nearest_host_match(t):
    host = F.regexp_extract("source_ip", r"\.(\d+)$", 1).cast("int")
    near = R.nearest_hosts(t.registry)
    return t.flows.withColumn("host", host).join(F.broadcast(near), "host").select("event_id", "near_name", "distance")


@query(
    "identifier_resolution",
    "SELECT identifier, asset, criticality, confidence, is_known FROM resolution",
)
def identifier_resolution(t):
    ids = t.flows.select(F.col("source_ip").alias("identifier")).union(t.flows.select("destination_ip")).distinct()
    return R.resolve_identifiers(ids, t.registry)


@query(
    "resolved_flows",
    """SELECT event_id, source_asset, source_criticality, destination_asset, destination_criticality,
       resolution_confidence FROM resolved""",
)
def resolved_flows(t):
    return t.resolved.select(
        "event_id", "source_asset", "source_criticality", "destination_asset", "destination_criticality",
        "resolution_confidence",
    )


@query(
    "display_names",
    """SELECT event_id, coalesce(s.name, source_ip) AS source_name, coalesce(d.name, destination_ip) AS destination_name
       FROM flows f LEFT JOIN assets s ON s.ip = f.source_ip LEFT JOIN assets d ON d.ip = f.destination_ip""",
)
def display_names(t):
    rows = R.display_names(t.flows, t.assets, ip="source_ip", name="source_name")
    rows = R.display_names(rows, t.assets, ip="destination_ip", name="destination_name")
    return rows.select("event_id", "source_name", "destination_name")


@query(
    "criticality_map",
    """SELECT asset, criticality, is_registered, count(*) OVER (PARTITION BY is_registered) AS group_size FROM (
         SELECT DISTINCT name AS asset, criticality, TRUE AS is_registered FROM registry
         UNION ALL SELECT DISTINCT asset, criticality, FALSE FROM resolution WHERE NOT is_known AND asset LIKE 'Unresolved!_%' ESCAPE '!')""",
)
def criticality_map(t):
    table = R.criticality_map(t.registry, identifier_resolution(t))
    sizes = table.groupBy("is_registered").agg(F.count(F.lit(1)).alias("group_size"))
    return table.join(F.broadcast(sizes), "is_registered")


@query(
    "protected_touches",
    """SELECT concat('Gateway_L', a.purdue_level) AS gateway, a.name AS asset, count(*) AS events
       FROM flows f JOIN assets a ON a.ip = f.destination_ip WHERE a.criticality >= 0.85 GROUP BY ALL""",
)
def protected_touches(t):
    guarded = R.protected_assets(t.assets, threshold=S.GATEWAY_THRESHOLD)
    ips = t.assets.select(F.col("ip").alias("destination_ip"), F.col("name").alias("asset"))
    hits = t.flows.join(F.broadcast(ips.join(guarded, "asset")), "destination_ip")
    return hits.groupBy("gateway", "asset").agg(F.count(F.lit(1)).alias("events"))


@query(
    "sector_lookup",
    """SELECT event_id, coalesce(s.sector, 'core') AS source_sector, d.sector AS destination_sector
       FROM resolved r LEFT JOIN assets s ON s.name = r.source_asset LEFT JOIN assets d ON d.name = r.destination_asset""",
)
def sector_lookup(t):
    names = t.assets.select("name", "sector")
    src = names.select(F.col("name").alias("source_asset"), F.col("sector").alias("_s"))
    dst = names.select(F.col("name").alias("destination_asset"), F.col("sector").alias("destination_sector"))
    rows = t.resolved.join(F.broadcast(src), "source_asset", "left").join(F.broadcast(dst), "destination_asset", "left")
    return rows.select(
        "event_id", F.coalesce("_s", F.lit(inv.CORE_SECTOR)).alias("source_sector"), "destination_sector"
    )


@query(
    "eligible_targets",
    """SELECT a.name, count(f.event_id) AS events FROM assets a LEFT JOIN flows f ON f.source_ip = a.ip
       GROUP BY a.name ORDER BY a.name""",
)
def eligible_targets(t):
    from ripplewatch.operators.serve import eligible_targets as pick

    activity = t.flows.groupBy("source_ip").agg(F.count(F.lit(1)).alias("events"))
    rows = pick(t.assets.withColumn("is_gateway", F.lit(False))).join(
        activity, F.col("ip") == F.col("source_ip"), "left"
    )
    return rows.select("name", F.coalesce("events", F.lit(0)).alias("events")).orderBy("name")


@query(
    "tripwire_canonical",
    """SELECT event_id, ts AS timestamp, d.gateway_zone AS destination_asset_id, d.emulated_protocol AS protocol,
       concat('T1078_Valid_Accounts::', d.credential_id) AS attck_evidence, ts + INTERVAL 1 SECOND AS observed_at,
       CAST(right(d.gateway_zone, 1) AS INT) AS purdue_level, 0::DOUBLE AS bytes
       FROM flows f JOIN decoys d ON d.gateway_zone = concat('Gateway_L', f.k % 9) WHERE f.is_attack""",
)
def tripwire_canonical(t):
    from ripplewatch.sources.deception import honeytoken_events

    decoys = inv.decoys(t.spark)
    by_zone = decoys.select(F.col("gateway_zone").alias("_z"), "username")
    log = t.flows.filter("is_attack").withColumn("_z", F.concat(F.lit("Gateway_L"), (F.col("k") % 9).cast("string")))
    log = log.join(F.broadcast(by_zone), "_z", "left").select("event_id", "ts", "username")
    return honeytoken_events(log, decoys, keep=["event_id"]).select(
        "event_id", "timestamp", "destination_asset_id", "protocol", "attck_evidence", "observed_at", "purdue_level", "bytes"
    )


@query(
    "display_identity",
    """SELECT event_id, CASE WHEN source_asset LIKE 'Unresolved!_%' ESCAPE '!' THEN source_ip ELSE source_asset END AS identity FROM resolved""",
)
def display_identity(t):
    from ripplewatch.functions.net import display_identity as shown

    return t.resolved.select("event_id", shown(F.col("source_asset"), F.col("source_ip")).alias("identity"))
