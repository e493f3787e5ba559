"""Queries whose meaning depends on row order: windows, sessions, drift."""

from pyspark.sql import functions as F

from ripplewatch.operators import drift, sequence
from ripplewatch.plans.catalog import cte, query

BUCKET, GAP = 86_400, 3 * 86_400

cte(
    "edge_buckets",
    f"""SELECT CAST(floor(epoch_us(ts) / {BUCKET * 1000000}) AS BIGINT) AS bucket, source_ip AS node, destination_ip AS peer, max(epoch_us(ts)) AS last_seen,
      sum(bytes)::DOUBLE AS bytes, count(*) AS flows FROM flows GROUP BY ALL""",
)
cte(
    "bucket_clock",
    """SELECT bucket, max(last_seen) AS clock, lag(max(last_seen)) OVER (ORDER BY bucket) AS prev_clock,
      row_number() OVER (ORDER BY bucket) AS batch FROM edge_buckets GROUP BY bucket""",
)
cte(
    "edge_lives",
    f"""SELECT *, sum(bytes) OVER (PARTITION BY node, peer, life ORDER BY bucket) AS live_bytes,
        sum(flows) OVER (PARTITION BY node, peer, life ORDER BY bucket) AS live_flows FROM (
      SELECT *, sum(restart) OVER (PARTITION BY node, peer ORDER BY bucket) AS life FROM (
        SELECT e.*, lead(e.bucket) OVER w AS next_bucket, min(e.bucket) OVER (PARTITION BY node, peer) AS first_bucket,
          CASE WHEN lag(e.last_seen) OVER w IS NULL OR c.prev_clock - lag(e.last_seen) OVER w > {GAP * 1000000} THEN 1 ELSE 0 END AS restart
        FROM edge_buckets e JOIN bucket_clock c USING (bucket) WINDOW w AS (PARTITION BY node, peer ORDER BY e.bucket)))""",
)
cte(
    "live_edges",
    f"""SELECT c.bucket, c.batch, l.node, l.peer, l.live_bytes, l.live_flows, l.first_bucket < c.bucket AS seen_before
      FROM edge_lives l JOIN bucket_clock c ON c.bucket >= l.bucket AND (l.next_bucket IS NULL OR c.bucket < l.next_bucket)
        AND c.clock - l.last_seen <= {GAP * 1000000}""",
)
cte(
    "drift_history",
    """SELECT n.bucket, n.node, e.peer, sum(e.bytes) AS w FROM (SELECT DISTINCT bucket, node FROM live_edges) n
       JOIN edge_buckets e ON e.node = n.node AND e.bucket < n.bucket GROUP BY ALL""",
)


def _entropy_sql(table: str, weight: str) -> str:
    return f"""SELECT bucket, node, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-(w / t) * log2(w / t)) / log2(count(*)) END AS h FROM (
        SELECT bucket, node, {weight} AS w, sum({weight}) OVER (PARTITION BY bucket, node) AS t FROM {table} WHERE {weight} > 0)
        GROUP BY bucket, node"""


cte("live_entropy", _entropy_sql("live_edges", "live_bytes"))
cte("history_entropy", _entropy_sql("drift_history", "w"))
cte(
    "drift_rows",
    """SELECT a.bucket, a.batch, a.node, a.degree, coalesce(h.peers, 0) AS history_peers,
      CASE WHEN h.peers > 0 THEN a.degree - a.known ELSE a.globally_new END::DOUBLE / a.degree AS unseen_peer_ratio,
      a.degree::DOUBLE / (coalesce(h.peers, 0) + 1) AS degree_expansion,
      1 - a.known::DOUBLE / (coalesce(h.peers, 0) + a.degree - a.known) AS neighbor_drift,
      abs(coalesce(le.h, 0) - coalesce(he.h, 0)) AS traffic_entropy_delta
     FROM (SELECT l.bucket, l.batch, l.node, count(*) AS degree, count(*) FILTER (seen_before) AS known,
             count(*) FILTER (g.first_bucket >= l.bucket) AS globally_new FROM live_edges l
           JOIN (SELECT peer, min(bucket) AS first_bucket FROM edge_buckets GROUP BY peer) g USING (peer) GROUP BY ALL) a
     LEFT JOIN (SELECT bucket, node, count(*) AS peers FROM drift_history GROUP BY ALL) h USING (bucket, node)
     LEFT JOIN live_entropy le USING (bucket, node) LEFT JOIN history_entropy he USING (bucket, node)""",
)


@query("edge_lifetimes", "SELECT bucket, node, peer, live_bytes, live_flows::BIGINT AS live_flows, seen_before FROM live_edges")
def edge_lifetimes(t):
    return drift.live_edges(drift.edge_buckets(t.flows, bucket_sec=BUCKET), bucket_sec=BUCKET, gap_sec=GAP).select(
        "bucket", "node", "peer", "live_bytes", "live_flows", "seen_before"
    )


def features(t):
    return drift.drift_features(t.flows, bucket_sec=BUCKET, gap_sec=GAP)


@query(
    "drift_features",
    """SELECT bucket, node, degree, history_peers, round(unseen_peer_ratio, 6) AS unseen_peer_ratio, round(degree_expansion, 6) AS degree_expansion,
       round(neighbor_drift, 6) AS neighbor_drift, round(traffic_entropy_delta, 6) AS traffic_entropy_delta FROM drift_rows""",
)
def drift_features(t):
    return features(t).select(
        "bucket", "node", "degree", "history_peers", *[F.round(c, 6).alias(c) for c in drift.FEATURES]
    )


@query(
    "peer_set_sizes",
    """SELECT bucket, node, degree AS fan_out, known AS intersection, peers + degree - known AS union_size FROM (
         SELECT l.bucket, l.node, count(*) AS degree, count(*) FILTER (seen_before) AS known,
           (SELECT count(*) FROM drift_history h WHERE h.bucket = l.bucket AND h.node = l.node) AS peers FROM live_edges l GROUP BY l.bucket, l.node)""",
)
def peer_set_sizes(t):
    rows = features(t)
    known = F.round((1 - F.col("neighbor_drift")) * (F.col("history_peers") + F.col("degree")) / (2 - F.col("neighbor_drift")))
    return rows.select(
        "bucket", "node", F.col("degree").alias("fan_out"), known.cast("bigint").alias("intersection"),
        (F.col("history_peers") + F.col("degree") - known).cast("bigint").alias("union_size"),
    )


@query(
    "new_peers",
    """SELECT l.bucket, l.node, l.peer FROM live_edges l LEFT JOIN edge_buckets e ON e.node = l.node AND e.peer = l.peer AND e.bucket < l.bucket
       WHERE e.node IS NULL""",
)
def new_peers(t):
    live = drift.live_edges(drift.edge_buckets(t.flows, bucket_sec=BUCKET), bucket_sec=BUCKET, gap_sec=GAP)
    return live.filter(~F.col("seen_before")).select("bucket", "node", "peer")


def scored_drift(t):
    return drift.score_drift(features(t))


@query("drift_model")
def drift_model(t):
    """Epoch-wise forest over the drift features; random trees have no SQL equivalent."""
    return scored_drift(t).select("bucket", "node", "drift_decision", "drift_score", "drift_fired", "abstained")


@query("drift_verdicts")
def drift_verdicts(t):
    out = drift.drift_verdicts(t.flows, scored_drift(t), bucket_sec=BUCKET)
    return out.select("event_id", "drift_score", "drift_fired", "abstained", drift.drift_summary().alias("summary"))


@query(
    "virtual_times",
    """SELECT f.event_id, epoch_us(f.ts) / 1e6 + (row_number() OVER (PARTITION BY f.ts ORDER BY event_id) - 1)::DOUBLE
         / count(*) OVER (PARTITION BY f.ts) * coalesce(g.gap, 0) AS virtual_sec
       FROM (SELECT event_id, date_trunc('hour', ts) AS ts FROM flows) f
       JOIN (SELECT ts, coalesce(lead(us) OVER (ORDER BY ts) - us, us - lag(us) OVER (ORDER BY ts)) / 1e6 AS gap
             FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts, epoch_us(date_trunc('hour', ts)) AS us FROM flows)) g ON g.ts = f.ts""",
)
def virtual_times(t):
    hourly = t.flows.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return sequence.spread_ties(hourly, ts="ts", tie="event_id").select("event_id", "virtual_sec")


@query("chronological", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM flows")
def chronological(t):
    from ripplewatch.functions.partitions import with_rank

    return with_rank(t.flows.select("event_id", "ts"), ["ts", "event_id"], "position").select("event_id", "position")


@query(
    "temporal_split",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM flows""",
)
def temporal_split(t):
    return sequence.temporal_split(t.flows.select("event_id", "ts"), fraction=0.7).select("event_id", "part")


cte(
    "label_runs",
    """SELECT user_id, min(event_id) AS start_id, max(event_id) AS end_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS rows, bool_or(pred) AS detected FROM (
        SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM (
          SELECT user_id, event_id, ts, event_type = 'error' AS truth, value > 60 AS pred,
            CASE WHEN event_type = 'error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') <> 'error' THEN 1 ELSE 0 END AS start
          FROM flows)) WHERE truth GROUP BY user_id, seg""",
)


def labelled(t):
    return t.flows.select(
        "user_id", "event_id", "ts", (F.col("event_type") == "error").alias("truth"), (F.col("value") > 60).alias("pred")
    )


@query("attack_segments", "SELECT user_id, start_id, end_id, start_ts, end_ts, rows, detected FROM label_runs")
def attack_segments(t):
    out = sequence.segments(labelled(t), ["ts", "event_id"], keys=["user_id"])
    return out.select(
        "user_id", F.col("start.event_id").alias("start_id"), F.col("end.event_id").alias("end_id"),
        F.col("start.ts").alias("start_ts"), F.col("end.ts").alias("end_ts"), "rows", "detected",
    )


@query(
    "global_attack_segments",
    """SELECT min(event_id) AS start_id, max(event_id) AS end_id, count(*) AS rows, bool_or(value > 60) AS detected FROM (
        SELECT *, sum(start) OVER (ORDER BY ts, event_id) AS seg FROM (
          SELECT *, CASE WHEN is_attack AND NOT coalesce(lag(is_attack) OVER (ORDER BY ts, event_id), FALSE) THEN 1 ELSE 0 END AS start FROM flows))
        WHERE is_attack GROUP BY seg""",
)
def global_attack_segments(t):
    out = sequence.segments(labelled(t), ["ts", "event_id"])
    return out.select(
        F.col("start.event_id").alias("start_id"), F.col("end.event_id").alias("end_id"), "rows", "detected"
    )


@query(
    "events_per_second",
    "SELECT date_trunc('second', ts) AS second, count(*) AS events FROM flows GROUP BY ALL",
)
def events_per_second(t):
    return t.flows.groupBy(F.window("ts", "1 second")["start"].alias("second")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "risk_trend",
    """SELECT slot, value AS risk FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, value,
         row_number() OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ts DESC, event_id DESC) AS rn,
         max(ts) OVER () AS newest, ts FROM flows) WHERE rn = 1 AND ts >= newest - INTERVAL 1 DAY""",
)
def risk_trend(t):
    samples = t.flows.select("ts", "event_id", F.col("value").alias("risk"))
    return sequence.rolling_trend(samples, value="risk", tie="event_id", slot="5 minutes", keep_sec=86_400).select("slot", "risk")
