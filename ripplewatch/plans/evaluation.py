"""Queries over detector evaluation."""

from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.operators import evaluate as E
from ripplewatch.operators import supervised
from ripplewatch.plans.catalog import cte, query
from ripplewatch.plans.ordered import labelled

_COUNTS = """count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp,
   count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn"""
_LABELLED = "(SELECT user_id, event_id, ts, is_attack AS truth, value > 60 AS pred, value FROM flows)"


@query(
    "confusion_metrics",
    f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
        SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM (SELECT {_COUNTS} FROM {_LABELLED}))""",
)
def confusion_metrics(t):
    return E.confusion(labelled(t))


@query(
    "confusion_by_asset",
    f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
        SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall
        FROM (SELECT user_id, {_COUNTS} FROM {_LABELLED} GROUP BY user_id))""",
)
def confusion_by_asset(t):
    return E.confusion(labelled(t), by=["user_id"])


@query(
    "roc_auc",
    """SELECT sum(p)::BIGINT AS positives, sum(n - p)::BIGINT AS negatives,
       (sum(p * (upto - n + (n + 1) / 2.0::DOUBLE)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) AS auc FROM (
         SELECT p, n, sum(n) OVER (ORDER BY value) AS upto FROM (
           SELECT value, count(*) AS n, count(*) FILTER (is_attack) AS p FROM flows GROUP BY value))""",
)
def roc_auc(t):
    return E.roc_auc(t.flows, score="value", truth="is_attack")


@query(
    "segment_metrics",
    f"""SELECT segments, detected, tp, fp, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
         SELECT segments, detected, tp, fp, tp / (tp + fp) AS precision, detected / segments AS recall
         FROM (SELECT count(*) AS segments, count(*) FILTER (detected) AS detected FROM label_runs) CROSS JOIN (SELECT {_COUNTS} FROM {_LABELLED}))""",
)
def segment_metrics(t):
    return E.segment_metrics(labelled(t), ["ts", "event_id"], keys=["user_id"])


@query(
    "split_guard",
    "SELECT avg(is_attack::INT) AS positive_rate FROM flows",
)
def split_guard(t):
    rate = E.guard_split(t.flows, truth="is_attack")
    return t.flows.agg(F.avg(F.col("is_attack").cast("int")).alias("positive_rate")).filter(F.lit(0.01 <= rate <= 0.99))


@query(
    "benign_train_split",
    """SELECT event_id, CASE WHEN NOT is_attack AND row_number() OVER (PARTITION BY is_attack ORDER BY md5('42|' || event_id))
         <= floor(count(*) OVER (PARTITION BY is_attack) * 0.6::DOUBLE) THEN 'train' ELSE 'eval' END AS part FROM flows""",
)
def benign_train_split(t):
    rows = t.flows.select("event_id", F.col("is_attack").alias("truth"))
    return E.benign_split(rows, fraction=0.6).select("event_id", "part")


@query(
    "stratified_sample",
    """SELECT event_id FROM (SELECT event_id, is_attack, row_number() OVER (PARTITION BY is_attack ORDER BY md5('42|' || event_id)) AS r,
         least(count(*) FILTER (is_attack) OVER (), 1000) AS p FROM flows) WHERE r <= CASE WHEN is_attack THEN p ELSE 2000 - p END""",
)
def stratified_sample(t):
    from ripplewatch.sources.flows import stratified_sample as sample

    return sample(t.flows, positive=F.col("is_attack"), limit=2000, key=["event_id"]).select("event_id")


@query(
    "file_quota_sample",
    """SELECT event_id FROM (SELECT event_id, is_attack, n, p, row_number() OVER (PARTITION BY protocol, is_attack ORDER BY md5('42|' || event_id)) AS r
         FROM (SELECT *, count(*) OVER (PARTITION BY protocol) AS n, count(*) FILTER (is_attack) OVER (PARTITION BY protocol) AS p FROM flows))
       WHERE n <= 1500 OR r <= CASE WHEN is_attack THEN least(p, 750) ELSE 1500 - least(p, 750) END""",
)
def file_quota_sample(t):
    from ripplewatch.sources.flows import per_file_quota

    return per_file_quota(
        t.flows, limit=3000, key=["event_id"], file="protocol", positive=F.col("is_attack")
    ).select("event_id")


@query(
    "rare_positive_top_up",
    """WITH ranked AS (SELECT event_id, is_honeytoken_use AS p, row_number() OVER (ORDER BY ts, event_id) AS r FROM flows),
       head AS (SELECT count(*) FILTER (p AND r <= 2000) < 50 AS few FROM ranked),
       later AS (SELECT event_id FROM ranked WHERE p AND r > 2000 ORDER BY r LIMIT 500)
       SELECT event_id FROM ranked, head WHERE r <= CASE WHEN few THEN 2000 - (SELECT count(*) FROM later) ELSE 2000 END
       UNION ALL SELECT l.event_id FROM later l, head WHERE few""",
)
def rare_positive_top_up(t):
    from ripplewatch.sources.payments import top_up_rare

    rows = t.flows.select("event_id", "ts", "is_honeytoken_use")
    out = top_up_rare(rows, limit=2000, positive=F.col("is_honeytoken_use"), order=["ts", "event_id"])
    return out.select("event_id")


@query(
    "positives_only",
    "SELECT o_orderkey FROM payments WHERE isFraud = 1",
)
def positives_only(t):
    from ripplewatch.plans.preparation import payments
    from ripplewatch.sources.payments import only_fraud

    return only_fraud(payments(t)).select("o_orderkey")


_LEADS = """SELECT source_ip, a AS recon_detected_at, b AS exfil_detected_at, (epoch_us(b) - epoch_us(a)) / 1e6 AS lead_time_seconds FROM (
   SELECT source_ip, min(ts) FILTER (is_honeytoken_use) AS a, min(ts) FILTER (is_anomaly) AS b FROM flows GROUP BY source_ip)
   WHERE a IS NOT NULL AND b IS NOT NULL"""


def _leads(t):
    return E.lead_times(t.flows.filter("is_honeytoken_use"), t.flows.filter("is_anomaly"), key="source_ip")


@query("lead_times", _LEADS)
def lead_times(t):
    return _leads(t)


@query(
    "lead_time_summary",
    f"""SELECT count(*) AS n_attacks, count(*) FILTER (lead_time_seconds > 0) AS n_tripwire_earlier, round(avg(lead_time_seconds), 6) AS mean_lead_time_seconds
        FROM ({_LEADS})""",
)
def lead_time_summary(t):
    out = E.lead_time_summary(_leads(t))
    return out.withColumn("mean_lead_time_seconds", F.round("mean_lead_time_seconds", 6))


@query("detector_benchmark")
def detector_benchmark(t):
    """Z-score, median deviation and isolation forest, point-wise."""
    return E.evaluate(t.flows.withColumn("truth", F.col("is_attack")))


_Z = [f"z_{f}" for f in S.FEATURES]
cte(
    "bench_split",
    """SELECT *, NOT is_attack AND row_number() OVER (PARTITION BY is_attack ORDER BY md5('42|' || event_id))
       <= floor(count(*) OVER (PARTITION BY is_attack) * 0.5::DOUBLE) AS train FROM flows""",
)
cte(
    "bench_scale",
    "SELECT " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in S.FEATURES)
    + " FROM bench_split WHERE train",
)
cte(
    "bench_rows",
    "SELECT event_id, ts, is_attack AS truth, train, " + ", ".join(f"({f} - m_{f}) / s_{f} AS z_{f}" for f in S.FEATURES)
    + " FROM bench_split CROSS JOIN bench_scale",
)
cte(
    "bench_fit",
    "SELECT " + ", ".join(f"avg({z}) AS c_{z}, CASE WHEN stddev_pop({z}) = 0 THEN 1 ELSE stddev_pop({z}) END AS s_{z}, median({z}) AS m_{z}" for z in _Z)
    + " FROM bench_rows WHERE train",
)
cte(
    "bench_dev",
    "SELECT " + ", ".join(f"CASE WHEN median(abs({z} - m_{z})) = 0 THEN 1 ELSE median(abs({z} - m_{z})) END AS d_{z}" for z in _Z)
    + " FROM bench_rows CROSS JOIN bench_fit WHERE train",
)
cte(
    "bench_scored",
    f"""SELECT *, anomaly > edge AS pred FROM (
        SELECT 'zscore' AS detector, 3.0 AS edge, event_id, ts, truth, greatest({", ".join(f"abs(({z} - c_{z}) / s_{z})" for z in _Z)}) AS anomaly
          FROM bench_rows CROSS JOIN bench_fit WHERE NOT train
        UNION ALL SELECT 'mad', 3.5, event_id, ts, truth, greatest({", ".join(f"abs(0.6745 * (({z} - m_{z}) / d_{z}))" for z in _Z)})
          FROM bench_rows CROSS JOIN bench_fit CROSS JOIN bench_dev WHERE NOT train)""",
)
cte(
    "bench_auc",
    """SELECT detector, sum(n)::BIGINT AS eval_rows, (sum(p * (upto - n + (n + 1) / 2.0::DOUBLE)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) AS auc FROM (
         SELECT *, sum(n) OVER (PARTITION BY detector ORDER BY anomaly) AS upto FROM (
           SELECT detector, round(anomaly, 9) AS anomaly, count(*) AS n, count(*) FILTER (truth) AS p FROM bench_scored GROUP BY ALL)) GROUP BY detector""",
)
_F1 = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1"


def _points(t, scoring):
    return E.evaluate(t.flows.withColumn("truth", F.col("is_attack")), ("zscore", "mad"), scoring=scoring)


@query(
    "detector_benchmark_points",
    f"""SELECT detector, 'pointwise' AS scoring, precision, recall, {_F1}, auc, eval_rows FROM (
         SELECT detector, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall
         FROM (SELECT detector, {_COUNTS} FROM bench_scored GROUP BY detector)) JOIN bench_auc USING (detector)""",
)
def detector_benchmark_points(t):
    """The two detectors without random trees, point-wise."""
    return _points(t, "pointwise")


@query(
    "detector_benchmark_segments",
    f"""WITH runs AS (SELECT detector, seg, bool_or(pred) AS hit FROM (
           SELECT *, sum(start) OVER (PARTITION BY detector ORDER BY ts, event_id) AS seg FROM (
             SELECT *, CASE WHEN truth AND NOT coalesce(lag(truth) OVER (PARTITION BY detector ORDER BY ts, event_id), FALSE) THEN 1 ELSE 0 END AS start
             FROM bench_scored)) WHERE truth GROUP BY detector, seg)
        SELECT detector, 'segment' AS scoring, precision, recall, {_F1}, auc, eval_rows FROM (
          SELECT detector, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM (SELECT detector, {_COUNTS} FROM bench_scored GROUP BY detector))
        JOIN (SELECT detector, count(*) FILTER (hit) / count(*) AS recall FROM runs GROUP BY detector) USING (detector) JOIN bench_auc USING (detector)""",
)
def detector_benchmark_segments(t):
    return _points(t, "segment")


@query("supervised_scores")
def supervised_scores(t):
    """Class-balanced random forest fitted and scored on every flow."""
    rows = t.flows.drop("supervised_score")
    model = supervised.fit_supervised(rows)
    return supervised.score_supervised(rows, model).select("event_id", "supervised_score", "supervised_fired")


@query("supervised_temporal_evaluation")
def supervised_temporal_evaluation(t):
    return supervised.temporal_split_evaluate(t.flows.drop("supervised_score"))
