"""Queries over sinks and set operations."""

from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.operators import policy
from ripplewatch.plans.catalog import query
from ripplewatch.plans.channels import fused
from ripplewatch.sources import sinks


def keyed(t):
    """Flows with a session and a row id; every seventh row is delivered twice."""
    rows = t.flows.withColumns(
        {
            "session_id": F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")),
            "source_row_id": F.concat(F.lit("day:"), F.col("event_id").cast("string")),
        }
    )
    return rows


@query(
    "idempotent_write",
    """SELECT date_trunc('day', ts)::DATE AS event_date, count(*) AS n FROM flows GROUP BY ALL""",
)
def idempotent_write(t):
    """Overlapping deliveries into one table, one of them with corrected dates, leave every event exactly once."""
    path = sinks.scratch_path(t.spark, "events")
    rows = keyed(t)
    sinks.write_events(rows.filter("k < 60"), path)
    sinks.write_events(rows.filter("k >= 30").union(rows.filter("k >= 90")), path)
    later = F.col("ts") + F.make_dt_interval(days=F.lit(40))
    sinks.write_events(rows.filter("k between 10 and 40").withColumn("ts", later), path)
    return t.spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


@query("already_ingested", "SELECT event_id FROM flows WHERE k >= 60")
def already_ingested(t):
    rows = keyed(t)
    return sinks.new_rows(rows.filter("k >= 30"), rows.filter("k < 60")).select("event_id")


@query(
    "union_of_sources",
    """SELECT 'flows' AS origin, count(*) AS n, count(amount) AS amounts FROM (SELECT NULL AS amount FROM flows)
       UNION ALL SELECT 'payments', count(*), count(amount) FROM payments""",
)
def union_of_sources(t):
    from ripplewatch.plans.preparation import payments

    both = t.flows.withColumn("origin", F.lit("flows")).unionByName(
        payments(t).withColumn("origin", F.lit("payments")), allowMissingColumns=True
    )
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("amounts"))


def _asset_tables(t):
    rows = t.read("supplier")
    base = rows.select(
        F.col("s_name").alias("name"), F.lit(None).cast("string").alias("ip"), F.lit("Supplier").alias("type"),
        F.col("s_acctbal").alias("criticality"), (F.col("s_nationkey") % 6).alias("purdue_level"), F.lit(False).alias("is_gateway"),
    )
    current = base.join(rows.select(F.col("s_name").alias("name"), "s_suppkey"), "name")
    old = current.filter("s_suppkey % 10 <> 3").drop("s_suppkey")
    new = current.filter("s_suppkey % 10 <> 4").withColumn(
        "criticality", F.when(F.col("s_suppkey") % 10 == 5, 0.0).otherwise(F.col("criticality"))
    ).drop("s_suppkey")
    return old, new


@query(
    "asset_upsert_report",
    """SELECT CASE s_suppkey % 10 WHEN 3 THEN 'created' WHEN 4 THEN 'stale' WHEN 5 THEN CASE WHEN s_acctbal = 0 THEN 'unchanged' ELSE 'updated' END ELSE 'unchanged' END AS outcome, count(*) AS n
       FROM supplier GROUP BY ALL""",
)
def asset_upsert_report(t):
    return sinks.upsert_assets(*_asset_tables(t))[1]


@query("stale_assets", "SELECT s_name AS name FROM supplier WHERE s_suppkey % 10 = 4")
def stale_assets(t):
    old, new = _asset_tables(t)
    return old.join(new, "name", "left_anti").select("name")


@query(
    "stored_alert_tables",
    """SELECT alert_kind, count(*) AS n FROM alert_candidates GROUP BY alert_kind""",
)
def stored_alert_tables(t):
    """Candidate alerts appended to a partitioned table and read back."""
    path = sinks.scratch_path(t.spark, "alert-rows")
    rows = policy.alert_candidates(fused(t), volumetric_enabled=True, score_floor=0.8, hybrid_enabled=True)
    sinks.append_table(rows.select("event_id", "ts", "source_asset", "alert_kind"), path, partition_by=["alert_kind"])
    return t.spark.read.parquet(path).groupBy("alert_kind").agg(F.count(F.lit(1)).alias("n"))


_BENIGN = "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in S.FEATURES) + (
    ", count(*) AS warmup_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM flows WHERE NOT is_attack"
)


@query(
    "stored_scorer",
    "SELECT event_id, " + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS z_{f}" for f in S.FEATURES)
    + f", TRUE AS judged, warmup_rows, first_ts, last_ts FROM flows CROSS JOIN ({_BENIGN})",
)
def stored_scorer(t):
    """Scaler, forest and supervised model fitted, stored as one bundle, loaded and applied to every flow."""
    from ripplewatch.sources import bundle, sinks

    path, flows = sinks.scratch_path(t.spark, "bundle"), t.flows.drop("supervised_score")
    fitted = bundle.fit_bundle(flows.filter(~F.col("is_attack")), flows, trees=20, min_rows=100)
    bundle.save_bundle(fitted, path, flows, day="monday")
    loaded = bundle.load_bundle(t.spark, path, flows, day="monday")
    facts = loaded.warmup
    out = bundle.score(flows, loaded)
    judged = F.col("fired").isNotNull() & F.col("supervised_score").between(0, 1)
    first, last = (F.lit(facts[k].isoformat(sep=" ")).cast("timestamp_ntz") for k in ("first_ts", "last_ts"))
    return out.select(
        "event_id", *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in S.FEATURES], judged.alias("judged"),
        F.lit(facts["rows"]).cast("bigint").alias("warmup_rows"), first.alias("first_ts"), last.alias("last_ts"),
    )
