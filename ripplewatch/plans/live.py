"""Streaming queries: the event file drained as a stream, compared with the batch result."""

from math import ceil

from pyspark.sql import functions as F

from ripplewatch.operators import analysis
from ripplewatch.plans.catalog import cte, query
from ripplewatch.plans.channels import BEACON
from ripplewatch.plans.policy import HALF_DAY, POLICY, TTL, _greedy
from ripplewatch.plans.tables import Tables
from ripplewatch.streaming import ingest, state


def stream(t):
    """The flow columns over a file stream of the events table; ts becomes a zoned timestamp for watermarks."""
    live = Tables(t.spark, t.path)
    live.events = ingest.flow_stream(t.spark, t.path, t.events.schema, glob="events.parquet")
    return live.flows.withColumn("ts", F.col("ts").cast("timestamp"))


def tripwired(t):
    return stream(t).withColumn("tripwire_fired", F.col("is_honeytoken_use"))


@query(
    "live_minute_counts",
    """SELECT date_trunc('minute', ts) AS minute, count(*) AS events, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (is_honeytoken_use) AS tripwires
       FROM flows GROUP BY ALL""",
)
def live_minute_counts(t):
    updates = ingest.run_available(ingest.live_counts(tripwired(t), width="1 minute"), t.spark, "counts", mode="update")
    out = ingest.latest_windows(updates, ["window"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "events", "anomalies", "tripwires")


@query(
    "live_subnet_counts",
    """SELECT date_trunc('hour', ts) AS hour, subnet, count(*) AS events FROM (SELECT ts, unnest(list_distinct([
        regexp_extract(source_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24', regexp_extract(destination_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'])) AS subnet FROM flows) GROUP BY ALL""",
)
def live_subnet_counts(t):
    updates = ingest.run_available(ingest.live_subnets(stream(t), width="1 hour"), t.spark, "subnets", mode="update")
    out = ingest.latest_windows(updates, ["window", "subnet"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "subnet", "events")


@query(
    "live_sector_counts",
    """SELECT date_trunc('hour', ts) AS hour, sector, count(*) AS events FROM (
         SELECT r.ts, unnest(list_distinct([s.sector, d.sector])) AS sector
         FROM resolved r LEFT JOIN assets s ON s.name = r.source_asset LEFT JOIN assets d ON d.name = r.destination_asset)
       WHERE sector IS NOT NULL GROUP BY ALL""",
)
def live_sector_counts(t):
    from ripplewatch.operators.resolve import resolve_assets

    flows = resolve_assets(stream(t), t.registry)
    updates = ingest.run_available(ingest.live_sectors(flows, t.assets, width="1 hour"), t.spark, "sectors", mode="update")
    out = ingest.latest_windows(updates, ["window", "sector"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "sector", "events")


@query(
    "live_deduplicated",
    "SELECT event_id, 1 AS copies FROM flows",
)
def live_deduplicated(t):
    rows = stream(t).withColumns({"session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")})
    twice = ingest.deduplicated(rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    out = ingest.run_available(twice.select("event_id"), t.spark, "dedup")
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "live_with_injected",
    """SELECT origin, count(*) AS n FROM (SELECT 'replay' AS origin FROM flows UNION ALL SELECT 'injected' FROM flows WHERE label = 'Bot') GROUP BY origin""",
)
def live_with_injected(t):
    injected = stream(t).filter(F.col("label") == "Bot").withColumn("source_ip", F.lit("10.0.1.30"))
    both = ingest.merge_injected(stream(t), injected).select("event_id", "origin")
    return ingest.run_available(both, t.spark, "injected").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "live_beaconing",
    """SELECT event_id, n AS usable_intervals, round(cv, 6) AS beacon_cv, coalesce(cv <= 0.25, FALSE) AS beacon_fired FROM beacons""",
)
def live_beaconing(t):
    out = ingest.run_available(state.beacon_stream(stream(t), **BEACON), t.spark, "beacon")
    return out.select("event_id", "usable_intervals", F.round("beacon_cv", 6).alias("beacon_cv"), "beacon_fired")


@query(
    "live_debounce",
    f"WITH {_greedy('flows', 'source_ip', HALF_DAY)} SELECT event_id, grp AS source_ip FROM walk WHERE ok",
)
def live_debounce(t):
    out = ingest.run_available(state.debounce_stream(stream(t), "source_ip", gap_sec=HALF_DAY), t.spark, "debounce")
    return out.select("event_id", "source_ip")


_LIFE = f"CASE lvl WHEN 2 THEN {TTL[0]} WHEN 3 THEN {TTL[1]} WHEN 4 THEN {TTL[2]} ELSE 0 END"


@query(
    "live_prevention",
    f"""WITH steps AS (SELECT source_ip AS source_asset, event_id, epoch_us(ts) AS us, CASE WHEN k >= 90 THEN 4 WHEN k >= 60 THEN 3 WHEN k >= 20 THEN 2 ELSE 1 END AS lvl,
          row_number() OVER (PARTITION BY source_ip ORDER BY ts, event_id) AS rn FROM flows),
        timed AS (SELECT *, us + ({_LIFE})::BIGINT * 1000000 AS ends FROM steps),
        state AS (SELECT *, TRUE AS written, CASE WHEN lvl >= 2 THEN lvl ELSE 0 END AS cur, ends AS cur_ends FROM timed WHERE rn = 1
          UNION ALL SELECT t.*, NOT (s.cur >= t.lvl AND s.cur_ends > t.us),
            CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur WHEN t.lvl >= 2 THEN t.lvl ELSE 0 END,
            CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur_ends ELSE t.ends END
          FROM state s JOIN timed t ON t.source_asset = s.source_asset AND t.rn = s.rn + 1),
        lives AS (SELECT source_asset, event_id, ends, lead(us) OVER (PARTITION BY source_asset ORDER BY rn) AS next_us FROM state WHERE written AND lvl >= 2),
        ended AS (SELECT l.*, (SELECT max(us) FROM steps) AS newest, a.last FROM lives l JOIN (SELECT source_asset, max(us) AS last FROM steps GROUP BY ALL) a USING (source_asset))
        SELECT source_asset, event_id, CASE WHEN written THEN 'written' ELSE 'suppressed' END AS outcome, us FROM state
        UNION ALL SELECT source_asset, event_id, 'superseded', next_us FROM ended WHERE next_us < ends
        UNION ALL SELECT source_asset, event_id, 'expired', ends FROM ended
          WHERE coalesce(next_us >= ends, TRUE) AND (ends <= last OR ends // 1000 < newest // 1000 - 600000)""",
)
def live_prevention(t):
    """Prevention state of all flows with event-time expiry: by the asset's next row, or by the watermark once it is silent."""
    action = F.when(F.col("k") >= 90, "quarantine").when(F.col("k") >= 60, "block").when(F.col("k") >= 20, "rate_limit")
    rows = stream(t).select("event_id", "ts", F.col("source_ip").alias("source_asset"), action.otherwise("alert").alias("prevention"))
    return ingest.run_available(state.prevention_stream(rows, ttl=TTL), t.spark, "prevention").select(
        "source_asset", "event_id", "outcome", "us"
    )


@query(
    "live_ingest",
    """SELECT count(*) AS received, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (is_honeytoken_use) AS tripwires,
       (SELECT count(*) FROM flows) AS stored FROM flows""",
)
def live_ingest(t):
    """The whole micro-batch: score, fuse, resolve, persist, alert."""
    from ripplewatch.sources.sinks import scratch_path

    rows = stream(t).withColumns({"session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")})
    job = ingest.Ingest(scratch_path(t.spark, "ingest"), t.registry, score=lambda df: df, debounce_sec=HALF_DAY)
    query_ = (
        rows.writeStream.option("checkpointLocation", scratch_path(t.spark, "ingest-state"))
        .foreachBatch(job.process_batch).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    counters = t.spark.read.parquet(job.path("counters")).agg(
        *[F.sum(c).alias(c) for c in ("received", "anomalies", "tripwires")]
    )
    stored = t.spark.read.parquet(job.path("events")).count()
    return counters.withColumn("stored", F.lit(stored).cast("bigint"))


@query(
    "live_drift",
    """WITH pairs AS (SELECT source_ip AS node, destination_ip AS peer, sum(bytes)::DOUBLE AS w, max(epoch_us(ts)) AS seen FROM flows GROUP BY ALL),
        alive AS (SELECT * FROM pairs WHERE (SELECT max(seen) FROM pairs) - seen <= 259200000000),
        spread AS (SELECT node, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-(w / t) * log2(w / t)) / log2(count(*)) END AS h
          FROM (SELECT node, w, sum(w) OVER (PARTITION BY node) AS t FROM alive WHERE w > 0) GROUP BY node)
        SELECT 1 AS batch, a.node, count(*) AS degree, 0 AS history_peers, 1.0::DOUBLE AS unseen_peer_ratio, count(*)::DOUBLE AS degree_expansion,
          1.0::DOUBLE AS neighbor_drift, round(coalesce(max(s.h), 0), 6) AS traffic_entropy_delta FROM alive a LEFT JOIN spread s USING (node) GROUP BY a.node""",
)
def live_drift(t):
    """Drift features of the streamed flows, a micro-batch at a time; one file is one micro-batch."""
    from ripplewatch.sources.sinks import scratch_path
    from ripplewatch.streaming.drift import DriftState

    job = DriftState(scratch_path(t.spark, "drift"), gap_sec=3 * 86_400)
    query_ = (
        stream(t).writeStream.option("checkpointLocation", scratch_path(t.spark, "drift-state"))
        .foreachBatch(job.process_batch).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    out = job.features(t.spark)
    return out.withColumn("traffic_entropy_delta", F.round("traffic_entropy_delta", 6))


PARTS = 8
PART_ROWS = 100_000
_REUSE = 6 * 3600
_DRIFT = {"gap_sec": 3 * 86_400, "baseline_batches": 3, "refit_every": 2, "min_rows": 20, "min_degree": 4}
_jobs: dict = {}
cte(
    "parts",
    f"""SELECT *, least({PARTS - 1}, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {PARTS} // greatest(1, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ())) AS part FROM flows""",
)


def deliver(t, root: str, process, columns=("*",)) -> None:
    """The events as ``PARTS`` micro-batches in time order, the fifth of which arrives once more at the end.

    The table is read once and dealt to files by part, ``PART_ROWS`` rows each on average, so that a delivery reads its own part
    only and a micro-batch has a task for every few files whatever the splits of the table were. ``process`` gets ``columns``:
    what it does not need is best left out here, as a micro-batch is computed whole.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = t.events.agg(F.min(us).alias("a"), F.max(us).alias("b"), F.count(F.lit(1)).alias("n")).first()
    part = F.least(F.lit(PARTS - 1), F.floor((us - span["a"]) * PARTS / max(1, span["b"] - span["a"])))
    folder, staged, files = f"{root}/arriving", f"{root}/staged", ceil(max(1, span["n"]) / (PARTS * PART_ROWS))
    salt = F.pmod(F.xxhash64("event_id"), F.lit(files))
    dealt = t.events.withColumn("part", part.cast("int")).repartition(PARTS * files, "part", salt)
    dealt.write.mode("overwrite").partitionBy("part").parquet(staged)
    parts = t.spark.read.schema(dealt.schema).parquet(staged)
    for n in [*range(PARTS), 4]:
        parts.filter(F.col("part") == n).drop("part").write.mode("append").parquet(folder)
        live = Tables(t.spark, t.path)
        live.events = ingest.flow_stream(t.spark, folder, t.events.schema)
        rows = live.flows.withColumns(
            {"ts": F.col("ts").cast("timestamp"), "session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")}
        )
        query_ = (
            rows.select(*columns).writeStream.option("checkpointLocation", f"{root}/progress")
            .foreachBatch(process).trigger(availableNow=True).start()
        )
        query_.awaitTermination()


def ingested(t) -> ingest.Ingest:
    """The whole pipeline over all micro-batches; the queries below read what it stored, so it runs once for a table."""
    from ripplewatch import inventory as inv
    from ripplewatch.sources.sinks import scratch_path

    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _jobs:
        root = scratch_path(t.spark, "pipeline")
        job = ingest.Ingest(
            f"{root}/tables", t.registry, score=lambda df: df, debounce_sec=HALF_DAY, edges=inv.edges(t.spark), assets=t.assets,
            alert_policy=POLICY, snapshot_reuse_sec=_REUSE, prevention=True, ttl=TTL,
        )
        deliver(t, root, job.process_batch)
        _jobs[key] = job
    return _jobs[key]


cte(
    "live_fused",
    """SELECT *, CASE WHEN tripwire_fired OR threat_score >= 0.85 THEN 'confirmed' WHEN threat_score >= 0.55 THEN 'likely'
        WHEN threat_score >= 0.25 THEN 'suspicious' ELSE 'benign' END AS band,
      CASE WHEN tripwire_fired OR threat_score >= 0.55 THEN 'alert' ELSE 'observe' END AS fused_action,
      is_anomaly::INT + tripwire_fired::INT + (supervised_score >= 0.5)::INT + (signature_n > 0)::INT AS n_fired
     FROM (SELECT *, CASE WHEN tripwire_fired THEN 1.0::DOUBLE ELSE 1 -
        (1 - CASE WHEN is_anomaly THEN volumetric_score * 0.02::DOUBLE ELSE 0 END) *
        (1 - CASE WHEN supervised_score >= 0.5 THEN supervised_score::DOUBLE * 0.9::DOUBLE ELSE 0 END) *
        (1 - CASE WHEN signature_n > 0 THEN signature_score * 0.85::DOUBLE ELSE 0 END) END AS threat_score
      FROM channel_rows JOIN (SELECT event_id, part FROM parts) USING (event_id))""",
)


def _walk(name: str, source: str, gap: int) -> None:
    """Named subqueries ``<name>_order`` and ``<name>_walk``: rows at least ``gap`` seconds after the asset's last accepted one."""
    cte(f"{name}_order", f"SELECT source_asset, event_id, ts, row_number() OVER (PARTITION BY source_asset ORDER BY ts, event_id) AS rn FROM {source}")
    open_ = f"epoch_us(o.ts) - epoch_us(w.last_ts) >= {gap}000000"
    cte(
        f"{name}_walk",
        f"""SELECT source_asset, rn, event_id, ts AS last_ts, TRUE AS ok FROM {name}_order WHERE rn = 1
            UNION ALL SELECT o.source_asset, o.rn, o.event_id, CASE WHEN {open_} THEN o.ts ELSE w.last_ts END, {open_}
            FROM {name}_walk w JOIN {name}_order o ON o.source_asset = w.source_asset AND o.rn = w.rn + 1""",
    )


cte(
    "snap_rows",
    """SELECT event_id, ts, part, source_asset, volumetric_score FROM live_fused
       WHERE source_asset IN (SELECT name FROM city_nodes) AND (is_anomaly OR tripwire_fired OR fused_action = 'alert')""",
)
_walk("snap", "snap_rows", _REUSE)
cte(
    "city_hits",
    "SELECT * FROM city_level0 UNION SELECT * FROM city_level1 UNION SELECT * FROM city_level2 UNION SELECT * FROM city_level3",
)
cte(
    "units",
    """SELECT origin, median(share) AS m, quantile_cont(share, 0.05) AS lo, quantile_cont(share, 0.95) AS hi FROM (
         SELECT r.origin, r.iteration, sum(CASE WHEN r.node <> r.origin THEN w.c ELSE 0 END) / ((SELECT sum(c) FROM city_weights) - max(own.c)) AS share
         FROM city_hits r JOIN city_weights w ON w.name = r.node JOIN city_weights own ON own.name = r.origin GROUP BY r.origin, r.iteration) GROUP BY origin""",
)
cte(
    "snaps",
    """SELECT c.event_id, c.ts, c.part, c.source_asset, least(1, c.volumetric_score * u.m) AS cii_median, least(1, c.volumetric_score * u.lo) AS cii_p5,
         least(1, c.volumetric_score * u.hi) AS cii_p95 FROM snap_walk w JOIN snap_rows c USING (event_id) JOIN units u ON u.origin = c.source_asset WHERE w.ok""",
)
cte(
    "live_alert_rows",
    """SELECT *, CASE WHEN tripwire_fired THEN 'tripwire' WHEN is_anomaly AND volumetric_score >= 0.8 THEN 'volumetric' ELSE 'hybrid' END AS alert_kind
       FROM live_fused WHERE tripwire_fired OR (is_anomaly AND volumetric_score >= 0.8) OR (NOT is_anomaly AND fused_action = 'alert')""",
)
_walk("live_alert", "live_alert_rows", HALF_DAY)
cte(
    "live_steps",
    """SELECT *, row_number() OVER (PARTITION BY source_asset ORDER BY ts, event_id) AS rn FROM (
         SELECT f.source_asset, f.event_id, f.ts, f.part, epoch_us(f.ts) AS us, CASE WHEN f.band IN ('benign', 'suspicious') THEN 0 WHEN NOT (f.tripwire_fired OR f.n_fired >= 2) THEN 1
           WHEN f.threat_score >= 0.85 AND f.source_criticality >= 0.85 AND s.cii_median >= 0.1 THEN 4
           WHEN f.threat_score >= 0.85 AND f.source_criticality >= 0.5 THEN 3 WHEN f.threat_score >= 0.55 THEN 2 ELSE 1 END AS lvl
         FROM live_fused f ASOF LEFT JOIN snaps s ON s.source_asset = f.source_asset AND s.ts <= f.ts) WHERE lvl > 0""",
)
cte("live_timed", f"SELECT *, us + (CASE lvl WHEN 2 THEN {TTL[0]} WHEN 3 THEN {TTL[1]} WHEN 4 THEN {TTL[2]} END)::BIGINT * 1000000 AS ends FROM live_steps")
cte(
    "live_fate",
    """SELECT source_asset, rn, event_id, part, us, lvl, ends, TRUE AS written, CASE WHEN lvl >= 2 THEN lvl ELSE 0 END AS cur, CASE WHEN lvl >= 2 THEN ends ELSE 0 END AS cur_ends FROM live_timed WHERE rn = 1
       UNION ALL SELECT t.source_asset, t.rn, t.event_id, t.part, t.us, t.lvl, t.ends, NOT (s.cur >= t.lvl AND s.cur_ends > t.us),
         CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur WHEN t.lvl >= 2 THEN t.lvl ELSE 0 END,
         CASE WHEN s.cur >= t.lvl AND s.cur_ends > t.us THEN s.cur_ends WHEN t.lvl >= 2 THEN t.ends ELSE 0 END
       FROM live_fate s JOIN live_timed t ON t.source_asset = s.source_asset AND t.rn = s.rn + 1""",
)
cte(
    "live_lives",
    """SELECT event_id, ends, lead(us) OVER (PARTITION BY source_asset ORDER BY rn) AS next_us FROM live_fate WHERE written AND lvl >= 2""",
)


@query(
    "live_snapshots",
    """SELECT event_id, source_asset, round(cii_median, 6) AS cii_median, round(cii_p5, 6) AS cii_p5, round(cii_p95, 6) AS cii_p95,
         (SELECT count(DISTINCT node) FROM city_hits h WHERE h.origin = snaps.source_asset AND h.node <> h.origin) AS n_impacted FROM snaps""",
)
def live_snapshots(t):
    """Impact snapshots that the micro-batches computed; all others reused the asset's last one."""
    out = t.spark.read.parquet(ingested(t).path("snapshots"))
    rounded = [F.round(c, 6).alias(c) for c in ("cii_median", "cii_p5", "cii_p95")]
    return out.select("event_id", "source_asset", *rounded, F.size("impacted").cast("bigint").alias("n_impacted"))


@query(
    "live_alerts",
    """SELECT a.event_id, a.alert_kind, s.event_id AS snapshot_event_id
       FROM (SELECT r.* FROM live_alert_walk w JOIN live_alert_rows r USING (event_id) WHERE w.ok) a
       ASOF LEFT JOIN snaps s ON s.source_asset = a.source_asset AND s.ts <= a.ts""",
)
def live_alerts(t):
    return t.spark.read.parquet(ingested(t).path("alerts")).select("event_id", "alert_kind", "snapshot_event_id")


@query(
    "live_actions",
    """SELECT event_id, CASE WHEN written THEN 'written' ELSE 'suppressed' END AS outcome FROM live_fate
       UNION ALL SELECT event_id, CASE WHEN next_us < ends THEN 'superseded' ELSE 'expired' END FROM live_lives
         WHERE next_us < ends OR ends <= (SELECT max(epoch_us(ts)) FROM flows)""",
)
def live_actions(t):
    """The log of prevention actions over all micro-batches."""
    return t.spark.read.parquet(ingested(t).path("actions")).select("event_id", "outcome")


@query(
    "live_batch_counters",
    f"""SELECT p.part AS batch, p.n AS received, p.n AS inserted, 0 AS deduplicated, f.anomalies, f.tripwires, f.escalated, f.signature_hits,
         coalesce(s.computed, 0) AS cii_computed, coalesce(s.n, 0) - coalesce(s.computed, 0) AS cii_reused, coalesce(a.created, 0) AS alerts_created,
         coalesce(a.n, 0) - coalesce(a.created, 0) AS alerts_suppressed, coalesce(a.hybrid, 0) AS hybrid_alerts, coalesce(x.written, 0) AS actions_written, coalesce(x.suppressed, 0) AS actions_suppressed
       FROM (SELECT part, count(*) AS n FROM parts GROUP BY part) p
       JOIN (SELECT part, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (tripwire_fired) AS tripwires, count(*) FILTER (fused_action = 'alert') AS escalated,
               count(*) FILTER (signature_n > 0) AS signature_hits FROM live_fused GROUP BY part) f USING (part)
       LEFT JOIN (SELECT part, count(*) AS n, count(*) FILTER (ok) AS computed FROM snap_rows JOIN snap_walk USING (event_id) GROUP BY part) s USING (part)
       LEFT JOIN (SELECT part, count(*) AS n, count(*) FILTER (ok) AS created, count(*) FILTER (ok AND alert_kind = 'hybrid') AS hybrid
                  FROM live_alert_rows JOIN live_alert_walk USING (event_id) GROUP BY part) a USING (part)
       LEFT JOIN (SELECT part, count(*) FILTER (written) AS written, count(*) FILTER (NOT written) AS suppressed FROM live_fate GROUP BY part) x USING (part)
       UNION ALL SELECT {PARTS}, count(*), 0, count(*), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM parts WHERE part = 4""",
)
def live_batch_counters(t):
    """Counters of every micro-batch, the one delivered twice included."""
    out = t.spark.read.parquet(ingested(t).path("counters")).withColumn("batch", F.col("batch_id").cast("bigint"))
    return out.select(
        "batch", "received", "inserted", "deduplicated", "anomalies", "tripwires", "escalated", "signature_hits", "cii_computed",
        "cii_reused", "alerts_created", "alerts_suppressed", "hybrid_alerts", "actions_written", "actions_suppressed",
    )


cte(
    "live_degrees",
    f"""SELECT n.batch, p.node, count(*) AS degree FROM (SELECT range + 1 AS batch FROM range({PARTS})) n
        JOIN (SELECT DISTINCT source_ip AS node, destination_ip AS peer FROM flows) p ON TRUE
        WHERE (SELECT max(epoch_us(ts)) FROM parts WHERE part < n.batch) - (SELECT max(epoch_us(ts)) FROM parts f WHERE f.part < n.batch AND f.source_ip = p.node AND f.destination_ip = p.peer)
          <= {_DRIFT["gap_sec"]}000000 GROUP BY ALL""",
)
cte(
    "live_fit",
    f"""SELECT greatest({_DRIFT["baseline_batches"]}, min(batch)) AS first FROM (
          SELECT batch, sum(count(*) FILTER (degree >= {_DRIFT["min_degree"]})) OVER (ORDER BY batch) AS n FROM live_degrees GROUP BY batch) WHERE n >= {_DRIFT["min_rows"]}""",
)


def drifted(t):
    """The drift detector alone over the same micro-batches."""
    from ripplewatch.sources.sinks import scratch_path
    from ripplewatch.streaming.drift import DriftState

    root = scratch_path(t.spark, "drifted")
    job, made = DriftState(f"{root}/drift", scoring={"trees": 20}, **_DRIFT), f"{root}/verdicts"

    def process(batch, batch_id):
        if batch_id < PARTS:  # the repeated delivery is the keyed sink's to drop
            job.process_batch(batch, batch_id)
            job.verdicts(batch.sparkSession, batch_id).write.mode("overwrite").parquet(f"{made}/batch_id={batch_id}")

    deliver(t, root, process, ("source_ip", "destination_ip", "ts", "bytes"))
    return t.spark.read.parquet(made)


@query(
    "live_drift_verdicts",
    f"""SELECT batch, node, degree, CASE WHEN batch < (SELECT first FROM live_fit) THEN 'baseline_not_fitted' WHEN degree < {_DRIFT["min_degree"]} THEN 'insufficient_edges' END AS abstained,
          batch >= (SELECT first FROM live_fit) AND degree >= {_DRIFT["min_degree"]} AS judged FROM live_degrees""",
)
def live_drift_verdicts(t):
    """Every node's verdict in every micro-batch, or why there is none; scores themselves come from a trained forest."""
    return drifted(t).select("batch", "node", "degree", "abstained", F.col("drift_decision").isNotNull().alias("judged"))


@query("live_six_channels")
def live_six_channels(t):
    """Threat scores of a stream with the drift channel in the fusion; compared with batch fusion in tests."""
    from ripplewatch.sources.sinks import scratch_path
    from ripplewatch.streaming.drift import DriftState

    root = scratch_path(t.spark, "six")
    job = ingest.Ingest(f"{root}/tables", t.registry, score=lambda df: df, drift=DriftState(f"{root}/drift", scoring={"trees": 20}, **_DRIFT))
    deliver(t, root, job.process_batch)
    return t.spark.read.parquet(job.path("events")).select("event_id", "threat_score", "band", "drift_fired", "drift_score")


@query("batch_analysis")
def batch_analysis(t):
    """Features, forest, tripwire, status, risk and blast radius of one run; one summary row."""
    from ripplewatch import inventory as inv

    return analysis.analyse(t.flows, t.assets, inv.edges(t.spark), t.registry).summary
