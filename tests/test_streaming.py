"""A stream drained over several micro-batches ends where the batch operators end."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ripplewatch.operators import beacon, chains, drift, policy
from ripplewatch.plans import live
from ripplewatch.plans.policy import TTL
from ripplewatch.streaming import ingest, state
from ripplewatch.streaming.drift import DriftState

ARGS = dict(max_interval_sec=864000.0, max_cv=0.9)


@pytest.fixture(scope="module")
def arriving(spark, small_flows, tmp_path_factory):
    """The flows as eight files that arrive one per micro-batch, in time order."""
    folder = tmp_path_factory.mktemp("arriving")
    flows = small_flows.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(8):
        flows.filter(F.floor(F.col("event_id") / 125) == part).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), flows


def stream(spark, arriving):
    path, flows = arriving
    return spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_beaconing_state_matches_batch(spark, arriving):
    out = ingest.run_available(state.beacon_stream(stream(spark, arriving), **ARGS), spark, "t-beacon")
    assert out.select("batch_id").distinct().count() > 1
    want = beacon.beaconing_verdicts(arriving[1], **ARGS)
    cols = ("event_id", "usable_intervals", "beacon_fired")
    assert rows(out, *cols) == rows(want, *cols)


def test_debounce_state_matches_batch(spark, arriving):
    out = ingest.run_available(state.debounce_stream(stream(spark, arriving), "source_ip", gap_sec=43200), spark, "t-debounce")
    assert rows(out, "event_id") == rows(chains.debounce(arriving[1], "source_ip", gap_sec=43200), "event_id")


def test_silent_keys_leave_the_state(spark, arriving, tmp_path):
    """Timers drop keys: after the last batch only those that were heard of lately are held, and results stay the same."""
    day = 86_400
    last = arriving[1].agg(F.max("ts")).first()[0]
    for name, made, columns, held in (
        ("debounce", state.debounce_stream(stream(spark, arriving), "source_ip", gap_sec=3600), ["source_ip"], 3600 + 1200),
        ("beacon", state.beacon_stream(stream(spark, arriving), idle_sec=2 * day, **ARGS), ["source_ip", "destination_ip"], 4 * day),
    ):
        q = (
            made.writeStream.format("noop").option("checkpointLocation", str(tmp_path / name))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
        operators = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        lately = arriving[1].filter(F.col("ts") > F.lit(last) - F.make_dt_interval(secs=F.lit(float(held))))
        assert operators[-1] <= lately.select(*columns).distinct().count() < arriving[1].select(*columns).distinct().count()


def decisions(df):
    action = F.when(F.col("k") >= 90, "quarantine").when(F.col("k") >= 60, "block").when(F.col("k") >= 20, "rate_limit")
    return df.select("event_id", "ts", F.col("source_ip").alias("source_asset"), action.otherwise("alert").alias("prevention"))


def test_prevention_state_matches_batch(spark, arriving):
    ttl = (21600, 43200, 86400)
    out = ingest.run_available(state.prevention_stream(decisions(stream(spark, arriving)), ttl=ttl), spark, "t-prevent")
    want = policy.prevention_state(decisions(arriving[1]), ttl=ttl)
    for outcome in ("written", "suppressed"):
        assert rows(out.filter(F.col("outcome") == outcome), "event_id") == rows(want.filter(F.col("outcome") == outcome), "event_id")
    ended = want.filter("status in ('superseded', 'expired')").select("event_id", F.col("status").alias("outcome"))
    got = out.filter("outcome in ('superseded', 'expired')").select("event_id", "outcome")
    # The stream may still be waiting for its watermark where the batch already knows the end.
    assert set(rows(got, "event_id", "outcome")) <= set(rows(ended, "event_id", "outcome"))
    assert set(rows(got.filter("outcome = 'superseded'"), "event_id")) == set(rows(ended.filter("outcome = 'superseded'"), "event_id"))


def test_live_prevention_decides_on_all_flows(tables):
    out = live.live_prevention(tables)
    want = policy.prevention_state(decisions(tables.flows), ttl=TTL)
    assert want.count() == tables.flows.count() > tables.flows.filter("is_attack").count()
    for outcome in ("written", "suppressed"):
        assert rows(out.filter(F.col("outcome") == outcome), "event_id") == rows(want.filter(F.col("outcome") == outcome), "event_id")


def test_ingest_is_idempotent_and_debounces_across_batches(spark, arriving, tables, tmp_path):
    def keyed(df):
        return df.withColumns({"session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")})

    job = ingest.Ingest(str(tmp_path / "out"), tables.registry, score=lambda df: df, debounce_sec=43200,
                        alert_policy={"volumetric_enabled": True, "score_floor": 0.8})
    q = (
        keyed(stream(spark, arriving)).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(job.process_batch).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    events = spark.read.parquet(job.path("events"))
    assert events.count() == arriving[1].count() and events.select("batch_id").distinct().count() > 1
    before = spark.read.parquet(job.path("alerts")).count()
    # A lost commit delivers the last batch again, and a later batch repeats old rows.
    last = events.agg(F.max("batch_id")).first()[0]
    ids = [r["event_id"] for r in events.filter(F.col("batch_id") == last).select("event_id").collect()]
    again = keyed(arriving[1].filter(F.col("event_id").isin(ids)))
    job.process_batch(again, last)
    assert spark.read.parquet(job.path("events")).count() == arriving[1].count()
    job.process_batch(again, last + 1)
    assert spark.read.parquet(job.path("events")).count() == arriving[1].count()
    assert spark.read.parquet(job.path("alerts")).count() == before
    wanted = policy.alert_candidates(job.fused(keyed(arriving[1])), **job.alert_policy)
    wanted = chains.debounce(wanted, "source_asset", gap_sec=43200)
    assert rows(spark.read.parquet(job.path("alerts")), "event_id") == rows(wanted, "event_id")
    # Retention deletes: what is stored afterwards is the newest rows, in the scores as well, and nothing else.
    job.retention = {"max_rows": 100}
    n = arriving[1].count()
    assert job.prune(spark) == {"kept": 100, "pruned": n - 100}
    newest = rows(arriving[1].orderBy(F.desc("ts"), F.desc("event_id")).limit(100), "event_id")
    assert rows(spark.read.parquet(job.path("events")), "event_id") == newest
    assert rows(spark.read.parquet(job.path("scores")).select("event_id").distinct(), "event_id") == newest
    assert job.prune(spark) == {"kept": 100, "pruned": 0}


def test_redelivered_rows_drop_within_the_watermark(spark, arriving):
    rows_ = stream(spark, arriving).withColumns({"session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")})
    twice = ingest.deduplicated(rows_.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    out = ingest.run_available(twice.select("event_id"), spark, "t-dedup")
    assert rows(out, "event_id") == rows(arriving[1], "event_id")


def test_drift_state_matches_batch(spark, small_flows, tmp_path):
    """Each bucket delivered as one micro-batch gives the features of the batch form."""
    day, gap = 86_400, 3 * 86_400
    flows = small_flows.filter("ts < timestamp_ntz'2024-01-07'")
    want = drift.drift_features(flows, bucket_sec=day, gap_sec=gap).select("batch", "node", "degree", "history_peers", *drift.FEATURES)
    job = DriftState(str(tmp_path / "drift"), gap_sec=gap)
    days = [r[0] for r in flows.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days):
        job.process_batch(flows.filter(F.to_date("ts") == F.lit(d)), i)
    job.process_batch(flows.filter(F.to_date("ts") == F.lit(days[-1])), len(days) - 1)  # a retried batch changes nothing
    got = {(r["batch"], r["node"]): r for r in job.features(spark).collect()}
    expected = {(r["batch"], r["node"]): r for r in want.collect()}
    assert got.keys() == expected.keys()
    for k, r in expected.items():
        assert (got[k]["degree"], got[k]["history_peers"]) == (r["degree"], r["history_peers"])
        assert [got[k][c] for c in drift.FEATURES] == pytest.approx([r[c] for c in drift.FEATURES], abs=1e-9)


def by_day(flows):
    days = [r[0] for r in flows.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    return [flows.filter(F.to_date("ts") == F.lit(d)) for d in days]


def test_drift_verdicts_match_batch(spark, small_flows, tmp_path):
    """Baseline, refits, scores and reasons of the stream are those of the batch form on the same feature rows.

    The rows themselves are compared above, up to the order of sums; a forest need not be the same after such a change.
    """
    gap = 3 * 86_400
    flows = small_flows.filter("ts < timestamp_ntz'2024-01-10'")
    fit = {"baseline_batches": 3, "refit_every": 2, "min_rows": 10, "min_degree": 6}
    job = DriftState(str(tmp_path / "verdicts"), gap_sec=gap, scoring={"trees": 10}, **fit)
    got = []
    for i, batch in enumerate(by_day(flows)):
        for _ in range(2 if i in (2, 4) else 1):
            job.process_batch(batch, i)
            last = job.verdicts(spark, i).collect()
        got += last
    expected = {(r["batch"], r["node"]): r for r in drift.score_drift(job.features(spark), trees=10, **fit).collect()}
    assert {(r["batch"], r["node"]): r["abstained"] for r in got} == {k: r["abstained"] for k, r in expected.items()}
    for r in got:
        other = expected[r["batch"], r["node"]]
        assert r["drift_fired"] == other["drift_fired"] and r["drift_score"] == pytest.approx(other["drift_score"], abs=1e-9)
    assert {r["abstained"] for r in got} >= {None, "baseline_not_fitted", "insufficient_edges"}


def test_a_drift_batch_is_evaluated_once(spark, small_flows, tmp_path):
    seen, calls = small_flows.count(), spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    columns = small_flows.select("source_ip", "destination_ip", "ts", "bytes")
    DriftState(str(tmp_path / "once")).process_batch(columns.mapInPandas(passed, columns.schema), 0)
    assert calls.value == seen


def test_deliveries_are_whole_and_spread_over_tasks(spark, tables, tmp_path, monkeypatch):
    """Every event arrives in its part, the fifth part twice; a table in one split gives micro-batches of several tasks."""
    monkeypatch.setattr(live, "PART_ROWS", 10)
    got = {}

    def process(batch, batch_id):
        got[batch_id] = (batch.rdd.getNumPartitions(), rows(batch, "event_id"))

    assert tables.events.rdd.getNumPartitions() == 1
    live.deliver(tables, str(tmp_path), process)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a, b = tables.events.agg(F.min(us), F.max(us)).first()
    part = F.least(F.lit(live.PARTS - 1), F.floor((us - a) * live.PARTS / (b - a)))
    for n, k in enumerate([*range(live.PARTS), 4]):
        tasks, ids = got[n]
        assert ids == rows(tables.events.filter(part == k), "event_id") and tasks > 1
    assert len(got) == live.PARTS + 1


def test_the_drift_channel_joins_the_fusion(tables):
    six = {r["event_id"]: r for r in live.live_six_channels(tables).collect()}
    five = {r["event_id"]: r for r in ingest.Ingest("", tables.registry, score=lambda df: df).fused(tables.flows).collect()}
    assert six.keys() == five.keys() and any(r["drift_fired"] for r in six.values())
    for k, r in six.items():
        kept = 1 - r["drift_score"] * 0.15 * r["drift_fired"]
        wanted = 1.0 if five[k]["has_confirmed"] else 1 - (1 - five[k]["threat_score"]) * kept
        assert r["threat_score"] == pytest.approx(wanted, abs=1e-12)


def test_an_ended_action_ends_once(spark, tables, tmp_path):
    """When a batch leaves no active action, the next one does not meet those of the batch before."""
    job = ingest.Ingest(str(tmp_path / "tables"), tables.registry, score=lambda df: df, prevention=True, ttl=(60, 60, 60))
    row = "'a', true, 3, 'confirmed', 1.0D, 0.6D"
    for batch_id, minute in enumerate((0, 10, 20)):
        last = spark.sql(f"SELECT timestamp'2024-01-01 00:{minute:02d}:00' AS t").first()[0]
        done = spark.sql(f"SELECT {batch_id}L AS event_id, s AS source_asset, timestamp'2024-01-01 00:{minute:02d}:00' AS ts, c AS has_confirmed, n AS n_fired, b AS band, x AS threat_score, y AS source_criticality FROM VALUES ({row}) AS v(s, c, n, b, x, y)")
        job._actions(spark, done if batch_id == 0 else done.limit(0), batch_id, {"last": last})
    actions = spark.read.parquet(job.path("actions"))
    assert rows(actions, "event_id", "outcome", "batch_id") == [(0, "expired", 1), (0, "written", 0)]


def test_the_whole_batch_is_idempotent(spark, tables, tmp_path):
    """A batch that is processed twice under its number leaves snapshots, alerts, actions and counters as they were."""
    from ripplewatch import inventory as inv

    flows = tables.flows.withColumns(
        {"ts": F.col("ts").cast("timestamp"), "session_id": F.lit("s"), "source_row_id": F.col("event_id").cast("string")}
    )
    job = ingest.Ingest(
        str(tmp_path / "tables"), tables.registry, score=lambda df: df, edges=inv.edges(spark), assets=tables.assets, iterations=70,
        snapshot_reuse_sec=6 * 3600, debounce_sec=43200, prevention=True, ttl=TTL, alert_policy={"volumetric_enabled": True, "score_floor": 0.8},
    )
    parts = [flows.filter(F.floor(F.col("event_id") / 400) == k) for k in range(3)]
    names = ("snapshots", "alerts", "actions", "counters", "impacts")

    def state():
        return {n: sorted(map(str, spark.read.parquet(job.path(n)).collect())) for n in names}

    for k, part in enumerate(parts):
        job.process_batch(part, k)
    once = state()
    job.process_batch(parts[2], 2)
    assert state() == once
    counters = spark.read.parquet(job.path("counters")).collect()
    assert sum(r["inserted"] for r in counters) == flows.count()
    for table, name in (("snapshots", "cii_computed"), ("alerts", "alerts_created")):
        assert len(once[table]) == sum(r[name] for r in counters) > 0
    assert len(once["impacts"]) == len({r["origin"] for r in spark.read.parquet(job.path("impacts")).collect()})
