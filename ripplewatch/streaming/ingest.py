"""Micro-batch ingest and the stateless streaming operators."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplewatch import settings as S
from ripplewatch.functions.lookup import moment
from ripplewatch.functions.net import subnet24
from ripplewatch.functions.partitions import broadcast_if_small, cut_lineage
from ripplewatch.operators import cascade, fusion, policy, rollup, signature, volumetric
from ripplewatch.operators.graph import build_graph, graph_nodes
from ripplewatch.operators.resolve import in_effect, resolve_assets
from ripplewatch.operators.sequence import is_victim
from ripplewatch.sources import sinks
from ripplewatch.streaming.drift import DriftState
from ripplewatch.streaming.state import WATERMARK


def flow_stream(spark: SparkSession, path: str, schema: T.StructType, *, glob: str | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def merge_injected(flows: DataFrame, injected: DataFrame) -> DataFrame:
    """Base and what-if streams in one, told apart by ``origin``."""
    base = flows.withColumn("origin", F.lit("replay"))
    return base.unionByName(injected.withColumn("origin", F.lit("injected")), allowMissingColumns=True)


def deduplicated(flows: DataFrame, *, keys=sinks.EVENT_KEY, watermark: str = WATERMARK) -> DataFrame:
    """Drop re-deliveries that arrive within the watermark; the sink's key check covers later ones."""
    return flows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def live_counts(flows: DataFrame, *, width: str = "1 second", watermark: str = WATERMARK) -> DataFrame:
    """Events, anomalies and tripwires per tumbling window."""
    return flows.withWatermark("ts", watermark).groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if("tripwire_fired").alias("tripwires"),
    )


def live_subnets(flows: DataFrame, *, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Events per tumbling window and touched /24, an event counting once per distinct subnet."""
    ends = F.array_distinct(F.array_compact(F.array(subnet24(F.col("source_ip")), subnet24(F.col("destination_ip")))))
    rows = flows.withWatermark("ts", watermark).select("ts", F.explode(ends).alias("subnet"))
    return rows.groupBy(F.window("ts", width), "subnet").agg(F.count(F.lit(1)).alias("events"))


def live_sectors(flows: DataFrame, sectors: DataFrame, *, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Events per tumbling window and touched sector; ``sectors`` is a static dimension."""
    rows = flows.withWatermark("ts", watermark)
    for end, name in (("source_asset", "_s"), ("destination_asset", "_d")):
        side = sectors.select(F.col("name").alias(end), F.col("sector").alias(name))
        rows = rows.join(side, end, "left")
    touched = F.explode(F.array_distinct(F.array_compact(F.array("_s", "_d")))).alias("sector")
    return rows.select("ts", touched).groupBy(F.window("ts", width), "sector").agg(F.count(F.lit(1)).alias("events"))


@dataclass
class Ingest:
    """Score, fuse, resolve, persist and alert, one micro-batch at a time; pass ``process_batch`` to foreachBatch.

    ``score`` adds the model-backed channel columns (``is_anomaly``, ``volumetric_score``, ``supervised_score`` and,
    when used, the beacon columns) with models fitted beforehand; nothing else is fitted while streaming. All stored
    tables live under ``root``. Re-running a batch after a failure inserts nothing twice: events are keyed, and
    everything downstream is derived from newly inserted rows only, written under the batch's own partition.

    With ``edges`` and ``assets``, anomalies and escalated rows of graph nodes get impact snapshots: an origin's cascade is
    simulated once, when it first needs one, and kept in ``impacts``; a snapshot scales it by the row's score, and an
    asset's last snapshot is reused for ``snapshot_reuse_sec``. Alerts name the snapshot in effect. With ``prevention``,
    decisions meet the asset's active action, which the previous batch left in ``prevention_state``; ``actions`` logs
    what is written, suppressed, superseded or expired. With ``drift``, the drift channel joins the fusion.
    """

    root: str
    registry: DataFrame
    score: Callable[[DataFrame], DataFrame]
    alert_policy: dict = field(default_factory=dict)
    debounce_sec: float = 60.0
    beaconing: bool = False
    retention_every: int = 0
    retention: dict = field(default_factory=dict)
    edges: DataFrame | None = None
    assets: DataFrame | None = None
    iterations: int = S.CASCADE_ITERATIONS
    snapshot_reuse_sec: float = S.SNAPSHOT_DEBOUNCE_SEC
    prevention: bool = False
    prevention_policy: dict = field(default_factory=dict)
    ttl: tuple[int, int, int] = (S.TTL_RATE_LIMIT, S.TTL_BLOCK, S.TTL_QUARANTINE)
    drift: DriftState | None = None
    _nodes: DataFrame | None = None

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def fused(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """The batch with all channels, resolved and fused; ``in_graph`` tells rows whose source asset is a graph node."""
        rows = volumetric.two_channel_confidence(volumetric.tripwire(self.score(batch)))
        rows = signature.signature_verdicts(resolve_assets(rows, self.registry))
        if self.drift is not None:
            rows = self.drift.with_verdicts(rows, batch_id)
        rows = fusion.fuse(fusion.collect_verdicts(rows, beaconing=self.beaconing, drift=self.drift is not None))
        if self.edges is None:
            return rows.withColumn("in_graph", F.lit(False))
        if self._nodes is None:
            self._nodes = cut_lineage(graph_nodes(build_graph(self.edges, self.assets)))
        nodes = broadcast_if_small(self._nodes.select(F.col("name").alias("source_asset"), F.lit(True).alias("_node")))
        rows = rows.join(nodes, "source_asset", "left")
        return rows.withColumn("in_graph", F.col("_node").isNotNull()).drop("_node")

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        span = batch.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if span["first"] is None:
            return
        stored = self._earlier(spark, "events", batch_id)
        # A key counts whatever its timestamp was.
        inserted = sinks.new_rows(batch, stored)
        if self.drift is not None:
            inserted = cut_lineage(inserted)
            self.drift.process_batch(inserted, batch_id)
        fresh = self.fused(inserted, batch_id).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        fresh.write.mode("overwrite").parquet(self.path(f"batches/batch_id={batch_id}"))
        done = spark.read.parquet(self.path(f"batches/batch_id={batch_id}")).withColumn(
            "batch_id", F.lit(batch_id).cast("bigint")
        )
        self._replace(done.drop("verdicts", "matched_rules"), "events", batch_id)
        self._replace(fusion.score_rows(done), "scores", batch_id)
        counters = rollup.batch_counters(done, detectors=(*rollup.CHANNELS, "drift")).first().asDict()
        counters["inserted"] = counters["received"]
        counters |= {"received": span["n"], "deduplicated": span["n"] - counters["inserted"]}
        if self.edges is not None:
            counters |= self._snapshots(spark, done, batch_id, span["first"])
        counters |= self._alerts(spark, done, batch_id, span["first"])
        if self.prevention:
            counters |= self._actions(spark, done, batch_id, span)
        row = spark.range(0, 1, 1, 1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counters.items()])
        self._replace(row, "counters", batch_id)
        if self.retention_every and batch_id and batch_id % self.retention_every == 0:
            self.prune(spark)

    def _earlier(self, spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
        """A stored table without what this batch wrote itself: a replayed batch must see its own output as absent."""
        stored = sinks.existing_table(spark, self.path(table))
        return None if stored is None else stored.filter(F.col("batch_id") != batch_id)

    def prune(self, spark: SparkSession) -> dict[str, int]:
        """Delete what retention gives up from the stored events and their scores; returns rows kept and pruned.

        Partitions of micro-batches without survivors are dropped; those that lose some rows are rewritten beside and
        swapped in, so a failure leaves either form of a partition. Readers see pruned rows no more.
        """
        events = spark.read.parquet(self.path("events"))
        marked = events.withColumn("_pruned", is_victim(events, **self.retention))
        sizes = marked.groupBy("batch_id").agg(F.count_if("_pruned").alias("gone"), F.count_if(~F.col("_pruned")).alias("left"))
        touched = [(r["batch_id"], r["left"]) for r in sizes.filter("gone > 0").collect()]  # one row for each micro-batch
        total = sizes.agg(F.sum("left").alias("kept"), F.sum("gone").alias("pruned")).first().asDict()
        for batch_id, left in touched:
            kept = marked.filter((F.col("batch_id") == batch_id) & ~F.col("_pruned")).select("event_id")
            kept = cut_lineage(kept) if left else kept
            for table in ("scores", "events"):  # events last: they say what is left to do after a failure
                own = f"{self.path(table)}/batch_id={batch_id}"
                if left:
                    beside = self.path(f"rewritten/{table}-{batch_id}")
                    spark.read.parquet(own).join(kept, "event_id", "left_semi").write.mode("overwrite").parquet(beside)
                    sinks.swap_folder(spark, beside, own)
                else:
                    sinks.drop_folder(spark, own)
        return {k: v or 0 for k, v in total.items()}

    def _replace(self, df: DataFrame, table: str, batch_id: int, **counted) -> dict[str, int]:
        """Write a batch's rows as that batch's own partition, so a retry overwrites instead of repeating.

        ``counted`` columns are aggregated inside the write.
        """
        rows, seen = df.drop("batch_id"), Observation()
        if counted:
            rows = rows.observe(seen, *[value.alias(name) for name, value in counted.items()])
        rows.write.mode("overwrite").parquet(f"{self.path(table)}/batch_id={batch_id}")
        return dict(seen.get) if counted else {}

    def _since(self, spark: SparkSession, table: str, batch_id: int, like: DataFrame, first, seconds: float) -> DataFrame | None:
        """Rows of earlier batches that can still cover rows from ``first`` on."""
        earlier = self._earlier(spark, table, batch_id)
        since = moment(like, "ts", first) - F.make_dt_interval(secs=F.lit(seconds))
        return None if earlier is None else earlier.filter(F.col("ts") > since)

    def _debounced(self, candidates: DataFrame, recent: DataFrame | None, gap_sec: float) -> DataFrame:
        """Candidates that neither each other's nor the assets' last stored rows cover."""
        candidates = candidates.withColumn("_stored", F.lit(False))
        if recent is not None:
            last = recent.groupBy("source_asset").agg(F.max_by(F.struct("event_id", "ts"), "ts").alias("_l"))
            last = last.select("source_asset", "_l.event_id", "_l.ts", F.lit(True).alias("_stored"))
            candidates = candidates.unionByName(last, allowMissingColumns=True)
        kept = policy.debounce(candidates, "source_asset", gap_sec=gap_sec)
        return kept.filter(~F.col("_stored")).drop("_stored")

    def _impacts(self, spark: SparkSession, origins: DataFrame, batch_id: int) -> DataFrame:
        """Quantiles of the impact at score 1 and the assets it reaches, for all origins so far; new ones are simulated."""
        stored = self._earlier(spark, "impacts", batch_id)
        fresh = cut_lineage(origins if stored is None else origins.join(stored.select("origin"), "origin", "left_anti"))
        if not fresh.isEmpty():
            scored = fresh.withColumn("score", F.lit(1.0))
            summary, details = cascade.cascade(scored, self.edges, self.assets, iterations=self.iterations)
            order = F.struct((-F.col("compromise_freq")).alias("f"), F.col("node").alias("node"))
            reached = details.groupBy("origin").agg(F.sort_array(F.collect_list(order))["node"].alias("impacted"))
            self._replace(summary.join(reached, "origin", "left"), "impacts", batch_id)
        kinds = "origin string, cii_median double, cii_p5 double, cii_p95 double, impacted array<string>, batch_id int"
        known = sinks.existing_table(spark, self.path("impacts"))
        return spark.createDataFrame([], kinds) if known is None else known

    def _snapshots(self, spark: SparkSession, done: DataFrame, batch_id: int, first) -> dict[str, int]:
        """Impact snapshots of the batch: computed where the asset's last one is too old, else reused."""
        wanted = F.col("is_anomaly") | F.col("tripwire_fired") | (F.col("fused_action") == "alert")
        columns = ["event_id", "ts", "source_asset", "volumetric_score"]
        candidates = cut_lineage(done.filter(F.col("in_graph") & wanted).select(*columns))
        recent = self._since(spark, "snapshots", batch_id, done, first, self.snapshot_reuse_sec)
        fresh = cut_lineage(self._debounced(candidates, recent, self.snapshot_reuse_sec))
        impacts = self._impacts(spark, fresh.select(F.col("source_asset").alias("origin")).distinct(), batch_id)
        scaled = [F.least(F.lit(S.CASCADE_CLAMP), F.col("volumetric_score") * F.col(c)).alias(c) for c in ("cii_median", "cii_p5", "cii_p95")]
        rows = fresh.join(impacts.drop("batch_id"), F.col("source_asset") == F.col("origin")).select(
            "event_id", "ts", "source_asset", *scaled, F.coalesce("impacted", F.array().cast("array<string>")).alias("impacted")
        )
        made = self._replace(rows, "snapshots", batch_id, cii_computed=F.count(F.lit(1)))
        return made | {"cii_reused": candidates.count() - made["cii_computed"]}

    def _in_effect(self, spark: SparkSession, rows: DataFrame, columns) -> DataFrame:
        """Rows with columns of the last snapshot of their asset up to their time."""
        stored = spark.read.parquet(self.path("snapshots")).select("event_id", "ts", "source_asset", "cii_median")
        return in_effect(rows, stored, key="source_asset", ts="ts", tie="event_id", columns=columns)

    def _alerts(self, spark: SparkSession, done: DataFrame, batch_id: int, first) -> dict[str, int]:
        """New alerts, debounced against the asset's last stored alert as well as within the batch."""
        columns = ["event_id", "ts", "source_asset", "alert_kind", "threat_score"]
        candidates = cut_lineage(policy.alert_candidates(done, **self.alert_policy).select(*columns))
        recent = self._since(spark, "alerts", batch_id, done, first, self.debounce_sec)
        kept = self._debounced(candidates, recent, self.debounce_sec)
        if self.edges is not None:
            kept = self._in_effect(spark, kept, [F.col("event_id").alias("snapshot_event_id")]).drop("snapshot_ts")
        hybrid = F.count_if(F.col("alert_kind") == "hybrid")
        made = self._replace(kept, "alerts", batch_id, alerts_created=F.count(F.lit(1)), hybrid_alerts=hybrid)
        return made | {"alerts_suppressed": candidates.count() - made["alerts_created"]}

    def _actions(self, spark: SparkSession, done: DataFrame, batch_id: int, span) -> dict[str, int]:
        """Prevention decisions against the active actions that earlier batches left; a log of what became of both.

        An action ends when the batch's clock, its last event time, has passed its end, even if its asset is silent.
        Decisions that arrive later than the action they meet count from that action's start.
        """
        rows = done if self.edges is None else self._in_effect(spark, done, ["cii_median"]).drop("snapshot_ts")
        rows = rows if "cii_median" in rows.columns else rows.withColumn("cii_median", F.lit(None).cast("double"))
        rows = policy.prevention_decisions(rows, ttl=self.ttl, **self.prevention_policy)
        rows = rows.filter("prevention <> 'observe'").select("source_asset", "ts", "event_id", "prevention", "reason")
        rows = rows.withColumns({"_tie": F.col("event_id"), "_new": F.lit(True)})
        versions = sinks.existing_table(spark, self.path("prevention_state"))
        before = None if versions is None else versions.filter(F.col("version") < batch_id).agg(F.max("version")).first()[0]
        if before is not None:
            active = versions.filter((F.col("version") == before) & F.col("event_id").isNotNull()).drop("version")
            started = active.select("source_asset", F.col("ts").alias("_started"))
            rows = rows.join(started, "source_asset", "left").withColumn("ts", F.greatest("ts", "_started")).drop("_started")
            seeds = active.withColumns({"_tie": F.lit(-(2**62)), "_new": F.lit(False)})
            rows = rows.unionByName(seeds, allowMissingColumns=True)
        fate = cut_lineage(policy.prevention_state(rows, tie="_tie", ttl=self.ttl, clock=span["last"]))
        ended = fate.filter("status in ('superseded', 'expired')").select(
            "source_asset", "event_id", "prevention", F.col("status").alias("outcome"), F.col("ended_at").alias("at")
        )
        log = fate.filter("_new").select(
            "source_asset", "event_id", "prevention", "outcome", F.col("ts").alias("at"), "reason", "expires_at"
        )
        count = {f"actions_{k}": F.count_if(F.col("outcome") == k) for k in ("written", "suppressed", "superseded", "expired")}
        made = self._replace(log.unionByName(ended, allowMissingColumns=True), "actions", batch_id, **count)
        still = fate.filter("status = 'simulated' and prevention <> 'alert'")
        still = still.select("source_asset", "ts", "event_id", "prevention")
        # A row without an action, so that a version in which nothing is active is seen and not the one before it.
        empty = spark.range(0, 1, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in still.schema])
        still.unionByName(empty).write.mode("overwrite").parquet(self.path(f"prevention_state/version={batch_id}"))
        return made


def run_available(stream: DataFrame, spark: SparkSession, name: str, *, mode: str = "append") -> DataFrame:
    """Drain a stream once into Parquet and return what it wrote, with the micro-batch number of each row."""
    out, state = sinks.scratch_path(spark, name), sinks.scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def latest_windows(updates: DataFrame, keys) -> DataFrame:
    """Final value per window of an update-mode stream."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return last.select(*keys, "_v.*")
