"""Structural drift over a stream: one micro-batch is one batch of the detector.

The state is a table with one row per (node, peer) pair ever seen: its history and, while the edge is alive, the totals
of its current life. Each micro-batch joins its own pair totals with that table and writes the next version, so a
retried batch rewrites the same version and the cost follows the number of pairs, not of flows. Versions before the
last are dropped.

Verdicts come from the baseline of the current epoch. What is kept of a baseline is its training buffer, a bounded table
written when the epoch begins: the fit is a function of it, so every later batch has the same model, lost tasks included.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import epoch_micros
from ripplewatch.functions.partitions import cut_lineage
from ripplewatch.operators.drift import FEATURES, _unfitted, _wlog, feature_columns, score_batch
from ripplewatch.sources.sinks import drop_folder, existing_table

_STATE = "node string, peer string, history_bytes double, live_bytes double, live_flows bigint, last_seen bigint"


@dataclass
class DriftState:
    """Pass ``process_batch`` to foreachBatch; feature rows accumulate under ``root`` by micro-batch."""

    root: str
    gap_sec: int = S.DRIFT_WINDOW_SEC
    baseline_batches: int = S.DRIFT_BASELINE_BATCHES
    refit_every: int = S.DRIFT_REFIT_BATCHES
    min_rows: int = S.DRIFT_MIN_ROWS
    min_degree: int = S.DRIFT_MIN_DEGREE
    buffer: int = S.DRIFT_TRAINING_ROWS
    scoring: dict = field(default_factory=dict)

    def _version(self, batch_id: int) -> str:
        return f"{self.root}/pairs/version={batch_id}"

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/features").drop("batch_id")

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = existing_table(spark, self._version(batch_id - 1)) if batch_id else None
        if batch_id and stored is None:
            raise RuntimeError(f"the pair table of batch {batch_id - 1} is missing; learning cannot go on without it")
        state = spark.createDataFrame([], _STATE) if stored is None else stored
        # Stored, as the clock and the next version both read it and the batch behind it is far larger.
        new = cut_lineage(
            batch.select(
                F.col("source_ip").alias("node"), F.col("destination_ip").alias("peer"),
                epoch_micros(F.col("ts")).alias("us"), F.col("bytes").cast("double").alias("b"),
            )
            .groupBy("node", "peer")
            .agg(F.sum("b").alias("new_bytes"), F.count(F.lit(1)).alias("new_flows"), F.max("us").alias("new_seen"))
        )
        both = state.join(new, ["node", "peer"], "full_outer").withColumn(
            "_seen", F.coalesce("new_seen", "last_seen")
        )
        clock = F.lit(both.agg(F.max("_seen")).first()[0] or 0)
        alive = F.coalesce(clock - F.col("_seen") <= self.gap_sec * 1_000_000, F.lit(False))
        zero = F.lit(0.0)
        both = both.withColumns(
            {
                "_alive": alive,
                "_bytes": F.coalesce("live_bytes", zero) + F.coalesce("new_bytes", zero),
                "_flows": F.coalesce("live_flows", F.lit(0)) + F.coalesce("new_flows", F.lit(0)),
            }
        )
        total = F.coalesce("history_bytes", zero) + F.coalesce("new_bytes", zero)
        both.select(
            "node",
            "peer",
            total.alias("history_bytes"),
            F.when(F.col("_alive"), F.col("_bytes")).alias("live_bytes"),
            F.when(F.col("_alive"), F.col("_flows")).alias("live_flows"),
            F.when(F.col("_alive"), F.col("_seen")).alias("last_seen"),
            F.col("history_bytes").alias("_before"),
        ).write.mode("overwrite").parquet(self._version(batch_id))
        self._write_features(spark.read.parquet(self._version(batch_id)), batch_id)
        if batch_id > 1:
            drop_folder(spark, self._version(batch_id - 2))

    def _baseline(self, spark: SparkSession, batch_id: int) -> tuple[int, DataFrame] | None:
        """(first fitted batch, training rows of the current epoch); the batch that begins an epoch writes them."""
        now, trained = batch_id + 1, existing_table(spark, f"{self.root}/training")
        rows = spark.read.parquet(f"{self.root}/features").filter((F.col("batch") <= now) & (F.col("degree") >= self.min_degree))
        first = None
        if trained is not None:
            first = trained.filter(F.col("epoch") == 0).agg(F.min("start")).first()[0]
        if first is None or first >= now:  # not fitted yet, or by this batch before it was delivered again
            if now < self.baseline_batches or rows.count() < self.min_rows:
                return None
            first = now
        epoch = (now - first) // self.refit_every
        path = f"{self.root}/training/epoch={epoch}"
        if (now - first) % self.refit_every == 0:
            newest = rows.orderBy(F.col("batch").desc(), F.col("node").desc()).limit(self.buffer)
            columns = [F.col(f).alias(f"train_{f}") for f in FEATURES]
            place = F.row_number().over(Window.orderBy("batch", "node"))  # of at most ``buffer`` rows
            newest.select(place.alias("_at"), F.lit(first).alias("start"), *columns).write.mode("overwrite").parquet(path)
        return first, spark.read.parquet(path).withColumn("epoch", F.lit(epoch).cast("bigint"))

    def verdicts(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The batch's feature rows with decision, score, fired flag and, where there is no verdict, the reason."""
        features = spark.read.parquet(f"{self.root}/features/batch_id={batch_id}")
        baseline = self._baseline(spark, batch_id)
        if baseline is None:
            return _unfitted(features)
        options = {"refit_every": self.refit_every, "min_degree": self.min_degree} | self.scoring
        return score_batch(features, baseline[1], baseline[0], **options)

    def with_verdicts(self, flows: DataFrame, batch_id: int) -> DataFrame:
        """Flows of a processed batch with their source node's verdict; AQE splits the join for a busy node."""
        columns = ["degree", "history_peers", *FEATURES, "drift_decision", "drift_score", "drift_fired", "abstained"]
        nodes = self.verdicts(flows.sparkSession, batch_id).select(F.col("node").alias("source_ip"), *columns)
        out = flows.join(nodes, "source_ip", "left")
        return out.withColumns(
            {
                "drift_score": F.coalesce("drift_score", F.lit(0.0)),
                "drift_fired": F.coalesce("drift_fired", F.lit(False)),
                "abstained": F.coalesce("abstained", F.when(F.col("degree").isNull(), "insufficient_edges")),
            }
        )

    def _write_features(self, pairs: DataFrame, batch_id: int) -> None:
        known_anywhere = pairs.filter(F.col("_before").isNotNull()).select("peer").distinct().withColumn("_old", F.lit(True))
        live = pairs.filter(F.col("last_seen").isNotNull()).join(known_anywhere, "peer", "left")
        w, h = F.col("live_bytes"), F.col("_before")
        now = live.groupBy("node").agg(
            F.count(F.lit(1)).alias("degree"),
            F.count_if(h.isNotNull()).alias("known"),
            F.count_if(F.col("_old").isNull()).alias("globally_new"),
            F.count_if(w > 0).alias("positive"),
            F.sum(F.when(w > 0, w)).alias("weight"),
            F.sum(_wlog(w)).alias("weight_log"),
        )
        past = pairs.filter(h.isNotNull()).groupBy("node").agg(
            F.count(F.lit(1)).alias("history_peers"),
            F.count_if(h > 0).alias("_h_positive"),
            F.sum(h).alias("_h_bytes"),
            F.sum(_wlog(h)).alias("_h_log"),
        )
        rows = now.join(past, "node", "left").fillna(0, ["history_peers", "_h_positive", "_h_bytes", "_h_log"])
        rows = rows.withColumn("batch", F.lit(batch_id + 1)).select(*feature_columns())
        rows.write.mode("overwrite").parquet(f"{self.root}/features/batch_id={batch_id}")
