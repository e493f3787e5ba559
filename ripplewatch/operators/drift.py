"""Structural drift: does a node talk to other peers, to more of them, or in other proportions than before?

Flows are reduced to one row per (bucket, source, destination) first; everything after that follows the number of
distinct edges, not of flows. History is never re-read per batch: peer counts and entropy terms are running sums of
per-bucket changes.
"""

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import epoch_micros, ladder
from ripplewatch.functions.partitions import cut_lineage, largest_group
from ripplewatch.operators.iforest import ForestModel, _grow, _Walker

FEATURES = ("unseen_peer_ratio", "degree_expansion", "neighbor_drift", "traffic_entropy_delta")


def _edges(flows: DataFrame, bucket_sec: int) -> DataFrame:
    us = epoch_micros(F.col("ts"))
    return (
        flows.select(
            F.floor(us / (bucket_sec * 1_000_000)).alias("bucket"),
            F.col("source_ip").alias("node"),
            F.col("destination_ip").alias("peer"),
            us.alias("us"),
            F.col("bytes").cast("double").alias("bytes"),
        )
        .groupBy("bucket", "node", "peer")
        .agg(F.max("us").alias("last_seen"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    )


def _entropy(n_positive: Column, total: Column, total_log: Column) -> Column:
    """Normalised Shannon entropy from the count, the sum w and the sum w*log2(w) of positive weights."""
    raw = (F.log2(total) - total_log / total) / F.log2(n_positive)
    return F.when(n_positive <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def _wlog(w: Column) -> Column:
    return F.when(w > 0, w * F.log2(w)).otherwise(0.0)


def edge_buckets(flows: DataFrame, *, bucket_sec: int = S.DRIFT_WINDOW_SEC) -> DataFrame:
    """Stored (bucket, node, peer) totals: the only pass over the flows that drift needs."""
    return cut_lineage(_edges(flows, bucket_sec))


def live_edges(
    edges: DataFrame, *, bucket_sec: int = S.DRIFT_WINDOW_SEC, gap_sec: int = S.DRIFT_WINDOW_SEC
) -> DataFrame:
    """Edges alive at the end of each non-empty bucket, from ``edge_buckets``, with the totals of their current life.

    An edge lives on while the newest timestamp seen is at most ``gap_sec`` past its last flow. When it comes back
    after having been dropped, it starts a new life from zero. ``seen_before`` marks edges of an earlier bucket.
    """
    gap = gap_sec * 1_000_000
    # One row per non-empty bucket; its size follows the time span, not the data.
    clock = edges.groupBy("bucket").agg(F.max("last_seen").alias("clock"))
    in_time = Window.orderBy("bucket")
    clock = clock.select(
        "bucket",
        "clock",
        F.lag("clock").over(in_time).alias("previous_clock"),
        F.row_number().over(in_time).alias("batch"),
    )
    pair = Window.partitionBy("node", "peer").orderBy("bucket")
    rows = edges.join(clock.select("bucket", "previous_clock"), "bucket").withColumns(
        {
            "_previous": F.lag("last_seen").over(pair),
            "_until": F.lead("bucket").over(pair) - 1,
            "first_bucket": F.min("bucket").over(Window.partitionBy("node", "peer")),
            "history_bytes": F.sum("bytes").over(pair),
        }
    )
    restart = F.coalesce(F.col("previous_clock") - F.col("_previous") > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_life", F.sum(restart).over(pair))
    life = Window.partitionBy("node", "peer", "_life").orderBy("bucket")
    rows = rows.withColumns({"live_bytes": F.sum("bytes").over(life), "live_flows": F.sum("flows").over(life)})
    last = F.floor((F.col("last_seen") + gap) / (bucket_sec * 1_000_000))
    stop = F.greatest(F.col("bucket"), F.least(last, F.coalesce("_until", last)))
    spread = rows.withColumn("at", F.explode(F.sequence("bucket", stop)))
    ends = clock.select(F.col("bucket").alias("at"), "clock", "batch")
    alive = spread.join(ends, "at").filter(F.col("clock") - F.col("last_seen") <= gap)
    return alive.select(
        F.col("at").alias("bucket"),
        "batch",
        "node",
        "peer",
        "live_bytes",
        "live_flows",
        (F.col("first_bucket") < F.col("at")).alias("seen_before"),
    )


def _history_changes(edges: DataFrame) -> DataFrame:
    """Per (node, bucket): how the node's peer history changes once that bucket is merged."""
    pair = Window.partitionBy("node", "peer").orderBy("bucket")
    rows = edges.withColumn("_after", F.sum("bytes").over(pair))
    before = F.col("_after") - F.col("bytes")
    first = F.row_number().over(pair) == 1
    rows = rows.withColumns(
        {
            "_new": first.cast("int"),
            "_positive": ((F.col("_after") > 0) & (F.coalesce(before, F.lit(0.0)) <= 0)).cast("int"),
            "_log": _wlog(F.col("_after")) - _wlog(before),
        }
    )
    return rows.groupBy("node", "bucket").agg(
        F.sum("_new").alias("new_peers"),
        F.sum("_positive").alias("new_positive"),
        F.sum("bytes").alias("new_bytes"),
        F.sum("_log").alias("new_log"),
    )


def drift_features(
    flows: DataFrame, *, bucket_sec: int = S.DRIFT_WINDOW_SEC, gap_sec: int = S.DRIFT_WINDOW_SEC
) -> DataFrame:
    """The four drift features per (bucket, node) with live edges, against strictly earlier history."""
    return features_of_edges(edge_buckets(flows, bucket_sec=bucket_sec), bucket_sec=bucket_sec, gap_sec=gap_sec)


def features_of_edges(
    edges: DataFrame, *, bucket_sec: int = S.DRIFT_WINDOW_SEC, gap_sec: int = S.DRIFT_WINDOW_SEC
) -> DataFrame:
    """``drift_features`` from edge totals."""
    live = live_edges(edges, bucket_sec=bucket_sec, gap_sec=gap_sec)
    first_anywhere = edges.groupBy("peer").agg(F.min("bucket").alias("_first"))
    rows = live.join(first_anywhere, "peer")
    w = F.col("live_bytes")
    now = rows.groupBy("node", "bucket").agg(
        F.max("batch").alias("batch"),
        F.count(F.lit(1)).alias("degree"),
        F.count_if("seen_before").alias("known"),
        F.count_if(F.col("_first") >= F.col("bucket")).alias("globally_new"),
        F.count_if(w > 0).alias("positive"),
        F.sum(F.when(w > 0, w)).alias("weight"),
        F.sum(_wlog(w)).alias("weight_log"),
    )
    changes = _history_changes(edges)
    both = now.unionByName(changes, allowMissingColumns=True).groupBy("node", "bucket").agg(
        *[F.max(c).alias(c) for c in ("batch", "degree", "known", "globally_new", "positive", "weight", "weight_log",
                                      "new_peers", "new_positive", "new_bytes", "new_log")]
    )
    past = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(past), F.lit(0))

    both = both.withColumns(
        {
            "history_peers": before("new_peers"),
            "_h_positive": before("new_positive"),
            "_h_bytes": before("new_bytes"),
            "_h_log": before("new_log"),
        }
    ).filter(F.col("degree").isNotNull())
    return both.select("bucket", *feature_columns())


def feature_columns() -> list[Column]:
    """Batch, node and the four features, from the per-node counts and sums of live edges and history."""
    warm = F.col("history_peers") > 0
    union = F.col("history_peers") + F.col("degree") - F.col("known")
    return [
        F.col("batch"),
        F.col("node"),
        F.col("degree"),
        F.col("history_peers"),
        (F.when(warm, F.col("degree") - F.col("known")).otherwise(F.col("globally_new")) / F.col("degree")).alias(
            "unseen_peer_ratio"
        ),
        (F.col("degree") / (F.col("history_peers") + 1)).alias("degree_expansion"),
        (1.0 - F.col("known") / union).alias("neighbor_drift"),
        F.abs(
            _entropy(F.col("positive"), F.col("weight"), F.col("weight_log"))
            - _entropy(F.col("_h_positive"), F.col("_h_bytes"), F.col("_h_log"))
        ).alias("traffic_entropy_delta"),
    ]


def boundary_calibration(decision: Column, positive: Column, negative: Column, threshold: float) -> Column:
    """Map a decision value to [0, 1] so that 0 lands on ``threshold``, scaled by the training spread per side."""
    inlier = F.when(F.coalesce(positive, F.lit(0.0)) == 0, F.lit(threshold)).otherwise(
        threshold * (1.0 - F.least(decision / positive, F.lit(1.0)))
    )
    outlier = F.when(F.coalesce(negative, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(
        threshold + (1.0 - threshold) * F.least(-decision / negative, F.lit(1.0))
    )
    return F.when(decision >= 0, inlier).otherwise(outlier)


def _fit_small(points: np.ndarray, trees: int, contamination: float, seed: int) -> tuple[ForestModel, float, float]:
    """Fit on one epoch's training buffer (bounded rows) and measure the decision spread on both sides."""
    rng = np.random.default_rng(seed)
    size = min(S.FOREST_SAMPLE, len(points))
    limit = max(1, ceil(log2(max(size, 2))))
    parts = []
    for t in range(trees):
        picked = points[rng.choice(len(points), size, replace=False)]
        frame = pd.DataFrame(_grow(picked, rng, limit), columns=["node", "feature", "cut", "low", "high", "depth"])
        frame.insert(0, "tree", t)
        parts.append(frame)
    model = ForestModel(pd.concat(parts, ignore_index=True), FEATURES, size, 0.0, contamination)
    samples = _Walker(model).score(points)
    offset = float(np.quantile(samples, contamination))
    decision = samples - offset
    up, down = decision[decision > 0], -decision[decision < 0]
    p95 = [float(np.quantile(side, 0.95)) if len(side) else 0.0 for side in (up, down)]
    return ForestModel(model.nodes, FEATURES, size, offset, contamination), p95[0], p95[1]


def score_drift(
    features: DataFrame,
    *,
    threshold: float = S.DRIFT_FIRE,
    baseline_batches: int = S.DRIFT_BASELINE_BATCHES,
    refit_every: int = S.DRIFT_REFIT_BATCHES,
    min_rows: int = S.DRIFT_MIN_ROWS,
    min_degree: int = S.DRIFT_MIN_DEGREE,
    buffer: int = S.DRIFT_TRAINING_ROWS,
    contamination: float = S.DRIFT_CONTAMINATION,
    trees: int = S.FOREST_TREES,
    seed: int = S.SEED,
    max_rows: int = 1_000_000,
) -> DataFrame:
    """Add ``drift_decision``, ``drift_score``, ``drift_fired`` and ``abstained`` to feature rows.

    The baseline is fitted once ``baseline_batches`` batches and ``min_rows`` trainable rows exist, on the newest
    ``buffer`` of them, and refitted every ``refit_every`` batches. Each fit is an epoch; epochs train and score as
    independent groups, a large epoch being split over several tasks that share one fitted model.
    """
    features = cut_lineage(features)  # read several times below, and far smaller than the flows behind it
    trainable = features.filter(F.col("degree") >= min_degree)
    per_batch = features.groupBy("batch").agg(F.count_if(F.col("degree") >= min_degree).alias("_n"))
    run_up = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    bounds = per_batch.withColumn("_sum", F.sum("_n").over(run_up)).agg(
        F.min(F.when(F.col("_sum") >= min_rows, F.col("batch"))).alias("enough"), F.max("batch").alias("last")
    ).first()
    if bounds["enough"] is None:
        return _unfitted(features)
    start, last = max(int(bounds["enough"]), baseline_batches), bounds["last"]
    if last < start:
        return _unfitted(features)
    epochs = int((last - start) // refit_every) + 1

    # Position of every trainable row in (batch, node) order. An epoch trains on the newest ``buffer`` positions up to
    # its own first batch, which is a range of positions; ranges meet rows by equality on blocks of ``buffer``.
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_batch.select("batch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_batch = F.row_number().over(Window.partitionBy("batch").orderBy("node"))
    rows = trainable.withColumn("_in", in_batch).join(offsets, "batch").select(
        "batch", "node", *FEATURES, (F.col("_offset") + F.col("_in")).alias("_at")
    )
    joins = F.greatest(F.lit(0), F.ceil((F.col("batch") - start) / refit_every)).cast("bigint")
    ends = (
        per_batch.withColumn("epoch", joins)
        .groupBy("epoch")
        .agg(F.sum("_n").alias("_n"))
        .join(features.sparkSession.range(epochs).select(F.col("id").alias("epoch")), "epoch", "right")
        .select("epoch", F.sum("_n").over(Window.orderBy("epoch")).alias("_end"))
        .withColumn("_block", F.explode(F.sequence(
            F.floor(F.greatest(F.col("_end") - buffer + 1, F.lit(1)) / buffer), F.floor(F.col("_end") / buffer))))
    )
    training = (
        rows.withColumn("_block", F.floor(F.col("_at") / buffer))
        .join(ends, "_block")
        .filter((F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - buffer))
        .select("epoch", "_at", *[F.col(f).alias(f"train_{f}") for f in FEATURES])
    )
    scored = _fit_and_score(features, training, start, refit_every, min_degree, contamination, trees, seed, max_rows)
    return _judged(scored, start, min_degree, threshold)


def score_batch(
    features: DataFrame,
    training: DataFrame,
    start: int,
    *,
    threshold: float = S.DRIFT_FIRE,
    refit_every: int = S.DRIFT_REFIT_BATCHES,
    min_degree: int = S.DRIFT_MIN_DEGREE,
    contamination: float = S.DRIFT_CONTAMINATION,
    trees: int = S.FOREST_TREES,
    seed: int = S.SEED,
    max_rows: int = 1_000_000,
) -> DataFrame:
    """``score_drift`` of one epoch's batches, given the (bounded) training rows of that epoch and the first fitted batch.

    ``training`` has epoch, ``_at`` (their order) and the features with the prefix ``train_``.
    """
    scored = _fit_and_score(features, training, start, refit_every, min_degree, contamination, trees, seed, max_rows)
    return _judged(scored, start, min_degree, threshold)


def _judged(scored: DataFrame, start: int, min_degree: int, threshold: float) -> DataFrame:
    ready = F.col("batch") >= start
    reason = ladder(
        (~ready, F.lit("baseline_not_fitted")), (F.col("degree") < min_degree, F.lit("insufficient_edges"))
    )
    score = F.when(
        F.col("drift_decision").isNotNull(),
        boundary_calibration(F.col("drift_decision"), F.col("_up"), F.col("_down"), threshold),
    )
    return scored.withColumns(
        {
            "drift_score": F.coalesce(score, F.lit(0.0)),
            "drift_fired": F.coalesce((F.col("drift_decision") < 0) & (score >= threshold), F.lit(False)),
            "abstained": reason,
        }
    ).drop("_up", "_down")


def _fit_and_score(features, training, start, refit_every, min_degree, contamination, trees, seed, max_rows):
    """Per epoch: fit on its (bounded) training rows, score its rows; large epochs are split over tasks."""
    epoch = F.floor((F.col("batch") - start) / refit_every)
    to_score = features.withColumn("epoch", epoch)
    wanted = (F.col("epoch") >= 0) & (F.col("degree") >= min_degree)
    largest = largest_group(to_score.filter(wanted), ["epoch"])
    parts = max(1, ceil(largest / max_rows))
    left = to_score.filter(wanted).withColumn("_part", F.pmod(F.hash("node"), F.lit(parts)))
    right = training.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = "batch int, node string, drift_decision double, _up double, _down double"

    def run(key: tuple, rows: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or train.empty:
            return pd.DataFrame({"batch": [], "node": [], "drift_decision": [], "_up": [], "_down": []})
        points = train.sort_values("_at")[[f"train_{f}" for f in FEATURES]].to_numpy(dtype=float)
        model, up, down = _fit_small(points, trees, contamination, seed)
        decision = _Walker(model).score(rows[list(FEATURES)].to_numpy(dtype=float)) - model.offset
        return pd.DataFrame(
            {"batch": rows["batch"], "node": rows["node"], "drift_decision": decision, "_up": up, "_down": down}
        )

    decisions = left.groupBy("epoch", "_part").cogroup(right.groupBy("epoch", "_part")).applyInPandas(run, schema)
    return features.join(decisions, ["batch", "node"], "left")


def _unfitted(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "drift_decision": F.lit(None).cast("double"),
            "drift_score": F.lit(0.0),
            "drift_fired": F.lit(False),
            "abstained": F.lit("baseline_not_fitted"),
        }
    )


def drift_verdicts(
    flows: DataFrame, scored: DataFrame, *, bucket_sec: int = S.DRIFT_WINDOW_SEC
) -> DataFrame:
    """Give every flow its source node's verdict of that bucket; nodes are scored once, then joined.

    AQE splits the join for a node that sends a large share of all flows.
    """
    bucket = F.floor(epoch_micros(F.col("ts")) / (bucket_sec * 1_000_000))
    nodes = scored.select(
        "bucket", F.col("node").alias("source_ip"), "degree", "history_peers", *FEATURES,
        "drift_decision", "drift_score", "drift_fired", "abstained",
    )
    out = flows.withColumn("bucket", bucket).join(nodes, ["bucket", "source_ip"], "left")
    return out.withColumns(
        {
            "drift_score": F.coalesce("drift_score", F.lit(0.0)),
            "drift_fired": F.coalesce("drift_fired", F.lit(False)),
            "abstained": F.coalesce(
                "abstained", F.when(F.col("degree").isNull(), "insufficient_edges")
            ),
        }
    )


def drift_summary() -> Column:
    """One sentence on a fired flow: what changed, never more than was measured."""
    novel = F.round(F.col("unseen_peer_ratio") * F.col("degree")).cast("bigint")
    host = F.col("source_ip")
    text = ladder(
        (
            F.col("history_peers") == 0,
            F.format_string(
                # Fixed value: the opening words.
                "Cold-start host %s has no past of its own; %d of its peers were never contacted by any host before.",
                host, novel,
            ),
        ),
        (
            novel > 0,
            F.format_string(
                "%s reached %d peer(s) for the first time, %.0f%% of those in this window, at %.1f times its usual number.", host, novel, 100 * F.col("unseen_peer_ratio"), F.col("degree_expansion"),
            ),
        ),
        default=F.format_string(
            "%s kept to known peers but not to its habits: %.1f times its usual number of them, set distance %.2f.", host, F.col("degree_expansion"), F.col("neighbor_drift"),
        ),
    )
    return F.when(F.col("drift_fired"), text)
