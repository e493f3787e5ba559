"""Detector evaluation: splits, guards, point-wise and segment-wise metrics, lead time, benchmark."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import hash_order
from ripplewatch.functions.partitions import cut_lineage, hash_rank, range_slices
from ripplewatch.operators import iforest, sequence, volumetric


@dataclass(frozen=True)
class Detector:
    """``fit(df, features) -> model`` and ``score(df, model) -> df`` adding ``raw_score`` and ``fired``.

    Lower raw scores are more anomalous.
    """

    fit: Callable
    score: Callable


DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


register_detector("zscore", Detector(volumetric.fit_scaler, volumetric.score_zscore))
register_detector("mad", Detector(volumetric.fit_mad, volumetric.score_mad))
register_detector("isolation_forest", Detector(iforest.fit_iforest, iforest.score_iforest))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _with_f1(df: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


def confusion(df: DataFrame, *, truth: str = "truth", pred: str = "pred", by=()) -> DataFrame:
    """Confusion counts, precision, recall and F1 (0 where undefined)."""
    y, p = F.col(truth).cast("boolean"), F.col(pred).cast("boolean")
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp = F.col("tp")
    return _with_f1(
        counts.withColumns({"precision": _ratio(tp, tp + F.col("fp")), "recall": _ratio(tp, tp + F.col("fn"))})
    )


def roc_auc(df: DataFrame, *, score: str, truth: str = "truth") -> DataFrame:
    """Area under the ROC curve by rank sums with tied average ranks; NaN when only one class occurs.

    Rows collapse to distinct scores first. Those are put in order by range partitions, so neither a repeated
    score nor a continuous one ends up in one task.
    """
    y = F.col(truth).cast("boolean")
    per_score = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_p")
    )
    cut = range_slices(per_score, ["_s"])
    sizes = cut.groupBy("_slice").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    run = Window.partitionBy("_slice").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("_upto", F.sum("_n").over(run)).join(F.broadcast(offsets), "_slice")
    rank = F.col("_offset") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    sums = ranked.agg(
        F.sum("_p").alias("positives"),
        F.sum(F.col("_n") - F.col("_p")).alias("negatives"),
        F.sum(rank * F.col("_p")).alias("_ranks"),
    )
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    auc = F.when((p > 0) & (n > 0), (F.col("_ranks") - p * (p + 1) / 2) / (p * n)).otherwise(float("nan"))
    return sums.select("positives", "negatives", auc.alias("auc"))


def segment_metrics(df: DataFrame, order, *, keys=(), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Share of attack segments touched by a prediction, row-wise precision, and their F1."""
    found = sequence.segments(df, order, keys=keys, truth=truth, pred=pred).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("detected").alias("detected")
    )
    rows = confusion(df, truth=truth, pred=pred).select("tp", "fp", "precision")
    # Both sides are single rows.
    both = found.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return _with_f1(both.withColumn("recall", _ratio(F.col("detected"), F.col("segments"))))


def guard_split(df: DataFrame, *, truth: str = "truth", low: float = 0.01, high: float = 0.99) -> float:
    """The positive rate; an error when it is too close to 0 or 1 to evaluate anything."""
    rate = df.agg(F.avg(F.col(truth).cast("boolean").cast("double"))).first()[0]
    if rate is None or not low <= rate <= high:
        raise ValueError(f"degenerate split: positive rate {rate} is outside [{low}, {high}]")
    return rate


def benign_split(
    df: DataFrame, *, fraction: float, key: str = "event_id", truth: str = "truth", seed: int = S.SEED
) -> DataFrame:
    """Add ``part``: a hash-chosen share of the benign rows is ``train``, everything else ``eval``."""
    ranked = hash_rank(df, hash_order(seed, F.col(key)), [truth], "_r", "_of")
    train = ~F.col(truth) & (F.col("_r") <= F.floor(F.col("_of") * fraction))
    return ranked.withColumn("part", F.when(train, "train").otherwise("eval")).drop("_r", "_of")


def lead_times(early: DataFrame, late: DataFrame, *, key: str, ts: str = "ts") -> DataFrame:
    """Seconds by which the first tripwire precedes the first volumetric detection, per attack key."""
    a = early.groupBy(key).agg(F.min(ts).alias("recon_detected_at"))
    b = late.groupBy(key).agg(F.min(ts).alias("exfil_detected_at"))
    lead = F.timestamp_diff("MICROSECOND", F.col("recon_detected_at"), F.col("exfil_detected_at")) / 1e6
    return a.join(b, key).withColumn("lead_time_seconds", lead)


def lead_time_summary(leads: DataFrame) -> DataFrame:
    return leads.agg(
        F.count(F.lit(1)).alias("n_attacks"),
        F.count_if(F.col("lead_time_seconds") > 0).alias("n_tripwire_earlier"),
        F.avg("lead_time_seconds").alias("mean_lead_time_seconds"),
    )


def evaluate(
    df: DataFrame,
    detectors=("zscore", "mad", "isolation_forest"),
    *,
    features=S.FEATURES,
    truth: str = "truth",
    key: str = "event_id",
    order=("ts", "event_id"),
    train_fraction: float = 0.5,
    seed: int = S.SEED,
    scoring: str = "pointwise",
) -> DataFrame:
    """One row of metrics per registered detector, fitted on benign training rows only.

    Features are standardised with training statistics; the evaluation rows keep their time order. Scores are cut to 9
    decimals for the curve, so that equal distances on both sides of a centre tie whatever the order of summing was.
    """
    unknown = [d for d in detectors if d not in DETECTORS]
    if unknown:
        raise ValueError(f"unknown detectors {unknown}; registered: {sorted(DETECTORS)}")
    if scoring not in ("pointwise", "segment"):
        raise ValueError("scoring must be 'pointwise' or 'segment'")
    split = cut_lineage(
        benign_split(
            df.select(*dict.fromkeys([key, *order, truth, *features])), fraction=train_fraction, key=key, truth=truth, seed=seed
        )
    )
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "eval")
    guard_split(test, truth=truth)
    scaler = volumetric.fit_scaler(train, features)
    names = [f"z_{f}" for f in features]
    train, test = volumetric.apply_scaler(train, scaler), volumetric.apply_scaler(test, scaler)
    rows = []
    for name in detectors:
        detector = DETECTORS[name]
        scored = detector.score(test, detector.fit(train, names))
        scored = scored.select(key, *[c for c in order if c != key], truth, F.col("fired").alias("pred"),
                               F.round(-F.col("raw_score"), 9).alias("_anomaly"))
        scored = cut_lineage(scored)  # read by the counts, the segments and the curve
        metrics = (
            confusion(scored, truth=truth)
            if scoring == "pointwise"
            else segment_metrics(scored, list(order), truth=truth)
        ).select("precision", "recall", "f1")
        auc = roc_auc(scored, score="_anomaly", truth=truth)
        one = metrics.withColumn("_one", F.lit(1)).join(auc.withColumn("_one", F.lit(1)), "_one").drop("_one")
        rows.append(one.select(F.lit(name).alias("detector"), F.lit(scoring).alias("scoring"), "precision", "recall",
                               "f1", "auc", (F.col("positives") + F.col("negatives")).alias("eval_rows")))
    return reduce(DataFrame.unionByName, rows)
