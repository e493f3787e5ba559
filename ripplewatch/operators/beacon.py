"""Beaconing: how regular are the gaps between a pair's connections?"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import computed, micros_between
from ripplewatch.functions.partitions import MAX_ROWS_PER_TASK, with_lookback

PAIR = ("source_ip", "destination_ip")


def intervals(flows: DataFrame, *, keys=PAIR, ts="ts", tie="event_id", name="interval_sec") -> DataFrame:
    """Seconds since the pair's previous connection, always positive; null for the first."""
    return _with_intervals(flows, keys, ts, tie, name, 1, MAX_ROWS_PER_TASK).filter(~F.col("_halo")).drop("_halo", "_slice")


def _with_intervals(flows, keys, ts, tie, name, rows, max_rows):
    cut = with_lookback(flows, keys, [ts, tie], rows, max_rows=max_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    return cut.withColumn(name, F.abs(micros_between(F.lag(ts).over(w), F.col(ts))) / 1e6)


def beaconing_verdicts(
    flows: DataFrame,
    *,
    keys=PAIR,
    ts: str = "ts",
    tie: str = "event_id",
    min_samples: int = S.BEACON_MIN_SAMPLES,
    history: int = S.BEACON_HISTORY,
    max_cv: float = S.BEACON_MAX_CV,
    min_interval_sec: float = S.BEACON_MIN_INTERVAL,
    max_interval_sec: float = S.BEACON_MAX_INTERVAL,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Score each flow by the variation of the usable gaps among the pair's last ``history`` connections.

    Abstains (score 0, no raw score) below ``min_samples - 1`` usable gaps. One shuffle by pair; a pair too
    large for one task is cut along time and looks back across the cut.
    """
    if min_samples < 3 or history < min_samples or not 0 < min_interval_sec < max_interval_sec:
        raise ValueError("need min_samples >= 3, history >= min_samples and 0 < min_interval < max_interval")
    rows = _with_intervals(flows, keys, ts, tie, "_gap", history - 1, max_rows)
    usable = F.when(F.col("_gap").between(min_interval_sec, max_interval_sec), F.col("_gap"))
    # ``history`` arrivals including this one hold history - 1 gaps.
    frame = Window.partitionBy(*keys, "_slice").orderBy(ts, tie).rowsBetween(-(history - 2), 0)
    rows = rows.withColumn("_usable", usable).withColumns(
        {
            "usable_intervals": F.count("_usable").over(frame),
            "_mean": F.avg("_usable").over(frame),
            "_dev": F.stddev_samp("_usable").over(frame),
        }
    )
    enough = F.col("usable_intervals") >= min_samples - 1
    cv = F.when(enough & (F.col("_mean") > 0), F.col("_dev") / F.col("_mean"))
    scored = computed(
        rows.filter(~F.col("_halo")), beacon_cv=cv, mean_interval_sec=F.when(enough, F.col("_mean"))
    )
    fired = F.coalesce(F.col("beacon_cv") <= max_cv, F.lit(False))
    depth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("beacon_cv") / max_cv))
    summary = F.when(
        fired,
        F.format_string(
            "Calls %s port %d about every %.2fs; relative spread %.2f in %d gaps.",
            F.col("destination_ip"), F.col("destination_port"), F.col("mean_interval_sec"), F.col("beacon_cv"),
            F.col("usable_intervals"),
        ),
    ) if {"destination_ip", "destination_port"} <= set(flows.columns) else F.lit(None).cast("string")
    return scored.withColumns(
        {
            "beacon_fired": fired,
            # greatest() and least() skip nulls, so abstention is spelled out.
            "beacon_score": F.when(F.col("beacon_cv").isNull(), 0.0).otherwise(depth),
            "beacon_summary": summary,
        }
    ).drop("_gap", "_usable", "_mean", "_dev", "_halo", "_slice")
