"""Volumetric channel: scaler statistics, z-score and median-deviation detectors, explanations.

A fitted model here is a handful of numbers per feature. It comes to the driver once and returns to the plan as
literals, so scoring is a narrow, code-generated projection over the flows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.quantile import exact_medians


@dataclass(frozen=True)
class FeatureStats:
    """Centre and spread of one feature; ``degenerate`` when the training slice never varied."""

    name: str
    centre: float
    spread: float
    degenerate: bool = False


def scaler_table(df: DataFrame, features=S.FEATURES) -> DataFrame:
    """One row per feature: mean, population deviation (1 when there is none), degenerate flag."""
    stats = df.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features],
    )
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("_s")) for f in features])
    return stats.select(F.inline(rows)).select(
        "feature",
        "mean",
        F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")).alias("scale"),
        (F.col("_s") == 0).alias("degenerate"),
    )


def fit_scaler(df: DataFrame, features=S.FEATURES) -> list[FeatureStats]:
    by_name = {r["feature"]: r for r in scaler_table(df, features).collect()}
    return [FeatureStats(f, by_name[f]["mean"], by_name[f]["scale"], by_name[f]["degenerate"]) for f in features]


def fit_mad(df: DataFrame, features=S.FEATURES) -> list[FeatureStats]:
    """Median and median absolute deviation per feature (1 when the deviation is 0)."""
    medians = exact_medians(df, {f: F.col(f) for f in features})
    deviations = exact_medians(df, {f: F.abs(F.col(f).cast("double") - F.lit(m)) for f, m in medians.items()})
    return [FeatureStats(f, m, deviations[f] or 1.0, deviations[f] == 0) for f, m in medians.items()]


def standardised(stats: FeatureStats) -> Column:
    return (F.col(stats.name).cast("double") - F.lit(stats.centre)) / F.lit(stats.spread)


def apply_scaler(df: DataFrame, model: list[FeatureStats]) -> DataFrame:
    """Add ``z_<feature>`` columns."""
    return df.withColumns({f"z_{s.name}": standardised(s) for s in model})


def _widest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _score(df: DataFrame, distance: Column, limit: float) -> DataFrame:
    return df.withColumns({"raw_score": -distance, "score": distance, "fired": distance > limit})


def score_zscore(df: DataFrame, model: list[FeatureStats], *, limit: float = S.ZSCORE_LIMIT) -> DataFrame:
    """Fired when any feature is more than ``limit`` deviations from its mean; lower raw score = more anomalous."""
    return _score(df, _widest([F.abs(standardised(s)) for s in model]), limit)


def score_mad(df: DataFrame, model: list[FeatureStats], *, limit: float = S.MAD_LIMIT) -> DataFrame:
    return _score(df, _widest([F.abs(S.MAD_CONSISTENCY * standardised(s)) for s in model]), limit)


def explain(df: DataFrame, model: list[FeatureStats]) -> DataFrame:
    """Add ``features`` (deviation structs, widest first, degenerate last), ``top_feature`` and ``summary``."""

    def entry(position: int, s: FeatureStats) -> Column:
        value = F.col(s.name).cast("double")
        z = F.lit(None).cast("double") if s.degenerate else standardised(s)
        direction = F.when(value > s.centre, "above").when(value < s.centre, "below").otherwise("at")
        return F.struct(
            # The sort key comes first: degenerate last, then widest, then declared order.
            F.lit(1 if s.degenerate else 0).alias("degenerate_rank"),
            (-F.coalesce(F.abs(z), F.lit(0.0))).alias("order_key"),
            F.lit(position).alias("position"),
            F.lit(s.name).alias("name"),
            value.alias("value"),
            F.lit(s.centre).alias("baseline_mean"),
            F.lit(s.spread).alias("baseline_std"),
            z.alias("z"),
            direction.alias("direction"),
        )

    ranked = F.array_sort(F.array(*[entry(i, s) for i, s in enumerate(model)]))
    out = df.withColumn("_ranked", ranked).withColumn("_top", F.col("_ranked")[0])
    top = F.col("_top")
    summary = F.when(
        top["z"].isNull(),
        F.concat(
            top["name"], F.lit(" "), F.format_number(top["value"], 0), F.lit(" where training only ever saw "),
            F.format_number(top["baseline_mean"], 0),
        ),
    ).otherwise(
        F.concat(top["name"], F.format_string(": %.1f deviations ", F.abs(top["z"])), top["direction"], F.lit(" its mean"))
    )
    features = F.transform("_ranked", lambda e: e.dropFields("degenerate_rank", "order_key", "position"))
    return out.withColumns({"features": features, "top_feature": top["name"], "summary": summary}).drop("_ranked", "_top")


def tripwire(df: DataFrame, *, signal: str | Column = "is_honeytoken_use", score: float = S.TRIPWIRE_SCORE) -> DataFrame:
    """Deterministic decoy-credential flag. A missing column means no touch."""
    if isinstance(signal, str):
        signal = F.col(signal) if signal in df.columns else F.lit(False)
    flag = F.coalesce(signal.cast("boolean"), F.lit(False))
    return df.withColumns({"tripwire_fired": flag, "tripwire_score": F.when(flag, score).otherwise(0.0)})


def two_channel_confidence(
    df: DataFrame,
    *,
    volume: str = "is_anomaly",
    decoy: str = "tripwire_fired",
    both: float = S.CONFIDENCE_BOTH,
    tripwire_only: float = S.CONFIDENCE_TRIPWIRE,
    volume_only: float = S.CONFIDENCE_VOLUME,
) -> DataFrame:
    v, t = F.col(volume), F.col(decoy)
    return df.withColumn(
        "confidence", F.when(v & t, both).when(t, tripwire_only).when(v, volume_only).otherwise(0.0)
    )


def network_risk(df: DataFrame, *, flag: str = "is_anomaly", cii_median: float | None = None) -> DataFrame:
    """Totals, anomaly share and the 0..100 risk figure of one analysis run."""
    rate = F.avg(F.col(flag).cast("int"))
    risk = F.least(F.lit(100), F.floor(300 * rate)) if cii_median is None else F.lit(int(100 * cii_median))
    return df.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.count_if(F.col(flag)).alias("anomalies"),
        (100 * rate).alias("anomaly_percent"),
        risk.cast("bigint").alias("network_risk"),
    )
