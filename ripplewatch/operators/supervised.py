"""Supervised channel: a class-balanced random forest over seven flow features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.partitions import cut_lineage
from ripplewatch.operators import histforest
from ripplewatch.operators.evaluate import confusion, guard_split, roc_auc
from ripplewatch.operators.histforest import SupervisedModel
from ripplewatch.operators.sequence import temporal_split


def fit_supervised(
    df: DataFrame, *, features=S.SUPERVISED_FEATURES, truth: str = "is_attack", trees: int = 100, depth: int = 10,
    seed: int = S.SEED, key: str = "event_id",
) -> SupervisedModel:
    """Fit with row weights n / (2 * class size), so both classes carry the same total weight."""
    return histforest.fit(df, features, truth=truth, key=key, trees=trees, depth=depth, seed=seed)


def score_supervised(df: DataFrame, model: SupervisedModel, *, threshold: float = 0.5) -> DataFrame:
    """Add ``supervised_score`` = P(attack) and ``supervised_fired``."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"model expects features {list(model.features)}; missing {missing}")
    out = histforest.score(df, model, "supervised_score")
    return out.withColumn("supervised_fired", F.col("supervised_score") >= threshold)


def temporal_split_evaluate(
    df: DataFrame,
    *,
    fraction: float = S.SPLIT_FRACTION,
    trees: int = 100,
    depth: int = 10,
    truth: str = "is_attack",
    seed: int = S.SEED,
) -> DataFrame:
    """Train on the first part of time, measure on the rest: one row of metrics."""
    split = temporal_split(df, fraction=fraction)
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
    guard_split(test, truth=truth)
    model = fit_supervised(train, truth=truth, trees=trees, depth=depth, seed=seed)
    # Read once for the counts and more than once for the curve; the forest is applied once.
    scored = cut_lineage(score_supervised(test, model).select(truth, "supervised_score", "supervised_fired"))
    metrics = confusion(scored, truth=truth, pred="supervised_fired").withColumn("_one", F.lit(1))
    auc = roc_auc(scored, score="supervised_score", truth=truth).select("auc", F.lit(1).alias("_one"))
    return metrics.join(auc, "_one").drop("_one")
