"""Fitted scorers as one folder: scaler, forest, supervised forest and warm-up facts under one manifest.

The manifest is written last and names a fingerprint of the features and their types. Loading never fits anything: it
refuses a folder that is incomplete, of another layout or day, or fitted on other features or types than the rows to score.
"""

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.operators import histforest
from ripplewatch.operators.histforest import SupervisedModel
from ripplewatch.operators.iforest import ForestModel, fit_warmup, load_model, save_model, score_iforest
from ripplewatch.operators.supervised import fit_supervised, score_supervised
from ripplewatch.operators.volumetric import FeatureStats, apply_scaler

LAYOUT = 2
_MANIFEST = "layout int, fingerprint string, day string, supervised boolean, written_with string"
_SCALER = "position int, name string, centre double, spread double, degenerate boolean"
_WARMUP = "rows bigint, attacks bigint, first_ts timestamp_ntz, last_ts timestamp_ntz"


class BundleRefused(ValueError):
    """The stored models do not fit what is asked of them."""


@dataclass(frozen=True)
class Bundle:
    """Models that were fitted together; ``supervised`` is missing where no labels were at hand."""

    scaler: list[FeatureStats]
    forest: ForestModel
    warmup: dict
    supervised: SupervisedModel | None = None

    @property
    def features(self) -> list[str]:
        own = self.supervised.features if self.supervised else []
        return [s.name for s in self.scaler] + list(own)


def fingerprint(df: DataFrame, features) -> str:
    """A digest of the features' names and types, in order; a feature that ``df`` lacks is refused."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise BundleRefused(f"rows lack the features {missing}")
    lines = [f"{f}:{df.schema[f].dataType.simpleString()}" for f in features]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def fit_bundle(benign: DataFrame, labelled: DataFrame | None = None, *, trees: int = S.FOREST_TREES, **warmup) -> Bundle:
    """Fit scaler and forest on a benign slice and, where given, the supervised model on labelled rows."""
    forest, scaler, facts = fit_warmup(benign, trees=trees, **warmup)
    return Bundle(scaler, forest, facts, fit_supervised(labelled, trees=trees) if labelled is not None else None)


def save_bundle(bundle: Bundle, path: str, like: DataFrame, *, day: str = "") -> None:
    """Write the bundle; ``like`` has the rows' types. A manifest that was there before goes first."""
    from ripplewatch.sources.sinks import drop_folder

    spark = like.sparkSession
    drop_folder(spark, f"{path}/manifest")
    scaler = [(k, s.name, float(s.centre), float(s.spread), bool(s.degenerate)) for k, s in enumerate(bundle.scaler)]
    spark.createDataFrame(scaler, _SCALER).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    facts = [tuple(bundle.warmup[k] for k in ("rows", "attacks", "first_ts", "last_ts"))]
    spark.createDataFrame(facts, _WARMUP).write.mode("overwrite").parquet(f"{path}/warmup")
    save_model(spark, bundle.forest, f"{path}/forest", day=day)
    if bundle.supervised:
        histforest.save_model(spark, bundle.supervised, f"{path}/supervised")
    manifest = [(LAYOUT, fingerprint(like, bundle.features), day, bundle.supervised is not None, spark.version)]
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, like: DataFrame, *, day: str | None = None) -> Bundle:
    """The stored bundle, if it is whole and was fitted on the features and types that ``like`` has, on that ``day``."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest").first()
    except AnalysisException as e:
        raise BundleRefused(f"no whole bundle at {path}") from e
    if manifest["layout"] != LAYOUT:
        raise BundleRefused(f"bundle layout {manifest['layout']}, expected {LAYOUT}")
    if day is not None and manifest["day"] != day:
        raise BundleRefused(f"bundle of day {manifest['day']!r}, expected {day!r}")
    stats = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()  # a row for each feature
    scaler = [FeatureStats(r["name"], r["centre"], r["spread"], r["degenerate"]) for r in stats]
    forest = load_model(spark, f"{path}/forest")
    if list(forest.features) != [f"z_{s.name}" for s in scaler]:
        raise BundleRefused(f"forest of {list(forest.features)} beside a scaler of {[s.name for s in scaler]}")
    supervised = histforest.load_model(spark, f"{path}/supervised") if manifest["supervised"] else None
    warmup = spark.read.parquet(f"{path}/warmup").first().asDict()
    bundle = Bundle(scaler, forest, warmup, supervised)
    if fingerprint(like, bundle.features) != manifest["fingerprint"]:
        raise BundleRefused(f"rows do not have the types that the features {bundle.features} were fitted on")
    return bundle


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Add z-scores, the forest's ``raw_score``, ``score`` and ``fired`` and, if there is one, the supervised score.

    Nothing is fitted; the plan stays narrow.
    """
    out = score_iforest(apply_scaler(df, bundle.scaler), bundle.forest)
    return score_supervised(out, bundle.supervised) if bundle.supervised else out.withColumn("supervised_fired", F.lit(None).cast("boolean"))
