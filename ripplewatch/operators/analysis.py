"""One batch analysis run over a set of flows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.partitions import cut_lineage
from ripplewatch.operators import cascade, iforest, rollup, volumetric
from ripplewatch.operators.prepare import default_features
from ripplewatch.operators.resolve import resolve_assets


#: Fixed value: the anomaly score of an asset that is known to be compromised.
COMPROMISED_SCORE = 0.98


@dataclass
class Analysis:
    events: DataFrame
    asset_status: DataFrame
    impact: DataFrame
    impact_details: DataFrame
    summary: DataFrame


def analyse(
    flows: DataFrame,
    assets: DataFrame,
    edges: DataFrame,
    registry: DataFrame,
    *,
    scenario: DataFrame | None = None,
    compromised: str | None = None,
    every_source: bool = False,
    features=S.FEATURES,
    contamination: float = S.FOREST_CONTAMINATION,
    iterations: int = S.CASCADE_ITERATIONS,
    key: str = "event_id",
    ts: str = "ts",
) -> Analysis:
    """Scale, fit and score the forest on the same rows, flag tripwires, mark assets, and cascade.

    A row is anomalous if its volume is or a tripwire fired. ``scenario`` rows are appended first. The blast radius is
    that of ``compromised``, or else of the destination of the first tripwire hit, at a fixed score; with neither there
    is none. ``every_source`` cascades from all anomalous sources with their own scores instead.
    """
    rows = flows if scenario is None else flows.unionByName(scenario, allowMissingColumns=True)
    rows = default_features(rows)
    scaler = volumetric.fit_scaler(rows, features)
    scaled = volumetric.apply_scaler(rows, scaler)
    model = iforest.fit_iforest(scaled, [f"z_{f}" for f in features], key=key, contamination=contamination)
    scored = iforest.score_iforest(scaled, model).withColumns(
        {"is_anomaly": F.col("fired"), "volumetric_score": F.col("score")}
    )
    scored = volumetric.two_channel_confidence(volumetric.tripwire(scored))
    # Read by the status, the risk figures and the cascade; scoring is the expensive part, so it runs once.
    events = cut_lineage(resolve_assets(scored, registry).drop(*[f"z_{f}" for f in features], "fired", "score"))
    events = events.withColumn("is_anomaly", F.col("is_anomaly") | F.col("tripwire_fired"))
    status = rollup.asset_status(events, assets)
    if every_source:
        origins = events.filter("is_anomaly").groupBy(F.col("source_asset").alias("origin")).agg(
            F.max(F.greatest("volumetric_score", "confidence")).alias("score")
        )
    else:
        if compromised is None:
            hit = events.filter("tripwire_fired").agg(F.min_by("destination_asset", F.struct(ts, key)).alias("a")).first()
            compromised = hit["a"]
        origins = flows.sparkSession.createDataFrame(
            [(compromised, COMPROMISED_SCORE)] if compromised else [], "origin string, score double"
        )
    impact, details = cascade.cascade(origins, edges, assets, iterations=iterations)
    impact = cut_lineage(impact)
    worst = impact.agg(F.max("cii_median")).first()[0]
    summary = volumetric.network_risk(events, flag="is_anomaly", cii_median=worst)
    return Analysis(events, status, impact, details, summary)
