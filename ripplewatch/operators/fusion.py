"""Verdict arrays and hybrid fusion: one threat score, band and action per flow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import computed, ladder

ORDER = ("volumetric", "tripwire", "supervised", "signature", "beaconing", "drift")


def verdict(
    detector: str,
    fired: Column,
    score: Column,
    raw: Column | None = None,
    *,
    reliability: float | None = None,
    certainty: Column | None = None,
) -> Column:
    """One detector's opinion as a struct; ``certainty`` defaults to heuristic."""
    trust = S.RELIABILITY[detector] if reliability is None else reliability
    return F.struct(
        F.lit(detector).alias("detector"),
        F.coalesce(fired, F.lit(False)).alias("fired"),
        F.coalesce(score.cast("double"), F.lit(0.0)).alias("calibrated_score"),
        F.lit(float(trust)).alias("reliability"),
        (F.lit("heuristic") if certainty is None else certainty).alias("certainty"),
        (F.lit(None).cast("double") if raw is None else raw.cast("double")).alias("raw_score"),
    )


def tripwire_verdict(fired: Column, *, score: float = S.TRIPWIRE_SCORE) -> Column:
    """The only producer of a confirmed verdict."""
    return verdict(
        "tripwire",
        fired,
        F.when(fired, 1.0).otherwise(0.0),
        F.when(fired, F.lit(score)),
        certainty=F.when(fired, "confirmed").otherwise("heuristic"),
    )


def collect_verdicts(df: DataFrame, *, volumetric=True, supervised=True, signature=True, beaconing=True, drift=True) -> DataFrame:
    """Add ``verdicts`` from whichever channel columns are wanted, in the fixed channel order."""
    parts = []
    if volumetric:
        parts.append(verdict("volumetric", F.col("is_anomaly"), F.col("volumetric_score"), F.col("volumetric_score")))
    parts.append(tripwire_verdict(F.col("tripwire_fired")))
    if supervised:
        p = F.col("supervised_score")
        parts.append(verdict("supervised", p >= 0.5, p, p))
    if signature:
        parts.append(verdict("signature", F.col("signature_fired"), F.col("signature_score"), F.col("signature_raw")))
    if beaconing:
        parts.append(verdict("beaconing", F.col("beacon_fired"), F.col("beacon_score"), F.col("beacon_cv")))
    if drift:
        parts.append(verdict("drift", F.col("drift_fired"), F.col("drift_score"), F.col("drift_decision")))
    return computed(df, verdicts=F.array(*parts))


def check_bands(suspicious: float, likely: float, confirmed: float) -> None:
    if not 0.0 < suspicious < likely < confirmed <= 1.0:
        raise ValueError("bands must satisfy 0 < suspicious < likely < confirmed <= 1")


def fuse(
    df: DataFrame,
    *,
    verdicts: str = "verdicts",
    suspicious: float = S.BAND_SUSPICIOUS,
    likely: float = S.BAND_LIKELY,
    confirmed: float = S.BAND_CONFIRMED,
) -> DataFrame:
    """Add ``threat_score``, ``band``, ``fused_action``, ``fired_detectors``, ``n_fired`` and ``has_confirmed``.

    A fired confirmed verdict decides alone. Otherwise the fired verdicts combine as 1 - prod(1 - score * trust).
    One fold over the array: no shuffle.
    """
    check_bands(suspicious, likely, confirmed)
    start = F.struct(
        F.lit(1.0).alias("survival"), F.lit(False).alias("sure"), F.array().cast("array<string>").alias("names")
    )

    def add(acc: Column, v: Column) -> Column:
        nxt = F.struct(
            (acc["survival"] * (1.0 - v["calibrated_score"] * v["reliability"])).alias("survival"),
            (acc["sure"] | (v["certainty"] == "confirmed")).alias("sure"),
            F.array_append(acc["names"], v["detector"]).alias("names"),
        )
        return F.when(v["fired"], nxt).otherwise(acc)

    out = computed(df, _fused=F.aggregate(verdicts, start, add))
    sure, names = F.col("_fused.sure"), F.col("_fused.names")
    out = computed(
        out,
        has_confirmed=sure,
        threat_score=F.when(sure, 1.0).otherwise(1.0 - F.col("_fused.survival")),
        fired_detectors=names,
        n_fired=F.size(names),
    ).drop("_fused")
    s = F.col("threat_score")
    return computed(
        out,
        band=ladder(
            (F.col("has_confirmed") | (s >= confirmed), F.lit("confirmed")),
            (s >= likely, F.lit("likely")),
            (s >= suspicious, F.lit("suspicious")),
            default=F.lit("benign"),
        ),
        fused_action=F.when(F.col("has_confirmed") | (s >= likely), "alert").otherwise("observe"),
    )


def rationale(df: DataFrame, *, verdicts: str = "verdicts") -> DataFrame:
    """Add the one-line explanation of a fused row; numbers are cut to 9 decimals first, so that ties round alike everywhere."""
    v = F.col(verdicts)
    fired = F.filter(v, lambda x: x["fired"])
    sure = F.transform(F.filter(fired, lambda x: x["certainty"] == "confirmed"), lambda x: x["detector"])
    lead = F.when(sure[0] == "tripwire", "honeytoken credential used (confirmed)").otherwise(
        F.concat(F.get(sure, F.lit(0)), F.lit(" confirmed"))
    )
    many = F.concat(lead, F.lit(" (confirmed via "), F.concat_ws(", ", sure), F.lit(")"))
    parts = F.concat_ws(", ", F.transform(
        fired, lambda x: F.format_string("%s %.2f x%.2f", x["detector"], F.round(x["calibrated_score"], 9), x["reliability"])))
    text = ladder(
        (F.size(v) == 0, F.lit("no detectors reported")),
        (F.size(sure) > 1, many),
        (F.size(sure) == 1, lead),
        (F.size(fired) == 0, F.format_string("%d detector(s) ran, none fired", F.size(v))),
        default=F.concat(parts, F.format_string(" -> %.2f", F.round("threat_score", 9))),
    )
    return df.withColumn("rationale", text)


def score_rows(df: DataFrame, *, event: str = "event_id") -> DataFrame:
    """Long event x detector rows for storage.

    Tripwire rows exist only when fired; every other verdict gives a row; ``hybrid`` carries the fused result.
    The first two channels store the two-channel confidence, the others their calibrated score.
    """
    v = F.col("v")
    hybrid = F.struct(
        F.lit("hybrid").alias("detector"),
        (F.col("band") != "benign").alias("fired"),
        F.col("threat_score").alias("calibrated_score"),
        F.lit(1.0).alias("reliability"),
        F.lit("heuristic").alias("certainty"),
        F.col("threat_score").alias("raw_score"),
    )
    rows = df.select(event, "confidence", F.explode(F.concat("verdicts", F.array(hybrid))).alias("v"))
    rows = rows.filter((v["detector"] != "tripwire") | v["fired"])
    return rows.select(
        event,
        v["detector"].alias("detector"),
        v["raw_score"].alias("raw_score"),
        v["calibrated_score"].alias("calibrated_score"),
        v["fired"].alias("is_anomaly"),
        F.when(v["detector"].isin("volumetric", "tripwire"), F.col("confidence"))
        .otherwise(v["calibrated_score"])
        .alias("confidence"),
    )
