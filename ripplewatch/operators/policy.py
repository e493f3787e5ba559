"""Alert and prevention policy: decisions per row, and the state they leave per asset."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import computed, ladder, moment
from ripplewatch.functions.partitions import cut_lineage
from ripplewatch.operators.chains import MAX_GROUP, accepted_rows, debounce
from ripplewatch.operators.resolve import in_effect

# --- fixed values: alert titles and severities ---
TITLES = {
    "tripwire": "Honeytoken credential used",
    "volumetric": "Anomalous traffic volume",
    "hybrid": "Hybrid detection: correlated signal",
}
LEVELS = {"observe": 0, "alert": 1, "rate_limit": 2, "block": 3, "quarantine": 4}


def alert_candidates(
    df: DataFrame,
    *,
    volumetric_enabled: bool = False,
    score_floor: float = S.ALERT_SCORE_FLOOR,
    hybrid_enabled: bool = False,
) -> DataFrame:
    """Rows that would alert if no earlier alert covered their asset, with ``alert_kind``.

    A tripwire always alerts. A purely volumetric anomaly needs the channel enabled and a score at the floor. A row
    that is no anomaly alerts only through the fused decision, and only with that path enabled.
    """
    anomaly = F.col("is_anomaly") | F.col("tripwire_fired")
    kind = ladder(
        (F.col("tripwire_fired"), F.lit("tripwire")),
        (
            F.col("is_anomaly") & F.lit(volumetric_enabled) & (F.col("volumetric_score") >= score_floor),
            F.lit("volumetric"),
        ),
        (~anomaly & F.lit(hybrid_enabled) & (F.col("fused_action") == "alert"), F.lit("hybrid")),
    )
    return computed(df, alert_kind=kind).filter(F.col("alert_kind").isNotNull())


def alerts(
    df: DataFrame, *, asset: str = "source_asset", debounce_sec: float = S.ALERT_DEBOUNCE_SEC,
    max_group: int = MAX_GROUP, **policy,
) -> DataFrame:
    """Candidates after the per-asset debounce that all alert kinds share."""
    candidates = cut_lineage(alert_candidates(df, **policy))
    return debounce(candidates, asset, gap_sec=debounce_sec, max_group=max_group)


def alert_content(df: DataFrame, *, asset: str = "source_asset") -> DataFrame:
    """Add severity, title, detail and a JSON explanation to alert rows.

    Needs the fused columns and ``rationale``; ``top_feature`` is used when present.
    """
    kind, name = F.col("alert_kind"), F.col(asset)
    driver = F.col("top_feature") if "top_feature" in df.columns else F.lit(None).cast("string")
    detail = ladder(
        (
            kind == "tripwire",
            F.format_string(
                "%s took part in traffic that presented a planted credential. Nobody is ever given that credential, so "
                "its use proves an intrusion.", name,
            ),
        ),
        (
            kind == "volumetric",
            F.concat(
                F.format_string("Traffic volume of %s is unusual: score %.3f", name, F.round("volumetric_score", 9)),
                F.coalesce(F.concat(F.lit(", mostly from "), driver), F.lit("")),
                F.lit(". Learned without labels."),
            ),
        ),
        default=F.format_string(
            "Combined evidence puts %s in band %s at threat score %.3f. Channels: %s. %s", name, F.col("band"),
            F.round("threat_score", 9), F.concat_ws(", ", "fired_detectors"), F.col("rationale"),
        ),
    )
    explanation = F.to_json(
        F.struct("threat_score", "band", F.col("fused_action").alias("action"), "rationale", "verdicts")
    )
    title = ladder(*[(kind == k, F.lit(v)) for k, v in TITLES.items()])
    return df.withColumns(
        {
            "severity": F.when(kind == "tripwire", "critical").otherwise("warning"),
            "title": title,
            "detail": detail,
            "explanation": explanation,
        }
    )


def snapshots(
    df: DataFrame, *, asset: str = "source_asset", reuse_sec: float = S.SNAPSHOT_DEBOUNCE_SEC, max_group: int = MAX_GROUP
) -> DataFrame:
    """Candidate rows that compute a fresh impact snapshot; the others reuse the asset's last one."""
    return debounce(df, asset, gap_sec=reuse_sec, max_group=max_group)


def with_snapshot(
    alert_rows: DataFrame, snapshot_rows: DataFrame, *, asset: str = "source_asset", ts: str = "ts", tie: str = "event_id",
    columns=("event_id",),
) -> DataFrame:
    """Alert rows with the snapshot in effect for their asset at that time."""
    packed = [F.col(c).alias(f"snapshot_{c}") for c in columns]
    return in_effect(alert_rows, snapshot_rows, key=asset, ts=ts, tie=tie, columns=packed)


def check_prevention(rate_limit: float, block: float, low: float, high: float) -> None:
    if not 0.0 < rate_limit <= block <= 1.0:
        raise ValueError("need 0 < rate_limit_score <= block_score <= 1")
    if not 0.0 <= low <= high <= 1.0:
        raise ValueError("need 0 <= block_criticality <= quarantine_criticality <= 1")


def prevention_decisions(
    df: DataFrame,
    *,
    criticality: str = "source_criticality",
    cii: str = "cii_median",
    min_detectors: int = S.MIN_CORROBORATING,
    rate_limit_score: float = S.RATE_LIMIT_SCORE,
    block_score: float = S.BLOCK_SCORE,
    block_criticality: float = S.BLOCK_CRITICALITY,
    quarantine_criticality: float = S.QUARANTINE_CRITICALITY,
    quarantine_cii: float = S.QUARANTINE_CII,
    ttl: tuple[int, int, int] = (S.TTL_RATE_LIMIT, S.TTL_BLOCK, S.TTL_QUARANTINE),
) -> DataFrame:
    """Add ``prevention``, ``ttl_sec``, ``corroborated`` and ``reason`` to fused rows; first matching tier wins.

    Active tiers need a confirmed signal or several fired detectors, whatever the score says.
    """
    check_prevention(rate_limit_score, block_score, block_criticality, quarantine_criticality)
    s, crit, impact = F.col("threat_score"), F.col(criticality), F.col(cii)
    corroborated = F.col("has_confirmed") | (F.col("n_fired") >= min_detectors)
    low = F.col("band").isin("benign", "suspicious")
    quarantine = (s >= block_score) & (crit >= quarantine_criticality) & F.coalesce(impact >= quarantine_cii, F.lit(False))
    block = (s >= block_score) & (crit >= block_criticality)
    action = ladder(
        (low, F.lit("observe")),
        (~F.col("corroborated"), F.lit("alert")),
        (quarantine, F.lit("quarantine")),
        (block, F.lit("block")),
        (s >= rate_limit_score, F.lit("rate_limit")),
        default=F.lit("alert"),
    )
    out = computed(computed(df, corroborated=corroborated), prevention=action)
    a, band = F.col("prevention"), F.col("band")
    reason = ladder(
        (low, F.format_string("nothing to prevent: band %s does not reach the alert level", band)),
        (
            ~F.col("corroborated"),
            F.format_string(
                "alert only: in band %s, but %d channel(s) agree where %d, or one confirmed signal, are asked for", band, F.col("n_fired"), F.lit(min_detectors),
            ),
        ),
        (
            a == "quarantine",
            F.format_string(
                "cut off: confirmed in band %s, target criticality %.2f, median impact of a cascade %.3f", band, crit, impact,
            ),
        ),
        (
            a == "block",
            F.format_string(
                "block: confirmed in band %s at threat score %.3f, target criticality %.2f",
                band, s, crit,
            ),
        ),
        (
            a == "rate_limit",
            F.format_string(
                "slow down: confirmed in band %s by %d channel(s), but score or target stay under what blocking asks for", band, F.col("n_fired"),
            ),
        ),
        default=F.format_string(
            "alert only: confirmed in band %s, but threat score %.3f is under every threshold for acting", band, s
        ),
    )
    seconds = ladder(*[(a == k, F.lit(v)) for k, v in zip(("rate_limit", "block", "quarantine"), ttl)])
    return out.withColumns({"ttl_sec": seconds, "reason": reason})


def _level(action: Column) -> Column:
    return ladder(*[(action == k, F.lit(v)) for k, v in LEVELS.items()])


def prevention_state(
    df: DataFrame,
    *,
    asset: str = "source_asset",
    ts: str = "ts",
    tie: str = "event_id",
    ttl: tuple[int, int, int] = (S.TTL_RATE_LIMIT, S.TTL_BLOCK, S.TTL_QUARANTINE),
    rollbacks: DataFrame | None = None,
    clock=None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Every non-observe decision with its fate: outcome, status, expires_at, ended_at.

    An active action covers its asset until it expires or a stronger one supersedes it; covered decisions are
    suppressed. Alert-kind decisions are written when nothing covers the asset, and never cover anything themselves.
    ``rollbacks`` (action id as ``tie`` column, ``rolled_back_at``) end actions that are still active at that time;
    they change the record, while coverage of other rows follows from the decisions alone. Actions are judged expired
    at ``clock``, or else at the last decision.
    """
    rows = df.filter(F.col("prevention") != "observe")
    # The few rows that decide anything are read by several branches below.
    rows = cut_lineage(computed(rows, _level=_level(F.col("prevention"))))
    seconds = dict(zip((2, 3, 4), ttl))
    active = rows.filter(F.col("_level") >= 2)
    kept = accepted_rows(active, asset, ttl_sec=seconds, level="_level", ts=ts, tie=tie, max_group=max_group)
    life = ladder(*[(F.col("level") == k, F.lit(v)) for k, v in seconds.items()])
    expires = F.col(ts) + F.make_dt_interval(secs=life)
    following = F.lead(ts).over(Window.partitionBy(asset).orderBy(ts, tie))
    now = rows.agg(F.max(ts)).first()[0] if clock is None else clock
    kept = kept.withColumns({"expires_at": expires, "_next": following})
    kept = kept.withColumn(
        "status",
        ladder(
            (F.col("_next") < F.col("expires_at"), F.lit("superseded")),
            (F.col("expires_at") <= moment(rows, ts, now), F.lit("expired")),
            default=F.lit("simulated"),
        ),
    ).withColumn(
        "ended_at",
        F.when(F.col("status") == "superseded", F.col("_next")).when(F.col("status") == "expired", F.col("expires_at")),
    )
    if rollbacks is not None:
        first = rollbacks.groupBy(tie).agg(F.min("rolled_back_at").alias("_rolled"))
        kept = kept.join(first, tie, "left")
        early = (F.col("_rolled") >= F.col(ts)) & (F.col("_rolled") < F.coalesce("ended_at", "expires_at"))
        kept = kept.withColumns(
            {
                "ended_at": F.when(early, F.col("_rolled")).otherwise(F.col("ended_at")),
                "status": F.when(early, "rolled_back").otherwise(F.col("status")),
            }
        ).drop("_rolled")
    done = kept.select(asset, ts, tie, "status", "expires_at", "ended_at")
    strong = active.join(done, [asset, ts, tie], "left").withColumn(
        "outcome", F.when(F.col("status").isNotNull(), "written").otherwise("suppressed")
    )
    # Alert-kind rows: covered when the asset's last written action has not ended by expiry yet.
    cover = kept.select(asset, ts, tie, F.col("expires_at").alias("covered_until"))
    weak = in_effect(
        rows.filter(F.col("_level") == 1), cover, key=asset, ts=ts, tie=tie, columns=["covered_until"], ordered_ties=True
    )
    covered = F.coalesce(F.col("covered_until") > F.col(ts), F.lit(False))
    weak = weak.withColumns(
        {
            "outcome": F.when(covered, "suppressed").otherwise("written"),
            "status": F.when(~covered, "simulated"),
        }
    ).drop("covered_until", "snapshot_ts")
    return strong.unionByName(weak, allowMissingColumns=True).drop("_level")
