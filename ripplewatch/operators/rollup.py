"""Roll-ups an operator console reads. All are map-side combined aggregates; ranks only see aggregated rows."""

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.functions.lookup import ladder, moment
from ripplewatch.functions.net import subnet24
from ripplewatch.functions.partitions import broadcast_if_small

OTHER = "other"
_RANK = {"normal": 0, "warning": 1, "critical": 2}


def detector_stats(scores: DataFrame) -> DataFrame:
    """Rows, fires and mean score per detector."""
    return scores.groupBy("detector").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if("is_anomaly").alias("fired"),
        F.avg("calibrated_score").alias("mean_score"),
    )


def top_sources(df: DataFrame, *, flag: str = "is_anomaly", by: str = "source_asset", n: int = 10) -> DataFrame:
    """The ``n`` sources with the most flagged rows; ties by name."""
    counts = df.filter(F.col(flag)).groupBy(by).agg(F.count(F.lit(1)).alias("anomalies"))
    return counts.orderBy(F.col("anomalies").desc(), by).limit(n)


def score_histogram(df: DataFrame, *, score: str, flag: str = "is_anomaly", bins: int = 20) -> DataFrame:
    """Counts of a [0, 1] score per equal-width bin and flag."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)))
    df = df.filter(F.col(score).isNotNull())
    return df.groupBy(at.cast("int").alias("bin"), F.col(flag).alias("flagged")).agg(F.count(F.lit(1)).alias("n"))


def anomalous_endpoints(df: DataFrame, *, flag: str = "is_anomaly") -> DataFrame:
    """Distinct endpoints of flagged rows."""
    hits = df.filter(F.col(flag))
    return hits.select(F.explode(F.array("source_asset", "destination_asset")).alias("asset")).distinct()


def asset_status(df: DataFrame, assets: DataFrame, *, flag: str = "is_anomaly") -> DataFrame:
    """Every asset with its status: highlighted when it is an endpoint of any flagged row."""
    hit = anomalous_endpoints(df, flag=flag).select(F.col("asset").alias("name"), F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit"), "Threat Highlighted").otherwise("Secure")
    return assets.join(hit, "name", "left").withColumn("status", status).drop("_hit")


def subnet_rollup(df: DataFrame, *, anomaly: str = "is_anomaly", decoy: str = "tripwire_fired") -> DataFrame:
    """Per /24: events, anomalies, tripwires. An event counts once per distinct endpoint subnet."""
    ends = F.array_distinct(F.array_compact(F.array(subnet24(F.col("source_ip")), subnet24(F.col("destination_ip")))))
    rows = df.select(F.explode(ends).alias("subnet"), F.col(anomaly).alias("_a"), F.col(decoy).alias("_t"))
    return rows.groupBy("subnet").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("_a") & ~F.col("_t")).alias("anomalies"),
        F.count_if("_t").alias("tripwires"),
    )


def subnet_links(df: DataFrame) -> DataFrame:
    """Directed /24 pairs with their flow count; pairs inside one subnet are dropped."""
    rows = df.select(
        subnet24(F.col("source_ip")).alias("source"), subnet24(F.col("destination_ip")).alias("target")
    ).filter(F.col("source") != F.col("target"))
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("events"))


def capped_subnets(df: DataFrame, *, cap: int, **flags) -> tuple[DataFrame, DataFrame]:
    """The ``cap`` busiest subnets with everything else summed into ``other``, and the links remapped alike."""
    stats = subnet_rollup(df, **flags)
    top = stats.orderBy(F.col("events").desc(), "subnet").limit(cap).select("subnet", F.lit(True).alias("_top"))
    top = F.broadcast(top)  # ``cap`` rows
    nodes = stats.join(top, "subnet", "left").withColumn("id", F.when(F.col("_top"), F.col("subnet")).otherwise(OTHER))
    nodes = nodes.groupBy("id").agg(
        F.sum("events").alias("events"),
        F.sum("anomalies").alias("anomalies"),
        F.sum("tripwires").alias("tripwires"),
        F.count(F.lit(1)).alias("subnets"),
    )
    links = subnet_links(df)
    for end in ("source", "target"):
        side = top.select(F.col("subnet").alias(end), F.col("_top").alias(f"_{end}"))
        links = links.join(F.broadcast(side), end, "left").withColumn(
            end, F.when(F.col(f"_{end}"), F.col(end)).otherwise(OTHER)
        )
    links = links.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(
        F.sum("events").alias("events")
    )
    return nodes, links


def event_level(*, anomaly: str = "is_anomaly", decoy: str = "tripwire_fired"):
    return ladder((F.col(decoy), F.lit("critical")), (F.col(anomaly), F.lit("warning")), default=F.lit("normal"))


def sector_activity(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Events and worst severity per touched sector; an event counts once per distinct sector."""
    src = sectors.select(F.col("name").alias("source_asset"), F.col("sector").alias("_s"))
    dst = sectors.select(F.col("name").alias("destination_asset"), F.col("sector").alias("_d"))
    rows = df.select("source_asset", "destination_asset", event_level().alias("_level"))
    rows = rows.join(broadcast_if_small(src), "source_asset", "left").join(
        broadcast_if_small(dst), "destination_asset", "left"
    )
    touched = F.explode(F.array_distinct(F.array_compact(F.array("_s", "_d")))).alias("sector")
    rank = ladder(*[(F.col("_level") == k, F.lit(v)) for k, v in _RANK.items()])
    worst = rows.select(touched, rank.alias("_rank")).groupBy("sector").agg(
        F.count(F.lit(1)).alias("events"), F.max("_rank").alias("_worst")
    )
    name = ladder(*[(F.col("_worst") == v, F.lit(k)) for k, v in _RANK.items()])
    return worst.select("sector", "events", name.alias("worst_severity"))


def asset_recency(
    df: DataFrame, known: DataFrame, *, pulse_sec: float, ts: str = "ts", now=None,
    anomaly: str = "is_anomaly", decoy: str = "tripwire_fired",
) -> DataFrame:
    """Severity of each touched curated asset from its last tripwire / anomaly within a pulse window of ``now``."""
    newest = df.agg(F.max(ts)).first()[0] if now is None else now
    t, a = F.col(decoy), F.col(anomaly) & ~F.col(decoy)
    rows = df.select(
        F.explode(F.array("source_asset", "destination_asset")).alias("asset"),
        F.when(t, F.col(ts)).alias("_t"),
        F.when(a, F.col(ts)).alias("_a"),
    )
    last = rows.groupBy("asset").agg(F.max("_t").alias("last_tripwire"), F.max("_a").alias("last_anomaly"))
    last = last.join(broadcast_if_small(known.select(F.col("name").alias("asset"))), "asset", "left_semi")
    since = moment(df, ts, newest) - F.make_dt_interval(secs=F.lit(pulse_sec))
    severity = ladder(
        (F.col("last_tripwire") >= since, F.lit("critical")),
        (F.col("last_anomaly") >= since, F.lit("warning")),
        default=F.lit("normal"),
    )
    return last.withColumn("severity", severity)


def alert_trend(alerts: DataFrame, *, buckets: int = 24, ts: str = "ts") -> DataFrame:
    """Counts by severity class in equal-width time buckets between the first and last alert."""
    span = alerts.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    low, high = span["low"], span["high"]
    if low is None:
        return alerts.select(
            F.lit(0).alias("bucket"), *[F.lit(0).alias(c) for c in ("high", "medium", "low")]
        ).limit(0)
    width = max((high - low) // timedelta(microseconds=1), 1)
    offset = F.timestamp_diff("MICROSECOND", moment(alerts, ts, low), F.col(ts))
    at = F.least(F.lit(buckets - 1), F.floor(offset / F.lit(width) * buckets)).cast("int").alias("bucket")
    s = F.col("severity")
    return alerts.groupBy(at).agg(
        F.count_if(s == "critical").alias("high"),
        F.count_if(s == "warning").alias("medium"),
        F.count_if(~s.isin("critical", "warning")).alias("low"),
    )


def impact_summary(snapshots: DataFrame, sectors: DataFrame, *, key: str, impacted: str = "impacted") -> DataFrame:
    """Impacted assets and distinct sectors per snapshot; ``impacted`` is an array of asset names."""
    names = broadcast_if_small(sectors.select(F.col("name").alias("asset"), "sector"))
    rows = snapshots.select(key, F.explode_outer(impacted).alias("asset")).join(names, "asset", "left")
    return rows.groupBy(key).agg(
        F.count_distinct("asset").alias("impacted_assets"), F.count_distinct("sector").alias("sectors")
    )


def session_tallies(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("tripwire_fired").alias("tripwire_hits"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(F.col("origin") == "injected").alias("injected"),
    )


CHANNELS = ("volumetric", "supervised", "signature", "beaconing")


def batch_counters(df: DataFrame, *, by=(), detectors=CHANNELS) -> DataFrame:
    """Counters of a fused batch: rows, anomalies, tripwires, notable rows and per-detector hits."""
    def hits(name: str):
        return F.count_if(F.array_contains("fired_detectors", name)).alias(f"{name}_hits")

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if("tripwire_fired").alias("tripwires"),
        F.count_if(F.col("fused_action") == "alert").alias("escalated"),
        *[hits(d) for d in detectors],
    )

