"""Flow logs: the two labelled CSV layouts and generic connection tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions import net
from ripplewatch.functions.clock import twelve_hour_timestamp
from ripplewatch.functions.lookup import all_of, hash_order, ladder
from ripplewatch.functions.partitions import broadcast_if_small, hash_rank, lowest_by_hash
from ripplewatch.operators.prepare import finite, flow_direction, label_evidence
from ripplewatch.operators.resolve import resolve_assets

# --- fixed values: column names of the two layouts ---
REQUIRED_79 = ("Destination Port", "Total Fwd Packets", "Total Length of Fwd Packets", "Flow Duration", "Label")
REQUIRED_85 = (
    "Source IP",
    "Source Port",
    "Destination IP",
    "Destination Port",
    "Protocol",
    "Timestamp",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Length of Fwd Packets",
    "Label",
)
OPTIONAL_85 = {
    "Bwd Packet Length Mean": ("bwd_packet_length_mean", "double"),
    "Init_Win_bytes_forward": ("init_win_bytes_forward", "bigint"),
    "Init_Win_bytes_backward": ("init_win_bytes_backward", "bigint"),
    "Average Packet Size": ("average_packet_size", "double"),
}


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_flow_csv_79(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flows without addresses; rows missing a required value are dropped. Keeps ``_file``."""
    raw = trimmed_header(spark.read.csv(path, header=True))
    missing = sorted(set(REQUIRED_79) - set(raw.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    # A literal "NaN" counts as missing, as it does for any numeric reader.
    present = all_of(~F.lower(F.trim(F.col(f"`{c}`"))).isin("nan", "") for c in REQUIRED_79)
    return raw.withColumn("_file", F.input_file_name()).na.drop(subset=list(REQUIRED_79)).filter(present)


def stratified_sample(df: DataFrame, *, positive: Column, limit: int, key, seed: int = S.SEED) -> DataFrame:
    """At most ``limit`` rows: up to half positives, the rest negatives, chosen by a repeatable hash.

    Applied only when there are more than ``limit`` rows. ``key`` identifies a row.
    """
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p")).first()
    n, p = counts["n"], counts["p"]
    if n <= limit:
        return df
    quota = min(p, limit // 2)
    order = hash_order(seed, *[F.col(k) for k in key])
    rows = df.withColumn("_order", order)
    chosen = lowest_by_hash(rows.filter(positive), quota, "_order", p).unionByName(
        lowest_by_hash(rows.filter(~positive), limit - quota, "_order", n - p)
    )
    return chosen.drop("_order")


def per_file_quota(df: DataFrame, *, limit: int, key, file: str = "_file", positive: Column | None = None) -> DataFrame:
    """Share ``limit`` between files: each file that holds attacks gets limit / number of such files.

    Files with 'Monday' in their name are all benign; they take the same quota but do not count in the divisor.
    Within a file up to half the quota goes to positives when ``positive`` is given.
    """
    names = df.select(file).distinct()
    attack_files = names.filter(~F.col(file).contains("Monday")).count()
    quota = limit // max(attack_files, 1)
    order = hash_order(S.SEED, *[F.col(k) for k in key])
    if positive is None:
        return hash_rank(df, order, [file], "_r").filter(F.col("_r") <= quota).drop("_r")
    rows = df.withColumn("_positive", positive)
    totals = rows.groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_positive").alias("_p"))
    ranked = hash_rank(rows, order, [file, "_positive"], "_r").join(broadcast_if_small(totals), file)
    take_p = F.least(F.col("_p"), F.lit(quota // 2))
    keep = (
        (F.col("_n") <= quota)
        | (F.col("_positive") & (F.col("_r") <= take_p))
        | (~F.col("_positive") & (F.col("_r") <= quota - take_p))
    )
    return ranked.filter(keep).drop("_r", "_positive", "_n", "_p")


def flows_79_to_canonical(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical events; endpoints are inferred from the label and the destination port."""

    def number(name: str, default: float) -> Column:
        return F.coalesce(finite(F.trim(F.col(f"`{name}`"))), F.lit(default))

    port = number("Destination Port", 0.0).cast("int")
    rows = label_evidence(raw.withColumn("_label", F.trim("Label")), "_label")
    rows = rows.withColumns(
        {
            "destination_port": port,
            "action": F.when(F.col("attck_evidence").isNull(), "PASS").otherwise("ALERT"),
        }
    )
    service = net.port_service(F.col("destination_port"))
    size = number("Total Length of Fwd Packets", 0.0)
    return flow_direction(rows, registry).select(
        F.lit("2017-07-03 09:00:00").cast("timestamp").alias("timestamp"),
        "source_asset_id",
        "destination_asset_id",
        service.alias("protocol"),
        size.alias("payload_size"),
        "action",
        F.when(F.col("action") == "PASS", "INTERNAL").otherwise("DMZ").alias("zone"),
        service.alias("process_or_service"),
        "attck_evidence",
        F.lit(None).cast("double").alias("raw_anomaly_score"),
        "calibrated_alert_level",
        F.lit("CIC-IDS2017").alias("provenance"),
        F.lit(1.0).alias("confidence"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit("network_flow").alias("signal_type"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        F.lit(3).alias("purdue_level"),
        F.greatest(number("Flow Duration", 0.0) / 1000000, F.lit(0.0)).alias("duration_sec"),
        number("Total Fwd Packets", 1.0).cast("bigint").alias("packets"),
        size.alias("bytes"),
    )


def _lines(spark: SparkSession, path: str) -> list[tuple[DataFrame, list[str]]]:
    """Text lines with file and line order, and the trimmed header they go by: one pair for each distinct header.

    Reading lines keeps ragged rows visible. A file's header is its first line that is not blank; files may order
    their columns differently, and each must hold the required ones.
    """
    # The text source hands over raw bytes; decode them as what they are.
    text = spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
        F.input_file_name().alias("_file"),
        F.monotonically_increasing_id().alias("_line"),
    )
    heads = text.filter(F.length(F.trim("line")) > 0).groupBy("_file").agg(F.min_by("line", "_line").alias("line"))
    layouts: dict[tuple, list[str]] = {}
    for file, line in heads.collect():  # one row for each file
        header = tuple(h.strip() for h in line.lstrip("﻿").split(","))
        missing = sorted(set(REQUIRED_85) - set(header))
        if missing:
            raise ValueError(f"missing required columns in {file}: {missing}")
        layouts.setdefault(header, []).append(file)
    if not layouts:
        raise ValueError(f"no rows in {path}")
    if len(layouts) == 1:
        return [(text, list(header)) for header in layouts]
    files = [(file, n) for n, own in enumerate(layouts.values()) for file in own]
    of_layout = text.join(F.broadcast(spark.createDataFrame(files, "_file string, _layout int")), "_file")
    return [(of_layout.filter(F.col("_layout") == n).drop("_layout"), list(h)) for n, h in enumerate(layouts)]


def _parsed_85(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with the parsed flow, or the first reason it was refused."""
    parsed = [_parsed_lines(text, header) for text, header in _lines(spark, path)]
    return reduce(DataFrame.unionByName, parsed)


def _parsed_lines(text: DataFrame, header: list[str]) -> DataFrame:
    rows = text.withColumn("_f", F.split("line", ",", -1))
    at = {name: F.get(F.col("_f"), F.lit(i)) for i, name in reversed(list(enumerate(header)))}
    is_header = (F.trim(at["Label"]) == "Label") | (F.trim(at["Source IP"]) == "Source IP")

    def text_of(name: str) -> Column:
        return F.trim(at[name])

    def whole(name: str) -> Column:
        return finite(F.trim(at[name])).try_cast("int")

    stamp = twelve_hour_timestamp(at["Timestamp"])
    optional = {
        target: (finite(F.trim(at[name])).try_cast(kind) if name in at else F.lit(0).cast(kind))
        for name, (target, kind) in OPTIONAL_85.items()
    }
    parsed = rows.withColumn("_stamp", stamp).select(
        "_file",
        F.md5(F.col("line").cast("binary")).alias("_content"),
        F.size("_f").alias("_width"),
        is_header.alias("_is_header"),
        F.col("_stamp.ts").alias("ts"),
        text_of("Source IP").alias("source_ip"),
        whole("Source Port").alias("source_port"),
        text_of("Destination IP").alias("destination_ip"),
        whole("Destination Port").alias("destination_port"),
        net.protocol_name(whole("Protocol")).alias("protocol"),
        F.greatest(finite(F.trim(at["Flow Duration"])) / 1000000.0, F.lit(0.0)).alias("duration_sec"),
        finite(F.trim(at["Flow Duration"])).isNotNull().alias("_has_duration"),
        finite(F.trim(at["Total Fwd Packets"])).try_cast("bigint").alias("packets"),
        finite(F.trim(at["Total Length of Fwd Packets"])).try_cast("bigint").alias("bytes"),
        text_of("Label").alias("label"),
        F.col("_stamp.timing_provenance").alias("timing_provenance"),
        *[c.alias(n) for n, c in optional.items()],
    )
    values = ("source_port", "destination_port", "protocol", "packets", "bytes", *optional)
    unparseable = (
        ~all_of(F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("source_ip", "destination_ip", "label"))
        | ~all_of(F.col(c).isNotNull() for c in values)
        | ~F.col("_has_duration")
    )
    reason = ladder(
        (F.col("_width") != len(header), F.lit("ragged")),
        (F.col("_is_header"), F.lit("repeated_header")),
        (F.col("ts").isNull(), F.lit("bad_timestamp")),
        (unparseable, F.lit("unparseable")),
    )
    return parsed.withColumn("skip_reason", reason)


def read_flow_csv_85(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flows with addresses and timestamps, in the FLOW contract; refused rows are left out."""
    good = _parsed_85(spark, path).filter(F.col("skip_reason").isNull())
    name = F.element_at(F.split("_file", "/"), -1)
    # An id from the row's own content is the same however the files are listed or split; equal lines are numbered.
    same = F.row_number().over(Window.partitionBy("_file", "_content").orderBy(F.lit(0)))
    good = good.withColumn("_same", same)
    return good.withColumns(
        {
            "is_attack": F.upper("label") != "BENIGN",
            "source_row_id": F.concat_ws(":", name, "_content", "_same"),
            "is_honeytoken_use": F.lit(False),
            "source_dataset": F.lit("CIC-IDS2017"),
        }
    ).drop("_file", "_content", "_same", "_width", "_is_header", "_has_duration", "skip_reason")


def read_skip_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows seen, emitted and refused by first matching reason (the leading header is not a row)."""
    rows = _parsed_85(spark, path)

    def reason(name: str) -> Column:
        return F.count_if(F.col("skip_reason") == name).alias(name)

    return rows.groupBy(F.element_at(F.split("_file", "/"), -1).alias("file")).agg(
        (F.count(F.lit(1)) - 1).alias("seen"),
        F.count_if(F.col("skip_reason").isNull()).alias("emitted"),
        (F.count_if(F.col("skip_reason") == "repeated_header") - 1).alias("repeated_header"),
        reason("ragged"),
        reason("bad_timestamp"),
        reason("unparseable"),
    )


def edges_to_canonical(
    edges: DataFrame, registry: DataFrame, *, source: str = "source", target: str = "target", keep=()
) -> DataFrame:
    """A generic connection table as canonical events; a ground-truth flag drives the action."""

    def or_default(name: str, kind: str, default) -> Column:
        return F.col(name).cast(kind) if name in edges.columns else F.lit(default).cast(kind)

    truth = F.col("is_ground_truth_anomaly") if "is_ground_truth_anomaly" in edges.columns else F.lit(False)
    payload = or_default("bytes", "double", None) if "bytes" in edges.columns else or_default("packets", "double", 1)
    rows = resolve_assets(edges, registry, source=source, destination=target)
    return rows.select(
        *keep,
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        F.col("source_asset").alias("source_asset_id"),
        F.col("destination_asset").alias("destination_asset_id"),
        F.lit("TCP").alias("protocol"),
        payload.alias("payload_size"),
        F.when(truth, "ALERT").otherwise("PASS").alias("action"),
        F.lit("INTERNAL").alias("zone"),
        F.lit("SyntheticGenerator").alias("process_or_service"),
        F.lit(None).cast("string").alias("attck_evidence"),
        F.lit(None).cast("double").alias("raw_anomaly_score"),
        F.lit(None).cast("string").alias("calibrated_alert_level"),
        F.lit("synthetic").alias("provenance"),
        F.lit(0.5).alias("confidence"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit("network_flow").alias("signal_type"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        F.lit(None).cast("int").alias("purdue_level"),
        or_default("duration_sec", "double", 1.0).alias("duration_sec"),
        or_default("packets", "bigint", 1).alias("packets"),
        or_default("bytes", "double", 500.0).alias("bytes"),
    )


