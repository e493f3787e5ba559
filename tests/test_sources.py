from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch.functions.clock import sensor_timestamp, twelve_hour_timestamp
from ripplewatch.operators import prepare, sequence
from ripplewatch.schema import CANONICAL_COLUMNS
from ripplewatch.sources import sinks
from ripplewatch.sources.datasets import load_dataset
from ripplewatch.sources.flows import read_flow_csv_85, read_skip_stats
from ripplewatch.sources.sensors import sensor_features

HEAD = (
    "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, "
    "Total Fwd Packets, Total Length of Fwd Packets, Average Packet Size, Label"
)


def row(stamp="3/7/2017 8:55:58", src="1.2.3.4", port="80", duration="1500000", size="120", avg="12.5", label="BENIGN"):
    return f"id,{src},4000,10.0.1.10,{port},6,{stamp},{duration},3,{size},{avg},{label}"


@pytest.mark.parametrize("hour,expected", [(h, h + 12 if h <= 7 else h) for h in range(1, 13)])
def test_hours_without_am_pm(spark, hour, expected):
    df = spark.createDataFrame([(f"3/7/2017 {hour}:05",)], "t string").select(twelve_hour_timestamp(F.col("t")).alias("s"))
    r = df.first()["s"]
    assert r["ts"] == datetime(2017, 7, 3, expected, 5) and r["timing_provenance"] == "interpolated_minute_bucket"


@pytest.mark.parametrize(
    "text", ["", "3/7/2017", "3/7/2017 0:10", "3/7/2017 13:10", "32/7/2017 9:10", "3/7/2017 9", "a/b/c 9:10", "3/7/2017 9:10:99", "3/7/2017 9:10 AM"]
)
def test_bad_timestamps(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(twelve_hour_timestamp(F.col("t")).alias("s"))
    assert df.first()["s"]["ts"] is None


def test_seconds_set_the_provenance(spark):
    df = spark.createDataFrame([("3/7/2017 8:55:58",)], "t string").select(twelve_hour_timestamp(F.col("t")).alias("s"))
    assert tuple(df.first()["s"]) == (datetime(2017, 7, 3, 8, 55, 58), "capture_seconds")


def test_flow_csv_keeps_good_rows_and_counts_the_rest(spark, tmp_path):
    lines = [
        HEAD,
        row(label="DoS \x96 Hulk"),
        row(stamp="3/7/2017 2:05"),
        row() + ",extra",
        "",
        HEAD,
        row(stamp="nonsense"),
        row(duration="NaN"),
        row(size="Infinity"),
        row(port="x"),
        row(avg="NaN"),
        row(src=" "),
        row(duration="-5"),
    ]
    path = tmp_path / "day.csv"
    path.write_bytes("\n".join(lines).encode("latin-1"))
    good = {r["timing_provenance"] + r["label"]: r for r in read_flow_csv_85(spark, str(path)).collect()}
    assert len(good) == 3
    hulk = good["capture_secondsDoS \x96 Hulk"]
    assert hulk["is_attack"] and hulk["protocol"] == "TCP" and hulk["duration_sec"] == 1.5 and hulk["bytes"] == 120
    assert hulk["average_packet_size"] == 12.5 and hulk["init_win_bytes_forward"] == 0
    assert hulk["source_row_id"].startswith("day.csv:")
    assert good["capture_secondsBENIGN"]["duration_sec"] == 0.0  # clipped
    assert good["interpolated_minute_bucketBENIGN"]["ts"] == datetime(2017, 7, 3, 14, 5)
    s = read_skip_stats(spark, str(path)).first()
    assert (s["seen"], s["emitted"], s["repeated_header"], s["ragged"], s["bad_timestamp"], s["unparseable"]) == (12, 3, 1, 2, 1, 5)


def test_each_file_has_its_own_header_and_rows_keep_their_ids(spark, tmp_path):
    swapped = [h.strip() for h in HEAD.split(",")]
    a, b = swapped.index("Source Port"), swapped.index("Destination Port")
    swapped[a], swapped[b] = swapped[b], swapped[a]
    many = [row(src=f"1.2.3.{k % 40}", port=str(1000 + k)) for k in range(300)] + [row(), row()]
    folder = tmp_path / "days"
    folder.mkdir()
    (folder / "b.csv").write_text("\n".join([HEAD, *many]))
    before = {r["source_row_id"]: (r["source_ip"], r["destination_port"]) for r in read_flow_csv_85(spark, str(folder)).collect()}
    assert len(before) == len(many)
    (folder / "a.csv").write_text("\n".join([",".join(swapped), row(port="77")]))
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    after = {r["source_row_id"]: (r["source_ip"], r["destination_port"]) for r in read_flow_csv_85(small, str(folder)).collect()}
    assert {k: v for k, v in after.items() if k in before} == before and len(after) == len(before) + 1
    new = read_flow_csv_85(spark, str(folder)).filter("source_row_id like 'a.csv%'").first()
    assert (new["source_port"], new["destination_port"]) == (77, 4000)


def test_flow_csv_without_addresses_is_refused(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Destination Port,Label\n80,BENIGN\n")
    with pytest.raises(ValueError, match="missing required columns"):
        read_flow_csv_85(spark, str(path))


def test_labelled_flows_without_addresses(spark, tmp_path):
    (tmp_path / "Tuesday.csv").write_text(
        " Destination Port, Total Fwd Packets,Total Length of Fwd Packets, Flow Duration, Label\n"
        "22,3,100,2000000,SSH-Patator\n80,1,50,-4,BENIGN\n9999,,50,10,BENIGN\n3389,2,70,10,Web Attack x XSS\n"
    )
    df = load_dataset(spark, " CIC_IDS2017 ", str(tmp_path))
    got = sorted((r["protocol"], r["source_asset_id"], r["destination_asset_id"], r["action"], r["attck_evidence"], r["duration_sec"]) for r in df.collect())
    assert got == [
        ("HTTP", "Citizen_Portal", "Citizen_Portal", "PASS", None, 0.0),
        ("RDP", "External_185.220.101.5", "Traffic_Controller", "ALERT", "WebAttack_XSS", 1e-05),
        ("SSH", "External_185.220.101.5", "SCADA_Historian", "ALERT", "BruteForce_SSH", 2.0),
    ]
    assert df.columns[: len(CANONICAL_COLUMNS)] == CANONICAL_COLUMNS


def test_quota_shares_files_and_keeps_attacks(spark, tmp_path):
    head = "Destination Port,Total Fwd Packets,Total Length of Fwd Packets,Flow Duration,Label\n"
    for name, attacks in (("Monday", 0), ("Tuesday", 5), ("Friday", 60)):
        body = "".join(f"80,1,{i},10,{'Bot' if i < attacks else 'BENIGN'}\n" for i in range(100))
        (tmp_path / f"{name}.csv").write_text(head + body)
    got = load_dataset(spark, "cic_ids2017", str(tmp_path), limit=40).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in got} == {"ALERT": 5 + 10, "PASS": 20 + 15 + 10}


def test_payments(spark, tmp_path):
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
    (tmp_path / "p.csv").write_text(
        head + "1,TRANSFER,10.5,C1,0,0,C2,0,0,1,0\n25,payment,-3,C3,0,0,M4,0,0,0,0\n2,ODD,1,zzz,0,0,M4,0,0,0,0\n"
    )
    df = load_dataset(spark, "paysim", str(tmp_path))
    got = {r["attck_evidence"] or r["process_or_service"]: r for r in df.collect()}
    assert got["TRANSFER_FRAUD"]["action"] == "ALERT" and got["TRANSFER_FRAUD"]["zone"] == "FINANCIAL_EXTERNAL"
    assert got["PaymentService"]["payload_size"] == 0.0 and got["PaymentService"]["timestamp"] == datetime(2021, 1, 2, 1)
    assert got["UnknownService"]["source_asset_id"] == "Unresolved_zzz" and got["UnknownService"]["confidence"] == pytest.approx(0.575)
    assert load_dataset(spark, "paysim", str(tmp_path), fraud_only=True).count() == 1


def test_sensors(spark, tmp_path):
    (tmp_path / "merged.csv").write_text(
        " Timestamp, FIT101, MV101 ,Normal/Attack\n 28/12/2015 10:00:00 AM,2.5,1,Normal\n28/12/2015 1:00:01 PM,2.6,2, Attack \nbroken,x,2,Normal\n"
    )
    df = load_dataset(spark, "swat", str(tmp_path / "merged.csv"))
    got = sorted(df.select("timestamp", "action", "FIT101").collect(), key=repr)
    assert [(r[0], r[1], r[2]) for r in got if r[0]] == [
        (datetime(2015, 12, 28, 10), "PASS", 2.5), (datetime(2015, 12, 28, 13, 0, 1), "ALERT", 2.6)
    ]
    assert [r[2] for r in got if r[0] is None] == [None]
    assert sensor_features(df) == ["FIT101", "MV101"]
    assert spark.createDataFrame([("2015-12-28 10:00:00",)], "t string").select(sensor_timestamp(F.col("t"))).first()[0]


def test_unknown_dataset_and_missing_columns(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        load_dataset(spark, "nope", "/nowhere")
    with pytest.raises(ValueError, match="missing required columns"):
        prepare.require_columns(spark.range(1))


def test_decoy_use(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(
        [(datetime(2024, 1, 1), "scada_admin_remote_v2"), (datetime(2024, 1, 2), "someone")], "ts timestamp, username string"
    ).write.parquet(path)
    r = load_dataset(spark, "deception", path).collect()
    assert len(r) == 1 and r[0]["attck_evidence"] == "T1078_Valid_Accounts::HT-L1-SCADA" and r[0]["purdue_level"] == 1
    assert (r[0]["observed_at"] - r[0]["timestamp"]).total_seconds() == 1 and r[0]["packets"] == 0
    with pytest.raises(KeyError):
        load_dataset(spark, "deception", path, zone="Gateway_L9")


def test_writes_are_idempotent(spark, small_flows, tmp_path):
    path = str(tmp_path / "events")
    batch = small_flows.select("event_id", "ts", F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("source_row_id"))
    n = batch.count()
    assert sinks.write_events(batch.filter("event_id % 2 = 0"), path)["deduplicated"] == 0
    second = sinks.write_events(batch.union(batch), path)
    assert second == {"received": 2 * n, "inserted": n - (n + 1) // 2, "deduplicated": 2 * n - (n - (n + 1) // 2)}
    assert sinks.write_events(batch, path)["inserted"] == 0
    # A corrected date does not make an event a new one.
    assert sinks.write_events(batch.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(90))), path)["inserted"] == 0
    assert rows(spark.read.parquet(path), "event_id") == rows(batch, "event_id")


def test_delivery_without_new_events_after_a_shuffled_join(spark, tmp_path):
    """AQE sees that the last shuffle is empty and drops what lies below; the count of inserted rows is 0 all the same."""
    batch = spark.range(100).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("source_row_id"),
                                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [sinks.write_events(batch, str(tmp_path / "events")) for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [m["inserted"] for m in made] == [100, 0] and made[1]["deduplicated"] == 100


def test_upsert_report(spark):
    cols = "name string, ip string, type string, criticality double, purdue_level int, is_gateway boolean"
    old = spark.createDataFrame([("a", None, "t", 0.1, None, False), ("b", None, "t", 0.1, 1, False), ("c", "x", "t", 0.1, 1, False)], cols)
    new = spark.createDataFrame([("a", None, "t", 0.1, None, False), ("b", None, "t", 0.2, 1, False), ("d", "x", "t", 0.1, 1, False)], cols)
    merged, report = sinks.upsert_assets(old, new)
    assert rows(report, "outcome", "n") == [("created", 1), ("stale", 1), ("unchanged", 1), ("updated", 1)]
    assert dict(rows(merged, "name", "criticality"))["b"] == 0.2


def test_retarget_checks_its_arguments(small_flows, tables):
    for bad in ({"scenario": "x", "target": inv.HUB_ASSET}, {"scenario": "ddos", "target": "Gateway_L1"}):
        with pytest.raises(ValueError):
            prepare.retarget(small_flows, tables.assets, count=1, **bad)


def test_spread_ties_and_retention(spark):
    df = spark.createDataFrame(
        [(i, datetime(2024, 1, 1, 0, m)) for i, m in enumerate([0, 0, 0, 2, 2, 3])], "event_id int, ts timestamp_ntz"
    )
    base = df.agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))).first()[0]
    got = [r["virtual_sec"] - base for r in sequence.spread_ties(df).orderBy("event_id").collect()]
    assert got == pytest.approx([0, 40, 80, 120, 150, 180])
    one = sequence.spread_ties(df.limit(1)).first()["virtual_sec"] - base
    assert one == 0
    assert rows(sequence.retain(df, max_rows=4), "event_id") == [(2,), (3,), (4,), (5,)]
    assert rows(sequence.retention_victims(df, max_rows=None, max_age_sec=61), "event_id") == [(0,), (1,), (2,)]
    assert sequence.retention_victims(df, max_rows=10).count() == 0
    with pytest.raises(ValueError):
        sequence.temporal_split(df, fraction=1.0)
