import ipaddress
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions import net
from ripplewatch.operators import beacon, drift, evaluate, fusion, iforest, policy, signature, supervised, volumetric

FLOW = (
    "event_id bigint, ts timestamp_ntz, source_ip string, source_port int, destination_ip string, "
    "destination_port int, bytes bigint"
)


def flow(spark, *specs):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, start + timedelta(seconds=sec), src, sp, dst, dp, size) for i, (sec, src, sp, dst, dp, size) in enumerate(specs)],
        FLOW,
    )


def test_external_addresses_agree_with_the_standard_registry(spark):
    rng = random.Random(5)
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(3000)]
    ips += ["10.1.2.3", "172.31.0.1", "172.32.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "203.0.113.9", "100.64.0.1"]
    ips += ["198.18.0.1", "198.19.255.1", "198.20.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "192.0.0.170"]
    got = dict(spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.is_external(F.col("ip"))).collect())
    assert all(got[i] == (not ipaddress.ip_address(i).is_private) for i in ips)
    bad = ["not-an-ip", "1.2.3", "300.1.1.1", "01.2.3.4", "", "1.2.3.4.5"]
    got = spark.createDataFrame([(i,) for i in bad], "ip string").select(net.is_external(F.col("ip"))).collect()
    assert not any(r[0] for r in got)


def test_signature_rules_and_near_misses(spark):
    df = flow(
        spark,
        (0, "185.220.101.5", 5000, "10.0.1.10", 80, 900),  # watch list
        (1, "10.0.1.10", 5000, "8.8.8.8", 4444, 64),  # small outbound
        (2, "10.0.1.10", 5000, "8.8.8.8", 4444, 65),  # one byte too many
        (3, "10.0.1.10", 500, "8.8.8.8", 4444, 6),  # service port answering
        (4, "10.0.1.10", 5000, "10.0.1.11", 4444, 6),  # stays inside
        (5, "10.0.1.10", 5000, "10.0.1.11", 445, 6000),  # admin port
        (6, "9.9.9.9", 5000, "10.0.1.11", 5432, 6000),  # outside to database
        (7, "10.0.1.9", 5000, "10.0.1.11", 5432, 6000),  # inside to database
        (8, "45.227.254.12", 5000, "10.0.1.11", 3306, 10),  # two rules, strongest wins
    )
    got = {r["event_id"]: r for r in signature.signature_verdicts(df).collect()}
    scores = [got[i]["signature_score"] for i in range(9)]
    assert scores == [0.9, 0.5, 0.0, 0.0, 0.0, 0.4, 0.65, 0.0, 0.9]
    assert got[8]["signature_raw"] == 2.0 and len(got[8]["matched_rules"]) == 2
    assert not got[2]["signature_fired"]


def test_rules_are_checked():
    with pytest.raises(ValueError):
        signature.Rule("", "t", 0.5, None)
    with pytest.raises(ValueError):
        signature.Rule("X", "t", 1.5, None)


def test_regular_arrivals_fire_and_bursts_do_not(spark):
    regular = [(30 * i, "10.0.1.10", 5000, "8.8.8.8", 443, 10) for i in range(10)]
    burst = [(0, "10.0.1.11", 5000, "8.8.8.8", 443, 10) for _ in range(10)]
    sparse = [(7200 * i, "10.0.1.12", 5000, "8.8.8.8", 443, 10) for i in range(10)]
    few = [(30 * i, "10.0.1.13", 5000, "8.8.8.8", 443, 10) for i in range(4)]
    got = beacon.beaconing_verdicts(flow(spark, *(regular + burst + sparse + few))).collect()
    last = {}
    for r in sorted(got, key=lambda r: (r["ts"], r["event_id"])):
        last[r["source_ip"]] = r
    assert last["10.0.1.10"]["beacon_fired"] and last["10.0.1.10"]["beacon_score"] > 0.9
    assert last["10.0.1.10"]["beacon_cv"] == 0.0 and "30.00s" in last["10.0.1.10"]["beacon_summary"]
    for ip in ("10.0.1.11", "10.0.1.12", "10.0.1.13"):
        assert not last[ip]["beacon_fired"] and last[ip]["beacon_score"] == 0.0 and last[ip]["beacon_cv"] is None
    with pytest.raises(ValueError):
        beacon.beaconing_verdicts(flow(spark, *regular), min_samples=2)


def verdicts(spark, *cases):
    data = [(i, [(d, f, float(s), float(r), c, None) for d, f, s, r, c in case]) for i, case in enumerate(cases)]
    schema = (
        "event_id bigint, verdicts array<struct<detector:string, fired:boolean, calibrated_score:double, "
        "reliability:double, certainty:string, raw_score:double>>"
    )
    return spark.createDataFrame(data, schema)


def test_fusion_precedence_noisy_or_and_bands(spark):
    h = "heuristic"
    df = verdicts(
        spark,
        [],
        [("volumetric", False, 0.9, 0.02, h)],
        [("supervised", True, 0.91, 0.9, h), ("beaconing", True, 0.6, 0.5, h)],
        [("supervised", True, 0.1, 0.1, h), ("tripwire", True, 1.0, 1.0, "confirmed")],
        [("signature", True, 0.5, 0.5, h)],
        [("signature", False, 1.0, 1.0, "confirmed")],
    )
    got = {r["event_id"]: r for r in fusion.rationale(fusion.fuse(df)).collect()}
    assert (got[0]["threat_score"], got[0]["band"], got[0]["rationale"]) == (0.0, "benign", "no detectors reported")
    assert got[1]["rationale"] == "1 detector(s) ran, none fired"
    assert got[2]["threat_score"] == pytest.approx(1 - (1 - 0.91 * 0.9) * (1 - 0.6 * 0.5))
    assert got[2]["rationale"] == "supervised 0.91 x0.90, beaconing 0.60 x0.50 -> 0.87"
    assert got[3]["threat_score"] == 1.0 and got[3]["band"] == "confirmed" and got[3]["fused_action"] == "alert"
    assert got[3]["rationale"] == "honeytoken credential used (confirmed)"
    assert (got[4]["threat_score"], got[4]["band"]) == (0.25, "suspicious")  # on the boundary: the higher band
    assert got[5]["band"] == "benign"
    with pytest.raises(ValueError):
        fusion.fuse(df, suspicious=0.9)


def test_prevention_tiers(spark):
    cols = "event_id int, threat_score double, band string, has_confirmed boolean, n_fired int, source_criticality double, cii_median double"
    data = [
        (0, 0.4, "suspicious", False, 3, 1.0, 0.5),
        (1, 0.9, "confirmed", False, 1, 1.0, 0.5),  # one detector alone
        (2, 0.9, "confirmed", False, 2, 0.9, 0.10),
        (3, 0.9, "confirmed", False, 2, 0.9, 0.09),
        (4, 0.9, "confirmed", True, 1, 0.9, None),
        (5, 0.9, "confirmed", False, 2, 0.4, 0.5),
        (6, 0.6, "likely", False, 2, 1.0, 0.5),
    ]
    got = {r["event_id"]: (r["prevention"], r["ttl_sec"]) for r in policy.prevention_decisions(spark.createDataFrame(data, cols)).collect()}
    assert got == {
        0: ("observe", None), 1: ("alert", None), 2: ("quarantine", 3600), 3: ("block", 1800), 4: ("block", 1800),
        5: ("rate_limit", 900), 6: ("rate_limit", 900),
    }


def test_alert_policy_defaults_keep_the_volumetric_channel_quiet(spark):
    cols = "event_id int, is_anomaly boolean, tripwire_fired boolean, volumetric_score double, fused_action string"
    data = [(0, True, False, 0.99, "alert"), (1, False, True, 0.1, "alert"), (2, False, False, 0.1, "alert")]
    df = spark.createDataFrame(data, cols)
    assert rows(policy.alert_candidates(df), "event_id", "alert_kind") == [(1, "tripwire")]
    both = policy.alert_candidates(df, volumetric_enabled=True, hybrid_enabled=True)
    assert rows(both, "event_id", "alert_kind") == [(0, "volumetric"), (1, "tripwire"), (2, "hybrid")]


def test_forest_finds_the_odd_rows_and_ignores_layout(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, 1, (1500, 3)), rng.normal(9, 0.5, (30, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "event_id int, a double, b double, c double")
    model = iforest.fit_iforest(df, ["a", "b", "c"], contamination=0.02, trees=50)
    scored = iforest.score_iforest(df, model)
    got = {r["event_id"]: r for r in scored.collect()}
    fired = {i for i, r in got.items() if r["fired"]}
    assert len(fired) == pytest.approx(0.02 * 1530, abs=2) and len(fired & set(range(1500, 1530))) >= 28
    assert all((r["score"] > 0.5) == r["fired"] or r["raw_score"] == 0 for r in got.values())
    again = iforest.fit_iforest(df.repartition(7), ["a", "b", "c"], contamination=0.02, trees=50)
    assert again.offset == model.offset and again.nodes.equals(model.nodes)
    with pytest.raises(ValueError):
        iforest.fit_iforest(df, ["a"], contamination=0.0)
    with pytest.raises(ValueError):
        iforest.score_iforest(df.drop("a"), model)


def test_warmup_refuses_short_or_dirty_slices_and_models_round_trip(spark, small_flows, tmp_path):
    benign = small_flows.filter(~F.col("is_attack"))
    with pytest.raises(ValueError):
        iforest.fit_warmup(benign)
    with pytest.raises(ValueError):
        iforest.fit_warmup(small_flows, min_rows=10)
    model, scaler, meta = iforest.fit_warmup(benign, min_rows=100, trees=10)
    assert meta["attacks"] == 0 and meta["rows"] == benign.count()
    iforest.save_model(spark, model, str(tmp_path / "m"))
    back = iforest.load_model(spark, str(tmp_path / "m"), features=model.features)
    scaled = volumetric.apply_scaler(small_flows, scaler)
    a, b = iforest.score_iforest(scaled, model), iforest.score_iforest(scaled, back)
    assert rows(a, "event_id", "raw_score") == rows(b, "event_id", "raw_score")
    with pytest.raises(ValueError):
        iforest.load_model(spark, str(tmp_path / "m"), features=["other"])


def test_explanations_mark_constant_features(spark):
    df = spark.createDataFrame([(float(i % 5), 3, 10.0 * i) for i in range(50)], "duration_sec double, packets int, bytes double")
    model = volumetric.fit_scaler(df)
    assert [m.degenerate for m in model] == [False, True, False] and model[1].spread == 1.0
    r = volumetric.explain(df.limit(1), model).first()
    assert [f["name"] for f in r["features"]][-1] == "packets" and r["features"][-1]["z"] is None
    assert "deviations below its mean" in r["summary"]
    flat = spark.createDataFrame([(1.0, 1, 1.0)] * 3, "duration_sec double, packets int, bytes double")
    assert "only ever saw" in volumetric.explain(flat, volumetric.fit_scaler(flat)).first()["summary"]


def drift_flows(spark, buckets, novel_in=None):
    data, n = [], 0
    from datetime import datetime, timedelta

    for b in range(buckets):
        for s in range(12):
            for p in range(5):
                if (s + p + b) % 6 == 0:
                    continue
                data.append((n, datetime(2024, 1, 1) + timedelta(seconds=60 * b + p), f"h{s}", f"p{(s + p) % 20}", 100 + p))
                n += 1
        if b == novel_in:
            for p in range(40):
                data.append((n, datetime(2024, 1, 1) + timedelta(seconds=60 * b + 20), "h0", f"new{p}", 100))
                n += 1
    return spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, source_ip string, destination_ip string, bytes bigint")


def test_drift_fires_on_novel_fan_out_only(spark):
    scored = drift.score_drift(drift.drift_features(drift_flows(spark, 16, novel_in=14)), trees=50)
    got = scored.collect()
    assert all(r["abstained"] == "baseline_not_fitted" and r["drift_score"] == 0 for r in got if r["batch"] < 10)
    hot = [r for r in got if r["batch"] == 15 and r["node"] == "h0"]
    assert hot and hot[0]["drift_fired"] and hot[0]["drift_score"] >= S.DRIFT_FIRE
    quiet = [r for r in got if r["batch"] > 10 and r["node"] != "h0" and r["abstained"] is None]
    assert sum(r["drift_fired"] for r in quiet) <= len(quiet) * 0.3
    assert all(0.0 <= r["drift_score"] <= 1.0 for r in got)


def test_drift_epochs_split_over_tasks_agree(spark):
    features = drift.drift_features(drift_flows(spark, 30))
    one = drift.score_drift(features, refit_every=5, trees=20, buffer=60)
    many = drift.score_drift(features, refit_every=5, trees=20, buffer=60, max_rows=10)
    assert rows(one, "batch", "node", "drift_decision") == rows(many, "batch", "node", "drift_decision")
    assert one.filter("drift_decision is not null").count() > 0


def test_drift_trains_on_the_newest_rows(spark, monkeypatch):
    features = drift.drift_features(drift_flows(spark, 30))
    seen = {}
    original = drift._fit_and_score

    def spy(features, training, *rest):
        seen["rows"] = [(r["epoch"], r["_at"]) for r in training.select("epoch", "_at").collect()]
        return original(features, training, *rest)

    monkeypatch.setattr(drift, "_fit_and_score", spy)
    drift.score_drift(features, refit_every=5, trees=5, buffer=50)
    trainable = sorted((r["batch"], r["node"]) for r in features.filter("degree >= 4").collect())
    for epoch in range(5):
        end = sum(1 for b, _ in trainable if b <= 10 + 5 * epoch)
        assert sorted(at for e, at in seen["rows"] if e == epoch) == list(range(max(1, end - 49), end + 1))


def test_calibration_is_anchored_at_the_threshold(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (5.0,), (-0.1,), (-9.0,)], "d double")
    c = drift.boundary_calibration(F.col("d"), F.lit(0.2), F.lit(0.2), 0.7)
    got = [r[0] for r in df.select(c).collect()]
    assert got == pytest.approx([0.7, 0.35, 0.0, 0.0, 0.85, 1.0])
    none = [r[0] for r in df.select(drift.boundary_calibration(F.col("d"), F.lit(None).cast("double"), F.lit(0.0), 0.7)).collect()]
    assert none == pytest.approx([0.7, 0.7, 0.7, 0.7, 1.0, 1.0])


@pytest.mark.parametrize(
    "truth,pred,want",
    [
        ([0, 0, 0], [0, 1, 0], (0, 0, 0.0)),
        ([1, 1, 1], [0, 0, 1], (1, 1, 1.0)),
        ([0, 1, 1, 0], [1, 1, 0, 0], (1, 1, 0.5)),
        ([1, 0, 1, 0, 0, 1], [1, 0, 0, 0, 0, 0], (3, 1, 1.0)),
    ],
)
def test_segment_metrics(spark, truth, pred, want):
    df = spark.createDataFrame([(i, bool(t), bool(p)) for i, (t, p) in enumerate(zip(truth, pred))], "i int, truth boolean, pred boolean")
    r = evaluate.segment_metrics(df, ["i"]).first()
    assert (r["segments"], r["detected"], r["precision"]) == want
    assert r["recall"] == (want[1] / want[0] if want[0] else 0.0)


def test_auc_of_one_class_is_undefined_and_guard_refuses(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True)], "s double, truth boolean")
    assert np.isnan(evaluate.roc_auc(df, score="s").first()["auc"])
    with pytest.raises(ValueError):
        evaluate.guard_split(df)


def test_registered_detectors_can_be_added(small_flows):
    class Fixed:
        @staticmethod
        def fit(df, features):
            return None

        @staticmethod
        def score(df, model):
            return df.withColumns({"raw_score": -F.col("z_bytes"), "fired": F.col("z_bytes") > 1.0})

    evaluate.register_detector("fixed", evaluate.Detector(Fixed.fit, Fixed.score))
    out = evaluate.evaluate(small_flows.withColumn("truth", F.col("is_attack")), ["fixed", "zscore"]).collect()
    assert [r["detector"] for r in out] == ["fixed", "zscore"] and all(0 <= r["auc"] <= 1 for r in out)
    with pytest.raises(ValueError):
        evaluate.evaluate(small_flows, ["nope"])


def test_supervised_model_is_sent_to_tasks_after_an_observation(spark, small_flows):
    from pyspark.sql import Observation

    from ripplewatch.functions.partitions import cut_lineage

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    model = supervised.fit_supervised(small_flows, trees=3, depth=3)
    scored = supervised.score_supervised(small_flows.drop("supervised_score"), model).filter("supervised_score >= 0")
    assert cut_lineage(scored.groupBy("supervised_fired").count()).count() > 0


def test_supervised_beats_chance_and_refuses_one_class(small_flows):
    df = small_flows.withColumn("bytes", F.when(F.col("is_attack"), F.col("bytes") + 5000).otherwise(F.col("bytes")))
    r = supervised.temporal_split_evaluate(df, trees=10, depth=4).first()
    assert r["auc"] > 0.9 and r["recall"] > 0.8
    with pytest.raises(ValueError):
        supervised.fit_supervised(df.filter("is_attack"))


def test_supervised_forest_counts_every_row_whatever_the_partitioning(spark, small_flows):
    """Equal forests from one and from seven partitions; a leaf holds the class shares of all rows drawn into it."""
    from ripplewatch.operators import histforest

    flows = small_flows.drop("supervised_score")
    one, seven = (supervised.fit_supervised(flows.repartition(k), trees=6, depth=4) for k in (1, 7))
    assert one.cuts == seven.cuts
    assert all((getattr(one, part) == getattr(seven, part)).all() for part in ("feature", "cut", "leaf"))
    names, n = [F.col(f).cast("double") for f in one.features], flows.count()
    found = flows.select(F.xxhash64(F.lit(42), "event_id"), "is_attack", *names).collect()
    identity = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64)
    attack, points = np.array([r[1] for r in found]), np.array([tuple(r)[2:] for r in found])
    flat, weight = histforest._bins(points, one.cuts).ravel(), np.where(attack, n / 2 / attack.sum(), n / 2 / (~attack).sum())
    for t in range(6):
        times = histforest._times(identity, t // 4, histforest._poisson())[:, t % 4] * weight
        at = histforest._descend(flat, np.arange(n), n, one.feature[t], one.cut[t], 4)
        all_, hits = (np.bincount(at, times * y, 16) for y in (np.ones(n), attack))
        used = all_ > 0
        assert used.sum() > 2 and one.leaf[t][used] == pytest.approx(hits[used] / all_[used])
    blocks = histforest._blocks(
        spark.range(100_000).repartition(1).select("id", F.lit(True), *[F.col("id").cast("double").alias(f) for f in one.features]), one.cuts, 100_000
    )
    held = blocks.rdd.glom().map(lambda part: sum(len(r["label"]) for r in part)).collect()
    assert sum(held) == 100_000 and max(held) < 40_000  # a file in one split does not leave the passes to one task


def test_supervised_forest_is_as_good_as_mllib(small_flows):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    flows = small_flows.drop("supervised_score")
    share = flows.agg(F.avg(F.col("is_attack").cast("double"))).first()[0]
    features = list(supervised.S.SUPERVISED_FEATURES)
    ready = VectorAssembler(inputCols=features, outputCol="x").transform(flows).withColumns(
        {"label": F.col("is_attack").cast("double"), "w": F.when(F.col("is_attack"), 0.5 / share).otherwise(0.5 / (1 - share))})
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=20, maxDepth=5, seed=42).fit(ready).copy()
    theirs = forest.transform(ready).select("event_id", vector_to_array("probability")[1].alias("theirs"), "is_attack")
    ours = supervised.score_supervised(flows, supervised.fit_supervised(flows, trees=20, depth=5))
    both = ours.select("event_id", "supervised_score").join(theirs, "event_id")
    auc = [evaluate.roc_auc(both, score=c, truth="is_attack").first()["auc"] for c in ("supervised_score", "theirs")]
    mean = both.agg(F.avg("supervised_score"), F.avg("theirs")).first()
    assert abs(auc[0] - auc[1]) < 0.05 and abs(mean[0] - mean[1]) < 0.02


def test_a_bundle_scores_as_before_and_is_refused_where_it_does_not_fit(spark, small_flows, tmp_path):
    from ripplewatch.sources import bundle

    flows, path = small_flows.drop("supervised_score"), str(tmp_path / "bundle")
    fitted = bundle.fit_bundle(flows.filter("not is_attack"), flows, trees=5, min_rows=100)
    with pytest.raises(bundle.BundleRefused, match="no whole bundle"):
        bundle.load_bundle(spark, path, flows)
    bundle.save_bundle(fitted, path, flows, day="monday")
    back = bundle.load_bundle(spark, path, flows, day="monday")
    assert back.scaler == fitted.scaler and back.warmup == fitted.warmup and back.features == fitted.features
    columns = ("event_id", "raw_score", "fired", "supervised_score", "supervised_fired")
    assert rows(bundle.score(flows, back), *columns) == rows(bundle.score(flows, fitted), *columns)
    with pytest.raises(bundle.BundleRefused, match="day"):
        bundle.load_bundle(spark, path, flows, day="tuesday")
    with pytest.raises(bundle.BundleRefused, match="types"):
        bundle.load_bundle(spark, path, flows.withColumn("bytes", F.col("bytes").cast("int")))
    with pytest.raises(bundle.BundleRefused, match="lack"):
        bundle.load_bundle(spark, path, flows.drop("packets"))
    unlabelled = bundle.fit_bundle(flows.filter("not is_attack"), trees=5, min_rows=100)
    bundle.save_bundle(unlabelled, path, flows)
    assert bundle.load_bundle(spark, path, flows).supervised is None
    other = bundle.Bundle(fitted.scaler[:2], fitted.forest, fitted.warmup)
    bundle.save_bundle(other, path, flows)
    with pytest.raises(bundle.BundleRefused, match="beside a scaler"):
        bundle.load_bundle(spark, path, flows)


def test_signatures_and_score_rows_stay_in_generated_code(small_flows):
    """No higher-order function, which would be interpreted for every row, and no failing cast of an empty text."""
    from ripplewatch.functions.partitions import cut_lineage
    from ripplewatch.operators import fusion, resolve, signature, volumetric

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    flows = signature.signature_verdicts(volumetric.two_channel_confidence(volumetric.tripwire(small_flows)))
    assert "lambda" not in plan(flows)
    stored = cut_lineage(fusion.fuse(fusion.collect_verdicts(flows, beaconing=False, drift=False)))
    assert "lambda" not in plan(fusion.score_rows(stored))
    hosts = small_flows.select(resolve._host(F.col("destination_ip")).alias("host"))
    assert "CASE WHEN" in plan(hosts) and 0 < hosts.filter("host IS NULL").count() < hosts.count()


def test_the_test_part_is_scored_once(small_flows):
    from ripplewatch.operators import supervised

    out = supervised.temporal_split_evaluate(small_flows.drop("supervised_score"), trees=2, depth=2)
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 1
