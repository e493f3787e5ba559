"""The paths taken when one key is too large for a task give the same rows as the plain ones."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from ripplewatch.functions import partitions as part
from ripplewatch.functions.quantile import exact_quantiles
from ripplewatch.operators import beacon, chains, policy, resolve, sequence


@pytest.fixture(scope="module")
def skewed(small_flows):
    """A third of all rows on one pair, plus exact timestamp ties."""
    from ripplewatch.functions.partitions import cut_lineage

    hot = F.col("event_id") % 3 == 0
    return cut_lineage(
        small_flows.select(
            "event_id",
            F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"),
            F.when(hot, "10.0.1.10").otherwise(F.col("source_ip")).alias("source_ip"),
            F.when(hot, "8.8.8.8").otherwise(F.col("destination_ip")).alias("destination_ip"),
            "destination_port",
            "value",
            "is_attack",
            "k",
        )
    )


def test_rank_is_a_permutation_in_order(skewed):
    got = part.with_rank(skewed.select("ts", "event_id"), ["ts", "event_id"], "r", "n").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1, len(got) + 1))
    assert all(r["n"] == len(got) for r in got)
    keys = [(r["ts"], r["event_id"]) for r in got]
    assert keys == sorted(keys)


def test_rank_needs_no_single_partition(skewed):
    sliced = part.range_slices(skewed.repartition(6).select("ts", "event_id"), ["ts", "event_id"])
    assert sliced.groupBy("_slice").count().count() >= 1
    assert rows(sliced, "event_id") == rows(skewed, "event_id")


def test_hash_rank_matches_sort(skewed):
    from ripplewatch.functions.lookup import hash_order

    got = part.hash_rank(skewed.select("event_id"), hash_order(7, F.col("event_id")), name="r").collect()
    import hashlib

    order = sorted(got, key=lambda r: hashlib.md5(f"7|{r['event_id']}".encode()).hexdigest())
    assert [r["r"] for r in order] == list(range(1, len(got) + 1))


@pytest.fixture
def many_slices(monkeypatch, spark):
    """Keep the range partitions apart so that cuts really happen at this size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_beaconing_across_cuts(skewed, many_slices):
    args = dict(max_interval_sec=864000.0, max_cv=0.9)
    plain = beacon.beaconing_verdicts(skewed, **args)
    cut = beacon.beaconing_verdicts(skewed, max_rows=20, **args)
    cols = ("event_id", "usable_intervals", "beacon_fired")
    assert rows(cut, *cols) == rows(plain, *cols)
    a = dict(rows(plain, "event_id", "beacon_cv"))
    b = dict(rows(cut, "event_id", "beacon_cv"))
    assert a.keys() == b.keys()
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


def test_lookback_copies_only_what_is_needed(skewed, many_slices):
    cut = part.with_lookback(skewed.select("source_ip", "ts", "event_id"), ["source_ip"], ["ts", "event_id"], 3, max_rows=20)
    halo = cut.filter("_halo")
    assert halo.count() > 0
    assert halo.groupBy("source_ip", "_slice").count().agg(F.max("count")).first()[0] <= 3
    assert rows(cut.filter("not _halo"), "event_id") == rows(skewed, "event_id")


def test_segments_across_cuts(skewed, many_slices):
    base = skewed.select(
        "source_ip", "ts", "event_id", (F.col("k") % 10 < 8).alias("truth"), (F.col("value") > 60).alias("pred")
    )
    cols = ("start.event_id", "end.event_id", "rows", "detected")
    one = sequence.segments(base, ["ts", "event_id"], keys=["source_ip"])
    two = sequence.segments(base, ["ts", "event_id"], keys=["source_ip"], max_rows=20)
    assert rows(two, "source_ip", *cols) == rows(one, "source_ip", *cols)
    everything = sequence.segments(base, ["ts", "event_id"])
    expect, run = [], []
    for r in sorted(base.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["truth"]:
            run.append(r)
        elif run:
            expect.append(run)
            run = []
    expect += [run] if run else []
    want = sorted(((a[0]["event_id"], a[-1]["event_id"], len(a), any(x["pred"] for x in a)) for a in expect), key=repr)
    assert rows(everything, *cols) == want


def test_as_of_join_across_cuts(skewed, many_slices):
    left = skewed.filter("k % 2 = 0").select("source_ip", "ts", "event_id")
    snaps = skewed.filter("k % 7 = 1").groupBy("source_ip", "ts").agg(F.max("value").alias("v"))
    a = resolve.in_effect(left, snaps, key="source_ip", ts="ts", tie="event_id", columns=["v"])
    b = resolve.in_effect(left, snaps, key="source_ip", ts="ts", tie="event_id", columns=["v"], max_rows=20)
    assert rows(a, "event_id", "v") == rows(b, "event_id", "v")
    assert a.filter("v is not null").count() > 0


def _greedy(items, gap):
    last, out = {}, []
    for key, us, tie in sorted(items, key=lambda x: (x[1], x[2])):
        if key not in last or us - last[key] >= gap:
            last[key] = us
            out.append((key, tie))
    return sorted(out)


@pytest.mark.parametrize("gap", [60, 3600, 43200])
def test_debounce_both_ways(skewed, gap):
    items = [(r["source_ip"], int(r["ts"].timestamp() * 1e6), r["event_id"]) for r in skewed.collect()]
    want = _greedy(items, gap * 1_000_000)
    for limit in (10**6, 15):
        got = chains.debounce(skewed, "source_ip", gap_sec=gap, max_group=limit)
        assert sorted((r["source_ip"], r["event_id"]) for r in got.collect()) == want


def _states(items, ttl):
    state, written = {}, []
    for key, us, tie, level in sorted(items, key=lambda x: (x[1], x[2])):
        held = state.get(key)
        if held and held[0] >= level and held[1] > us:
            continue
        written.append(tie)
        if level >= 2:
            state[key] = (level, us + ttl[level])
        elif held and held[1] <= us:
            state.pop(key)
    return sorted(written)


@pytest.mark.parametrize("limit", [10**6, 15])
def test_prevention_state_both_ways(skewed, limit):
    ttl = (3600, 7200, 14400)
    names = F.when(F.col("k") >= 90, "quarantine").when(F.col("k") >= 60, "block").when(F.col("k") >= 20, "rate_limit")
    rows_ = skewed.select("event_id", "ts", F.col("source_ip").alias("source_asset"), names.otherwise("alert").alias("prevention"))
    levels = {"alert": 1, "rate_limit": 2, "block": 3, "quarantine": 4}
    items = [(r["source_asset"], int(r["ts"].timestamp() * 1e6), r["event_id"], levels[r["prevention"]]) for r in rows_.collect()]
    want = _states(items, {2: 3600 * 10**6, 3: 7200 * 10**6, 4: 14400 * 10**6})
    got = policy.prevention_state(rows_, ttl=ttl, max_group=limit)
    assert sorted(r["event_id"] for r in got.filter("outcome = 'written'").collect()) == want
    assert got.count() == len(items)


@pytest.mark.parametrize("seed", range(4))
def test_cell_functions_compose(seed):
    """A composed function gives the exit state that walking over all rows gives, from every state at entry."""
    rng = np.random.default_rng(seed)
    for trial in range(40):
        ttl = {1: int(rng.integers(1, 7))} if trial % 2 else {2: 3, 3: int(rng.integers(1, 9)), 4: 5}
        reach = max(ttl.values())
        width = 8 * reach if trial % 3 else reach + 1
        us = np.sort(rng.integers(0, 5 * width, 50))
        level = rng.choice(list(ttl), 50)
        whole = None
        for cell in np.unique(us // width):
            mine = us // width == cell
            step = chains.Steps.of_rows(us[mine], level[mine], int(cell) * width + reach, ttl)
            whole = whole.then(step) if whole else step
        first = int(us[0] // width) * width
        for entry in (0, *ttl):
            for moment in range(first - reach - 1, first):
                held = (moment, entry) if entry else None
                for u, v in zip(us.tolist(), level.tolist()):
                    if held is None or u >= held[0] + ttl[held[1]] or v > held[1]:
                        held = (u, v)
                got = whole.exits(entry, np.array([moment]))
                assert (int(got[0][0]), int(got[1][0])) == held


def test_hot_key_goes_through_a_tree(skewed, monkeypatch):
    """Several levels of functions, with null keys hot as well, give the rows of the plain walk."""
    monkeypatch.setattr(chains, "FAN_IN", 2)
    keyed = skewed.withColumn("source_ip", F.when(F.col("k") % 2 == 0, F.col("source_ip")))
    plain = chains.accepted_rows(keyed, "source_ip", ttl_sec={1: 600})
    cut = chains.accepted_rows(keyed, "source_ip", ttl_sec={1: 600}, max_group=15)
    assert plain.filter("source_ip is null").count() > 0
    assert rows(cut, "source_ip", "ts", "event_id") == rows(plain, "source_ip", "ts", "event_id")


def test_only_hot_keys_are_cut(skewed, many_slices):
    """One hot key is range partitioned and stored; the plan of the others stays what it is without hot keys."""
    sizes = {r["source_ip"]: r["count"] for r in skewed.groupBy("source_ip").count().collect()}
    limit = sorted(sizes.values())[-2]
    plain, none = part.cut_by_key(skewed, ["source_ip"], ["ts", "event_id"], max(sizes.values()))
    assert none is None and plain.count() == skewed.count()
    rest, hot = part.cut_by_key(skewed, ["source_ip"], ["ts", "event_id"], limit)
    assert [r[0] for r in hot.select("source_ip").distinct().collect()] == [max(sizes, key=sizes.get)]
    assert hot.select("_slice").distinct().count() > 1
    assert rest.select("_slice").distinct().collect() == [(0,)]
    assert rows(rest.unionByName(hot), "event_id") == rows(skewed, "event_id")
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(source_ip" not in plan


@pytest.mark.parametrize("points", [[0.0, 0.05, 0.5, 0.95, 1.0]])
def test_quantiles_when_the_column_is_too_long(spark, skewed, points):
    values = np.array([r["value"] for r in skewed.collect()])
    want = [float(np.quantile(values, p)) for p in points]
    assert exact_quantiles(skewed, "value", points) == pytest.approx(want)
    assert exact_quantiles(skewed, "value", points, small=50) == pytest.approx(want)
    # one value holding most of the column
    flat = skewed.select(F.when(F.col("k") < 90, 1.0).otherwise(F.col("value")).alias("value"))
    values = np.array([r["value"] for r in flat.collect()])
    want = [float(np.quantile(values, p)) for p in points]
    assert exact_quantiles(flat, "value", points, small=50) == pytest.approx(want)


def test_large_registry_is_resolved_on_distinct_identifiers(skewed, tables):
    a = resolve.resolve_assets(skewed, tables.registry)
    b = resolve.resolve_assets(skewed, tables.registry, max_registry=3)
    cols = ("event_id", "source_asset", "destination_asset", "resolution_confidence")
    assert rows(a, *cols) == rows(b, *cols)


def test_boundary_row_is_the_row_at_the_rank(spark):
    from pyspark.sql import functions as F

    from ripplewatch.functions.quantile import boundary_row, not_after

    rows = [(1_700_000_000 + (k * 7919) % 50, (k * 31) % 400) for k in range(300)] + [(1_700_000_007, 1000 + k) for k in range(90)]
    df = spark.createDataFrame(rows, "s long, id long").select(F.timestamp_seconds("s").alias("ts"), "id")
    order = sorted(rows)
    for rank in (1, 2, 57, 200, len(rows)):
        edge = boundary_row(df, "ts", "id", rank)
        assert edge == (order[rank - 1][0] * 1_000_000, order[rank - 1][1])
        assert df.filter(not_after("ts", "id", edge)).count() == sum(r <= order[rank - 1] for r in rows)
