import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch.operators import cascade as C
from ripplewatch.operators import graph as G

CRITICALITY = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.9}


def edges(spark, *items):
    data = [(i, s, t, k, float(p), prov) for i, (s, t, k, p, prov) in enumerate([(*e, None)[:5] if len(e) == 4 else e for e in items])]
    return spark.createDataFrame(data, "position bigint, src string, tgt string, edge_type string, prob double, provider_id string")


def toy_assets(spark):
    return spark.createDataFrame(
        [(None, n, "T", c, 1, "s") for n, c in CRITICALITY.items()],
        "ip string, name string, type string, criticality double, purdue_level int, sector string",
    )


def run(spark, items, origin="A", score=1.0, iterations=1000, **kw):
    origins = spark.createDataFrame([(origin, score)], "origin string, score double")
    summary, nodes = C.cascade(origins, edges(spark, *items), toy_assets(spark), iterations=iterations, apply_gateway=False, **kw)
    return summary.first(), {r["node"]: r for r in nodes.collect()}


def test_chain_frequencies_follow_the_probabilities(spark):
    s, n = run(spark, [("A", "B", "depends_on", 0.8), ("B", "C", "depends_on", 0.9)])
    assert n["B"]["compromise_freq"] == pytest.approx(0.8, abs=0.04) and n["B"]["hop"] == 1
    assert n["C"]["compromise_freq"] == pytest.approx(0.72, abs=0.05) and n["C"]["hop"] == 2
    assert s["cii_p5"] <= s["cii_median"] <= s["cii_p95"] == pytest.approx(1.0)


def test_redundant_feeds_need_all_to_fail(spark):
    _, n = run(spark, [("A", "B", "controls", 1.0), ("A", "C", "controls", 1.0), ("B", "D", "backed_up_by", 0.5), ("C", "D", "backed_up_by", 0.5)])
    assert n["D"]["compromise_freq"] == pytest.approx(0.25, abs=0.05) and n["D"]["hop"] == 2


def test_chained_redundant_feeds_are_evaluated_in_name_order(spark):
    _, n = run(spark, [("A", "B", "backed_up_by", 1.0), ("B", "C", "backed_up_by", 1.0), ("C", "D", "backed_up_by", 1.0)], iterations=5)
    assert {k: (v["compromise_freq"], v["hop"]) for k, v in n.items()} == {"B": (1.0, 1), "C": (1.0, 2), "D": (1.0, 3)}


def test_one_provider_never_splits(spark):
    items = [("A", "B", "shares_provider", 0.5, "P"), ("A", "C", "shares_provider", 0.9, "P"), ("A", "D", "shares_provider", 0.5, "Q")]
    graph = G.build_graph(edges(spark, *items), toy_assets(spark), apply_gateway=False)
    origins = spark.createDataFrame([("A",)], "origin string")
    reached = C.cascade_reach(origins, graph, iterations=400)
    per = {}
    for r in reached.collect():
        per.setdefault(r["iteration"], set()).add(r["node"])
    assert all(("B" in s) == ("C" in s) for s in per.values())
    assert 0 < sum("B" in s for s in per.values()) < 400 and any(("B" in s) != ("D" in s) for s in per.values())


def test_hop_limit_self_loop_unknown_and_disconnected(spark):
    _, n = run(spark, [("A", "B", "controls", 1.0), ("B", "C", "controls", 1.0), ("C", "D", "controls", 1.0)], max_hops=2, iterations=3)
    assert set(n) == {"B", "C"}
    s, n = run(spark, [("A", "A", "controls", 0.9), ("B", "C", "controls", 0.9)], iterations=20)
    assert n == {} and s["cii_median"] == 0.0
    s, n = run(spark, [("A", "B", "controls", 0.9)], origin="Z", iterations=3)
    assert s is None and n == {}


def test_results_ignore_partitioning(spark):
    items = [("A", "B", "controls", 0.5), ("A", "C", "controls", 0.5), ("B", "D", "controls", 0.5), ("C", "D", "controls", 0.5)]
    one = run(spark, items, iterations=100)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = run(spark, items, iterations=100)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two


def test_gateway_rewrite_of_the_city(spark):
    graph = G.build_graph(inv.edges(spark), inv.assets(spark))
    got = {(r["src"], r["tgt"]): r for r in graph.collect()}
    relay = got[("Gateway_L4", "City_Payment_Gateway")]
    assert relay["prob"] == pytest.approx(1 - 0.1 * 0.5 * 0.6) and relay["edge_type"] == G.RELAY
    assert ("Citizen_Portal", "City_Payment_Gateway") not in got and got[("Citizen_Portal", "Gateway_L4")]["is_gateway_edge"]
    nodes = G.node_table(graph, inv.assets(spark))
    assert nodes.count() == 50
    assert rows(nodes.filter("is_gateway"), "name") == [(f"Gateway_L{i}",) for i in (1, 3, 4, 5)]
    assert rows(nodes.filter("name = 'City_Grid'"), "criticality", "type") == [(0.5, "Synthesized Node")]


def test_gateway_origins(spark):
    origins = spark.createDataFrame([("Gateway_L0", 0.8), ("Gateway_L4", 1.0)], "origin string, score double")
    no_edges = inv.edges(spark).filter("tgt = 'City_Grid'")
    summary, nodes = C.cascade(origins, no_edges, inv.assets(spark), iterations=200)
    got = {r["origin"]: r for r in summary.collect()}
    assert got["Gateway_L0"]["cii_median"] == got["Gateway_L0"]["cii_p95"] == pytest.approx(0.8 * 0.15)
    hit = {r["node"]: r["compromise_freq"] for r in nodes.filter("origin = 'Gateway_L4'").collect()}
    assert len(hit) == 5 and all(f == pytest.approx(0.9, abs=0.08) for f in hit.values())


def test_duplicate_edges_last_wins_and_defaults(spark):
    df = spark.createDataFrame([("A", "B", 0.1), ("A", "B", 0.7)], "src string, tgt string, prob double").coalesce(1)
    r = G.build_graph(df, toy_assets(spark), apply_gateway=False).collect()
    assert [(x["prob"], x["edge_type"], x["confidence"]) for x in r] == [(0.7, "depends_on", 1.0)]


def test_breadth_first_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    graph = spark.createDataFrame(pairs, "src string, tgt string")
    got = {r["node"]: (r["hop"], r["parent"]) for r in G.hop_distances(graph, spark.createDataFrame([("n1",)], "origin string")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hop, level, want = {"n1": 0}, ["n1"], {"n1": (0, None)}
    while level:
        nxt = {}
        for u in level:
            for v in near.get(u, ()):
                if v not in hop:
                    nxt[v] = min(nxt.get(v, u), u)
        for v, u in nxt.items():
            hop[v] = hop[u] + 1
            want[v] = (hop[v], u)
        level = list(nxt)
    assert got == want


def test_criticality_of_gateways_is_negligible(spark):
    df = spark.createDataFrame([("Gateway_L4",), ("A",), ("x",)], "node string")
    got = dict(rows(C._criticality(df, toy_assets(spark), 0.5), "node", "criticality"))
    assert got == {"Gateway_L4": 0.0, "A": 1.0, "x": 0.5}


def test_distances_go_as_far_as_the_graph(spark):
    """A chain deeper than any fixed depth; a limit leaves nodes out and says so."""
    n = 70
    chain = edges(spark, *[(f"N{k:03d}", f"N{k + 1:03d}", "depends_on", 0.5) for k in range(n)])
    graph = G.build_graph(chain, toy_assets(spark), apply_gateway=False)
    origin = spark.createDataFrame([("N000",)], "origin string")
    found = {r["node"]: r["hop"] for r in G.hop_distances(graph, origin).collect()}
    assert found == {f"N{k:03d}": k for k in range(n + 1)}
    with pytest.warns(UserWarning):
        assert G.hop_distances(graph, origin, max_depth=5).count() == 6


def test_packed_paths_and_rows_that_are_not_shuffled(spark):
    """Rows of single origins are unpacked after the last shuffle, and paths of 64 origins at a time are those of the distances."""
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(110)]
    graph = spark.createDataFrame(pairs, "src string, tgt string")
    origins = G.graph_nodes(graph).withColumnRenamed("name", "origin")
    found = G.hop_distances(graph, origins)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning(word" in plan.split("explode(")[1]
    assert not any("Exchange hashpartitioning" in x for x in plan.split("explode(")[0].splitlines())
    ends = origins.select(F.col("origin").alias("name")).filter("name like '%7'")
    want = G.path_edges(found, found.filter("node like '%7'"))
    assert rows(G.paths_to(graph, origins, ends), "origin", "node", "parent") == rows(want, "origin", "node", "parent") != []


def test_paths_are_searched_from_the_smaller_side(spark, monkeypatch):
    """From the targets, a row for each pair with one, and back from the origins; both as in the distances."""
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(100)] + [("n1", "n1"), ("x", "y")]
    graph = spark.createDataFrame(pairs, "src string, tgt string")
    origins = G.graph_nodes(graph).withColumnRenamed("name", "origin")
    found = G.hop_distances(graph, origins)
    few, many = origins.select(F.col("origin").alias("name")).filter("name like '%7' or name = 'x'"), origins.filter("origin like '%3'")
    names = ("origin", "node", "parent")
    want = rows(G.path_edges(found, found.filter("node like '%7' or node = 'x'")), *names)
    with monkeypatch.context() as m:
        m.setattr(G, "_levels", None)  # no search that is packed by origins
        assert rows(G.paths_to(graph, origins, few), *names) == want != []
        with pytest.warns(UserWarning):
            G.paths_to(graph, origins, few, max_depth=1)
    back = found.join(many, "origin", "left_semi")
    assert rows(G.paths_to(graph, many, origins.select(F.col("origin").alias("name"))), *names) == rows(G.path_edges(back, back), *names) != []
