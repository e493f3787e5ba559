"""Asset dependency graph: gateway rewrite, node table, topology roll-up, breadth-first distances."""

import warnings
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch import settings as S
from ripplewatch.functions import net
from ripplewatch.functions.draws import WORD_BITS
from ripplewatch.functions.partitions import broadcast_if_small, cut_lineage, with_rank
from ripplewatch.operators.resolve import protected_assets

RELAY = "gateway_relay"
_LAST = 2**62
MAX_TASKS = 4096
LINK_ROWS = 1_000_000  # links are two or three narrow columns, so more of them than of other rows may be broadcast


def with_edge_defaults(edges: DataFrame) -> DataFrame:
    """Fill in what short edge records leave out."""
    defaults = {
        "edge_type": F.lit("depends_on"),
        "confidence": F.lit(1.0),
        "provider_id": F.lit(None).cast("string"),
        "position": F.monotonically_increasing_id(),
    }
    out = edges
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, value) if name in edges.columns else value)
    return out


def build_graph(
    edges: DataFrame, assets: DataFrame, *, apply_gateway: bool = True, directed: bool = True,
    threshold: float = S.GATEWAY_THRESHOLD,
) -> DataFrame:
    """Edges after the gateway rewrite, one per (src, tgt), the last one given winning.

    An edge into a protected asset ends at the asset's gateway instead; one relay per protected asset carries the
    union probability and the lowest confidence of the edges it stands for.
    """
    rows = with_edge_defaults(edges).select(
        "position", "src", "tgt", "edge_type", "prob", "confidence", "provider_id"
    )
    if apply_gateway:
        guard = protected_assets(assets, threshold=threshold).select(F.col("asset").alias("tgt"), "gateway")
        rows = rows.join(broadcast_if_small(guard), "tgt", "left")
        direct = rows.withColumns(
            {"tgt": F.coalesce("gateway", "tgt"), "is_gateway_edge": F.col("gateway").isNotNull()}
        ).drop("gateway")
        relay = rows.filter(F.col("gateway").isNotNull()).groupBy(F.col("gateway").alias("src"), "tgt").agg(
            F.lit(_LAST).alias("position"),
            F.lit(RELAY).alias("edge_type"),
            (1.0 - F.product(1.0 - F.col("prob"))).alias("prob"),
            F.min("confidence").alias("confidence"),
            F.lit(None).cast("string").alias("provider_id"),
            F.lit(True).alias("is_gateway_edge"),
        )
        rows = direct.unionByName(relay)
    else:
        rows = rows.withColumn("is_gateway_edge", F.lit(False))
    if not directed:
        rows = rows.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    rest = ["position", "edge_type", "prob", "confidence", "provider_id", "is_gateway_edge"]
    last = rows.groupBy("src", "tgt").agg(F.max_by(F.struct(*rest), "position").alias("_e"))
    return last.select("src", "tgt", "_e.*")


def graph_nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()


def node_table(graph: DataFrame, assets: DataFrame, *, default: float = S.DEFAULT_CRITICALITY) -> DataFrame:
    """Every graph node with type, criticality, level and sector: curated, gateway or synthesised."""
    known = broadcast_if_small(assets.withColumn("_known", F.lit(True)))
    rows = graph_nodes(graph).join(known, "name", "left")
    gateway = net.is_gateway(F.col("name")) & F.col("_known").isNull()
    curated = F.col("_known").isNotNull()
    return rows.select(
        "name",
        "ip",
        F.when(curated, F.col("type")).when(gateway, "Purdue Gateway").otherwise("Synthesized Node").alias("type"),
        F.when(curated, F.col("criticality")).when(gateway, S.GATEWAY_CRITICALITY).otherwise(default).alias("criticality"),
        F.when(curated, F.col("purdue_level")).when(gateway, net.gateway_level(F.col("name"))).alias("purdue_level"),
        gateway.alias("is_gateway"),
        "sector",
    )


def collapse_sectors(
    graph: DataFrame, nodes: DataFrame, *, focused=(), hub: str | None = inv.HUB_ASSET
) -> tuple[DataFrame, DataFrame]:
    """Fold members into one node per sector, except the hub and the members of focused sectors.

    Returns (nodes: id, members), (edges: source, target, edge_type, count). Self loops are dropped.
    """
    sector = F.coalesce("sector", F.lit(inv.CORE_SECTOR))
    open_ = (F.col("name") == F.lit(hub)) | sector.isin(*focused) if focused else F.col("name") == F.lit(hub)
    mapping = nodes.select("name", F.when(open_, F.col("name")).otherwise(F.concat(F.lit("sector:"), sector)).alias("id"))
    folded = mapping.groupBy("id").agg(F.count(F.lit(1)).alias("members"))
    table = broadcast_if_small(mapping)
    rows = graph
    for end, out in (("src", "source"), ("tgt", "target")):
        rows = rows.join(table.select(F.col("name").alias(end), F.col("id").alias(out)), end)
    same = (F.col("source") == F.col("src")) & (F.col("target") == F.col("tgt"))
    links = rows.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(
        F.max(F.when(same, F.col("edge_type")).otherwise("aggregated")).alias("edge_type"),
        F.count(F.lit(1)).alias("count"),
    )
    return folded, links


def hop_distances(graph: DataFrame, origins: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin, node, hop, parent) by undirected breadth-first search from every origin.

    Origins are numbered and packed 64 to a word: a row holds, for a (word, node), the origins that have reached the node and
    those that did so in the last level. A level is one join with the links and one OR by (word, node); every node keeps
    itself through a stay link, so what was reached earlier needs no second join. Rows of (origin, node) exist only once,
    at the end, and are not shuffled. Among several possible parents the smallest name is kept. The loop ends with the first empty level.
    ``max_depth`` leaves out nodes further away and warns if there are any.
    """
    levels, links, packed = _levels(graph, origins, max_depth)
    return _with_origins(_with_parents(levels, links, packed), packed)


def _levels(graph: DataFrame, origins: DataFrame, max_depth: int | None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(word, node, mask, hop) rows of each level, the links of both directions, and the origins' places (word, bit)."""
    both = graph.select("src", "tgt").unionByName(graph.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    links = cut_lineage(both.filter(F.col("src") != F.col("tgt")).distinct().withColumn("stay", F.lit(False)))
    numbered = cut_lineage(with_rank(origins.select("origin").distinct(), ["origin"]))
    place = F.col("rank") - 1
    packed = numbered.select(
        "origin", F.floor(place / WORD_BITS).alias("word"), F.pmod(place, F.lit(WORD_BITS)).cast("int").alias("bit")
    )
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    start = packed.groupBy("word", F.col("origin").alias("node")).agg(F.bit_or(one).alias("fresh"))
    level = cut_lineage(start.withColumn("seen", F.col("fresh")))
    zero = F.lit(0).cast("bigint")
    stays = graph_nodes(graph).unionByName(origins.select(F.col("origin").alias("name"))).distinct().select(
        F.col("name").alias("src"), F.col("name").alias("tgt"), F.lit(True).alias("stay")
    )
    steps = broadcast_if_small(cut_lineage(links.unionByName(stays)), LINK_ROWS)
    levels = [level.select("word", "node", F.col("fresh").alias("mask"), F.lit(0).alias("hop"))]
    for depth in count(1):
        moved = level.join(steps, F.col("node") == F.col("src")).filter(F.col("stay") | (F.col("fresh") != 0))
        merged = moved.groupBy("word", F.col("tgt").alias("node")).agg(
            F.bit_or(F.when(F.col("stay"), zero).otherwise(F.col("fresh"))).alias("came"),
            F.bit_or(F.when(F.col("stay"), F.col("seen")).otherwise(zero)).alias("had"),
        )
        fresh = F.col("came").bitwiseAND(F.bitwise_not("had"))
        level = cut_lineage(merged.select("word", "node", fresh.alias("fresh"), F.col("had").bitwiseOR(F.col("came")).alias("seen")))
        found = level.filter("fresh <> 0")
        if found.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            warnings.warn(f"nodes more than {max_depth} hops away are left out", stacklevel=2)
            break
        levels.append(found.select("word", "node", F.col("fresh").alias("mask"), F.lit(depth).alias("hop")))
    return levels, links, packed


def _with_parents(levels: list[DataFrame], links: DataFrame, packed: DataFrame) -> DataFrame:
    """(word, node, hop, src, mask): the nodes reached, with the least of their neighbours that were reached one hop earlier.

    Candidates are taken in the order of their names, each the origins that no earlier one took, so no row of a single origin
    is shuffled or sorted. One shuffle deals the words to tasks, a task to a word; what follows stays in that partitioning.
    """
    words = packed.agg(F.max("word")).first()[0]
    reached = reduce(DataFrame.unionByName, levels).repartition(min((words or 0) + 1, MAX_TASKS), "word")
    # A node meets itself through a link without a name: that row tells who reached it, and is the first of its group.
    own = links.select("src").distinct().unionByName(levels[0].select(F.col("node").alias("src"))).distinct()
    near = links.select("src", "tgt", F.col("src").alias("by")).unionByName(own.select("src", F.col("src").alias("tgt"), F.lit(None).cast("string").alias("by")))
    tried = reached.withColumnRenamed("node", "src").join(broadcast_if_small(near, LINK_ROWS), "src")
    hop = F.when(F.col("by").isNull(), F.col("hop")).otherwise(F.col("hop") + 1)
    return _least(tried.select("word", F.col("tgt").alias("node"), hop.alias("hop"), F.col("by").alias("src"), "mask"))


def _least(tried: DataFrame) -> DataFrame:
    """Of candidate rows and, with a null ``src``, the row of those wanted: each origin with its least candidate, and hop 0."""
    zero = F.lit(0).cast("bigint")
    ordered = Window.partitionBy("word", "node", "hop").orderBy(F.col("src").asc_nulls_first())
    candidate = F.when(F.col("src").isNotNull(), F.col("mask")).otherwise(zero)
    before = F.coalesce(F.bit_or(candidate).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), zero)
    wanted = F.bit_or(F.when(F.col("src").isNull(), F.col("mask")).otherwise(zero)).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = tried.withColumns({"_before": before, "_wanted": wanted})
    mask = F.when(F.col("src").isNull(), F.when(F.col("hop") == 0, F.col("mask")).otherwise(zero)).otherwise(
        F.col("mask").bitwiseAND(F.col("_wanted")).bitwiseAND(F.bitwise_not("_before"))
    )
    return rows.select("word", "node", "hop", "src", mask.alias("mask")).filter("mask <> 0")


def _with_origins(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Unpack rows with disjoint masks to (origin, node, hop, parent)."""
    rows = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))))
    rows = rows.filter(F.call_function("getbit", F.col("mask"), F.col("bit")) == 1)
    named = rows.join(broadcast_if_small(packed), ["word", "bit"])
    return named.select("origin", "node", "hop", F.col("src").alias("parent"))


def paths_to(graph: DataFrame, origins: DataFrame, targets: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin, node, parent) edges on the tree paths of ``hop_distances`` from every origin to the ``targets`` (name).

    The same as ``path_edges`` of all distances, but no more is searched than the smaller side needs: from the targets, if they
    are not more than the origins, and otherwise for 64 origins at a time.
    """
    origins, targets = origins.select("origin").distinct(), targets.select("name").distinct()
    search = _paths_from if targets.count() <= origins.count() else _paths_back
    return search(graph, origins, targets, max_depth)


def _paths_from(graph: DataFrame, origins: DataFrame, targets: DataFrame, max_depth: int | None) -> DataFrame:
    """``paths_to`` by breadth-first search from the targets.

    Going back from a target, each step takes the least name one hop nearer to the origin. So the path, read from the target, is the
    first in order of names among the shortest, and the beginning of such a path is such a path. A level therefore keeps
    the candidate whose path ranks first in the level before, and is sorted once to rank its own; rows are (target, node).
    """
    both = graph.select("src", "tgt").unionByName(graph.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    links = broadcast_if_small(cut_lineage(both.filter(F.col("src") != F.col("tgt")).distinct()), LINK_ROWS)
    pair = ["target", "node"]
    near = targets.select(F.col("name").alias("target"), F.col("name").alias("node"), F.lit(0).cast("bigint").alias("rank"), F.array("name").alias("path"))
    near, last, found = cut_lineage(near), None, []
    for depth in count(1):
        moved = near.join(links, F.col("node") == F.col("src")).select("target", F.col("tgt").alias("node"), "rank", "path")
        # A neighbour is in this level, the one before it or the next one.
        for level in (near, last) if last is not None else (near,):
            moved = moved.join(level.select(*pair), pair, "left_anti")
        fresh = moved.groupBy(*pair).agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"))
        order = ["target", "rank", "node"]
        fresh = fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
        last, near = near, cut_lineage(fresh.select(*pair, "rank", F.concat("path", F.array("node")).alias("path")))
        if near.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            warnings.warn(f"nodes more than {max_depth} hops away are left out", stacklevel=3)
            break
        found.append(near.select("node", "path"))
    paths = reduce(DataFrame.unionByName, found, near.select("node", "path").limit(0)).withColumnRenamed("node", "origin")
    steps = paths.join(broadcast_if_small(origins), "origin", "left_semi").select("origin", "path", F.posexplode("path").alias("at", "node"))
    return steps.select("origin", "node", F.try_element_at("path", F.col("at") + 2).alias("parent")).filter(F.col("parent").isNotNull()).distinct()


def _paths_back(graph: DataFrame, origins: DataFrame, targets: DataFrame, max_depth: int | None) -> DataFrame:
    """``paths_to`` by packed search from the origins, parents being looked for on the paths only, from the last level back."""
    levels, links, packed = _levels(graph, origins, max_depth)
    ends = broadcast_if_small(targets.select(F.col("name").alias("node")).distinct())
    near = broadcast_if_small(links.select("src", F.col("tgt").alias("node")), LINK_ROWS)
    found, wanted = [], None
    for level, before in zip(levels[:0:-1], levels[-2::-1]):
        here = level.join(ends, "node", "left_semi").select("word", "node", "mask", "hop")
        if wanted is not None:
            here = here.unionByName(wanted)
        here = cut_lineage(here.groupBy("word", "node", "hop").agg(F.bit_or("mask").alias("mask")))
        able = before.select("word", F.col("node").alias("src"), F.col("mask").alias("before"))
        tried = here.drop("mask").join(near, "node").join(able, ["word", "src"]).select("word", "node", "hop", "src", F.col("before").alias("mask"))
        own = here.select("word", "node", "hop", F.lit(None).cast("string").alias("src"), "mask")
        edges = cut_lineage(_least(tried.unionByName(own)))
        found.append(edges)
        wanted = edges.select("word", F.col("src").alias("node"), "mask", (F.col("hop") - 1).alias("hop"))
    empty = levels[0].select("word", "node", "hop", F.col("node").alias("src"), "mask").limit(0)
    return _with_origins(reduce(DataFrame.unionByName, found, empty), packed).select("origin", "node", "parent")


def path_edges(distances: DataFrame, impacted: DataFrame) -> DataFrame:
    """(origin, node, parent) edges on the tree paths from each origin to its impacted nodes."""
    tree = distances.filter(F.col("parent").isNotNull()).select("origin", "node", "parent", "hop")
    level = cut_lineage(tree.join(impacted.select("origin", "node").distinct(), ["origin", "node"], "left_semi"))
    found = level
    while True:
        up = level.select("origin", F.col("parent").alias("node")).distinct()
        fresh = tree.join(up, ["origin", "node"], "left_semi").join(found, ["origin", "node"], "left_anti")
        level = cut_lineage(fresh)
        if level.isEmpty():
            return found.select("origin", "node", "parent")
        found = found.unionByName(level)
