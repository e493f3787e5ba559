"""Random forest of two classes, grown a level at a time from counts.

Rows are cut into at most 32 bins a feature once and stored in blocks; every level is one Spark job for all trees: tasks
count their blocks' rows by (tree, node, drawn feature, bin, class), the counts meet by tree and each tree chooses its
splits. Between levels only the trees themselves, of a fixed size, come to the driver. Bootstrap counts are hashes of a row's
key, and all sums are whole numbers, so the forest does not depend on partitioning.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch.functions.lookup import hash_order
from ripplewatch.functions.partitions import cut_lineage, lowest_by_hash

BINS = 32
CUT_SAMPLE = 10_000
BLOCK_ROWS = 131_072
TASK_ROWS = 4_000_000
_NEVER = 255  # a bin that no row lies above: rows of a finished node keep going left
_BLOCK = pa.schema([("identity", pa.binary()), ("bins", pa.binary()), ("label", pa.binary())])
_TREES = "tree int, feature array<int>, cut array<int>, leaf array<double>"


def _poisson() -> np.ndarray:
    """Poisson counts of mean 1 for the 65,536 values of 16 random bits."""
    below = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


@dataclass(frozen=True)
class SupervisedModel:
    """Complete binary trees of one depth; a node that was not split sends its rows left to a copy of its value."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray


def _bins(points: np.ndarray, cuts) -> np.ndarray:
    """Per feature and row, the number of cuts below the value."""
    return np.stack([np.searchsorted(c, points[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)


def _cuts(sample: np.ndarray) -> tuple[float, ...]:
    """Up to ``BINS - 1`` cuts halfway between neighbouring values, at even shares of the sample."""
    values, counts = np.unique(sample, return_counts=True)
    if len(values) > BINS:
        shares = np.arange(1, BINS) * len(sample) / BINS
        places = np.unique(np.searchsorted(np.cumsum(counts), shares))
        places = places[places < len(values) - 1]
    else:
        places = np.arange(len(values) - 1)
    return tuple(float(c) for c in (values[places] + values[places + 1]) / 2)


def _drawn(seed: int, tree: int, level: int, features: int) -> np.ndarray:
    """The features each node of a level may be split by: the root of their number, chosen at random."""
    order = np.random.default_rng([seed, tree, level]).random((2**level, features)).argsort(axis=1)
    return order[:, : ceil(sqrt(features))]


def _times(identity: np.ndarray, group: int, poisson: np.ndarray) -> np.ndarray:
    """How often each row is drawn by each of the four trees of a group."""
    z = identity + np.uint64((group + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return poisson[(z ^ (z >> np.uint64(31))).view(np.uint16)].reshape(-1, 4)


def _descend(flat: np.ndarray, rows: np.ndarray, n: int, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place within level ``levels`` of a tree."""
    offset = feature.astype(np.int64) * n
    at = np.zeros(len(rows), dtype=np.int64)
    for level in range(levels):
        node = at + (2**level - 1)
        at = 2 * at + (flat.take(offset.take(node) + rows) > cut.take(node))
    return at


def _blocks(rows: DataFrame, cuts, n: int) -> DataFrame:
    """The rows as stored blocks of identities, bins and labels, dealt evenly whatever the input's splits were."""
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, ceil(n / TASK_ROWS))
    size = min(BLOCK_ROWS, max(8_192, ceil(n / tasks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def block():
            h, x, y = (np.concatenate(part, axis=-1) for part in zip(*held))
            return pa.RecordBatch.from_pylist([{"identity": h.tobytes(), "bins": x.tobytes(), "label": y.tobytes()}], _BLOCK)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            points = np.column_stack(columns[2:]).astype(float)
            held.append((columns[0].astype(np.int64), _bins(points, cuts), columns[1].astype(np.uint8)))
            waiting += len(points)
            if waiting >= size:
                yield block()
                held, waiting = [], 0
        if waiting:
            yield block()

    packed = rows.mapInArrow(pack, "identity binary, bins binary, label binary")
    return cut_lineage(packed.repartition(tasks))


def _level(blocks: DataFrame, state, level: int, features: int, seed: int, weights) -> list:
    """One row for each tree with active nodes: feature (-1: no split), cut and the children's class weights of each."""
    shared = blocks.sparkSession.sparkContext.broadcast(state)
    slots = ceil(sqrt(features))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut, active = shared.value
        poisson, plans = _poisson(), {}
        for t in np.flatnonzero(active.any(axis=1)):
            drawn = _drawn(seed, int(t), level, features)[active[t]]
            place = np.where(active[t], np.cumsum(active[t]) - 1, -1)
            plans[int(t)] = (drawn, place, np.zeros(len(drawn) * slots * BINS * 2))
        for batch in batches:
            for h, x, y in zip(*batch.columns):
                identity, flat, label = (np.frombuffer(b.as_buffer(), d) for b, d in ((h, np.uint64), (x, np.uint8), (y, np.uint8)))
                n, group = len(identity), -1
                for t, (drawn, place, totals) in plans.items():
                    if t // 4 != group:
                        group = t // 4
                        drawn_times = np.ascontiguousarray(_times(identity, group, poisson).T)
                    rows = np.flatnonzero(drawn_times[t % 4])
                    node = place.take(_descend(flat, rows, n, feature[t], cut[t], level))
                    if level:
                        kept = node >= 0
                        rows, node = rows[kept], node[kept]
                    times, first = drawn_times[t % 4].take(rows), node * (slots * BINS * 2) + label.take(rows)
                    for s in range(slots):
                        bins = flat.take((drawn[:, s] * n).take(node) + rows)
                        totals += np.bincount(first + (s * BINS * 2) + 2 * bins.astype(np.int64), times, len(totals))
        for t, (_, _, totals) in plans.items():
            yield pa.RecordBatch.from_pydict({"tree": [t], "counts": [totals.tobytes()]}, pa.schema([("tree", pa.int32()), ("counts", pa.binary())]))

    def choose(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        t, active = int(key[0]), shared.value[2]
        drawn = _drawn(seed, t, level, features)[active[t]]
        sums = sum(np.frombuffer(b) for b in found["counts"]).reshape(len(drawn), slots, BINS, 2) * np.asarray(weights)
        total = sums[:, :1].sum(axis=2, keepdims=True)
        left = sums.cumsum(axis=2)[:, :, :-1]
        # Summed from the other end, so that an empty side is exactly zero.
        right = sums[:, :, ::-1].cumsum(axis=2)[:, :, -2::-1]

        def impurity(c):
            w = c.sum(axis=-1)
            return w, 1.0 - ((c / np.maximum(w, 1e-300)[..., None]) ** 2).sum(axis=-1)

        (w, i), (wl, il), (wr, ir) = impurity(total), impurity(left), impurity(right)
        gain = np.where((wl > 0) & (wr > 0), i - wl / w * il - wr / w * ir, -1.0).reshape(len(drawn), -1)
        best, here = gain.argmax(axis=1), np.arange(len(drawn))
        slot, cut = best // (BINS - 1), best % (BINS - 1)
        split = gain[here, best] > 0
        children = np.stack([left[here, slot, cut], right[here, slot, cut]], axis=1)
        children = np.where(split[:, None, None], children, total.reshape(-1, 1, 2))
        chosen = np.where(split, drawn[here, slot], -1).astype(np.int64)
        return pd.DataFrame({"tree": [t], "feature": [chosen.tobytes()], "cut": [cut.astype(np.int64).tobytes()], "children": [children.tobytes()]})

    counted = blocks.mapInArrow(count, "tree int, counts binary").groupBy("tree")
    return counted.applyInPandas(choose, "tree int, feature binary, cut binary, children binary").collect()


def _prune(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> None:
    """From below, two leaves that predict one class become one, as in MLlib's forests; then leaves hand down their value."""
    inner, trees = cut != _NEVER, len(cut)
    for level in reversed(range(depth)):
        here, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        attack = (value[:, below] > 0.5).reshape(trees, -1, 2)
        leaves = ~inner[:, below].reshape(trees, -1, 2).any(axis=2) if level < depth - 1 else True
        inner[:, here] &= ~(leaves & (attack[:, :, 0] == attack[:, :, 1]))
    cut[~inner], feature[~inner] = _NEVER, 0
    for node in range(2**depth - 1):
        leaf = ~inner[:, node]
        value[leaf, 2 * node + 1] = value[leaf, node]


def fit(df: DataFrame, features, *, truth: str, key: str, trees: int, depth: int, seed: int) -> SupervisedModel:
    """Fit with row weights n / (2 * class size), so both classes carry the same total weight.

    Cuts are taken from the ``CUT_SAMPLE`` rows of lowest hash; all rows are counted in all trees. ``key`` identifies a row
    for its draws, as all its values do in a frame without it.
    """
    features = tuple(features)
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    identity = [F.col(key)] if key in df.columns else [*[F.col(f) for f in features], F.col(truth)]
    rows = df.select(F.xxhash64(F.lit(seed), *identity).alias("_h"), F.col(truth).cast("boolean").alias("_y"), *columns)
    names = [f"x{i}" for i in range(len(features))]
    unknown = F.col("_y").isNull()
    for c in names:
        unknown = unknown | F.col(c).isNull() | F.isnan(c)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_y").alias("p"), F.count_if(unknown).alias("unknown")).first()
    n, p = counts["n"], counts["p"]
    if counts["unknown"]:
        raise ValueError(f"{counts['unknown']} training rows lack a feature or the label")
    if p == 0 or p == n:
        raise ValueError("training needs rows of both classes")
    weights = (n / (2.0 * (n - p)), n / (2.0 * p))
    pool = lowest_by_hash(rows.select(hash_order(seed, F.col("_h")).alias("_o"), *names), CUT_SAMPLE, "_o", n)
    sample = np.array([tuple(r) for r in pool.select(*names).collect()], dtype=float)
    cuts = tuple(_cuts(sample[:, i]) for i in range(len(features)))
    blocks = _blocks(rows, cuts, n)

    feature = np.zeros((trees, 2**depth - 1), dtype=np.int8)
    cut = np.full((trees, 2**depth - 1), _NEVER, dtype=np.uint8)
    value = np.zeros((trees, 2 ** (depth + 1) - 1))
    active = np.ones((trees, 1), dtype=bool)
    for level in range(depth):
        following = np.zeros((trees, 2 ** (level + 1)), dtype=bool)
        known = 2**level - 1
        for row in _level(blocks, (feature[:, :known], cut[:, :known], active), level, len(features), seed, weights):
            t, at = row["tree"], np.flatnonzero(active[row["tree"]])
            chosen, bound = (np.frombuffer(row[c], np.int64) for c in ("feature", "cut"))
            children = np.frombuffer(row["children"]).reshape(-1, 2, 2)
            split = chosen >= 0
            feature[t, known + at[split]], cut[t, known + at[split]] = chosen[split], bound[split]
            share = children[:, :, 1] / children.sum(axis=2)
            if level == 0:
                value[t, 0] = children[0, :, 1].sum() / children.sum()
            for side in (0, 1):
                value[t, 2 * known + 1 + 2 * at + side] = share[:, side]
                mixed = split & (children[:, side] > 0).all(axis=1)
                following[t, 2 * at + side] = mixed
        active = following
    _prune(feature, cut, value, depth)
    return SupervisedModel(features, cuts, feature, cut, value[:, 2**depth - 1 :].copy())


def score(df: DataFrame, model: SupervisedModel, name: str) -> DataFrame:
    """Add the mean over the trees of the share of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # trees * 2 ** (depth + 1) nodes, whatever the data is
    features = model.features

    @F.pandas_udf("double")
    def shares(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        levels = m.leaf.shape[1].bit_length() - 1
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            if np.isnan(points).any():
                raise ValueError(f"rows to score lack one of the features {features}")
            flat, rows, total = _bins(points, m.cuts).ravel(), np.arange(len(points)), np.zeros(len(points))
            for feature, cut, leaf in zip(m.feature, m.cut, m.leaf):
                total += leaf.take(_descend(flat, rows, len(points), feature, cut, levels))
            yield pd.Series(total / len(m.leaf))

    return df.withColumn(name, shares(*[F.col(f).cast("double") for f in features]))


def save_model(spark: SparkSession, model: SupervisedModel, path: str) -> None:
    """Two Parquet tables: one row for each tree, one for each feature."""
    trees = [(t, *(part[t].tolist() for part in (model.feature, model.cut, model.leaf))) for t in range(len(model.leaf))]
    spark.createDataFrame(trees, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    cuts = [(i, f, list(c)) for i, (f, c) in enumerate(zip(model.features, model.cuts))]
    spark.createDataFrame(cuts, "position int, name string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")


def load_model(spark: SparkSession, path: str) -> SupervisedModel:
    cuts = spark.read.parquet(f"{path}/cuts").orderBy("position").collect()
    trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
    parts = [np.array([r[c] for r in trees], dtype=d) for c, d in (("feature", np.int8), ("cut", np.uint8), ("leaf", float))]
    return SupervisedModel(tuple(r["name"] for r in cuts), tuple(tuple(r["cuts"]) for r in cuts), *parts)
