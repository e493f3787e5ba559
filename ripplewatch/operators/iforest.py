"""Isolation forest: fitted as a grouped job, scored in Arrow batches.

The published algorithm: each tree isolates a small sample with random axis-parallel cuts, and rows that are
isolated early are anomalous. Samples are chosen by an md5 order, so a fit does not depend on partitioning. The
fitted trees have a fixed maximum size (trees x 2 x sample nodes), which is what makes broadcasting them safe.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplewatch import settings as S
from ripplewatch.functions.lookup import hash_order
from ripplewatch.functions.partitions import cut_lineage, lowest_by_hash
from ripplewatch.functions.quantile import exact_quantiles

_NODE = "tree int, node int, feature int, cut double, low int, high int, depth double"
_EULER = 0.5772156649015329


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` points, the value a leaf of size ``n`` stands for."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass(frozen=True)
class ForestModel:
    """Fitted trees as one small table, plus what scoring needs to refuse a mismatch."""

    nodes: pd.DataFrame
    features: tuple[str, ...]
    sample_size: int
    offset: float
    contamination: float


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int):
    """Nodes of one tree; ``points`` is at most a few hundred rows."""
    nodes = []
    work = [(np.arange(len(points)), 0, -1, False)]
    while work:
        rows, depth, parent, is_high = work.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_high else 3] = me
        spans = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spans > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([me, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        axis = int(rng.choice(usable))
        column = points[rows, axis]
        cut = float(rng.uniform(column.min(), column.max()))
        nodes.append([me, axis, cut, -1, -1, float(depth)])
        work.append((rows[column > cut], depth + 1, me, True))
        work.append((rows[column <= cut], depth + 1, me, False))
    return nodes


def fit_iforest(
    df: DataFrame,
    features=S.FEATURES,
    *,
    key: str = "event_id",
    trees: int = S.FOREST_TREES,
    sample: int = S.FOREST_SAMPLE,
    contamination: float = S.FOREST_CONTAMINATION,
    seed: int = S.SEED,
) -> ForestModel:
    """Fit on a frame of numeric features; ``key`` identifies a row for the sampling order.

    At most ``trees * sample`` rows are drawn from the table (a top-k by hash). Each tree takes a contiguous arc
    of that random order, wrapping around when the table is smaller, so every tree sees distinct rows.
    """
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    features = tuple(features)
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    order = hash_order(seed, F.col(key))
    pool = lowest_by_hash(df.select(order.alias("_o"), *columns), trees * sample, "_o", df.count())
    # The pool is bounded by trees * sample rows, so numbering it in one task is safe.
    numbered = pool.withColumn("_p", F.row_number().over(Window.orderBy("_o")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy())
    )
    size = F.least(F.lit(sample), F.col("_n"))
    tree = F.explode(
        F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.pmod(F.col("_p") - t * size, F.col("_n")) < size,
        )
    )
    names = [f"x{i}" for i in range(len(features))]

    def grow(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index = int(group[0])
        points = rows.sort_values("_o")[names].to_numpy(dtype=float)
        limit = max(1, ceil(log2(max(len(points), 2))))
        nodes = _grow(points, np.random.default_rng([seed, index]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "low", "high", "depth"])
        out.insert(0, "tree", index)
        return out.assign(size=len(points))

    grown = numbered.withColumn("tree", tree).select("tree", "_o", *names).groupBy("tree").applyInPandas(grow, _NODE + ", size int")
    nodes = grown.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    if nodes.empty:
        raise ValueError("cannot fit on an empty frame")
    used = int(nodes.pop("size").max())
    model = ForestModel(nodes, features, used, 0.0, contamination)
    # One number per row, stored: the quantile reads it several times and scoring is what costs.
    scores = cut_lineage(_score_samples(df.select(*features), model).select("_s"))
    (offset,) = exact_quantiles(scores, "_s", [contamination])
    return ForestModel(nodes, features, used, offset, contamination)


class _Walker:
    """All trees as complete binary trees of one depth, so a batch descends them in a fixed number of steps.

    A leaf above the last level repeats itself: its cut is infinite, so rows keep going left to a copy of its value.
    """

    def __init__(self, model: ForestModel):
        nodes = model.nodes.sort_values(["tree", "node"])
        self.levels = max(1, ceil(log2(max(model.sample_size, 2))))
        inner = 2**self.levels - 1
        trees = [g[["feature", "cut", "low", "high", "depth"]].to_numpy() for _, g in nodes.groupby("tree")]
        self.feature = np.zeros((len(trees), inner), dtype=np.intp)
        self.cut = np.full((len(trees), inner), np.inf)
        self.leaf = np.zeros((len(trees), inner + 1))
        for t, tree in enumerate(trees):
            place = [(0, 0)]
            while place:
                at, node = place.pop()
                feature, cut, low, high, depth = tree[int(node)]
                if at >= inner:
                    self.leaf[t, at - inner] = depth
                elif feature < 0:
                    place.append((2 * at + 1, node))
                else:
                    self.feature[t, at], self.cut[t, at] = int(feature), cut
                    place += [(2 * at + 1, low), (2 * at + 2, high)]
        self.norm = float(average_path(model.sample_size)) or 1.0

    def score(self, points: np.ndarray) -> np.ndarray:
        points = np.ascontiguousarray(points, dtype=float)
        values, base = points.ravel(), np.arange(len(points)) * points.shape[1]
        total = np.zeros(len(points))
        inner = self.cut.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(points), dtype=np.intp)
            for _ in range(self.levels):
                at = 2 * at + 1 + (values[base + feature[at]] > cut[at])
            total += leaf[at - inner]
        return -np.exp2(-(total / len(self.cut)) / self.norm)


def _score_samples(df: DataFrame, model: ForestModel, name: str = "_s") -> DataFrame:
    # At most trees * 2 * sample nodes, whatever the data is.
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        walker = _Walker(broadcast.value)
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(walker.score(points))

    return df.withColumn(name, score(*[F.col(f).cast("double") for f in model.features]))


def score_iforest(df: DataFrame, model: ForestModel) -> DataFrame:
    """Add ``raw_score`` (decision value, negative = anomalous), ``score`` in (0, 1) and ``fired``."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"model expects features {model.features}; missing {missing}")
    out = _score_samples(df, model, "_s").withColumn("raw_score", F.col("_s") - F.lit(model.offset)).drop("_s")
    return out.withColumns(
        {"score": 1.0 / (1.0 + F.exp(5.0 * F.col("raw_score"))), "fired": F.col("raw_score") < 0}
    )


def fit_warmup(
    df: DataFrame,
    features=S.FEATURES,
    *,
    truth: str = "is_attack",
    key: str = "event_id",
    ts: str = "ts",
    min_rows: int = S.WARMUP_MIN_ROWS,
    contamination: float = S.WARMUP_CONTAMINATION,
    trees: int = S.FOREST_TREES,
) -> tuple[ForestModel, list, dict]:
    """Fit once on a benign slice: forest on scaled features, scaler statistics, warm-up metadata.

    Refuses a slice that is too short or holds any attack row.
    """
    from ripplewatch.operators.volumetric import apply_scaler, fit_scaler

    meta = warmup_metadata(df, truth=truth, ts=ts).first().asDict()
    if meta["rows"] < min_rows:
        raise ValueError(f"warm-up needs at least {min_rows} rows, got {meta['rows']}")
    if meta["attacks"]:
        raise ValueError(f"warm-up slice holds {meta['attacks']} attack rows")
    scaler = fit_scaler(df, features)
    scaled = apply_scaler(df, scaler)
    model = fit_iforest(scaled, [f"z_{f}" for f in features], key=key, trees=trees, contamination=contamination)
    return model, scaler, meta


def warmup_metadata(df: DataFrame, *, truth: str = "is_attack", ts: str = "ts") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(truth)).alias("attacks"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def save_model(spark: SparkSession, model: ForestModel, path: str, *, day: str = "") -> None:
    """Persist as two Parquet tables: tree nodes and one metadata row."""
    spark.createDataFrame(model.nodes, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(list(model.features), model.sample_size, model.offset, model.contamination, day)]
    spark.createDataFrame(
        meta, "features array<string>, sample_size int, offset double, contamination double, day string"
    ).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str, *, features=None) -> ForestModel:
    """Load a stored model; refuses one fitted on other features."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if features is not None and tuple(features) != tuple(meta["features"]):
        raise ValueError(f"stored model has features {meta['features']}, expected {list(features)}")
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    return ForestModel(nodes, tuple(meta["features"]), meta["sample_size"], meta["offset"], meta["contamination"])
