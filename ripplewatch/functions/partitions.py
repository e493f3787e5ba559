"""Ordered work that survives skew.

Three questions come up whenever rows must be seen in order: how to number them globally, how to look back a
few rows, and how to carry a running value. A plain window answers all of them per key, but a key holding a
third of the data then sits in one task. The helpers here cut the *order* instead of the key: Spark's sampled
range partitioning puts contiguous, similarly sized runs of the sorted data in each partition, whatever the
keys are, and only per-partition summaries meet again afterwards. Where only some keys are hot, only their rows
take that path; all others keep the plain exchange by key.

Range bounds come from sampling, so two evaluations of one plan could disagree. The sorted rows are therefore
checkpointed (reliably, in the folder the cluster names) before anything reads them twice.
"""

import tempfile
from functools import reduce
from math import ceil, log
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS_PER_TASK = 4_000_000
BROADCAST_ROWS = 200_000
_INDEX_BITS = 33


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; make a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting that it stays within ``max_rows``; otherwise let it shuffle.

    The count is one number from each task; a limit before it would send rows through a single one.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def largest_group(df: DataFrame, keys) -> int:
    """Row count of the most frequent key (map-side combined, one row to the driver)."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()
    return (top[0] if top else 0) or 0


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equality join in which null keys meet null keys, as they do in groups and windows."""
    names = {k: f"_right_{k}" for k in keys}
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def hot_keys(df: DataFrame, keys, max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows and their ``_rows``, or None; there are fewer than rows / ``max_rows``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = cut_lineage(counts.filter(F.col("_rows") > max_rows))
    return None if found.isEmpty() else found


def apart(df: DataFrame, keys, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` without and with the rows of the hot keys; the few keys are broadcast, so neither side is shuffled."""
    few = broadcast_if_small(hot.select(*keys))
    return join_null_safe(df, few, keys, "left_anti"), join_null_safe(df, few, keys, "left_semi")


def range_slices(df: DataFrame, order) -> DataFrame:
    """Sort globally by ``order`` and tag rows with ``_slice`` and ``_index`` (position within the slice)."""
    rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    rows = cut_lineage(rows)
    return (
        rows.withColumn("_slice", F.shiftright("_pos", _INDEX_BITS))
        .withColumn("_index", F.col("_pos").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
        .drop("_pos")
    )


def with_rank(df: DataFrame, order, name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based global position in ``order`` (and optionally the row count), with no single-task window.

    Only one row per range partition meets in the offset window, and that table is what gets broadcast.
    """
    rows = range_slices(df, order)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    out = rows.join(F.broadcast(offsets), "_slice").withColumn(name, F.col("_offset") + F.col("_index") + 1)
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_slice", "_index", "_offset", "_total")


def hash_rank(df: DataFrame, key: Column, within=(), name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based rank by an md5 sort key, optionally within a few classes.

    Hash prefixes split the rows evenly without sampling, so no checkpoint is needed: rows are numbered inside a
    prefix cell, of which there are as many as keep about 65,536 rows or fewer in each, and the cell offsets are
    a small table.
    """
    within = list(within)
    digits = max(3, ceil(log(max(df.count() / 65_536, 1), 16)))
    rows = df.withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, digits))
    cells = rows.groupBy(*within, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    scope = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = scope.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *within,
        "_cell",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(scope).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*within, "_cell").orderBy("_key"))
    cells = broadcast_if_small(cells)
    out = rows.withColumn("_local", local).join(cells, [*within, "_cell"])
    out = out.withColumn(name, F.col("_offset") + F.col("_local"))
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_key", "_cell", "_local", "_offset", "_total")


def lowest_by_hash(df: DataFrame, limit: int, order: str, rows: int) -> DataFrame:
    """The ``limit`` rows of least ``order``, an evenly spread hexadecimal hash, of a table of ``rows`` rows.

    A threshold on the hash leaves little more than ``limit`` rows before they are sorted, so partitions do not each
    send ``limit`` rows to the task that picks; it is doubled in the rare case that it leaves too few.
    """
    share = 1.2 * (limit + 100) / max(rows, 1)
    while share < 0.5:
        near = df.filter(F.substring(order, 1, 8) < f"{int(share * 16**8):08x}")
        if near.count() >= limit:
            return near.orderBy(order).limit(limit)
        share *= 2
    return df.orderBy(order).limit(limit)


def cut_by_key(df: DataFrame, keys, order, max_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of keys with more than ``max_rows`` rows (None without such keys).

    Both get ``_slice``, so that every (keys, _slice) group is a bounded, contiguous run of its key's order. Ordinary
    keys are one slice, 0, and take no part in what follows for the hot ones: only the hot keys' rows are range
    partitioned by (keys, order), which cuts them wherever they are hot, and stored.
    """
    hot = hot_keys(df, keys, max_rows)
    if hot is None:
        return df.withColumn("_slice", F.lit(0).cast("bigint")), None
    rest, heavy = apart(df, keys, hot)
    return rest.withColumn("_slice", F.lit(0).cast("bigint")), range_slices(heavy, [*keys, *order]).drop("_index")


def with_lookback(df: DataFrame, keys, order, rows: int, *, max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """``cut_by_key`` plus, in each slice, copies of the key's ``rows`` preceding rows, marked ``_halo``.

    Windows over (keys, _slice) that look back at most ``rows`` rows are then exact on the rows where ``_halo``
    is false. Only the last ``rows`` rows of a slice of a hot key are ever copied.
    """
    rest, cut = cut_by_key(df, keys, order, max_rows)
    rest = rest.withColumn("_halo", F.lit(False))
    if cut is None:
        return rest
    keys = list(keys)
    from_end = Window.partitionBy(*keys, "_slice").orderBy(*[F.col(c).desc() for c in order])
    tails = cut.withColumn("_back", F.row_number().over(from_end)).filter(F.col("_back") <= rows).drop("_back")
    slices = tails.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_upto"))
    # One array per key, no longer than the number of range partitions.
    plan = slices.groupBy(*keys).agg(F.collect_list(F.struct("_slice", "_upto")).alias("_plan"))
    plan = plan.filter(F.size("_plan") > 1)
    place = Window.partitionBy(*keys).orderBy(*order)
    halo = (
        join_null_safe(
            join_null_safe(tails, plan.select(*keys), keys, "left_semi").withColumn("_place", F.row_number().over(place)),
            plan,
            keys,
        )
        .withColumn(
            "_goal",
            F.explode(
                F.filter(
                    "_plan",
                    lambda s: (s["_slice"] > F.col("_slice")) & (s["_upto"] < F.col("_place") + rows),
                )
            ),
        )
        .withColumn("_slice", F.col("_goal._slice"))
        .drop("_plan", "_goal", "_place")
        .withColumn("_halo", F.lit(True))
    )
    return rest.unionByName(cut.withColumn("_halo", F.lit(False))).unionByName(halo)
