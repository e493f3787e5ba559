"""Exact quantiles of large columns.

Spark's ``percentile`` keeps every distinct value of a group in one task. For whole-table quantiles the value is
bracketed with mergeable sketches first, and the exact percentile is taken inside a bracket small enough for one
task. The result equals linear interpolation over the sorted column.
"""

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 2_000_000
_ACCURACY = 100_000


def exact_quantiles(df: DataFrame, column: str, points, *, small: int = SMALL) -> list[float | None]:
    """Linear-interpolation quantiles of one numeric column; a list of floats (bounded, driver side)."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    points = [float(p) for p in points]
    n = values.count()
    if n == 0:
        return [None] * len(points)
    if n <= small:
        row = values.agg(F.percentile("v", F.array(*[F.lit(p) for p in points]))).first()
        return [float(x) for x in row[0]]
    return [_one(values, n, p, small) for p in points]


def _one(values: DataFrame, n: int, point: float, small: int) -> float:
    position = point * (n - 1)
    low_rank, weight = floor(position), position - floor(position)
    high_rank = min(low_rank + 1, n - 1)
    lo, hi = float("-inf"), float("inf")
    below, inside = 0, n
    while inside > small:
        rows = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        step = 4 * inside / _ACCURACY
        marks = [max(low_rank - below - step, 0) / inside, min((high_rank - below + step) / inside, 1.0)]
        a, b = rows.agg(F.percentile_approx("v", F.array(*[F.lit(m) for m in marks]), _ACCURACY)).first()[0]
        counts = values.agg(
            F.count_if(F.col("v") < a).alias("below"),
            F.count_if((F.col("v") >= a) & (F.col("v") <= b)).alias("inside"),
        ).first()
        if counts["below"] > low_rank or counts["below"] + counts["inside"] <= high_rank:
            break  # the sketch missed the bracket; finish on the last bracket known to hold both ranks
        if a == b:
            return float(a)
        if counts["inside"] >= inside:
            break
        lo, hi, below, inside = a, b, counts["below"], counts["inside"]
    # Distinct values with counts keep this bounded even when one value repeats many times.
    rows = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    if inside == 1:
        return float(rows.first()[0])
    span = inside - 1
    marks = [(low_rank - below) / span, (high_rank - below) / span]
    a, b = rows.agg(F.percentile("v", F.array(*[F.lit(m) for m in marks]))).first()[0]
    return float(a) if weight == 0 else float(a) + (float(b) - float(a)) * weight


def exact_medians(df: DataFrame, columns: dict, *, small: int = SMALL) -> dict[str, float | None]:
    """Medians of several numeric expressions; one pass over a table that fits one task, else bracketed one by one."""
    if df.count() <= small:
        row = df.agg(*[F.percentile(c.cast("double"), F.lit(0.5)).alias(n) for n, c in columns.items()]).first()
        return {n: None if row[n] is None else float(row[n]) for n in columns}
    return {n: exact_quantiles(df.select(c.alias("x")), "x", [0.5], small=small)[0] for n, c in columns.items()}


CELLS = 4096
FINE = 10_000


def _cell_of_rank(values: DataFrame, rank: int) -> tuple[int, int, int]:
    """(low, high, rank inside): a range of the whole number ``v`` that holds the row at ``rank``, and few others.

    Each round is one map-side combined count over at most ``CELLS`` cells.
    """
    span = values.agg(F.min("v"), F.max("v")).first()
    low, high = span[0], span[1]
    while True:
        width = max(1, -(-(high - low + 1) // CELLS))
        inside = values.filter(F.col("v").between(low, high))
        cells = inside.groupBy(F.floor((F.col("v") - low) / width).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        for cell, n in sorted(tuple(r) for r in cells.collect()):
            if rank <= n:
                break
            rank -= n
        low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
        if width == 1 or n <= FINE:
            return low, high, rank


def boundary_row(df: DataFrame, ts: str, tie: str, rank: int):
    """(microseconds, tie) of the row at 1-based ``rank`` in the order of (ts, tie), without sorting the table.

    Timestamps are narrowed to one that holds the rank, then the whole-number ``tie`` among its rows. Rows with a null
    time or tie are not counted. At most ``FINE`` rows meet in the final, exact step.
    """
    rows = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).cast("bigint").alias("tie")).dropna()
    low, high, rank = _cell_of_rank(rows.select(F.col("us").alias("v")), rank)
    rows = rows.filter(F.col("us").between(low, high))
    if low == high:
        a, b, rank = _cell_of_rank(rows.select(F.col("tie").alias("v")), rank)
        rows = rows.filter(F.col("tie").between(a, b))
        if a == b:
            return low, a
    edge = rows.orderBy("us", "tie").limit(rank).agg(F.max(F.struct("us", "tie")).alias("e")).first()["e"]
    return edge["us"], edge["tie"]


def not_after(ts: str, tie: str, edge):
    """Whether a row stands at or before ``edge`` in the order of (ts, tie)."""
    us, key = F.unix_micros(F.col(ts).cast("timestamp")), F.col(tie).cast("bigint")
    return (us < edge[0]) | ((us == edge[0]) & (key <= edge[1]))
