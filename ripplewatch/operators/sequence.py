"""Ordered operators: tie spreading, splits, segments, rolling trends, retention."""

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ripplewatch import settings as S
from ripplewatch.functions.lookup import epoch_micros, moment
from ripplewatch.functions.partitions import MAX_ROWS_PER_TASK, cut_by_key, join_null_safe, range_slices, with_rank
from ripplewatch.functions.quantile import boundary_row, not_after


def spread_ties(df: DataFrame, *, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``virtual_sec``: the k-th of n rows sharing a timestamp moves k/n of the way to the next timestamp.

    The last run reuses the gap before it. Only the distinct timestamps are put in order globally; positions
    inside a run come from a rank over the rows minus the number of rows before the run.
    """
    ranked = with_rank(df, [ts, tie], "_rank")
    runs = ranked.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first"))
    runs = runs.withColumn("_us", epoch_micros(F.col(ts)))
    placed = with_rank(runs, [ts], "_run")
    # The neighbour's time comes by an equality join on the run number.
    following = placed.select((F.col("_run") - 1).alias("_run"), F.col("_us").alias("_next"))
    earlier = placed.select((F.col("_run") + 1).alias("_run"), F.col("_us").alias("_previous"))
    gaps = placed.join(following, "_run", "left").join(earlier, "_run", "left")
    gap = F.coalesce(F.col("_next") - F.col("_us"), F.col("_us") - F.col("_previous"), F.lit(0)) / 1e6
    gaps = gaps.select(ts, "_n", "_first", "_us", gap.alias("_gap"))
    share = (F.col("_rank") - F.col("_first")) / F.col("_n")
    out = ranked.join(gaps, ts).withColumn("virtual_sec", F.col("_us") / 1e6 + share * F.col("_gap"))
    return out.drop("_rank", "_n", "_first", "_us", "_gap")


def temporal_split(df: DataFrame, *, fraction: float = S.SPLIT_FRACTION, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``part``: the first floor(n * fraction) rows in time are ``train``, the rest ``test``."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    first = floor(df.count() * fraction)
    if isinstance(df.schema[tie].dataType, IntegralType):  # one boundary row, then a filter
        train = not_after(ts, tie, boundary_row(df, ts, tie, first)) if first else F.lit(False)
        return df.withColumn("part", F.when(train, "train").otherwise("test"))
    ranked = with_rank(df, [ts, tie], "_rank")
    return ranked.withColumn("part", F.when(F.col("_rank") <= first, "train").otherwise("test")).drop("_rank")


def segments(
    df: DataFrame,
    order,
    *,
    keys=(),
    truth: str = "truth",
    pred: str | None = "pred",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Maximal runs of true rows: ``start`` and ``end`` (order structs), ``rows`` and ``detected``.

    Runs are found inside bounded slices of the order; a run that touches a slice border is then merged with its
    continuation. At most two runs per slice touch a border, so the merge is small whatever the data is. Keys that
    fit a task are not cut, and only the columns named here are shuffled.
    """
    keys, order = list(keys), list(order)
    df = df.select(*dict.fromkeys([*keys, *order, truth, *([pred] if pred else [])]))
    if keys:
        rest, cut = cut_by_key(df, keys, order, max_rows)
    else:
        rest, cut = None, range_slices(df, order).drop("_index")
    at = F.struct(*order)
    hit = F.max(F.col(pred).cast("boolean")) if pred else F.lit(None).cast("boolean")
    flag = F.coalesce(F.col(truth).cast("boolean"), F.lit(False))

    def found(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        rows = part.withColumn("_y", flag).withColumn("_start", F.col("_y") & ~F.coalesce(F.lag("_y").over(w), F.lit(False)))
        rows = rows.withColumn("_run", F.sum(F.col("_start").cast("int")).over(w))
        return rows.filter("_y").groupBy(*keys, "_slice", "_run").agg(
            F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("rows"), hit.alias("detected")
        )

    keep = [*keys, "start", "end", "rows", "detected"]
    if cut is None:
        return found(rest).select(*keep)
    edges = cut.groupBy(*keys, "_slice").agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    edges = edges.withColumn("_ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")))
    runs = join_null_safe(found(cut), edges, [*keys, "_slice"]).withColumns(
        {"_opens": F.col("start") == F.col("_low"), "_closes": F.col("end") == F.col("_high")}
    )
    inner = runs.filter(~F.col("_opens") & ~F.col("_closes")).select(*keep)
    border = runs.filter(F.col("_opens") | F.col("_closes"))
    along = Window.partitionBy(*keys).orderBy("start")
    joined = (
        F.col("_opens")
        & F.coalesce(F.lag("_closes").over(along), F.lit(False))
        & (F.lag("_ordinal").over(along) == F.col("_ordinal") - 1)
    )
    border = border.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int"))
    border = border.withColumn("_group", F.sum("_new").over(along))
    merged = border.groupBy(*keys, "_group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows"),
        F.max("detected").alias("detected"),
    )
    whole = inner.unionByName(merged.select(*keep))
    return whole if rest is None else found(rest).select(*keep).unionByName(whole)


def rolling_trend(
    samples: DataFrame, *, value: str, ts: str = "ts", tie: str = "event_id", slot: str = "2 seconds", keep_sec: int = 1800
) -> DataFrame:
    """The last value per time slot over the newest ``keep_sec`` seconds."""
    newest = samples.agg(F.max(ts)).first()[0]
    recent = samples.filter(F.col(ts) >= moment(samples, ts, newest) - F.make_dt_interval(secs=F.lit(keep_sec)))
    return recent.groupBy(F.window(ts, slot)["start"].alias("slot")).agg(
        F.max_by(value, F.struct(ts, tie)).alias(value)
    )


def retention_victims(
    events: DataFrame,
    *,
    max_rows: int | None = S.RETENTION_ROWS,
    max_age_sec: int | None = None,
    now=None,
    ts: str = "ts",
    key: str = "event_id",
) -> DataFrame:
    """Rows to prune: beyond the newest ``max_rows``, or older than ``max_age_sec`` before ``now``."""
    return events.filter(is_victim(events, max_rows=max_rows, max_age_sec=max_age_sec, now=now, ts=ts, key=key))


def is_victim(
    events: DataFrame,
    *,
    max_rows: int | None = S.RETENTION_ROWS,
    max_age_sec: int | None = None,
    now=None,
    ts: str = "ts",
    key: str = "event_id",
) -> Column:
    """Whether a row is pruned. The cap is one boundary row, narrowed by counts, so that pruning is a filter. ``key`` is a whole number."""
    victim = F.lit(False)
    if max_rows is not None:
        over = events.count() - max_rows
        if over > 0:
            victim = victim | not_after(ts, key, boundary_row(events, ts, key, over))
    if max_age_sec is not None:
        newest = events.agg(F.max(ts)).first()[0] if now is None else now
        victim = victim | (F.col(ts) < moment(events, ts, newest) - F.make_dt_interval(secs=F.lit(max_age_sec)))
    return F.coalesce(victim, F.lit(False))


def retain(
    events: DataFrame,
    *,
    max_rows: int | None = S.RETENTION_ROWS,
    max_age_sec: int | None = None,
    now=None,
    ts: str = "ts",
    key: str = "event_id",
) -> DataFrame:
    """The rows that survive; see ``retention_victims``."""
    return events.filter(~is_victim(events, max_rows=max_rows, max_age_sec=max_age_sec, now=now, ts=ts, key=key))
