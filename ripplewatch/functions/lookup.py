"""Small expression helpers built only from JVM-side functions."""

from collections.abc import Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_lookup(mapping: dict, key: Column) -> Column:
    """Look ``key`` up in a literal map; a missing key gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*mapping.items())]), key)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def micros_between(start, end) -> Column:
    """Whole microseconds from ``start`` to ``end``; works for both timestamp kinds."""
    return F.timestamp_diff("MICROSECOND", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 for a timestamp with or without a zone."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def noisy_or(probabilities: Column) -> Column:
    """1 - prod(1 - p) over an array column."""
    return 1.0 - F.aggregate(probabilities, F.lit(1.0), lambda acc, p: acc * (1.0 - p))


def uniform_draw(*parts) -> Column:
    """A repeatable draw in [0, 1): 52 bits of an md5 over the parts.

    The draw depends only on the parts, so neither partitioning nor a lost executor changes it.
    """
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def draw_threshold(probability: Column) -> Column:
    """The 13 hexadecimal digits under which ``draw_below`` finds the digits of every draw below ``probability``."""
    digits = F.lower(F.lpad(F.hex(F.ceil(probability * F.lit(float(2**52)))), 13, "0"))
    return F.when(probability >= 1.0, "g").when(probability <= 0.0, "").otherwise(digits)


def draw_below(threshold: Column, *parts) -> Column:
    """Whether ``uniform_draw`` of the parts is below the probability of a ``draw_threshold``, without making a number."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.substring(F.md5(text.cast("binary")), 1, 13) < threshold


def hash_order(*parts) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def ladder(*steps, default=None) -> Column:
    """``when`` chain from (condition, value) pairs, first match wins."""
    out = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps may filter on or reference many times.

    ``inline`` makes them outputs of one operator, evaluated once per row. Plain ``withColumn`` would let the
    optimizer copy a large expression into every filter and projection that mentions it.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(row)))


def moment(df: DataFrame, column: str, value) -> Column:
    """A collected timestamp as a literal of the column's own kind, whatever the session's time zone is."""
    kind = df.schema[column].dataType
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value)
