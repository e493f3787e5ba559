"""Timestamp parsing for the supported log formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_timestamp(step: Column) -> Column:
    """Hours since the start of 2021 as a timestamp."""
    return F.timestamp_add("HOUR", step.cast("int"), F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"))


def sensor_timestamp(text: Column) -> Column:
    """``28/12/2015 10:00:00 AM`` with a fallback to ISO-like text."""
    text = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d/M/yyyy h:mm:ss a")),
        F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm:ss")),
        F.try_to_timestamp(text),
    )


def twelve_hour_timestamp(text: Column) -> Column:
    """Struct (ts, provenance) for ``D/M/YYYY H:MM[:SS]`` clocks that lost their AM/PM mark.

    Captures run in working hours: 1..7 are afternoon, 8..12 stand as written, any other hour is invalid.
    ``ts`` is null when the text does not fit.
    """
    halves = F.split(F.trim(text), " ", -1)
    date = F.split(F.get(halves, F.lit(0)), "/", -1)
    clock = F.split(F.get(halves, F.lit(1)), ":", -1)
    n = F.size(clock)
    hour = F.get(clock, F.lit(0)).try_cast("int")
    second = F.when(n == 3, F.get(clock, F.lit(2)).try_cast("int")).otherwise(0)
    shape = (F.size(halves) == 2) & (F.size(date) == 3) & n.isin(2, 3) & hour.between(1, 12) & second.between(0, 59)
    ts = F.when(
        shape,
        F.try_make_timestamp_ntz(
            F.get(date, F.lit(2)).try_cast("int"),
            F.get(date, F.lit(1)).try_cast("int"),
            F.get(date, F.lit(0)).try_cast("int"),
            F.when(hour <= 7, hour + 12).otherwise(hour),
            F.get(clock, F.lit(1)).try_cast("int"),
            second.cast("decimal(8,6)"),
        ),
    )
    provenance = F.when(n == 3, "capture_seconds").otherwise("interpolated_minute_bucket")
    return F.struct(ts.alias("ts"), F.when(ts.isNotNull(), provenance).alias("timing_provenance"))
