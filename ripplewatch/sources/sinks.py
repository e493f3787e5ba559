"""Parquet sinks with idempotent appends, and table-level reports."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ripplewatch.functions.partitions import ensure_checkpoint_dir

EVENT_KEY = ("session_id", "source_row_id")
DAY = "event_date"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def existing_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or nothing when none has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table or partition folder."""
    fs, target, _ = _file_system(spark, path)
    fs.delete(target, True)


def swap_folder(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in the place of ``path``."""
    fs, target, as_path = _file_system(spark, path)
    fs.delete(target, True)
    if not fs.rename(as_path(fresh), target):
        raise OSError(f"cannot move {fresh} to {path}")
    spark.catalog.refreshByPath(path)


def new_rows(batch: DataFrame, stored: DataFrame | None, keys=EVENT_KEY) -> DataFrame:
    """Batch rows whose key is neither repeated in the batch nor stored already."""
    unique = batch.dropDuplicates(list(keys))
    return unique if stored is None else unique.join(stored.select(*keys), list(keys), "left_anti")


def write_events(batch: DataFrame, path: str, *, keys=EVENT_KEY, ts: str = "ts") -> dict[str, int]:
    """Append new events, partitioned by day; returns received, inserted and deduplicated counts.

    A key counts as stored whatever the timestamp it came with, so a corrected date does not insert it again: the
    keys of all stored rows are compared, two columns of the table. Inserted rows are counted inside the write, above its
    last shuffle: AQE drops the plan below a shuffle that turns out empty, and what is observed there with it.
    """
    seen, received = Observation(), batch.count()
    dated = batch.withColumn(DAY, F.to_date(ts))
    stored = existing_table(batch.sparkSession, path)
    # One file per day where days are small; AQE splits a day that holds much of the batch.
    fresh = new_rows(dated, stored, keys).hint("rebalance", DAY).observe(seen, F.count(F.lit(1)).alias("inserted"))
    fresh.write.mode("append").partitionBy(DAY).parquet(path)
    inserted = seen.get["inserted"]
    return {"received": received, "inserted": inserted, "deduplicated": received - inserted}


def append_table(df: DataFrame, path: str, *, partition_by=()) -> None:
    """Plain append for score, alert, snapshot and action rows."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


MUTABLE = ("ip", "type", "criticality", "purdue_level", "is_gateway")


def upsert_assets(current: DataFrame, desired: DataFrame, *, fields=MUTABLE) -> tuple[DataFrame, DataFrame]:
    """(merged table, report): desired rows win, stale rows stay; the report counts rows per outcome.

    Outcomes are created, updated, unchanged and stale; fields compare null-safe.
    """
    a = current.select("name", F.struct(*fields).alias("_old"))
    b = desired.select("name", F.struct(*fields).alias("_new"))
    both = a.join(b, "name", "full_outer")
    outcome = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), "stale")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    both = both.withColumn("outcome", outcome).withColumn("_row", F.coalesce("_new", "_old"))
    return both.select("name", "_row.*", "outcome"), both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
