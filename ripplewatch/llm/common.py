"""Shared pieces of the training-data operators: shared folders, ordered buckets and Arrow helpers."""

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4096
MOST_BUCKETS = 100_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later readers never recompute it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_buckets(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_bucket``: contiguous ranges of ``key`` holding about ``rows_per_bucket`` rows, in key order.

    The bounds are approximate quantiles, so they balance the buckets but never decide a result. Null keys go
    first. Unlike Spark's own range partitioning the bounds are values, hence the same in every evaluation. There are
    at most ``MOST_BUCKETS`` buckets, which then hold more rows, so a table with a row for each bucket stays small.
    """
    n = df.count()
    wanted = min(-(-n // rows_per_bucket), MOST_BUCKETS)
    bounds = np.zeros(0, np.int64)
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        error = max(0.1 / wanted, 1e-5)
        bounds = np.unique(np.asarray(df.approxQuantile(key, shares, error), np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, keys.fillna(-(2**62)).to_numpy(np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    return df.withColumn("_bucket", bucket(F.col(key).cast("long")))


def slices(batches, rows: int = 1024):
    """The rows of Arrow batches a thousand at a time, so that no task holds a whole batch as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    """The texts of an Arrow batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to clash with no column of ``df``."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """The two columns the text operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)

