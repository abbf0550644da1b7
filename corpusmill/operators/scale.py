"""Building blocks that keep hot keys and large sides off a single task.

* ``small_side``   broadcasts a side only after its row count was checked.
* ``running``      running sum or maximum per key, split by time bucket, so that
                   one key's history is never sorted in one task.
* ``latest_before`` as-of join on top of ``running``: no pairs are formed.
* ``top_n``        top n per key in two steps, for n too large for Spark's own
                   group limit.
* ``stage``        writes an intermediate table to the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
# Rows of a key and little else, some 50 bytes each, that may be broadcast; far cheaper than to shuffle the texts or the index they are joined to.
NARROW_ROWS = 2_000_000
HOUR_US = 3_600_000_000


def within(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; stops counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def row_bound(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> int | None:
    """The number of rows, or None if there are more than ``max_rows``."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def at_most(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, a proven bound on its size, is small enough."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, otherwise unchanged.

    Without the hint Spark joins by shuffling, and adaptive execution splits
    skewed partitions.
    """
    return F.broadcast(df) if within(df, max_rows) else df


def running(
    rows: DataFrame,
    keys: list[str],
    at: str,
    value: Column,
    how: str,
    name: str,
    width_us: int = HOUR_US,
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` per key in order of ``at``.

    Rows with the same time see each other. Each key is cut into time buckets:
    bucket totals are pre-aggregated, their running value becomes one carry row
    at the start of each bucket, and the window runs inside (key, bucket) only.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    micros = F.unix_micros(F.col(at))
    cut = rows.withColumns(
        {"_at": micros, "_bucket": F.floor(micros / F.lit(width_us)).cast("long"), "_v": value}
    )
    totals = cut.groupBy(*keys, "_bucket").agg(combine("_v").alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_bucket",
        combine("_v").over(before).alias("_v"),
        F.lit(-(2**63)).cast("long").alias("_at"),
        F.lit(True).alias("_carry"),
    ).filter(F.col("_v").isNotNull())
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at")
    return (
        cut.withColumn("_carry", F.lit(False))
        .unionByName(carry, allowMissingColumns=True)
        .withColumn(name, combine("_v").over(inside))
        .filter(~F.col("_carry"))
        .drop("_at", "_bucket", "_v", "_carry")
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    payload: list[str],
    name: str = "match",
    width_us: int = HOUR_US,
) -> DataFrame:
    """Adds to each left row the newest right row of the same key not later than it.

    The match is a struct of ``right_at`` and ``payload`` (null if there is none).
    Of several right rows at one instant the one with the greatest payload wins.
    """
    entry = F.struct(F.col(right_at).alias("at"), *[F.col(c).alias(c) for c in payload])
    marks = right.select(*keys, F.col(right_at).alias("_time"), entry.alias("_entry"), F.lit(False).alias("_left"))
    asks = left.withColumns({"_time": F.col(left_at), "_left": F.lit(True)})
    both = asks.unionByName(marks, allowMissingColumns=True)
    found = running(both, keys, "_time", F.col("_entry"), "max", name, width_us)
    return found.filter(F.col("_left")).drop("_time", "_entry", "_left")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str], salts: int = 64) -> DataFrame:
    """The first ``n`` rows per key, in two steps so that no task sorts a whole key.

    Rows are spread over ``salts`` parts of each key, each part keeps its first
    ``n`` and only those meet: at most ``salts * n`` rows per key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_n", F.row_number().over(part))
        .filter(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(whole))
        .filter(F.col("_n") <= n)
        .drop("_n", "_salt")
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the 1-based position per key; with ``n``, keeps the first n (pushed below the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if n is None else out.filter(F.col(name) <= n)


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out if it came as fewer splits than there are cores; a large one has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"corpusmill-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local master, where all tasks run on one machine, may go without one and gets a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
