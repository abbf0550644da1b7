"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of up to this many rows may be broadcast; every caller counts first and shuffles a larger one.
BROADCAST_ROWS = 50_000
#: A key with more than this share of the rows is hot; there are no more than its inverse of them.
HOT = 1 / 200


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without one; it gets a folder of its own below the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from now on, so that a lost executor costs only its tasks."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffles, broadcasts and checkpoints that nothing refers to any more; a long row of jobs otherwise keeps them on disk, and their plans in the heap."""
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder that no other call uses."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written by columns to the shared folder and read from there: smaller than ``keep``, and what numbers or deals its rows is fixed from then on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows, which are counted up to that bound; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def spread_join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has every key once: keys that hold more than ``HOT`` of ``many`` are broadcast, so none meets in one task."""
    number = many.count()
    hot = keep(many.groupBy(*keys).count().where(F.col("count") > max(HOT * number, 1000)).drop("count"))
    if hot.isEmpty():
        return many.join(one, keys)
    # fewer than 1 / HOT keys can hold more than HOT of the rows each
    those = F.broadcast(hot)
    common = many.join(those, keys, "left_semi").join(F.broadcast(one.join(those, keys, "left_semi")), keys)
    return many.join(those, keys, "left_anti").join(one, keys).unionByName(common)
