"""Sinks for evaluation reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def write_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """One summary row and the rows per question, numbers to four decimals."""
    _rounded(summary).write.mode("overwrite").json(f"{path}/summary")
    _rounded(detail).write.mode("overwrite").json(f"{path}/detail")


def append_stats(stats: DataFrame, path: str) -> None:
    """Adds parse statistics to an append-only log."""
    stats.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
