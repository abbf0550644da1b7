"""Relational tables from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of chunk and document metadata that older rows lack.
DEFAULTS = {"tenant_id": 1, "doc_level": "public", "min_level": 1}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
    ).load()


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing tenant, level and minimum level get their defaults, whether column or value is missing."""
    for name, value in DEFAULTS.items():
        column = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        df = df.withColumn(name, column)
    return df
