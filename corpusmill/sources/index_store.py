"""The index on disk: one Parquet table per part, partitioned by document bucket.

A document lives in one bucket of every table, so replacing or removing
documents rewrites their buckets and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.lexical import LexicalIndex, corpus_size, document_frequency, with_idf
from corpusmill.operators.scale import small_side, stage

BUCKETS = 64
TABLES = ["chunks", "parents", "postings", "vectors"]


def bucket_of(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def write_index(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    for name, table in tables.items():
        bucketed = table.withColumn("doc_bucket", bucket_of(buckets))
        bucketed.write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names or TABLES}
    return {name: table.filter(F.col("doc_id").isNotNull()).drop("doc_bucket") for name, table in tables.items()}


def read_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    """The lexical index; frequencies and sizes are aggregated from the postings as they are now."""
    rows = read_index(spark, path, ["postings"])["postings"]
    terms, stats = with_idf(document_frequency(rows), corpus_size(rows))
    return LexicalIndex(rows, terms, stats)


def replace_documents(
    spark: SparkSession, path: str, doc_ids: DataFrame, new: dict[str, DataFrame], buckets: int = BUCKETS
) -> None:
    """Removes the rows of ``doc_ids`` from the stored tables and adds ``new`` rows in their place.

    Only the buckets of those documents are read and overwritten. The new content
    of a bucket is written elsewhere first, so a failure leaves the old one.
    """
    gone = doc_ids.select("doc_id").distinct().withColumn("doc_bucket", bucket_of(buckets))
    touched = small_side(gone.select("doc_bucket").distinct())
    for name, rows in new.items():
        stored = spark.read.parquet(f"{path}/{name}")
        kept = (
            stored.join(touched, "doc_bucket", "left_semi")
            .filter(F.col("doc_id").isNotNull())
            .join(gone.select("doc_id"), "doc_id", "left_anti")
        )
        fresh = rows.withColumn("doc_bucket", bucket_of(buckets))
        # An empty row keeps the place of a bucket that loses its last document.
        marks = touched.select("doc_bucket")
        content = kept.unionByName(fresh).unionByName(marks, allowMissingColumns=True).select(stored.columns)
        staged = stage(content, name)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(
            f"{path}/{name}"
        )


def reingest(spark: SparkSession, path: str, docs: DataFrame, build, buckets: int = BUCKETS) -> None:
    """Rebuilds the given documents in the stored index; ``build(docs)`` returns the tables."""
    replace_documents(spark, path, docs.select("doc_id"), build(docs), buckets)
