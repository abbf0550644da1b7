"""Labelled questions and question banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.schemas import BANK, GOLDEN


def _or(*lists):
    """The first list that is neither null nor empty."""
    out = F.array().cast("array<string>")
    for column in reversed(lists):
        out = F.when(F.size(column) > 0, F.col(column)).otherwise(out)
    return out


def read_golden(spark: SparkSession, path: str, with_answers: bool = False) -> DataFrame:
    """JSON lines to (question, answer, relevant, note, must_contain).

    Lines that are not JSON objects or lack a question or relevant ids (and, with
    ``with_answers``, an answer) are skipped.
    """
    lines = spark.read.text(path).filter(F.try_parse_json("value").isNotNull())
    rows = lines.select(F.from_json("value", GOLDEN).alias("row")).filter(F.col("row").isNotNull()).select("row.*")
    ids = F.transform(_or("relevant_doc_ids", "key_id"), lambda i: i.try_cast("long"))
    note = F.when(F.length("note") > 0, F.col("note")).otherwise(F.array_join(F.coalesce("tags", F.array()), "/"))
    out = rows.select(
        strip(F.coalesce("question", F.lit(""))).alias("question"),
        strip(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.array_distinct(F.array_compact(ids)).alias("relevant"),
        note.alias("note"),
        F.coalesce("must_contain", F.array().cast("array<string>")).alias("must_contain"),
    ).filter((F.col("question") != "") & (F.size("relevant") > 0))
    return out.filter(F.col("answer") != "") if with_answers else out


def append_golden(candidates: DataFrame, path: str) -> None:
    """Appends added candidates (question, key_id) as JSON lines in the format ``read_golden`` reads."""
    candidates.select(
        "question", F.lit("").alias("answer"), "key_id", F.array(F.lit("from_feedback")).alias("tags")
    ).write.mode("append").json(path)


def read_bank(spark: SparkSession, path: str, types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Questions of a bank in file order, of the given types, the first ``limit``."""
    bank = spark.read.schema(BANK).option("multiLine", True).json(path)
    rows = bank.select(F.posexplode("questions").alias("pos", "question")).select("pos", "question.*")
    if types:
        rows = rows.filter(F.col("type").isin(types))
    rows = rows.orderBy("pos")
    return rows.limit(limit) if limit else rows
