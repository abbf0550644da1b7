"""From fused candidates to the hits a model gets to read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokenize
from corpusmill.operators.scale import ranked

FUSION_TOP, RERANK_TOP, MIN_NORM = 15, 8, 0.5
MIN_K, BASE_K, MAX_K = 3, 5, 8
HIGH, LOW, GAP = 0.85, 0.5, 0.15

Scorer = Callable[[Column, Column], Column]


def overlap_logit(question: Column, text: Column) -> Column:
    """Default scorer: the share of the question's words found in the text, as 8 * share - 4."""
    asked = F.array_distinct(tokenize(question))
    shared = F.size(F.array_intersect(asked, tokenize(text)))
    return 8.0 * F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(0.0)) - 4.0


def sigmoid(col: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col))


def rerank(
    candidates: DataFrame, scorer: Scorer = overlap_logit, in_n: int = FUSION_TOP, out_n: int = RERANK_TOP
) -> DataFrame:
    """The first ``in_n`` candidates scored against the question, the best ``out_n`` kept.

    Candidates carry query_id, rank, question and text; equal scores keep their order.
    """
    scored = candidates.filter(F.col("rank") <= in_n).withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    order = [F.desc("rerank_score"), F.col("rank")]
    out = ranked(scored, ["query_id"], order, out_n, "_rank")
    return out.withColumn("rank", F.col("_rank")).withColumn("rerank_norm", sigmoid(F.col("rerank_score"))).drop("_rank")


def confidence_floor(candidates: DataFrame, floor: float = MIN_NORM) -> DataFrame:
    """Hits at or above ``floor``; if a query has none, its first hit."""
    best = F.max("rerank_norm").over(Window.partitionBy("query_id"))
    below = F.coalesce(best < floor, F.lit(True))
    kept = F.coalesce(F.col("rerank_norm") >= floor, F.lit(False)) | (F.col("_below") & (F.col("rank") == 1))
    return candidates.withColumn("_below", below).filter(kept).drop("_below")


def norm_score() -> Column:
    """rerank_norm, else 1 / (1 + distance), else 0.5."""
    return F.coalesce(F.col("rerank_norm"), 1.0 / (1.0 + F.col("dense_score")), F.lit(0.5))


def dynamic_topk(candidates: DataFrame, requested: int | None = 5) -> DataFrame:
    """Adds ``k_used`` from the spread of each query's scores and keeps that many hits."""
    query = Window.partitionBy("query_id")
    place = F.row_number().over(query.orderBy(F.desc("_norm"), "rank"))
    top = F.max("_norm").over(query)
    second = F.max(F.when(F.col("_place") == 2, F.col("_norm"))).over(query)
    gap = F.coalesce(top - second, F.lit(1.0))
    mean = F.avg("_norm").over(query)
    chosen = (
        F.when((top >= HIGH) & (gap >= GAP), MIN_K).when(mean >= HIGH, MAX_K).when(top <= LOW, MIN_K).otherwise(BASE_K)
    )
    if requested:
        chosen = F.least(chosen, F.lit(requested))
    return (
        candidates.withColumn("_norm", norm_score())
        .withColumn("_place", place)
        .withColumn("k_used", chosen)
        .filter(F.col("rank") <= F.col("k_used"))
        .drop("_norm", "_place")
    )
