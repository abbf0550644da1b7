"""Reciprocal rank fusion and the merge of query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.scale import ranked

KEY = ["doc_id", "parent_id", "chunk_index"]


def _place(score: str) -> Column:
    return F.round(score, 12).desc()


def rrf(
    dense: DataFrame,
    sparse: DataFrame,
    k: int = 60,
    w_dense: float = 1.0,
    w_sparse: float = 1.0,
    by: list[str] | None = None,
) -> DataFrame:
    """Both ranked lists (query_id, key, rank from 1, score) fused per query.

    A candidate gets weight / (k + rank) from each list that holds it. Equal
    scores keep the order of the dense list, then of the sparse list.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    by = by or ["query_id"]
    sides = [
        side.select(
            *by,
            *KEY,
            (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"),
            *[(F.col("score") if name == side_name else F.lit(None).cast("double")).alias(f"{name}_score") for name in ["dense", "sparse"]],
            *[(F.col("rank") if name == side_name else F.lit(None).cast("int")).alias(f"{name}_rank") for name in ["dense", "sparse"]],
        )
        for side_name, side, weight in [("dense", dense, w_dense), ("sparse", sparse, w_sparse)]
    ]
    fused = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*by, *KEY)
        .agg(
            F.sum("part").alias("score"),
            *[F.max(c).alias(c) for c in ["dense_score", "sparse_score", "dense_rank", "sparse_rank"]],
        )
    )
    order = [_place("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()]
    return ranked(fused, by, order).drop("dense_rank", "sparse_rank")


def merge_variants(fused: DataFrame) -> DataFrame:
    """Variants of one query (query_id, variant, rank, ...) as one list.

    Scores of one candidate add up; the first variant that found it supplies the rest.
    """
    first = F.struct("variant", "rank")
    payload = [c for c in fused.columns if c not in {"query_id", "variant", "rank", "score", *KEY}]
    merged = fused.groupBy("query_id", *KEY).agg(
        F.sum("score").alias("score"),
        F.min(first).alias("_first"),
        *[F.min_by(c, first).alias(c) for c in payload],
    )
    order = [_place("score"), F.col("_first.variant"), F.col("_first.rank")]
    return ranked(merged, ["query_id"], order).drop("_first")
