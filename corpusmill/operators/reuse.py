"""Reuse of earlier answers, and the questions worth keeping answers for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize_question
from corpusmill.operators.cells import CellIndex, build_cells, nearest_in_cells
from corpusmill.operators.dense import QUERY_BLOCK, nearest
from corpusmill.operators.scale import HOUR_US, latest_before, running, stage, top_n, within

ANSWER_TTL, CONTEXT_TTL = 86_400, 21_600
SIMILAR = 0.92
HOT_ASKS, DAY_SECONDS = 5, 86_400
TEN_MINUTES_US = 600_000_000
CAPACITY = {"exact": 10_000, "semantic": 5_000, "context": 3_000}


def _age_seconds(now: str, then: str):
    return (F.unix_micros(F.col(now)) - F.unix_micros(F.col(then))) / 1_000_000


def reuse_exact(log: DataFrame, answers: DataFrame, ttl: int = ANSWER_TTL) -> DataFrame:
    """Per ask (key, ts) the newest answer (key, cached_at, answer_id) not older than ``ttl`` seconds.

    Adds answer_id and cached_at, null on a miss.
    """
    found = latest_before(log, answers, ["key"], "ts", "cached_at", ["answer_id"], "_match")
    alive = _age_seconds("ts", "_match.at") <= ttl
    return found.select(
        *log.columns,
        F.when(alive, F.col("_match.answer_id")).alias("answer_id"),
        F.when(alive, F.col("_match.at")).alias("cached_at"),
    )


def reuse_context(log: DataFrame, contexts: DataFrame, ttl: int = CONTEXT_TTL) -> DataFrame:
    """As ``reuse_exact`` for stored retrieval results; adds context_id."""
    found = reuse_exact(log, contexts.withColumnRenamed("context_id", "answer_id"), ttl)
    return found.withColumnsRenamed({"answer_id": "context_id", "cached_at": "context_at"})


def latest_entries(entries: DataFrame, isolate: bool = True) -> DataFrame:
    """One live entry per question (and tenant): the latest stored."""
    keys = ["question", *(["tenant_id"] if isolate else [])]
    rest = [c for c in entries.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("cached_at", "entry_id")).alias("_e")
    return entries.groupBy(*keys).agg(newest).select(*keys, "_e.*")


def reuse_semantic(
    queries: DataFrame,
    entries: DataFrame,
    threshold: float = SIMILAR,
    ttl: int = ANSWER_TTL,
    isolate: bool = True,
    cells: int | None = None,
    **blocks: int,
) -> DataFrame:
    """Per query the most similar live entry: (query_id, entry_id, similarity).

    Both sides carry tenant_id and embedding; queries have ts, entries cached_at.
    ``isolate=False`` lets answers cross tenants. With ``cells`` entries are filed in so many
    cells (0: about the root of their number), and a query reads those that may hold an entry as near as
    the threshold asks: the same result, without comparing every pair. Beyond ``query_block`` queries, either
    way, a query meets only entries of its tenant stored in the span of ``ttl`` it lies in or the one before.
    """
    ttl_us = int(ttl) * 1_000_000
    span = max(ttl_us, 1)

    def usable(asked: pd.DataFrame, stored: pd.DataFrame) -> np.ndarray:
        age = asked["at"].to_numpy()[:, None] - stored["stored_at"].to_numpy()[None, :]
        live = (age >= 0) & (age <= ttl_us)
        if isolate:
            live &= asked["tenant_id"].to_numpy()[:, None] == stored["tenant_id"].to_numpy()[None, :]
        return live

    asked = queries.select(
        "query_id", "embedding", F.coalesce(F.col("tenant_id").cast("long"), F.lit(-2)).alias("tenant_id"),
        F.unix_micros("ts").alias("at"),
    )
    stored = latest_entries(entries, isolate).select(
        "entry_id", "embedding", F.coalesce(F.col("tenant_id").cast("long"), F.lit(-1)).alias("tenant_id"),
        F.unix_micros("cached_at").alias("stored_at"),
    )
    limit = 1.0 - threshold + 1e-9
    if cells is None and (blocks or within(asked, QUERY_BLOCK)):
        best = nearest(asked, stored, ["entry_id"], 1, limit, "cosine", usable, **blocks)
    else:
        # Whatever serves a query was stored in one of two spans, and is nearest in one of them.
        by = ["span", *(["tenant_id"] if isolate else [])]
        at = lambda name: F.floor(F.col(name) / F.lit(span)).cast("long")
        asked = asked.withColumn("span", F.explode(F.array(at("at"), at("at") - 1)))
        stored = stage(stored.withColumn("span", at("stored_at")), "entries")
        filed = build_cells(stored, 1 if cells is None else cells or None, "cosine")
        index = CellIndex(stage(filed.vectors, "entry-cells"), filed.cells, "cosine")
        best = nearest_in_cells(stage(asked, "asks"), index, ["entry_id"], 1, limit, usable, by=by)
    return best.select("query_id", "entry_id", F.round(1.0 - F.col("distance"), 4).alias("similarity"))


def reuse_cascade(queries: DataFrame, exact: DataFrame, semantic: DataFrame, context: DataFrame) -> DataFrame:
    """The first layer that serves each query: exact, semantic, context or miss."""
    layers = (
        queries.select("query_id")
        .join(exact.filter(F.col("answer_id").isNotNull()).select("query_id", "answer_id"), "query_id", "left")
        .join(semantic.select("query_id", "entry_id"), "query_id", "left")
        .join(context.filter(F.col("context_id").isNotNull()).select("query_id", "context_id"), "query_id", "left")
    )
    layer = (
        F.when(F.col("answer_id").isNotNull(), "exact")
        .when(F.col("entry_id").isNotNull(), "semantic")
        .when(F.col("context_id").isNotNull(), "context")
        .otherwise("miss")
    )
    return layers.select("query_id", layer.alias("layer"), F.coalesce("answer_id", "entry_id", "context_id").alias("served_id"))


def trailing_asks(log: DataFrame, window_seconds: int = DAY_SECONDS) -> DataFrame:
    """Adds ``question`` in normal form and ``asks``: how often it was asked in the window that ends here.

    The window includes both ends. Each ask counts +1 when made and -1 just after
    it leaves the window, so the count is a running sum that splits by time.
    """
    asked = log.withColumn("question", normalize_question(F.col("question"))).withColumns(
        {"_at": F.col("ts"), "_step": F.lit(1), "_real": F.lit(True)}
    )
    left = asked.select(
        "question",
        F.timestamp_micros(F.unix_micros("ts") + F.lit(window_seconds * 1_000_000 + 1)).alias("_at"),
        F.lit(-1).alias("_step"),
        F.lit(False).alias("_real"),
    )
    steps = asked.withColumnRenamed("_at", "_time").unionByName(
        left.withColumnRenamed("_at", "_time"), allowMissingColumns=True
    )
    counted = running(steps, ["question"], "_time", F.col("_step"), "sum", "asks", TEN_MINUTES_US)
    return counted.filter("_real").drop("_time", "_step", "_real")


def hot_questions(log: DataFrame, n: int = HOT_ASKS, window_seconds: int = DAY_SECONDS) -> DataFrame:
    """Asks at which the question was asked at least ``n`` times in the window (no reset)."""
    return trailing_asks(log, window_seconds).filter(F.col("asks") >= n)


def hot_firings(log: DataFrame, n: int = HOT_ASKS, window_seconds: int = DAY_SECONDS, id_column: str = "event_id") -> DataFrame:
    """Asks at which a counter that resets after firing reaches ``n``.

    The counter before an ask is a number below ``n``, and the ask moves it to
    min(counter, other asks in the window) + 1. So each time block of a question
    is a map from its ``n`` possible starting counters to end counters; the maps
    are composed over the blocks, and each block then knows where it starts.
    Blocks are read as sorted streams, so no task holds a question, or even a
    block, in memory.
    """
    block = F.floor(F.unix_micros("ts") / F.lit(HOUR_US)).cast("long")
    # Asks of one instant come in id order, so an ask must not count those after it.
    same = Window.partitionBy("question", "ts").orderBy(F.desc(id_column))
    counted = trailing_asks(log, window_seconds)
    asks = counted.select(
        "question", "ts", id_column, block.alias("block"),
        F.least(F.col("asks") - F.row_number().over(same), F.lit(n - 1)).cast("int").alias("others"),
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, np.arange(n)
        for pdf in batches:
            fires, ends = [], []
            for question, number, others in zip(pdf["question"], pdf["block"], pdf["others"]):
                if (question, number) != current:
                    current, state = (question, number), np.arange(n)
                state = np.minimum(state, others) + 1
                fires.append(state == n)
                state = np.where(state == n, 0, state)
                ends.append(state.astype(np.int32))
            yield pdf.drop(columns="others").assign(fires=fires, ends=ends)

    kind = log.schema[id_column].dataType.simpleString()
    keys = ["question", "block"]
    walked = asks.repartition(*keys).sortWithinPartitions(*keys, "ts", id_column).mapInPandas(
        walk, f"question string, ts timestamp, {id_column} {kind}, block long, fires array<boolean>, ends array<int>"
    )
    # Read twice below, and Python should walk it once.
    walked = stage(walked, "hot-walk")

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counter = None, 0
        for pdf in batches:
            starts = []
            for question, ends in zip(pdf["question"], pdf["ends"]):
                if question != current:
                    current, counter = question, 0
                starts.append(counter)
                counter = int(ends[counter])
            yield pdf.drop(columns="ends").assign(start=starts)

    maps = walked.groupBy(*keys).agg(F.max_by("ends", F.struct("ts", id_column)).alias("ends"))
    entries = maps.repartition("question").sortWithinPartitions(*keys).mapInPandas(
        compose, "question string, block long, start int"
    )
    return walked.join(entries, keys).filter(F.get("fires", F.col("start"))).select("question", "ts", id_column)


def warmup_candidates(log: DataFrame, min_asks: int = 3, n: int = 50) -> DataFrame:
    """The ``n`` questions asked most often, at least ``min_asks`` times."""
    counted = log.groupBy(normalize_question(F.col("question")).alias("question")).agg(F.count("*").alias("asks"))
    return counted.filter(F.col("asks") >= min_asks).orderBy(F.desc("asks"), "question").limit(n)


def retain_latest(entries: DataFrame, capacity: dict[str, int] | None = None) -> DataFrame:
    """The newest entries of each layer up to its capacity (layer, entry_id, used_at)."""
    out = None
    for layer, n in (capacity or CAPACITY).items():
        kept = top_n(
            entries.filter(F.col("layer") == layer), ["layer"], [F.desc("used_at"), F.desc("entry_id")], n, ["entry_id"]
        )
        out = kept if out is None else out.unionByName(kept)
    return out


def reuse_stats(served: DataFrame) -> DataFrame:
    """Hits, misses and hit rate in percent per layer, and over all requests.

    A layer is checked only if those before it missed.
    """
    counts = served.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("layer") == name).alias(name) for name in ["exact", "semantic", "context"]],
    )
    rows, left = [], F.col("total")
    for name in ["exact", "semantic", "context"]:
        rows.append(F.struct(F.lit(name).alias("layer"), F.col(name).alias("hits"), (left - F.col(name)).alias("misses")))
        left = left - F.col(name)
    rows.append(F.struct(F.lit("overall").alias("layer"), (F.col("total") - left).alias("hits"), left.alias("misses")))
    rate = F.round(100.0 * F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 2)
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("hit_rate", rate)


def invalidate(entries: DataFrame, changes: DataFrame, scope: str = "tenant_id") -> DataFrame:
    """Adds ``alive``: no change of the entry's scope came after it was stored."""
    last = changes.groupBy(scope).agg(F.max("changed_at").alias("changed_at"))
    alive = F.col("changed_at").isNull() | (F.col("cached_at") >= F.col("changed_at"))
    return entries.join(last, scope, "left").withColumn("alive", alive).drop("changed_at")
