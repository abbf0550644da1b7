"""BM25 over chunks.

The index keeps one row per chunk with its distinct terms nested in it. A query
batch is small next to the corpus, so its weighted terms go to every task and are
matched where the chunks lie: a block of chunks is scored for those questions whose
bound, from the greatest weight of each term in the block, reaches their worst kept
score. Only the best k rows per query and task travel; the index never does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.functions.text import let, tokenize
from corpusmill.operators.access import CONTEXT, attach_grants, filter_visible, first_visible
from corpusmill.operators.dense import TopK, caller_columns, rights_columns, visible
from corpusmill.operators.scale import at_most, ranked, row_bound

K1, B, FLOOR = 1.5, 0.75, 0.25
CHUNK_KEY = ["doc_id", "chunk_index"]
CARRIED = ["parent_id", "owner_id", "tenant_id", "doc_level", "min_level"]

# (query, term) pairs that every task holds, about 30 bytes each; a larger batch meets
# the terms of the index in a join.
PAIRS = 1_000_000
# Scores that a task holds at a time.
SCORES = 2_000_000
TERM_SALTS = 32


@dataclass
class LexicalIndex:
    """``chunks``: key, carried columns, n_tokens, terms array<struct<term, tf>>;
    ``terms``: term, df, idf; ``stats``: one row n_chunks, avg_tokens, mean_idf."""

    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame


def term_counts(tokens: Column) -> Column:
    """Distinct tokens with their frequency, inside the row: runs of the sorted tokens, so that a long text costs little more than its sort."""

    def counted(words: Column) -> Column:
        new = F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i))
        return let(
            F.filter(new, lambda i: i.isNotNull()),
            lambda starts: F.transform(
                starts, lambda at, n: F.struct(F.get(words, at).alias("term"), (F.coalesce(F.get(starts, n + 1), F.size(words)) - at).alias("tf"))
            ),
        )

    return let(F.sort_array(tokens), counted)


def index_rows(chunks: DataFrame, keep_case: bool = False) -> DataFrame:
    carried = [c for c in CARRIED if c in chunks.columns]
    return (
        chunks.withColumn("tokens", tokenize(F.col("text"), keep_case))
        .select(*CHUNK_KEY, *carried, F.size("tokens").alias("n_tokens"), term_counts(F.col("tokens")).alias("terms"))
    )


def document_frequency(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_chunks"), F.avg("n_tokens").alias("avg_tokens"))


def with_idf(frequency: DataFrame, size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms with idf, stats): a negative idf becomes a quarter of the mean over all terms."""
    n = size.select("n_chunks").scalar()
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = frequency.agg(F.avg(raw).alias("mean_idf"))
    idf = F.when(raw < 0, FLOOR * mean.scalar()).otherwise(raw)
    return frequency.select("term", "df", idf.alias("idf")), size.withColumn("mean_idf", mean.scalar())


def build_lexical_index(chunks: DataFrame, keep_case: bool = False) -> LexicalIndex:
    # Frequencies need the words only, not the counted rows.
    words = chunks.select(tokenize(F.col("text"), keep_case).alias("words"))
    frequency = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms, stats = with_idf(frequency, corpus_size(words.select(F.size("words").alias("n_tokens"))))
    return LexicalIndex(index_rows(chunks, keep_case), terms, stats)


class _Scorer:
    """Scores blocks of index rows for one batch of weighted query terms and keeps each query's best."""

    def __init__(self, weighted: pd.DataFrame, callers: pd.DataFrame | None, avg_tokens: float, carried: list[str], k: int):
        ids, query = np.unique(weighted["query_id"].to_numpy(), return_inverse=True)
        self.vocabulary, term = np.unique(weighted["term"].to_numpy().astype(str), return_inverse=True)
        by_term = np.argsort(term, kind="stable")
        self.term, self.query, self.weight = term[by_term], query[by_term], weighted["weight"].to_numpy()[by_term]
        self.positive = bool((self.weight > 0).all())
        self.callers = None if callers is None else callers.set_index("query_id").loc[ids].reset_index()
        self.avg_tokens, self.carried = avg_tokens, carried
        self.best = TopK(ids, CHUNK_KEY, carried, k)
        self.terms = pa.array(self.vocabulary, pa.string())

    def add(self, batch: pa.RecordBatch) -> None:
        columns = [c for c in batch.schema.names if c != "terms"]
        rows = batch.select(columns).to_pandas()
        nested = batch.column("terms")
        entries = nested.flatten()
        row = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(nested), 0).to_numpy())
        term = pc.fill_null(pc.index_in(entries.field("term"), self.terms), -1).to_numpy()
        known = term >= 0
        row, term, tf = row[known], term[known], entries.field("tf").to_numpy()[known]
        if not len(row):
            return
        order = rows.sort_values(CHUNK_KEY).index.to_numpy()
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        tokens = rows["n_tokens"].to_numpy()[row]
        saturation = tf * (K1 + 1) / (tf + K1 * (1 - B + B * tokens / self.avg_tokens))
        queries = np.arange(len(self.best.query_ids))
        if self.positive:
            most = np.zeros(len(self.vocabulary))
            np.maximum.at(most, term, saturation)
            bound = np.bincount(self.query, self.weight * most[self.term], len(queries))
            queries = np.flatnonzero((bound > 0) & (bound + 1e-8 >= -self.best.bound))
        if not len(queries):
            return
        # The postings of the queries that are left: (query's place among them, weight) of each term.
        among = np.full(len(self.best.query_ids), -1)
        among[queries] = np.arange(len(queries))
        mine = among[self.query] >= 0
        holders, weights = among[self.query[mine]], self.weight[mine]
        first = np.concatenate([[0], np.cumsum(np.bincount(self.term[mine], minlength=len(self.vocabulary)))])
        entry = np.argsort(place[row], kind="stable")
        at, term, saturation = place[row][entry], term[entry], saturation[entry]
        rows = rows.iloc[order].reset_index(drop=True)
        step = max(1, SCORES // len(queries))
        for start in range(0, len(rows), step):
            low, high = np.searchsorted(at, [start, start + step])
            self._score(at[low:high] - start, term[low:high], saturation[low:high], rows.iloc[start : start + step], queries, holders, weights, first)

    def _score(self, at, term, saturation, rows, queries, holders, weights, first) -> None:
        number = first[term + 1] - first[term]
        total = int(number.sum())
        if not total:
            return
        pair = np.arange(total) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first[term], number)
        cell = holders[pair] * len(rows) + np.repeat(at, number)
        shape = (len(queries), len(rows))
        score = np.bincount(cell, weights[pair] * np.repeat(saturation, number), shape[0] * shape[1]).reshape(shape)
        matched = score > 0 if self.positive else np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) > 0
        distance = np.where(matched, -np.round(score, 9), np.inf)
        if self.callers is not None:
            distance[~visible(self.callers.iloc[queries], rows)] = np.inf
        self.best.take(distance, rows, queries)


def _scored_in_place(
    queries: DataFrame, weighted: DataFrame, index: LexicalIndex, acl: DataFrame | None, k: int
) -> DataFrame:
    """Each task's best ``k`` per query: the batch travels, the index is read where it lies."""
    carried = ["parent_id"] if "parent_id" in index.chunks.columns else []
    chunks = index.chunks.schema
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType)]
        + [T.StructField(c, chunks[c].dataType) for c in [*CHUNK_KEY, *carried]]
        + [T.StructField("distance", T.DoubleType())]
    )
    batch = weighted.toPandas()
    if batch.empty:
        return queries.sparkSession.createDataFrame([], schema)
    rows, callers = index.chunks, None
    wanted = [*CHUNK_KEY, *carried, "n_tokens", "terms"]
    if acl is not None:
        callers = queries.select("query_id", *caller_columns()).distinct().toPandas()
        rows = attach_grants(rows, acl, queries, callers_bound=len(callers))
        rows = rows.select(*wanted, *rights_columns(), "granted_to")
    else:
        rows = rows.select(*wanted)
    avg_tokens = index.stats.first()["avg_tokens"]
    held = queries.sparkSession.sparkContext.broadcast((batch, callers))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*held.value, avg_tokens, carried, k)
        for part in batches:
            if part.num_rows:
                scorer.add(part)
        out = scorer.best.result()
        if out is not None:
            yield pa.RecordBatch.from_pandas(out[[f.name for f in schema]], to_arrow_schema(schema), preserve_index=False)

    return rows.mapInArrow(scan, schema)


def bm25_search(
    queries: DataFrame,
    index: LexicalIndex,
    acl: DataFrame | None = None,
    k: int = 20,
    keep_case: bool = False,
    max_broadcast: int = PAIRS,
    pad_zero: bool = False,
) -> DataFrame:
    """Best ``k`` chunks per query: (query_id, rank, score, chunk key, parent_id).

    ``queries`` has query_id, question and, with ``acl``, the caller's context.
    Corpus statistics are global; visibility is applied before the cut. Chunks
    that share no term with the query are not returned, unless ``pad_zero`` fills
    short lists with them in chunk order, at score 0. Batches of more than
    ``max_broadcast`` (query, term) pairs meet the index in a shuffle join.
    """
    context = CONTEXT if acl is not None else []
    words = queries.select("query_id", *context, F.explode(tokenize(F.col("question"), keep_case)).alias("term"))
    counted = words.groupBy("query_id", "term", *context).agg(F.count("*").alias("qtf"))
    number = row_bound(counted, max_broadcast)
    # Terms are unique in the index, so the weighted terms are no more than the counted ones.
    weighted = index.terms.join(at_most(counted, number), "term").select(
        "query_id", "term", *context, (F.col("qtf") * F.col("idf")).alias("weight")
    )
    carried = [c for c in CARRIED if c in index.chunks.columns]
    if number is not None:
        found = _scored_in_place(queries, weighted.select("query_id", "term", "weight"), index, acl, k)
        scored = found.withColumn("score", -F.col("distance"))
    else:
        avg = index.stats.select("avg_tokens").scalar()
        entries = index.chunks.select("*", F.explode("terms").alias("entry")).select(
            *CHUNK_KEY,
            *carried,
            F.col("entry.term").alias("term"),
            (
                F.col("entry.tf") * (K1 + 1) / (F.col("entry.tf") + K1 * (1 - B + B * F.col("n_tokens") / avg))
            ).alias("saturation"),
        )
        salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
        spread = entries.withColumn("salt", F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(TERM_SALTS)).cast("int"))
        matched = spread.join(salted, ["term", "salt"])
        # Columns that depend on the chunk or the query alone ride along as keys: text
        # cannot sit in a hash aggregate's buffer.
        scored = matched.groupBy(*CHUNK_KEY, "query_id", *carried, *context).agg(
            F.sum(F.col("weight") * F.col("saturation")).alias("score")
        )
        if acl is not None:
            scored = filter_visible(scored, acl)
    top = ranked(scored, ["query_id"], by_score(), k)
    if pad_zero:
        top = _padded(top, queries, index, acl, k)
    return top.select("query_id", "rank", "score", *CHUNK_KEY, *(["parent_id"] if "parent_id" in carried else []))


def _padded(top: DataFrame, queries: DataFrame, index: LexicalIndex, acl: DataFrame | None, k: int) -> DataFrame:
    """Lists of fewer than ``k`` hits filled with visible chunks that match nothing.

    Such a list holds every match of its query, so the first 2k visible chunks
    contain enough others.
    """
    columns = ["query_id", "score", *CHUNK_KEY, *(["parent_id"] if "parent_id" in top.columns else [])]
    parents = index.chunks.select(*columns[2:])
    order = [F.col(c) for c in CHUNK_KEY]
    if acl is None:
        first = parents.orderBy(*order).limit(2 * k).agg(F.collect_list(F.struct(*columns[2:])).alias("c")).scalar()
        fill = queries.select("query_id", F.explode(first).alias("c")).select("query_id", "c.*")
    else:
        seen = first_visible(index.chunks, queries.select(*CONTEXT).distinct(), acl, columns[2:], order, 2 * k)
        fill = seen.drop("rank").join(queries.select("query_id", "user_id"), "user_id")
    fill = fill.join(top.select("query_id", *CHUNK_KEY), ["query_id", *CHUNK_KEY], "left_anti")
    both = top.select(*columns).unionByName(fill.withColumn("score", F.lit(0.0)).select(*columns))
    return ranked(both, ["query_id"], by_score(), k)


def by_score() -> list[Column]:
    """Descending score; equal scores (to 9 decimals) in chunk order."""
    return [F.desc(F.round("score", 9)), *[F.col(c) for c in CHUNK_KEY]]
