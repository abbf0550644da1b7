"""Quality classifier without hand labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Each heuristic votes for good, for bad, or not at all. Documents fall into few patterns
of votes; those are counted over the whole corpus, and from the counts EM estimates
how often each heuristic is right. The posteriors of the patterns label a bounded sample of
documents, on which a logistic scorer of hashed words and word shapes is trained; it scores every text.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, stored, text_or_empty
from corpusmill.llm.rules import measures

#: (name, condition for a vote for bad, condition for a vote for good), on the measures of a text.
LABELLERS = (
    ("symbols", "100 * n_symbols > 3 * word_chars", "false"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "false"),
    ("distinct", "n_words BETWEEN 30 AND 1000 AND 100 * n_distinct_words < 40 * n_words", "false"),
    ("capitals", "100 * n_capitals > 30 * word_chars", "false"),
    ("exclamations", "100 * n_exclamations > 15 * n_words", "false"),
    ("lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines", "false"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "false"),
    ("plain", "100 * n_symbols > word_chars OR 20 * n_exclamations > n_words OR 100 * n_capitals > 25 * word_chars", "n_symbols = 0 AND n_exclamations * 50 <= n_words AND 100 * n_capitals <= 10 * word_chars"),
    ("varied", "n_words BETWEEN 30 AND 1000 AND 2 * n_distinct_words < n_words OR 5 * n_repeat_words > n_words AND n_words >= 20", "100 * n_distinct_words >= 55 * n_words AND n_repeat_words * 20 <= n_words"),
)
#: P(vote | class) believed beforehand: rows bad and good, votes bad, neither and good; and the documents of each class it counts as, however many there are.
BELIEF = ((0.3, 0.6, 0.1), (0.002, 0.6, 0.398))
PRIOR_ROWS = 20.0
#: Documents the scorer is trained on, chosen by the hash of text and id; the bound of the sample.
TRAIN_ROWS = 8_000
DIMENSIONS = 1 << 15
EPOCHS, RATE, RIDGE = 8, 0.5, 1e-6
KEPT_FROM = 0.5
#: Rows of a batch that are worked on at a time.
AT_ONCE = 1_000
HALF = DIMENSIONS // 2
SIGNS = string.punctuation


def with_votes(docs: DataFrame, labellers=LABELLERS) -> DataFrame:
    """(doc_id, text, votes): a digit for each labeller, 2 for good, 0 for bad, 1 for neither. A condition that is null has no vote."""
    # inline() computes the measures once for all conditions
    measured = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", F.inline(F.array(measures(F.col("text")))))
    digits = [F.when(F.expr(bad), "0").when(F.expr(good), "2").otherwise("1") for _, bad, good in labellers]
    return measured.select("doc_id", "text", F.concat(*digits).alias("votes"))


def estimate(counts: dict[str, int], rounds: int = 500, prior_rows: float = PRIOR_ROWS) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of good for each pattern, the share of good documents, and P(vote | class) as [labeller, class, vote].

    Votes are taken as independent given the class. ``BELIEF`` counts as ``prior_rows`` documents of each class:
    it says which class is which and holds labellers that hardly vote, and the votes of a corpus outweigh it.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, 0.5, np.zeros((0, 2, 3))
    votes = np.array([[int(v) for v in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], dtype=float)
    number = votes.shape[1]
    belief = np.array(BELIEF)[None, :, :] * prior_rows
    good = np.where((votes == 0).any(axis=1), 0.1, 0.9)
    table = np.zeros((number, 2, 3))
    for _ in range(rounds):
        share = float(np.clip((weight @ good) / weight.sum(), 1e-6, 1 - 1e-6))
        table = np.zeros((number, 2, 3))
        for v in range(3):
            here = votes == v
            table[:, 1, v] = (weight * good) @ here
            table[:, 0, v] = (weight * (1 - good)) @ here
        table = (table + belief + 1e-3) / (table + belief + 1e-3).sum(axis=2, keepdims=True)
        logs = np.log(table)
        each = logs[np.arange(number)[None, :], :, votes].sum(axis=1)
        odds = np.log(share / (1 - share)) + each[:, 1] - each[:, 0]
        now = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(now - good).max()
        good = now
        if moved < 1e-9:
            break
    return dict(zip(patterns, map(float, good), strict=True)), share, table


@functools.lru_cache(maxsize=10_000)
def _shape_place(shape: str) -> int:
    return HALF + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % HALF


def _shape(word: str) -> str:
    """What a word is made of: its kind of core between the signs around it; runs of signs count as one."""
    core = word.strip(SIGNS)
    kind = "A" if core.isupper() and len(core) > 1 else "a" if core.isalpha() else "0" if core.isdigit() else "x" if core else ""
    return kind if len(core) == len(word) else word[0] * (word[0] in SIGNS) + kind + word[-1] * (word[-1] in SIGNS)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text, and how many of its words and shapes fall there; no word, no place."""
    sums: Counter = Counter()
    for word, n in Counter(text.split()).items():
        sums[zlib.crc32(word.encode("utf-8", "surrogatepass")) % HALF] += n
        sums[_shape_place(_shape(word))] += n
    return np.fromiter(sums.keys(), np.int32, len(sums)), np.fromiter(sums.values(), np.int32, len(sums))


def damped(counts: np.ndarray) -> np.ndarray:
    """Roots of the counts, of length 1 together."""
    values = np.sqrt(counts.astype(np.float64))
    return values / np.sqrt(max((values * values).sum(), 1.0))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights of a logistic scorer on (places, values, probability of good), the bias last; AdaGrad over a fixed order."""
    weights, squares = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(EPOCHS):
        for places, values, target in rows:
            z = weights[places] @ values + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            step = error * values + RIDGE * weights[places]
            squares[places] += step * step
            weights[places] -= RATE * step / np.sqrt(squares[places])
            squares[-1] += error * error
            weights[-1] -= RATE * error / np.sqrt(squares[-1])
    return weights


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of no more than ``AT_ONCE`` rows: what is made of a text is several times its size."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        made = [hashed(text.as_py()) for text in batch.column(3)]
        places, counts = (pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), places, counts], names=["doc_id", "text_key", "votes", "places", "counts"])


def _scored(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            places, counts = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            norm = np.sqrt(np.maximum(np.bincount(row, counts, len(lengths)), 1.0))
            z = np.bincount(row, weights[places] * np.sqrt(counts), len(lengths)) / norm + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "votes", "score"])

    return run


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, kept_from: float = KEPT_FROM) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) for every row of ``docs``.

    Vote patterns are counted over all rows, and no more than 3^labellers reach the
    driver. ``posterior`` is what the labellers say together, ``score`` what the trained
    scorer says of the words, ``kept`` whether the mean of both reaches ``kept_from``. It trains on up to
    ``train_rows`` different rows (doc_id, text), however often each comes. Null texts count as empty; an empty
    table gives no rows; other columns aren't read. Texts are read whole, once: votes and hashed words are
    stored, and scored from there.
    """
    voted = with_votes(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    made = voted.select("doc_id", F.xxhash64("text").alias("text_key"), "votes", "text").mapInArrow(_hashed_rows, "doc_id bigint, text_key bigint, votes string, places array<int>, counts array<int>")
    rows = stored(made, "hashed-words")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    posterior, _, _ = estimate(counts)
    order = (F.xxhash64("doc_id", "text_key"), "doc_id", "text_key")
    # the sample has a documented bound, and so has what is broadcast and what trains
    chosen = keep(rows.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key")).distinct().orderBy(F.xxhash64("of", "key"), "of", "key").limit(train_rows))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key"))
    # a row has no more places than there are dimensions, however long its text
    sample = rows.join(F.broadcast(chosen), same).dropDuplicates(["doc_id", "text_key"]).orderBy(*order).select("votes", "places", "counts").toLocalIterator()
    weights = train([(np.array(r["places"], np.int64), damped(np.array(r["counts"])), posterior[r["votes"]]) for r in sample])
    scored = rows.select("doc_id", "votes", "places", "counts").mapInArrow(_scored(weights), "doc_id bigint, votes string, score double")
    known = docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, posterior double")
    both = scored.join(F.broadcast(known), "votes", "left")
    return both.select("doc_id", "votes", "posterior", "score", ((F.col("posterior") + F.col("score")) / 2 >= kept_from).alias("kept"))
