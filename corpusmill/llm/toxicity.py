"""Toxicity: a weighted lexicon learned from labels and matched by Aho-Corasick in folded texts.

Folding puts look-alike letters and digit substitutions back and parts words by single
spaces. Terms are starts of words. Their weights compare how often they come in toxic and
in clean training texts. A text's score follows from the weights that match, normalised by its
length; inside an exception phrase nothing matches. Labels are read in training only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, small

#: Labelled rows that train, chosen by the hash of their ids; the bound of the sample.
TRAIN_ROWS = 20_000
#: Lengths of word starts, texts that must have a term, and the least log ratio of its rates.
STARTS = range(4, 10)
SUPPORT = 4
LEAST_WEIGHT = math.log(6)
THRESHOLD = 0.7
#: Values that must match what they stand for: letters of other scripts that look like Latin ones, and what is written for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _table() -> dict[int, str]:
    """Code point to what it folds to: full-width forms, look-alikes and substitutes to letters, other ASCII signs to a space, joiners to nothing."""
    made = {c: " " for c in range(128) if not chr(c).isalnum()}
    made |= {c: chr(c - 0xFF00 + 0x20).lower() for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
    made |= {ord(a): b for a, b in (LOOKALIKES | SUBSTITUTES).items()}
    return made | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "")


FOLD = _table()


def fold(text: str) -> str:
    """Words in small letters, each after one space, and a space at the end; a null text has none."""
    words = text.lower().translate(FOLD).split()
    return " " + " ".join(words) + " " if words else ""


def starts_of(word: str) -> list[str]:
    """Terms a word has: the word itself, ended by a space, and its starts."""
    return [f" {word} ", *(f" {word[:n]}" for n in STARTS if n <= len(word))]


@dataclass
class Model:
    """Weights by term, exception phrases, and the scale that turns features into a probability."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    scale: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0)

    def automaton(self):
        made = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            made.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if len(made):
            made.make_automaton()
        return made


def matches(automaton, folded: str) -> dict[int, float]:
    """Weight of the longest term at each word start, outside of exception phrases."""
    found: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    if not folded or not len(automaton):
        return found
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            free.append((start, end))
        else:
            found[start] = weight
    for a, b in free:
        for start in [s for s in found if a <= s < b]:
            del found[start]
    return found


def features(automaton, folded: str) -> tuple[float, float, float]:
    """Of the matched weights: density per word, log of the sum, log of the number."""
    found = matches(automaton, folded)
    words = max(folded.count(" ") - 1, 0)
    total = sum(found.values())
    return 20.0 * total / (words + 20), math.log1p(total), math.log1p(len(found))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of up to ``rows`` different labelled documents that may train: crc32 of the id as text, modulo 3, isn't 1. However often a row comes, it trains once."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(encode(string(doc_id), 'UTF-8')) % 3 <> 1")
    chosen = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    named = texts.join(small(keep(chosen)), "doc_id").dropDuplicates(["doc_id", "key"])
    return keep(named.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(rows).select("text", "toxic"))


def _counted(pairs, kind: str):
    """Emits (term, counts and texts in clean and in toxic rows), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter() for _ in range(4)]
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = pairs(fold(text.as_py()))
                side = bool(toxic.as_py())
                sums[side].update(found)
                sums[2 + side].update(found.keys())
        terms = list(sums[0] | sums[1])
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[t] for t in part], pa.int64()) for s in sums)], names=[kind, "clean", "toxic", "clean_texts", "toxic_texts"])

    return run


def _term_counts(folded: str) -> Counter:
    made: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        for term in starts_of(word):
            made[term] += n
    return made


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Terms whose rate in toxic texts is well over that in clean ones, by log ratio; a start that says as much as a longer one replaces it.

    All that pass are kept; there are no more of them than words in the bounded training rows.
    """
    words = F.size(F.split("text", r"\s+"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy(F.col("toxic").cast("boolean").alias("toxic")).agg(F.sum(words).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic:
        return {}
    counts = rows.mapInArrow(_counted(_term_counts, "term"), "term string, clean bigint, toxic bigint, clean_texts bigint, toxic_texts bigint").groupBy("term")
    summed = counts.agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "clean_texts", "toxic_texts")]).where(F.col("toxic_texts") >= SUPPORT)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1)))
    best = summed.withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc(F.col("weight") * F.col("toxic_texts")), "term")
    found = {r["term"]: r["weight"] for r in best.collect()}
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        shorter = max((kept.get(term[:n], 0.0) for n in range(2, len(term))), default=0.0)
        if shorter < 0.7 * found[term]:
            kept[term] = found[term]
    return kept


def learn_exceptions(rows: DataFrame, terms: dict[str, float]) -> set[str]:
    """Two-word phrases in which a term matches that come in several clean texts and in no toxic one."""

    def phrases(folded: str) -> Counter:
        automaton = _cached(Model(terms))
        made: Counter = Counter()
        for start in matches(automaton, folded):
            middle = folded.index(" ", start + 1)
            end = folded.find(" ", middle + 1)
            if end > 0:
                made[folded[start : end + 1]] += 1
        return made

    if not terms:
        return set()
    counted = rows.mapInArrow(_counted(phrases, "term"), "term string, clean bigint, toxic bigint, clean_texts bigint, toxic_texts bigint").groupBy("term")
    summed = counted.agg(F.sum("clean_texts").alias("c"), F.sum("toxic_texts").alias("t")).where("c >= 4 AND t = 0")
    return {r["term"] for r in summed.collect()}


_AUTOMATA: dict[int, object] = {}


def _cached(model: Model):
    """One automaton for each model in a Python worker."""
    key = hash((tuple(sorted(model.terms.items())), tuple(sorted(model.exceptions))))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = model.automaton()
    return _AUTOMATA[key]


def fit_scale(values: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    if not len(labels) or labels.min() == labels.max():
        return (-3.0, 1.0, 1.0, 1.0)
    x = np.hstack([np.ones((len(values), 1)), values])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (labels - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _cached(model)
        for batch in batches:
            made = [features(automaton, fold(t.as_py() or "")) for t in batch.column(1)]
            columns = [pa.array(list(c), pa.float64()) for c in zip(*made, strict=True)] or [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "x1", "x2", "x3"])

    return run


FEATURES = "id bigint, x1 double, x2 double, x3 double"


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, exceptions and scale from at most ``rows`` labelled documents. Without toxic rows the lexicon is empty."""
    train_on = training_rows(docs, labels, rows)
    terms = learn_terms(train_on)
    model = Model(terms, learn_exceptions(train_on, terms))
    got = train_on.select(F.col("toxic").cast("bigint").alias("id"), "text").mapInArrow(_featured(model), FEATURES).collect()
    values = np.array([[r["x1"], r["x2"], r["x3"]] for r in got]).reshape(-1, 3)
    return Model(model.terms, model.exceptions, fit_scale(values, np.array([float(r["id"] > 0) for r in got])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts score as texts without a match. ``held_out`` is null for a null id. Repeated rows
    repeat, an empty table gives no rows, other columns aren't read, and long texts are matched whole.
    """
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_featured(model), FEATURES)
    w = model.scale
    z = F.lit(w[0]) + w[1] * F.col("x1") + w[2] * F.col("x2") + w[3] * F.col("x3")
    scored = made.select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
