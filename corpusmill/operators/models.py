"""Plug-in models and their deterministic offline defaults.

A model is ``Callable[[pandas.Series], pandas.Series]`` over a batch of texts.
It runs inside an iterator pandas UDF, so it is loaded once per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BatchModel = Callable[[pd.Series], pd.Series]

# Texts a call of a model that is given, and of the default one, which keeps its words for the whole task.
EMBED_BATCH, LOCAL_BATCH = 16, 4096
DIMENSIONS, KNOWN_WORDS = 64, 200_000
WORD = re.compile(r"[^\W_]+")


def hashing_embedder(dimensions: int = DIMENSIONS) -> BatchModel:
    """Signed feature hashing of lower-case words, scaled to unit length."""

    places: dict[str, tuple[int, int]] = {}

    def embed_texts(texts: pd.Series) -> pd.Series:
        if len(places) > KNOWN_WORDS:
            places.clear()
        rows = []
        for text in texts:
            vector = np.zeros(dimensions)
            for word in WORD.findall((text or "").lower()):
                if word not in places:
                    digest = hashlib.md5(word.encode()).hexdigest()
                    places[word] = (int(digest[:6], 16) % dimensions, 1 if int(digest[6:8], 16) < 128 else -1)
                place, sign = places[word]
                vector[place] += sign
            size = np.sqrt((vector * vector).sum())
            rows.append((vector / size if size else vector).astype(np.float32))
        return pd.Series(rows, index=texts.index)

    return embed_texts


def _in_quarters(model: BatchModel, texts: pd.Series, skip: bool = False) -> pd.Series:
    """One call; if it fails, calls of a quarter of the size. A single text must succeed, or is left empty with ``skip``."""
    try:
        return model(texts)
    except Exception:
        if len(texts) <= 1:
            if skip:
                return pd.Series([None] * len(texts), index=texts.index, dtype=object)
            raise
        step = max(1, len(texts) // 4)
        return pd.concat([_in_quarters(model, texts.iloc[i : i + step], skip) for i in range(0, len(texts), step)])


def model_column(model: BatchModel, col: Column, result: str, batch: int, skip: bool = False) -> Column:
    """``model`` over a text column, called with at most ``batch`` texts at a time; ``skip`` leaves null for a text that it fails on."""

    @F.pandas_udf(result)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            yield pd.concat([_in_quarters(model, texts.iloc[i : i + batch], skip) for i in range(0, len(texts), batch)])

    return run(col)


def embed(df: DataFrame, column: str = "text", model: BatchModel | None = None, batch: int | None = None, skip: bool = False) -> DataFrame:
    """Adds ``embedding``, the vector of a text column; null with ``skip`` where the model fails on a text.

    The default model is local and takes a whole Arrow batch at a time.
    """
    size = batch or (EMBED_BATCH if model else LOCAL_BATCH)
    return df.withColumn("embedding", model_column(model or hashing_embedder(), F.col(column), "array<float>", size, skip))


def embed_queries(df: DataFrame, instruction: str = "", model: BatchModel | None = None) -> DataFrame:
    """Adds ``embedding`` of the question; queries carry a task instruction, documents do not."""
    prompted = df.withColumn("_prompted", F.concat(F.lit(instruction), F.col("question")))
    return embed(prompted, "_prompted", model).drop("_prompted")


def once_per_key(df: DataFrame, key: list[Column], apply: Callable[[DataFrame], DataFrame], results: list[str]) -> DataFrame:
    """Calls ``apply`` on one row per distinct key and joins its ``results`` columns back."""
    keyed = df.withColumn("call_key", F.md5(F.concat_ws("|", *key)))
    distinct = keyed.dropDuplicates(["call_key"])
    answered = apply(distinct).select("call_key", *results)
    return keyed.join(answered, "call_key")


def generate(prompts: DataFrame, model: BatchModel) -> DataFrame:
    """Adds ``answer``, the model's reply to ``prompt``."""
    return prompts.withColumn("answer", model_column(model, F.col("prompt"), "string", EMBED_BATCH))


def judge(pairs: DataFrame, model: BatchModel) -> DataFrame:
    """Adds ``reply``, the judging model's raw output for ``judge_prompt``."""
    return pairs.withColumn("reply", model_column(model, F.col("judge_prompt"), "string", EMBED_BATCH))
