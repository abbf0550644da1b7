"""Which texts hold which needles, by positional grams.

A needle is looked for by one of its grams of up to eight bytes: of several spread over it, the one
that comes least in the corpus. Texts are read in two passes whatever the number of needles, one that
counts those grams and one that finds the chosen ones, moves back by their place in the
needle and compares the whole needle there. A needle shorter than a gram is its own gram. Texts
aren't shuffled; only (needle, text) pairs leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators.scale import row_bound

GRAM, SPREAD = 8, 8
# Bytes of needles that every task holds in one pass, and needles of one pass at most.
NEEDLE_BYTES, NEEDLES = 64 << 20, 200_000
# Bytes of text that are looked at together.
AT_ONCE = 4 << 20


def _grams_at(data: np.ndarray, size: int) -> np.ndarray:
    """Each run of ``size`` bytes as one number."""
    made = np.zeros(max(len(data) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        made = (made << np.uint64(8)) | data[i : i + len(made)].astype(np.uint64)
    return made


def _number(piece: bytes) -> int:
    return int.from_bytes(piece, "big")


class _Lookup:
    """Places of a set of grams of one size in bytes."""

    def __init__(self, size: int, grams: np.ndarray):
        self.size, self.grams = size, np.unique(grams.astype(np.uint64))
        self.last = np.zeros(1 << 16, dtype=bool)
        self.last[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the gram) of every occurrence."""
        found = _grams_at(data, self.size)
        maybe = np.flatnonzero(self.last[(found & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, found[maybe]), len(self.grams) - 1)
        real = self.grams[at] == found[maybe]
        return maybe[real], at[real]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch: the first row, the starts of its texts with one more at the end, and their bytes."""
    column = batch.column("text").cast(pa.large_binary())
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + AT_ONCE, side="right")) - 1)
        yield row, starts[row : end + 1] - starts[row], data[starts[row] : starts[end]]
        row = end


def _anchors(needles: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
    """For each gram size, (gram, needle, its place in the needle) of the grams that may stand for a needle."""
    made: dict[int, list[tuple[int, int, int]]] = {}
    for n, needle in enumerate(needles):
        size = min(GRAM, len(needle))
        last = len(needle) - size
        for off in {last * i // (SPREAD - 1) for i in range(SPREAD)} if last else {0}:
            made.setdefault(size, []).append((_number(needle[off : off + size]), n, off))
    return made


def _counted(lookups: list[_Lookup]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(lookup.grams), np.int64) for lookup in lookups]
        for batch in batches:
            for _, _, data in _texts(batch):
                for lookup, total in zip(lookups, totals, strict=True):
                    total += np.bincount(lookup.places(data)[1], minlength=len(total))
        for lookup, total in zip(lookups, totals, strict=True):
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), lookup.size, np.int32)), pa.array(there.astype(np.int32)), pa.array(total[there])], names=["size", "gram", "n"]
            )

    return run


def _held(needles: list[bytes], ids: np.ndarray, chosen: list[tuple[_Lookup, list[list[tuple[int, int]]]]], k: int | None, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []

        def best() -> pd.DataFrame:
            joined = pd.concat(parts).sort_values(["_n", "doc_id"], kind="stable")
            return joined[joined.groupby("_n").cumcount() < k] if k is not None else joined

        def out(frame: pd.DataFrame) -> pa.RecordBatch:
            made = pd.DataFrame({"query_id": ids[frame["_n"].to_numpy()], "doc_id": frame["doc_id"].to_numpy()})
            return pa.RecordBatch.from_pandas(made, to_arrow_schema(schema), preserve_index=False)

        for batch in batches:
            docs = batch.column("doc_id").to_pandas()
            for first, starts, data in _texts(batch):
                pairs: set[tuple[int, int]] = set()
                raw = data.tobytes()
                for lookup, users in chosen:
                    places, grams = lookup.places(data)
                    rows = np.searchsorted(starts, places, side="right") - 1
                    whole = places + lookup.size <= starts[rows + 1]  # a run over the end of a text is in none
                    for place, gram, row in zip(places[whole].tolist(), grams[whole].tolist(), rows[whole].tolist(), strict=True):
                        for n, off in users[gram]:
                            if (n, row) in pairs:
                                continue
                            start, needle = place - off, needles[n]
                            if start >= starts[row] and start + len(needle) <= starts[row + 1] and raw.startswith(needle, start):
                                pairs.add((n, row))
                if pairs:
                    found = np.array(sorted(pairs))
                    parts.append(pd.DataFrame({"_n": found[:, 0], "doc_id": docs.iloc[first + found[:, 1]].to_numpy()}))
                if k is None and parts:
                    yield out(best())
                    parts = []
                elif k is not None and sum(map(len, parts)) > 4 * k * len(needles) + 10_000:
                    parts = [best()]
        if parts:
            yield out(best())

    return run


def holders(needles: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id): texts of ``docs`` (doc_id, text) that hold a needle of ``needles`` (query_id, needle), compared as they are.

    With ``k`` no task returns more than the first ``k`` doc_ids of a needle, so a later cut at ``k`` is whole. An empty
    needle is in every text; without ``k`` it is left out. Null needles and texts are in none. Equal
    needles are looked for once each; the batch goes in passes of bounded size.
    """
    schema = T.StructType([T.StructField("query_id", needles.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    asked = needles.where("needle IS NOT NULL")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    some = asked.where("needle <> ''")
    n = row_bound(some, NEEDLES)
    size = some.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    number = some.count() if n is None else n
    passes = max(1, -(-number // NEEDLES), -(-size // NEEDLE_BYTES))
    found = None
    for part in range(passes):
        mine = some if passes == 1 else some.where(F.pmod(F.xxhash64("query_id", "needle"), F.lit(passes)) == part)
        held = mine.select("query_id", "needle").toPandas()
        if held.empty:
            continue
        words = [w.encode() for w in held["needle"]]
        anchors = _anchors(words)
        lookups = [_Lookup(s, np.array([g for g, _, _ in rows], np.uint64)) for s, rows in sorted(anchors.items())]
        counts = texts.select("doc_id", "text").mapInArrow(_counted(lookups), "size int, gram int, n bigint").groupBy("size", "gram").agg(F.sum("n").alias("n"))
        seen = {(r["size"], r["gram"]): r["n"] for r in counts.collect()}
        chosen = []
        for lookup in lookups:
            rarest: dict[int, tuple[int, int, int]] = {}
            places = np.searchsorted(lookup.grams, np.array([g for g, _, _ in anchors[lookup.size]], np.uint64))
            for gram, (_, needle, off) in zip(places.tolist(), anchors[lookup.size], strict=True):
                rarest[needle] = min(rarest.get(needle, (1 << 62, 0, 0)), (seen.get((lookup.size, gram), 0), gram, off))
            used = sorted({gram for times, gram, _ in rarest.values() if times})
            users: list[list[tuple[int, int]]] = [[] for _ in used]
            numbers = {gram: i for i, gram in enumerate(used)}
            for needle, (times, gram, off) in rarest.items():
                if times:  # a gram that never comes: neither does its needle
                    users[numbers[gram]].append((needle, off))
            if used:
                chosen.append((_Lookup(lookup.size, lookup.grams[used]), users))
        if chosen:
            some_found = texts.mapInArrow(_held(words, held["query_id"].to_numpy(), chosen, k, schema), schema)
            found = some_found if found is None else found.unionByName(some_found)
    none = needles.sparkSession.createDataFrame([], schema)
    found = none if found is None else found
    if k is not None:
        first = texts.select("doc_id").orderBy("doc_id").limit(k)
        found = found.unionByName(asked.where("needle = ''").select("query_id").join(F.broadcast(first)).select("query_id", "doc_id"))
    return found
