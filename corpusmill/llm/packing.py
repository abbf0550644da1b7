"""Best-fit packing of documents into sequences of a fixed number of tokens, under conflicts.

Documents are dealt by hash into groups of about ``GROUP`` and each group is packed on
its own, the longest first. Open bins are ordered by what is left in them; each carries
bitmaps of the sources and of the duplicate clusters it holds. The search starts at
the tightest bin that has room and goes on to its successors until one has no
conflict; only if none has, a bin is opened. Bins that hold the same sources lie
together, so that a conflict of sources passes over all of them at once.

Only lengths, sources and clusters travel, never texts. A group's size follows from
the hash, not from a source or cluster, however common. Repeated rows are counted
first and numbered, so that they spread over the groups as well.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_or_empty

CAPACITY = 2048
#: Documents that are packed together.
GROUP = 4096
#: Documents of one source that a bin may hold.
PER_SOURCE = 2


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each (length, source, cluster), which come longest first; lengths are from 1 to ``capacity``.

    Sources and clusters are small numbers; a negative cluster conflicts with none.
    """
    shelves: list[dict[tuple[int, ...], list[int]]] = [defaultdict(list) for _ in range(capacity + 1)]
    open_at = 0  # bit r is set while a bin with r tokens left is open
    clusters: list[int] = []
    placed = []
    none = (0,) * per_source
    for length, source, cluster in items:
        bit, mark = 1 << source, (1 << cluster if cluster >= 0 else 0)
        left = open_at >> length
        room, chosen, held = length - 1, -1, none
        while left and chosen < 0:
            step = (left & -left).bit_length()
            room, left = room + step, left >> step
            for planes, bins in shelves[room].items():
                if planes[-1] & bit:
                    continue
                spot = next((i for i, b in enumerate(bins) if not clusters[b] & mark), -1)
                if spot >= 0:
                    chosen, held = bins.pop(spot), planes
                    break
        if chosen >= 0:
            if not shelves[room][held]:
                del shelves[room][held]
            if not shelves[room]:
                open_at &= ~(1 << room)
        else:
            chosen, room = len(clusters), capacity
            clusters.append(0)
        clusters[chosen] |= mark
        now = list(held)
        for plane in range(per_source):
            if not now[plane] & bit:
                now[plane] |= bit
                break
        if room > length:
            shelves[room - length][tuple(now)].append(chosen)
            open_at |= 1 << (room - length)
        placed.append(chosen)
    return placed


def _pack_group(capacity: int, per_source: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["g"].iloc[0])
        group = group.sort_values(["length", "doc_id", "copy", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        shared = group["cluster"].duplicated(keep=False)
        clusters = pd.factorize(group["cluster"].where(shared))[0]
        sources = pd.factorize(group["source"].fillna(""))[0]
        lengths = group["length"].to_numpy()
        whole = lengths // capacity
        rest = lengths % capacity
        order = sorted((i for i in range(len(group)) if rest[i]), key=lambda i: -rest[i])
        bins = best_fit([(int(rest[i]), int(sources[i]), int(clusters[i])) for i in order], capacity, per_source)
        used = max(bins, default=-1) + 1
        rows = []
        ids, copies = group["doc_id"].tolist(), group["copy"].tolist()
        keys = group["cluster"].tolist()
        for i in range(len(group)):
            for piece in range(int(whole[i])):
                rows.append((ids[i], keys[i], copies[i], piece, piece * capacity, capacity, used))
                used += 1
            if not lengths[i]:
                rows.append((ids[i], keys[i], copies[i], 0, 0, 0, -1))
        for i, b in zip(order, bins, strict=True):
            rows.append((ids[i], keys[i], copies[i], int(whole[i]), int(whole[i]) * capacity, int(rest[i]), b))
        out = pd.DataFrame(rows, columns=["doc_id", "cluster", "copy", "piece", "first_token", "n_tokens", "bin"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["slot"] = out.groupby("bin").cumcount()
        out["bin_id"] = (out["bin"] + (number << 32)).where(out["bin"] >= 0).astype("Int64")
        out["slot"] = out["slot"].where(out["bin"] >= 0).astype("Int64")
        return out[["doc_id", "cluster", "copy", "piece", "first_token", "n_tokens", "bin_id", "slot"]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, per_source: int = PER_SOURCE, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """(doc_id, cluster, copy, piece, first_token, n_tokens, bin_id, slot): where every token of every row goes.

    ``length`` is the number of tokens (words by default), ``cluster`` a number that
    equal or near-equal documents share (a hash of the text by default). A bin holds at
    most ``capacity`` tokens, ``per_source`` documents of a source and one of a cluster.
    A longer document fills bins of its own and its rest is packed like others. A document
    without tokens is one row without a bin. Null texts have no tokens, null sources are
    a source; rows that are equal in every column read get a ``copy`` number each.
    """
    text = text_or_empty()
    counted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.size(word_list(text)) if length is None else length).cast("bigint").alias("length"),
        (F.xxhash64(text) if cluster is None else cluster).cast("bigint").alias("cluster"),
    )
    number = max(1, math.ceil(docs.count() / group))
    rows = counted.groupBy("doc_id", "source", "length", "cluster").count().withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(number)))
    schema = "doc_id bigint, cluster bigint, copy bigint, piece bigint, first_token bigint, n_tokens bigint, bin_id bigint, slot bigint"
    return dealt.select("g", "doc_id", "source", "length", "cluster", "copy").groupBy("g").applyInPandas(_pack_group(capacity, per_source), schema)


def packed_sequences(docs: DataFrame, placements: DataFrame) -> DataFrame:
    """(bin_id, doc_ids, text): the packed words, joined by spaces; documents of a bin are parted by a blank line.

    ``placements`` as ``pack`` returns them with its own measure of length and cluster. A bin
    gathers no more than its capacity.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("cluster"), text_or_empty().alias("text"))
    texts = texts.dropDuplicates(["doc_id", "cluster"])
    same = placements["doc_id"].eqNullSafe(texts["doc_id"]) & (placements["cluster"] == texts["cluster"])
    pieces = placements.where("bin_id IS NOT NULL").join(texts, same).select(
        "bin_id", "slot", placements["doc_id"], F.array_join(F.slice(word_list(F.col("text")), (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")), " ").alias("words")
    )
    ordered = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "words")))
    return pieces.groupBy("bin_id").agg(ordered.alias("p")).select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.words", "\n\n").alias("text"))
