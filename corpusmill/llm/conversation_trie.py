"""Prefix trie of rebuilt conversations from composable fingerprints.

A conversation is rebuilt from the head of its base and its own turns after that head. No rebuilt text is made: a
run of turns has a fingerprint in a monoid, (length, sum of turn hash times a power of the base, modulo a
prime), where the product of two runs adds the second one shifted by the length of the
first. The fingerprint of every rebuilt prefix is the product of the stored prefix of the base conversation and a
difference of two prefixes of its own. Prefixes of one depth and fingerprint are a node; all of them must
refer to the same stored turn (by its digest) and to the same parent, or other bases are taken.

Each node belongs to its smallest conversation. What a conversation owns is one chain of nodes, from where it
leaves a smaller conversation to its end, so sums over subtrees are sums along chains of what
hangs on them; the totals of chains come by doubling of pointers. No row ever meets all of its descendants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, spread_join, stored
from corpusmill.llm.ordering import key_at, numbered

#: Turns of a conversation's head come from the first conversation of its hundred.
GROUP, HEADS = 100, 6
PRIME = (1 << 31) - 1
#: Independent sums that make one fingerprint, and how often other bases are tried.
PARTS, TRIES = 4, 3
#: Turns of a conversation that one window takes, and conversation ids that are joined into one text.
BLOCK = 4096
MOST_ROUNDS = 64
NODE = ["depth", "fa", "fb"]


def bases(attempt: int) -> list[int]:
    """One multiplier for each part, from a fixed rule."""
    return [int.from_bytes(hashlib.sha256(f"{attempt}:{i}".encode()).digest()[:4], "big") % (PRIME - 2) + 2 for i in range(PARTS)]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo ``PRIME``, by squaring."""
    made, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        made[odd] = made[odd] * square % PRIME
        square, left = square * square % PRIME, left >> 1
    return made


def _terms(multipliers: list[int]):
    """Adds ``v0``, ``v1``, …: each part of a turn's digest times its multiplier to the power of the turn's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(-1, 8).astype(np.int64)
            values = [digest[:, i] % PRIME * _powers(m, place) % PRIME for i, m in enumerate(multipliers)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], names=[*batch.schema.names, *(f"v{i}" for i in range(len(values)))])

    return run


def running(rows: DataFrame, key: str, place: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``rows`` with the running sums of columns, each row's own included, by ``key`` in order of ``place``; a long key is summed in blocks."""
    cut = rows.withColumn("_block", F.floor(F.col(place) / block))
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(value).over(inside).alias(name) for name, value in sums.items()])
    totals = cut.groupBy(key, "_block").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    more = totals.select(key, "_block", *[F.sum(f"_{name}").over(earlier).alias(f"_{name}") for name in sums])
    late = keep(more.where(F.col(f"_{next(iter(sums))}").isNotNull()))
    if late.isEmpty():
        return summed.drop("_block")
    found = summed.join(late, [key, "_block"], "left")
    return found.select(*rows.columns, *[(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in sums])


def _packed(parts: list[Column]) -> list[Column]:
    """Two longs of a fingerprint's four parts."""
    return [F.shiftleft(parts[i], 31).bitwiseOR(parts[i + 1]) for i in (0, 2)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, chars, place) of every turn, stored and numbered from 0 by ``turn``, nulls first, then digest.

    Only this step reads texts. A null role or text is empty; a row without ``conv_id`` belongs to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    return numbered(stored(rows, "turns"), ["conv_id"], ["turn", "digest"]).drop("turn")


def _rebuilt(turns: DataFrame, multipliers: list[int], block: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes (depth, fa, fb, pa, pb, digest, chars, conv_id, n) that ``n`` conversations from ``conv_id`` on have, the head ones added up; and each conversation's end (conv_id, depth, fa, fb)."""
    sums = {f"s{i}": f"v{i}" for i in range(PARTS)}
    fields = "conv_id bigint, digest binary, chars bigint, place bigint, " + ", ".join(f"v{i} bigint" for i in range(PARTS))
    own = stored(running(turns.mapInArrow(_terms(multipliers), fields), "conv_id", "place", sums, block), "prefixes")
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS
    before = F.col("place") < head
    conversations = own.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        *[F.sum(f"v{i}").alias(f"all{i}") for i in range(PARTS)],
        *[F.sum(F.when(before, F.col(f"v{i}")).otherwise(0)).alias(f"cut{i}") for i in range(PARTS)],
    )
    conversations = conversations.select("*", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    step = F.struct("place", *[F.pmod(f"s{i}", F.lit(PRIME)).alias(f"s{i}") for i in range(PARTS)], "digest", "chars")
    firsts = own.where((F.col("place") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # a base has the conversations of its hundred only
    joined = conversations.join(firsts, "base", "left").withColumn("hb", F.least("h", F.coalesce(F.size("steps"), F.lit(0))).cast("bigint"))
    last = F.try_element_at("steps", F.col("hb").cast("int"))
    inverse = [[pow(m, -k, PRIME) for k in range(HEADS)] for m in multipliers]
    shift = [F.element_at(F.array(*[F.lit(x).cast("bigint") for x in row]), (F.col("h") - F.col("hb") + 1).cast("int")).alias(f"shift{i}") for i, row in enumerate(inverse)]
    at_head = [F.when(F.col("hb") > 0, last[f"s{i}"]).otherwise(0).cast("bigint").alias(f"head{i}") for i in range(PARTS)]
    known = stored(joined.select("conv_id", "n", "h", "hb", "base", *at_head, *shift, *[f"cut{i}" for i in range(PARTS)], *[f"all{i}" for i in range(PARTS)]), "conversations")

    def product(i: int, upto: Column) -> Column:
        """The head times the own turns from the cut up to a prefix sum, shifted to where they stand."""
        return F.pmod(F.col(f"head{i}") + F.pmod(upto - F.col(f"cut{i}"), F.lit(PRIME)) * F.col(f"shift{i}"), F.lit(PRIME))

    def two(columns: list[Column], names: tuple[str, str]) -> list[Column]:
        return [c.alias(n) for c, n in zip(_packed(columns), names, strict=True)]

    at = own.join(known.where("n > h").select("conv_id", "h", "hb", *[f"{c}{i}" for c in ("head", "cut", "shift") for i in range(PARTS)]), "conv_id").where("place >= h")
    mine = at.select(
        (F.col("hb") + F.col("place") - F.col("h") + 1).alias("depth"),
        *two([product(i, F.col(f"s{i}")) for i in range(PARTS)], ("fa", "fb")),
        *two([product(i, F.col(f"s{i}") - F.col(f"v{i}")) for i in range(PARTS)], ("pa", "pb")),
        "digest",
        "chars",
        "conv_id",
        F.lit(1).cast("bigint").alias("n"),
    )
    heads = known.where("hb > 0").groupBy("base", "hb").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).join(firsts, "base")
    each = heads.select("n", "conv_id", "steps", F.posexplode(F.slice("steps", F.lit(1), F.col("hb").cast("int"))).alias("i", "step"))
    shared = each.select(
        (F.col("i") + 1).cast("bigint").alias("depth"),
        *two([F.col(f"step.s{i}") for i in range(PARTS)], ("fa", "fb")),
        *two([F.when(F.col("i") > 0, F.try_element_at("steps", F.greatest("i", F.lit(1)))[f"s{i}"]).otherwise(0).cast("bigint") for i in range(PARTS)], ("pa", "pb")),
        "step.digest",
        "step.chars",
        "conv_id",
        "n",
    )
    ends = known.select(
        "conv_id",
        (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"),
        *two([F.when(F.col("n") > F.col("h"), product(i, F.col(f"all{i}"))).otherwise(F.col(f"head{i}")) for i in range(PARTS)], ("fa", "fb")),
    )
    return mine.unionByName(shared), ends


def _grouped(prefixes: DataFrame) -> DataFrame:
    """Nodes below the root (depth, fa, fb, pa, pb, chars, conv_id, n), and whether all prefixes of one refer to the same turn and parent."""
    parent = F.struct("pa", "pb")
    grouped = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.min("chars").alias("chars"), F.min(parent).alias("parent"), F.max(parent).alias("other"), F.min("digest").alias("turn"), F.max("digest").alias("another")
    )
    same = (F.col("parent") == F.col("other")) & (F.col("turn") == F.col("another"))
    return stored(grouped.select(*NODE, "parent.pa", "parent.pb", "chars", "conv_id", "n", same.alias("same")), "nodes")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's lines, which come in order; a node of many lines is read as a stream."""
    node, sha = None, hashlib.sha256()
    made: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [*zip(*made, strict=True)] if made else [[]] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])
        made.clear()
        return batch

    for batch in batches:
        for i in range(batch.num_rows):
            now, line = key_at(batch, NODE, i), batch.column("line")[i].as_py().encode()
            if now != node:
                if node is not None:
                    made.append((*node, sha.hexdigest()))
                node, sha = now, hashlib.sha256(line)
            else:
                sha.update(b"," + line)
        yield flush()
    if node is not None:
        made.append((*node, sha.hexdigest()))
        yield flush()


def end_hashes(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, fa, fb, ends_sha256): the hash of the sorted ids that end at each node. Ids are joined block by block; only the texts of blocks meet."""
    placed = numbered(stored(ends, "ends"), NODE, ["conv_id"]).withColumn("block", F.expr(f"place div {block}"))
    lines = placed.groupBy(*NODE, "block").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("line"))
    return lines.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(_lines, "depth bigint, fa bigint, fb bigint, ends_sha256 string")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved): of each chain (chain, above, leaves, saved) its own and those of all chains that hang on it, by doubling of the pointers ``above``."""
    for _ in range(MOST_ROUNDS):
        hung = chains.where("above IS NOT NULL")
        if hung.isEmpty():
            return chains.select("chain", "leaves", "saved")
        from_below = hung.groupBy(F.col("above").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        upper = chains.select(F.col("chain").alias("above"), F.col("above").alias("next"))
        moved = spread_join(hung.select("chain", "above"), upper, ["above"]).select("chain", "next")
        joined = chains.join(from_below, "chain", "left").join(moved, "chain", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        chains = stored(joined.select("chain", F.col("next").alias("above"), *added), "chains")
    raise RuntimeError(f"pointers are left after {MOST_ROUNDS} rounds")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node is a distinct sequence of first turns (role, text) of rebuilt conversations, the root has none;
    ``conv_id`` is the smallest of its conversations. Nulls: a null role or text is empty, a null turn comes first,
    rows without ``conv_id`` are left out. Turns of one number are in order of their digests, repeated rows
    are turns one after the other. Texts are read whole, once. No conversation, no root; other columns aren't read.
    """
    turns = turns_of(conversations)
    for attempt in range(TRIES):
        prefixes, ends = _rebuilt(turns, bases(attempt), block)
        nodes = _grouped(prefixes)
        if nodes.where("NOT same").isEmpty():
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes met under {TRIES} sets of bases")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count("*").alias("n_children"))
    held = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes")
    own = held.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saving", (F.col("n") - 1) * F.col("chars"))
    top = F.min_by(F.struct("depth", "pa", "pb"), "depth").alias("top")
    chains = stored(own.groupBy(F.col("conv_id").alias("chain")).agg(top, F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved")), "chains")
    tops = chains.where("top.depth > 1").select("chain", (F.col("top.depth") - 1).alias("depth"), F.col("top.pa").alias("fa"), F.col("top.pb").alias("fb"))
    hung = stored(spread_join(tops, nodes.select(*NODE, F.col("conv_id").alias("above")), NODE).select("chain", "above", "depth"), "hung")
    totals = _chain_totals(chains.join(hung.select("chain", "above"), "chain", "left").select("chain", "above", "leaves", "saved"))
    attached = totals.join(hung, "chain").groupBy(F.col("above").alias("conv_id"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    weighed = own.join(attached, ["conv_id", "depth"], "left").select(
        *NODE, "conv_id", "n", "n_children", (-F.col("depth")).alias("from_end"), (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaf"), (F.col("saving") + F.coalesce("saved", F.lit(0))).alias("saving")
    )
    summed = running(stored(weighed, "weighed"), "conv_id", "from_end", {"n_leaves": "leaf", "saved_tokens": "saving"}, block)
    above = hung.select(F.col("chain").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "above")
    every = stored(ends, "all-ends")
    first = every.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).first()
    lowest = F.lit(first["conv_id"]).cast("bigint")
    below = summed.join(above, ["conv_id", "depth"], "left").select(
        *NODE, "conv_id", F.when(F.col("depth") == 1, lowest).otherwise(F.coalesce("above", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"
    )
    zero = F.lit(0).cast("bigint")
    root = own.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saving"), zero).alias("saved_tokens"))
    root = root.where(F.lit(bool(first["n"]))).select(
        *[zero.alias(c) for c in NODE], lowest.alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(first["n"]).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"
    )
    found = below.unionByName(root).join(end_hashes(every, block), NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
