"""Sharding over fixed virtual slots and a versioned map from slots to shards.

Records are hashed into ``SLOTS`` slots once and for all. Bytes and rows are added up per
slot; the map, one small table whatever the corpus, says which shard a slot belongs to.
Rebalancing edits the map into its next version and moves only the slots it names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, scratch_path, stored, text_or_empty
from corpusmill.llm.ordering import numbered

SLOTS = 4096
SHARDS = 24
#: What a record takes beside its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]`` for every slot, and the version of this edit."""

    version: int
    shard_of: tuple[int, ...]

    def moved(self, other: SlotMap) -> list[int]:
        """Slots that belong to another shard in ``other``."""
        return [slot for slot, (a, b) in enumerate(zip(self.shard_of, other.shard_of, strict=True)) if a != b]


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1: runs of equally many slots, before any bytes are known."""
    return SlotMap(1, tuple(slot * shards // slots for slot in range(slots)))


def rebalanced(now: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """The next version, with shard sizes near equal.

    Shards over the mean give up slots until they aren't, large ones as long as they fit
    into what is too much, then small ones; what is given up goes, largest first, to the shard with the least. Slots of
    shards that no longer exist are given up too. Empty slots stay.
    """
    mean = sum(sizes.values()) / shards
    loads = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    free = []
    target = list(now.shard_of)
    for slot, shard in enumerate(now.shard_of):
        size = sizes.get(slot, 0)
        if shard >= shards:
            free.append((size, slot))
        else:
            loads[shard] += size
            held[shard].append((size, slot))
    for shard in range(shards):
        kept = []
        for size, slot in sorted(held[shard], reverse=True):  # large ones that are over the mean as a whole
            if 0 < size <= loads[shard] - mean:
                loads[shard] -= size
                free.append((size, slot))
            else:
                kept.append((size, slot))
        for size, slot in sorted(kept):  # then small ones, down to just under the mean
            if size and loads[shard] > mean and len(kept) > 1:
                loads[shard] -= size
                free.append((size, slot))
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for size, slot in sorted(free, key=lambda s: (-s[0], s[1])):
        load, shard = heapq.heappop(heap)
        target[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return SlotMap(now.version + 1, tuple(target))


def write_map(spark: SparkSession, current: SlotMap, path: str) -> None:
    """Adds a version to the table of maps at ``path``, in a folder of its own; a version is written once."""
    rows = [(slot, shard) for slot, shard in enumerate(current.shard_of)]
    spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={current.version}")


def read_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
    return SlotMap(version, tuple(r["shard"] for r in rows))


def newest(spark: SparkSession, path: str) -> int | None:
    """The highest version stored at ``path``; None if there is none yet."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record; a null text has no bytes and the checksum of an empty one.

    Rows equal in id and checksum are numbered, and the number is hashed too: copies are spread over the slots.
    """
    text = text_or_empty()
    size = (F.octet_length(text) + OVERHEAD).cast("bigint")
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    copies = numbered(stored(measured, "records"), ["doc_id", "text_crc32"], ["size"], "copy")
    return copies.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int")).drop("copy")


def slot_totals(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows), added up before the shuffle; at most one row for each slot comes to the driver."""
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return [(r["virtual_slot"], r["bytes"], r["rows"]) for r in totals.collect()]


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for every row of ``docs``.

    The newest map at ``maps``, or the first one, is edited for the sizes of these records, stored as the next version
    and read back; without ``maps`` that is a new folder in the shared one. ``law`` is ``bytes``: shards are near equal in size. ``slot`` is the row's place in its
    shard, gapless from 0: slots of a shard follow each other and rows within one go by
    ``doc_id``, so no shard is sorted as a whole. Repeated rows get a place each, null ids one like others; a null
    text has size ``OVERHEAD``. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    records = keep(sized(docs, slots))
    totals = slot_totals(records)
    path = maps or scratch_path(spark, "slot-maps")
    version = newest(spark, path)
    if version is None:
        write_map(spark, first_map(shards, slots), path)
        version = 1
    now = read_map(spark, path, version)
    if len(now.shard_of) != slots:
        raise ValueError(f"the map at {path} has {len(now.shard_of)} slots, not {slots}; their number is fixed")
    write_map(spark, rebalanced(now, {slot: size for slot, size, _ in totals}, shards), path)
    mapped = read_map(spark, path, version + 1)
    offsets, filled = [], [0] * shards
    for slot, _, rows in sorted(totals):
        to = mapped.shard_of[slot]
        offsets.append((slot, to, filled[to]))
        filled[to] += rows
    placed = spark.createDataFrame(offsets, "virtual_slot int, shard int, before bigint")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    numbered = records.withColumn("at", F.row_number().over(order) - 1)
    # the map has no more rows than there are slots
    return numbered.join(F.broadcast(placed), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(mapped.version).alias("map_version"),
    )
