"""Exact duplicates by a tree of merges over sorted runs of digests.

Every part of the table makes short runs: its digests in order, each once, with the identifier that stays and
the number of rows. Runs are exchanged in rounds: ``FAN_IN`` neighbours meet, are merged
in order and become one run, until one run is left of each range of digests. A digest that a third of
all rows share is a single entry of each run, so no round has a hot key; going down the
same tree, the result reaches the rows, again by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, text_or_empty
from corpusmill.llm.decontaminate import ascii_lower
from corpusmill.llm.ordering import PART_BITS, changes

#: Runs that one merge takes.
FAN_IN = 16
#: Rows of a run at most, and rows of the whole table for one range of digests.
RUN_BITS, RANGE_ROWS = 16, 1 << 14
#: What two entries must share to be of one text: SHA-256 in its range, and as a check on it the length in bytes and a second hash.
SAME = ["digest", "octets", "check"]
ENTRY = "run bigint, span bigint, digest binary, octets bigint, check bigint, keep_id bigint, keep_row bigint, size bigint"


def _taken(whole: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """One entry for each stretch of equal ones: its first row, with the sizes added up."""
    sizes = np.add.reduceat(whole.column("size").to_numpy(), starts)
    first = whole.take(pa.array(starts))
    place = first.schema.get_field_index("size")
    return first.set_column(place, first.schema.field(place), pa.array(sizes)).combine_chunks().to_batches()[0]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges entries that come in order of run, digest and who stays; holds one batch and the last entry of the one before."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(changes(whole, ["run", *SAME])) + 1])
        made = _taken(whole, starts)
        if made.num_rows > 1:
            yield made.slice(0, made.num_rows - 1)
        rest = pa.Table.from_batches([made.slice(made.num_rows - 1)]).combine_chunks().to_batches()[0]
    if rest is not None:
        yield rest


def _order(smallest: bool) -> list[Column]:
    """Entries of one text begin with the one that stays: nulls come last, and the row's place settles ties."""
    return [F.col("keep_id").asc_nulls_last() if smallest else F.col("keep_id").desc_nulls_last(), F.col("keep_row").asc()]


def _merge(entries: DataFrame, into: Column, smallest: bool) -> DataFrame:
    """One round: the runs of the same ``into`` meet, a range of digests at a time, and become one sorted run."""
    met = entries.withColumn("run", into).repartition("span", "run").sortWithinPartitions("span", "run", *SAME, *_order(smallest))
    return stored(met.mapInArrow(_merged, ENTRY), "runs")


def hashed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, row, run, digest, octets, check) of every row, stored: only this step reads texts, and none is shuffled."""
    body = ascii_lower(text_or_empty(text).cast("string"))
    row = F.monotonically_increasing_id()
    made = docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("body"), row.alias("row"))
    return stored(
        made.select(
            "doc_id",
            "row",
            F.shiftright("row", RUN_BITS).alias("run"),
            F.unhex(F.sha2("body", 256)).alias("digest"),
            F.octet_length("body").cast("bigint").alias("octets"),
            F.xxhash64("body").alias("check"),
        ),
        "digests",
    )


def duplicate_groups(docs: DataFrame, smallest: bool = True, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if they are after A to Z became lower case; a null text counts as empty. Of equal
    texts the row of the smallest ``doc_id`` stays, or of the largest; a null ``doc_id`` stays only if
    all of them are null. Of rows that share that ``doc_id`` as well, exactly one stays.
    Long texts are read whole, once. An empty table gives no rows; other columns aren't read.
    """
    rows = hashed_rows(docs, text, key)
    number, last = rows.agg(F.count("*"), F.max(F.shiftright("row", PART_BITS))).first()
    spans = max(1, -(-number // range_rows))
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    entries = rows.select("run", F.shiftright(head * F.lit(spans), 32).alias("span"), *SAME, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("bigint").alias("size"))
    # a run is made where its rows lie; a file that is cut in two gives two runs of one number, which meet in the first round
    levels = [stored(entries.sortWithinPartitions("run", *SAME, *_order(smallest)).mapInArrow(_merged, ENTRY), "runs")]
    steps = [F.shiftright("run", PART_BITS - RUN_BITS)]
    parts = (last or 0) + 1
    while parts > 1:
        parts = -(-parts // fan_in)
        steps.append(F.expr(f"run div {fan_in}"))
    for step in steps:
        levels.append(_merge(levels[-1], step, smallest))
    known = levels[-1].where("size > 1").select("run", *SAME, "keep_id", "keep_row", "size")
    for level, step in zip(reversed(levels[:-1]), reversed(steps), strict=True):
        below = level.select(F.col("run").alias("below"), step.alias("run"), *SAME).join(known, ["run", *SAME])
        known = stored(below.select(F.col("below").alias("run"), *SAME, "keep_id", "keep_row", "size"), "kept")
    known = known.dropDuplicates(["run", *SAME])
    found = rows.join(known, ["run", *SAME], "left")
    alone = F.col("size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
