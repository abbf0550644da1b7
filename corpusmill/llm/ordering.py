"""Places of rows in an order, without a task that holds all rows of a key.

Rows are dealt by ranges of (key, order) and sorted inside each part, so a key of many rows is spread
over as many parts as it needs. A part counts its own rows; only the key it begins
with may go on from earlier parts, so what is added later is one number for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import small, stored

#: monotonically_increasing_id() has the number of the part above this many bits of the row's place in it.
PART_BITS = 33


def changes(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before in ``names``; nulls are equal."""
    n = batch.num_rows
    differ = np.zeros(max(n - 1, 0), dtype=bool)
    for name in names if n > 1 else ():
        column = batch.column(name)
        after, before = column.slice(1), column.slice(0, n - 1)
        differ |= pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
        differ |= pc.xor(pc.is_null(after), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return differ


def key_at(batch: pa.RecordBatch | pa.Table, names: list[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in names)


def _counted(by: list[str]):
    """Adds ``_local``, a row's place among the rows of its key in this part, and ``_index``, its place in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, index = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            goes_on = last is not None and key_at(batch, by, 0) == last
            starts = np.concatenate([[0], np.flatnonzero(changes(batch, by)) + 1])
            begin = np.repeat(starts, np.diff(np.append(starts, n)))
            local = np.arange(n) - begin
            if goes_on:
                local[begin == 0] += held
            last, held = key_at(batch, by, n - 1), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.arange(index, index + n))], names=[*batch.schema.names, "_local", "_index"])
            index += n

    return run


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, each row's place from 0 among the rows of the same ``by`` in ``order``, nulls first; written to the shared folder.

    ``rows`` must be a stored table: its row numbers settle ties, so that rows alike in all
    of these columns are spread as well. An empty table gives an empty table.
    """
    sort = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    tagged = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = tagged.repartitionByRange(*sort, F.col("_row").asc()).sortWithinPartitions(*sort, "_row").drop("_row")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _local bigint, _index bigint"
    counted = dealt.mapInArrow(_counted(by), schema).withColumn("_part", F.spark_partition_id())
    whole = stored(counted, "ordered")
    key = F.struct(*by)
    # of each part its first and last key and the rows of the last one: as many rows as there are parts
    parts = whole.groupBy("_part").agg(F.min_by(key, "_index").alias("first"), F.max_by(key, "_index").alias("last"), F.max_by(F.col("_local") + 1, "_index").alias("rows"))
    in_order = Window.orderBy("_part")
    ended = parts.withColumn("so_far", F.sum("rows").over(Window.partitionBy("last").orderBy("_part")))
    before = ended.select("_part", "first", F.lag("last").over(in_order).alias("key"), F.lag("so_far").over(in_order).alias("more"))
    goes_on = before.where(F.col("first").eqNullSafe(F.col("key")) & F.col("more").isNotNull())
    found = whole.join(small(goes_on.select("_part", "more")), "_part", "left")
    place = F.col("_local") + F.when(F.col("_local") == F.col("_index"), F.coalesce("more", F.lit(0))).otherwise(0)
    return found.select(*rows.columns, place.cast("bigint").alias(name))
