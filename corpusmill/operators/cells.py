"""Vector search by cells: vectors are filed under their nearest centre, and a query reads few cells.

Centres are fitted on a bounded sample, every vector is filed. A cell knows its radius, so no
vector in it is nearer to a query than the centre less the radius: with a greatest distance,
reading the cells that this bound allows is exact. ``probes`` reads the nearest ones only, and
is measured against the exact search. Cells lie together in groups of a bounded number of vectors.
Queries are copied to the groups they read cells of, once each; no vector is copied: a task holds one
group and streams that group's queries past the cells that they read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.access import attach_grants
from corpusmill.operators.dense import LEAST_ROWS, VECTOR_BLOCK, Mask, everything, group_rows, meet_in_groups, visible, with_rights
from corpusmill.operators.scale import ranked, stage

# Vectors that centres are fitted on, rounds of fitting, and the most cells there are.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 15, 4096
# Queries of one part of a batch, and copies of queries that are made at a time.
BATCH_ROWS, COPIES = 16_384, 16_384
# Distances to centres that a task holds at a time.
APART = 2_000_000
# Slack on bounds, for sums in another order.
SLACK = 1e-6


@dataclass
class CellIndex:
    """``vectors`` with their ``cell``; ``cells``: cell, center, radius, rows, one row for each of at most ``MOST_CELLS``; the metric they were filed by."""

    vectors: DataFrame
    cells: DataFrame
    metric: str = "l2"

    def write(self, path: str) -> None:
        self.vectors.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        self.cells.withColumn("metric", F.lit(self.metric)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @staticmethod
    def read(spark: SparkSession, path: str) -> CellIndex:
        cells = spark.read.parquet(f"{path}/cells")
        metric = cells.agg(F.max("metric")).first()[0] or "l2"
        return CellIndex(spark.read.parquet(f"{path}/vectors"), cells.drop("metric"), metric)


def _placed(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as cells see them: of length 1 for the cosine, half of whose squared distance is one minus the cosine."""
    if metric != "cosine":
        return matrix
    length = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1.0, length)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.empty((0, 0))


def _steps(rows: int, width: int) -> Iterator[slice]:
    """Parts of so many rows that their distances to ``width`` centres stay within ``APART``."""
    step = max(1, APART // max(width, 1))
    return (slice(start, min(start + step, rows)) for start in range(0, rows, step))


def fit_centers(vectors: DataFrame, cells: int, metric: str = "l2", sample: int = SAMPLE) -> np.ndarray:
    """Centres by k-means on at most ``sample`` vectors, chosen by their hash; the result doesn't depend on the order of rows."""
    rows = vectors.select("embedding").where("embedding IS NOT NULL").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toPandas()
    points = _placed(np.stack(rows["embedding"]).astype(np.float64), metric) if len(rows) else np.zeros((0, 1))
    points = np.unique(points, axis=0) if len(points) else points
    if not len(points):
        return points
    pick = np.random.default_rng(7)
    centers = points[pick.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        own = _apart(points, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        number = np.bincount(own, minlength=len(centers))
        moved = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def build_cells(vectors: DataFrame, cells: int | None = None, metric: str = "l2", sample: int = SAMPLE) -> CellIndex:
    """Files every vector under its nearest centre; about the root of their number of cells unless ``cells`` says how many.

    A row without an embedding is in no cell. The caller keeps the result.
    """
    number = cells or max(1, min(MOST_CELLS, math.isqrt(vectors.count())))
    centers = fit_centers(vectors, number, metric, sample)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            placed = _placed(_matrix(batch.column("embedding")), metric)
            for some in _steps(len(placed), len(centers)):
                apart = _apart(placed[some], centers)
                own = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(some.start, len(own)).columns, pa.array(own.astype(np.int32)), pa.array(apart[np.arange(len(own)), own])],
                    names=[*batch.schema.names, "cell", "_apart"],
                )

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_apart", T.DoubleType())])
    filed = vectors.where("embedding IS NOT NULL").mapInArrow(file, schema)
    if not len(centers):
        empty = vectors.sparkSession.createDataFrame([], "cell int, center array<double>, radius double, rows bigint")
        return CellIndex(filed.drop("_apart"), empty, metric)
    shapes = filed.groupBy("cell").agg(F.max("_apart").alias("radius"), F.count("*").alias("rows"))
    places = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    return CellIndex(filed.drop("_apart"), F.broadcast(places).join(shapes, "cell").select("cell", "center", "radius", "rows"), metric)


def _probed(cells: pd.DataFrame, metric: str, max_distance: float, probes: int | None) -> Callable:
    """Which cells each query of a batch reads, a matrix."""
    centers, radius = np.stack(cells["center"]), cells["radius"].to_numpy()

    def read(queries: np.ndarray) -> np.ndarray:
        apart = _apart(_placed(queries, metric), centers)
        least = np.maximum(apart - radius[None, :] - SLACK, 0.0) ** 2
        allowed = (least / 2 if metric == "cosine" else least) <= max_distance + SLACK
        if probes is None or probes >= len(centers):
            return allowed
        if probes < 1:
            return np.zeros_like(allowed)
        # The nearest so many; of those that are as far as the last of them, the first.
        apart = np.where(allowed, apart, np.inf)
        last = np.partition(apart, probes - 1, axis=1)[:, probes - 1 : probes]
        nearer, equal = apart < last, apart == last
        room = probes - nearer.sum(axis=1, keepdims=True)
        return (nearer | (equal & (np.cumsum(equal, axis=1) <= room))) & allowed

    def of(queries: np.ndarray) -> np.ndarray:
        return np.concatenate([read(queries[some]) for some in _steps(len(queries), len(centers))])

    return of


def _grouped(cells: pd.DataFrame, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell. Cells that lie along one direction are packed up to ``part_rows`` vectors; a larger one is dealt over groups of its own."""
    centers, rows = np.stack(cells["center"]), cells["rows"].to_numpy()
    across = np.linalg.svd(centers - centers.mean(axis=0), full_matrices=False)[2][0]
    parts = np.maximum(1, np.ceil(rows / part_rows)).astype(np.int64)
    first, group, filled = np.zeros(len(rows), np.int64), 0, 0
    for cell in np.argsort(centers @ across, kind="stable").tolist():
        if filled and (parts[cell] > 1 or filled + rows[cell] > part_rows):
            group, filled = group + 1, 0
        first[cell] = group
        if parts[cell] > 1:
            group += int(parts[cell])
        else:
            filled += int(rows[cell])
    return first, parts


def nearest_in_cells(
    queries: DataFrame,
    index: CellIndex,
    keys: list[str],
    k: int,
    max_distance: float = math.inf,
    mask: Mask = everything,
    probes: int | None = None,
    prepare: Callable[[DataFrame, DataFrame, list[str]], DataFrame] | None = None,
    carry: list[str] | None = None,
    part_rows: int = VECTOR_BLOCK,
    by: list[str] | None = None,
) -> DataFrame:
    """As ``dense.nearest`` over an index of cells: (query_id, rank, distance, keys).

    Without ``probes`` the result is exact. Rights come before the cut, by ``mask``. With ``by``, whole-number
    columns of both sides, only rows with the same values meet; a query may come once for each of several.
    """
    carried = carry or []
    spark = queries.sparkSession
    vectors = index.vectors
    fields = [queries.schema["query_id"], *[vectors.schema[c] for c in [*keys, *carried]], T.StructField("distance", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    cells = index.cells.toPandas().sort_values("cell", ignore_index=True)
    if cells.empty:
        return ranked(spark.createDataFrame([], schema), ["query_id"], [F.col("distance")], k)
    of = _probed(cells, index.metric, max_distance, probes)
    numbers = cells["cell"].to_numpy()
    part_rows = group_rows(vectors, part_rows, mask)
    if by:
        asked, filed = _by_values(queries, vectors, keys, by, part_rows)
        place, groups = [*by, "part", "query_part"], None
    else:
        asked, filed = _by_cells(queries, vectors, keys, cells, of, part_rows)
        place, groups = ["part"], int(np.add(*_packed(spark, cells, part_rows)).max())
    if prepare:
        filed = prepare(filed, queries, [])
    found = meet_in_groups(asked, filed, place, groups, schema, keys, carried, k, max_distance, index.metric, mask, numbers, of)
    return ranked(found, ["query_id"], [F.col("distance"), *[F.col(c) for c in keys]], k)


def _packed(spark: SparkSession, cells: pd.DataFrame, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_grouped``, in smaller groups where there would be fewer than keep all cores busy."""
    few = math.ceil(int(cells["rows"].sum()) / (2 * spark.sparkContext.defaultParallelism))
    return _grouped(cells, min(part_rows, max(few, LEAST_ROWS)))


def _by_cells(queries: DataFrame, vectors: DataFrame, keys: list[str], cells: pd.DataFrame, of: Callable, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries at the groups they read cells of, and vectors in their group."""
    spark = queries.sparkSession
    first, parts = _packed(spark, cells, part_rows)
    groups = int((first + parts).max())
    member = np.zeros((len(cells), groups), np.float32)
    for cell, (low, number) in enumerate(zip(first.tolist(), parts.tolist(), strict=True)):
        member[cell, low : low + number] = 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("embedding"))
            for some in _steps(len(matrix), max(len(cells), groups)):
                row, group = np.nonzero(of(matrix[some]).astype(np.float32) @ member)
                for start in range(0, len(row), COPIES):
                    made = batch.take(pa.array(some.start + row[start : start + COPIES]))
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(group[start : start + COPIES].astype(np.int32))], names=[*batch.schema.names, "part"])

    asked = queries.mapInArrow(ask, T.StructType([*queries.schema.fields, T.StructField("part", T.IntegerType())]))
    shapes = spark.createDataFrame(pd.DataFrame({"cell": cells["cell"].to_numpy().astype(np.int32), "first": first, "parts": parts}))
    # No more rows than there are cells.
    filed = vectors.join(F.broadcast(shapes), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64(*keys), F.col("parts"))).cast("int"))
    return asked, filed.drop("first", "parts")


def _by_values(queries: DataFrame, vectors: DataFrame, keys: list[str], by: list[str], part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by the values of ``by``; where many rows share them, in a grid of bounded parts of vectors and of the batch."""
    parts = vectors.groupBy(*by).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    shares = queries.groupBy(*by).agg(F.ceil(F.count("*") / BATCH_ROWS).cast("int").alias("shares"))
    shapes = parts.join(shares, by)
    dealt = lambda columns, number: F.pmod(F.xxhash64(*columns), F.col(number)).cast("int")
    across = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    asked = queries.join(shapes, by).withColumn("query_part", dealt(["query_id"], "shares")).withColumn("part", across("parts"))
    filed = vectors.join(shapes, by).withColumn("part", dealt(keys, "parts")).withColumn("query_part", across("shares"))
    return asked.drop("parts", "shares"), filed.drop("parts", "shares")


def search_cells(
    queries: DataFrame,
    index: CellIndex,
    acl: DataFrame | None = None,
    k: int = 20,
    max_distance: float = 1.5,
    keys: list[str] | None = None,
    probes: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """As ``dense.dense_search`` over an index of cells: nearest visible vectors per query, visibility before the cut."""
    keys = keys or ["doc_id", "chunk_index"]
    if acl is None:
        return nearest_in_cells(queries.select("query_id", "embedding"), index, keys, k, max_distance, probes=probes, carry=carry)
    asked, stored = with_rights(queries, index.vectors, ["cell", *keys, *(carry or [])])
    filed = CellIndex(stored, index.cells, index.metric)
    # Read several times, and may come from a join with all users.
    asked = stage(asked, "asked")
    grants = lambda rows, batch, by: attach_grants(rows, acl, batch, by)
    return nearest_in_cells(asked, filed, keys, k, max_distance, visible, probes, grants, carry)


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many of the exact hits were found, and their share."""
    both = exact.select("query_id", *keys).join(found.select("query_id", *keys, F.lit(1).alias("_hit")), ["query_id", *keys], "left")
    return both.agg(F.count("*").alias("hits"), F.count("_hit").alias("found")).withColumn("recall", F.try_divide("found", "hits"))
