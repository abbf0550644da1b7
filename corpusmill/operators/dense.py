"""Exact vector search for query batches.

A bounded batch becomes one matrix that every task holds; the vectors stay where
they are, are multiplied block by block, and each task returns only its best k
per query. A batch beyond the bound meets the vectors in a grid of bounded
groups instead, with the same kernel: a task holds one group and streams queries past it.

Queries are multiplied only with the rows that their callers may see, in single precision. Whatever may be
near enough by the error bound of that product is then measured in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators.access import CONTEXT, attach_grants
from corpusmill.operators.scale import ranked, stage, within

QUERY_BLOCK = 4096
# Rows of a group of vectors that a task holds, and numbers in them at most; rows where smaller groups would make more of them than cores.
VECTOR_BLOCK, VECTOR_VALUES, LEAST_ROWS = 65_536, 16_000_000, 1024
SCAN_ROWS = 2048
DIGITS = 9
# Pairs of a block for each one near enough, from which those few are sorted by themselves.
FEW = 16
# Queries that meet a group at a time, by rows that callers see and by the matrix of a mask; rows of a group for a mask.
ASKED, MASKED, MASKED_ROWS = 8192, 512, 16_384
# Queries and rows of one product, pairs that are measured at a time and numbers in them, hits that are kept before they are cut.
TILE_QUERIES, TILE_ROWS, MEASURED, VALUES, POOL = 512, 4096, 65_536, 2_000_000, 262_144
# Squared lengths beyond which single precision may overflow.
LONG = 1e30

Mask = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def everything(queries: pd.DataFrame, vectors: pd.DataFrame) -> np.ndarray:
    return np.ones((len(queries), len(vectors)), dtype=bool)


def visible(queries: pd.DataFrame, vectors: pd.DataFrame) -> np.ndarray:
    """Matrix of ``access.visible_columns`` for a block; missing ids were made unequal before."""
    shared = (
        (queries["caller_tenant"].to_numpy()[:, None] == vectors["tenant_id"].to_numpy()[None, :])
        & (vectors["doc_level"].to_numpy() == "public")[None, :]
        & (vectors["min_level"].to_numpy()[None, :] <= queries["clearance"].to_numpy()[:, None])
    )
    owned = queries["user_id"].to_numpy()[:, None] == vectors["owner_id"].to_numpy()[None, :]
    mask = shared | owned | queries["is_admin"].to_numpy(dtype=bool)[:, None]
    if "granted_to" in vectors:
        users = queries["user_id"].to_numpy()
        for i, granted in enumerate(vectors["granted_to"]):
            if granted is not None and len(granted):
                mask[:, i] |= np.isin(users, granted)
    return mask


class TopK:
    """Running best k per query over blocks of rows, by distance and then by key."""

    def __init__(self, query_ids: np.ndarray, keys: list[str], carried: list[str], k: int, max_distance: float = math.inf):
        self.query_ids, self.keys, self.carried, self.k = query_ids, keys, carried, k
        self.bound = np.full(len(query_ids), max_distance, dtype=np.float64)
        self.parts: list[pd.DataFrame] = []
        self.rows = 0

    def take(self, distance: np.ndarray, rows: pd.DataFrame, queries: np.ndarray | None = None) -> None:
        """A block of distances (queries by rows, infinite where a pair doesn't count); ``rows`` are in key order, ``queries`` names those of the block."""
        limit = self.bound if queries is None else self.bound[queries]
        # At most k per query: of many equal rows, those first in key order.
        near = distance <= limit[:, None]
        if np.count_nonzero(near) * FEW < distance.size:
            query, row = np.nonzero(near)
            order = np.lexsort((row, distance[query, row], query))
            query, row = query[order], row[order]
            least = np.searchsorted(query, query, side="left")
            kept = (np.arange(len(query)) - least < self.k) & np.isfinite(distance[query, row])
            query, row = query[kept], row[kept]
            if not len(query):
                return
        else:
            if distance.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
            nearer = distance < limit[:, None]
            equal = (distance == limit[:, None]) & np.isfinite(distance)
            room = self.k - nearer.sum(axis=1)
            query, row = np.nonzero(nearer | (equal & (np.cumsum(equal, axis=1) <= room[:, None])))
        part = rows[[*self.keys, *self.carried]].iloc[row].reset_index(drop=True)
        part["_query"], part["distance"] = query if queries is None else queries[query], distance[query, row]
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > 8 * self.k * len(self.query_ids):
            self.prune()

    def prune(self) -> None:
        joined = pd.concat(self.parts).sort_values(["_query", "distance", *self.keys], kind="stable")
        joined = joined[joined.groupby("_query").cumcount() < self.k]
        last = joined.groupby("_query")["distance"].agg(["size", "max"])
        full = last[last["size"] == self.k]
        self.bound[full.index] = np.minimum(self.bound[full.index], full["max"])
        self.parts, self.rows = [joined], len(joined)

    def result(self) -> pd.DataFrame | None:
        if not self.rows:
            return None
        self.prune()
        out = self.parts[0]
        out.insert(0, "query_id", self.query_ids[out["_query"]])
        return out.drop(columns="_query")


class Block:
    """Some rows of vectors in key order, and their matrix."""

    def __init__(self, vectors: pd.DataFrame, keys: list[str]):
        self.rows = vectors.sort_values(keys, ignore_index=True)
        self.matrix = np.stack(self.rows["embedding"]).astype(np.float64)
        self.norms = (self.matrix**2).sum(axis=1)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values in all columns."""
    n = len(columns[0])
    if not n:
        return
    differs = np.zeros(n - 1, dtype=bool)
    for column in columns:
        differs |= column[1:] != column[:-1]
    edges = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
    yield from zip(edges[:-1], edges[1:], strict=True)


class Callers:
    """Queries of a batch by what their callers may see: administrators, and the others by tenant and clearance, among them by user."""

    def __init__(self, queries: pd.DataFrame):
        admin = queries["is_admin"].to_numpy(dtype=bool)
        self.admin, rest = np.flatnonzero(admin), np.flatnonzero(~admin)
        column = lambda name: queries[name].to_numpy()[rest]
        order = np.lexsort((column("user_id"), column("clearance"), column("caller_tenant")))
        tenant, clearance, user = (column(name)[order] for name in ("caller_tenant", "clearance", "user_id"))
        rest, self.classes = rest[order], []
        for low, high in _runs(tenant, clearance):
            users = [(user[low + a], rest[low + a : low + b]) for a, b in _runs(user[low:high])]
            self.classes.append((tenant[low], clearance[low], rest[low:high], users))


class Rights:
    """Rows of a block in the order that callers' rights ask for."""

    def __init__(self, rows: pd.DataFrame, wide: np.ndarray):
        self.tenant, self.least = rows["tenant_id"].to_numpy(), rows["min_level"].to_numpy()
        self.public = rows["doc_level"].to_numpy() == "public"
        shared = np.flatnonzero(self.public)
        self.shared = shared[np.lexsort((self.least[shared], self.tenant[shared]))]
        self.shared_wide, self.shared_tenant, self.shared_least = wide[self.shared], self.tenant[self.shared], self.least[self.shared]
        user, row = rows["owner_id"].to_numpy(), np.arange(len(rows))
        if "granted_to" in rows:
            granted = [(i, g) for i, g in enumerate(rows["granted_to"]) if g is not None and len(g)]
            if granted:
                number = np.fromiter((len(g) for _, g in granted), np.int64, len(granted))
                user = np.concatenate([user, *[np.asarray(g, dtype=np.int64) for _, g in granted]])
                row = np.concatenate([row, np.repeat(np.fromiter((i for i, _ in granted), np.int64, len(granted)), number)])
        order = np.lexsort((row, user))
        self.user, self.row = user[order], row[order]

    def open_to(self, tenant: int, clearance: int) -> slice:
        """Of ``shared``: public rows of the tenant within the clearance."""
        low, high = np.searchsorted(self.shared_tenant, [tenant, tenant + 1])
        return slice(low, low + np.searchsorted(self.shared_least[low:high], clearance, side="right"))

    def own(self, user: int, tenant: int, clearance: int) -> np.ndarray:
        """Rows that the user owns or was granted, without those that are open to their tenant."""
        low, high = np.searchsorted(self.user, [user, user + 1])
        rows = np.unique(self.row[low:high])
        return rows[~(self.public[rows] & (self.tenant[rows] == tenant) & (self.least[rows] <= clearance))]


class Part:
    """Some rows of a group: their numbers in it, and their matrix as ``_Best`` multiplies it."""

    def __init__(self, ids: np.ndarray, group: Group):
        self.ids, self.wide = ids, group.wide(ids)
        self.cells = None if group.at is None else np.unique(group.at[ids])
        self.rights = Rights(group.rows.iloc[ids], self.wide) if group.rights else None

    def tiles(self, callers: Callers | None, everyone: np.ndarray, chosen: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, rows and their matrix: every pair that counts, in one tile only, and no other pair."""
        pick = lambda q: q if chosen is None else q[chosen[q]]
        if callers is None:
            yield pick(everyone), self.ids, self.wide
            return
        yield pick(callers.admin), self.ids, self.wide
        for tenant, clearance, asked, users in callers.classes:
            seen = self.rights.open_to(tenant, clearance)
            yield pick(asked), self.ids[self.rights.shared[seen]], self.rights.shared_wide[seen]
            for user, mine in users:
                own = self.rights.own(user, tenant, clearance)
                if len(own):
                    yield pick(mine), self.ids[own], self.wide[own]


class Group:
    """Rows of vectors in key order with their matrix, in parts; with ``cells``, the rows of a cell lie in few parts."""

    def __init__(
        self, rows: pd.DataFrame, matrix: np.ndarray, keys: list[str], metric: str, mask: Mask, cells: np.ndarray | None = None, part_rows: int | None = None
    ):
        order = rows.reset_index(drop=True).sort_values(keys, kind="stable").index.to_numpy()
        self.rows, self.matrix, self.metric, self.rights = rows.iloc[order].reset_index(drop=True), matrix[order], metric, mask is visible
        self.norms = np.einsum("ij,ij->i", self.matrix, self.matrix, dtype=np.float64)
        # By the error of a sum of so many products, with a factor of two.
        self.eps = (matrix.shape[1] + 16) * 2.0**-23
        self.slack = self.eps * (np.ones(len(order)) if metric == "cosine" else self.norms)
        finite = self.norms[np.isfinite(self.norms)]
        self.kind = np.float64 if len(finite) and finite.max() > LONG else np.float32
        self.at = None if cells is None else np.searchsorted(cells, self.rows["cell"].to_numpy())
        place = np.arange(len(order)) if self.at is None else np.argsort(self.at, kind="stable")
        step = part_rows or max(1, len(order))
        self.parts = [Part(place[low : low + step], self) for low in range(0, len(order), step)]
        self.most_slack = float(self.slack[np.isfinite(self.slack)].max(initial=0.0))

    def wide(self, ids: np.ndarray) -> np.ndarray:
        """Rows with one more column, so that the product with (query, 1) falls as the distance grows; never too low by more than the query's slack."""
        rows, norms, slack = self.matrix[ids], self.norms[ids], self.slack[ids]
        if self.metric == "cosine":
            length = np.sqrt(norms)
            return np.column_stack([rows / np.where(length == 0, 1.0, length)[:, None], slack]).astype(self.kind)
        return np.column_stack([rows.astype(self.kind, copy=False), (slack - norms / 2).astype(self.kind)])


def _where(hit: np.ndarray) -> np.ndarray:
    """Places of the true values of a flat matrix, eight at a time as most are false."""
    hit = hit.reshape(-1)
    even = len(hit) // 8 * 8
    some = (np.flatnonzero(hit[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([some[hit[some]], even + np.flatnonzero(hit[even:])])


class _Best(TopK):
    """The best k of blocks of vectors for a batch of query vectors."""

    def __init__(
        self, queries: pd.DataFrame, keys: list[str], carried: list[str], k: int, max_distance: float, metric: str, mask: Mask,
        matrix: np.ndarray | None = None,
    ):
        self.queries = queries.reset_index(drop=True)
        super().__init__(self.queries["query_id"].to_numpy(), keys, carried, k, max_distance)
        self.matrix = np.stack(self.queries["embedding"]).astype(np.float64) if matrix is None else matrix.astype(np.float64)
        self.norms = (self.matrix**2).sum(axis=1)
        self.metric, self.mask = metric, mask
        self.tiled = mask is everything or mask is visible
        if self.tiled:
            self._widen()

    def _widen(self) -> None:
        self.callers, self.everyone = Callers(self.queries) if self.mask is visible else None, np.arange(len(self.queries))
        rows, size = self.matrix, self.norms
        if self.metric == "cosine":
            length = np.sqrt(self.norms)
            rows, size = rows / np.where(length == 0, 1.0, length)[:, None], np.ones(len(rows))
        self.slack = (self.matrix.shape[1] + 16) * 2.0**-23 * size / 2 + 1e-8
        finite = size[np.isfinite(size)]
        kind = np.float64 if len(finite) and finite.max() > LONG else np.float32
        self.wide = np.column_stack([rows, np.ones(len(rows))]).astype(kind)
        self.limit_to_bound()

    def limit_to_bound(self) -> None:
        """The least product of a pair within the bound."""
        least = (1.0 - self.bound if self.metric == "cosine" else (self.norms - self.bound) / 2) - self.slack
        self.limit = np.nextafter(least.astype(self.wide.dtype), self.wide.dtype.type(-np.inf))

    def add(self, vectors: pd.DataFrame) -> None:
        if not len(vectors):
            return
        if self.tiled:
            matrix = np.stack(vectors["embedding"])
            self.search(Group(vectors.drop(columns="embedding"), matrix, self.keys, self.metric, self.mask))
            return
        for start in range(0, len(vectors), SCAN_ROWS):
            self.meet(Block(vectors.iloc[start : start + SCAN_ROWS].reset_index(drop=True), self.keys))

    def meet(self, block: Block, queries: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        """A block, for all queries or those of the numbers ``queries``; pairs that are not ``allowed`` don't count."""
        mine = slice(None) if queries is None else queries
        product = self.matrix[mine] @ block.matrix.T
        if self.metric == "cosine":
            lengths = np.sqrt(np.outer(self.norms[mine], block.norms))
            distance = 1.0 - product / np.where(lengths == 0, 1.0, lengths)
        else:
            distance = np.maximum(self.norms[mine][:, None] + block.norms[None, :] - 2 * product, 0.0)
        distance = np.round(distance, DIGITS)
        distance[~self.mask(self.queries.iloc[mine], block.rows)] = np.inf
        if allowed is not None:
            distance[~allowed] = np.inf
        self.take(distance, block.rows, queries)

    def search(self, group: Group, read: np.ndarray | None = None) -> None:
        """A group of vectors; ``read``, a matrix, says which cells each query reads."""
        self.group, self.read, self.raw, self.raw_rows, self.hits, self.hit_rows = group, read, [], 0, [], 0
        for part in group.parts:
            chosen = None if read is None else read[:, part.cells].any(axis=1)
            for queries, rows, wide in part.tiles(self.callers, self.everyone, chosen):
                if len(queries) and len(rows):
                    self._multiply(queries, rows, wide)
        self._measure()
        self._cut()
        if not self.hit_rows:
            return
        query, row, distance = self.hits[0]
        found = group.rows[[*self.keys, *self.carried]].iloc[row].reset_index(drop=True)
        found["_query"], found["distance"] = query, distance
        self.parts.append(found)
        self.rows += len(found)
        if self.rows > 8 * self.k * len(self.query_ids):
            self.prune()
            self.limit_to_bound()

    def _multiply(self, queries: np.ndarray, rows: np.ndarray, wide: np.ndarray) -> None:
        for first in range(0, len(queries), TILE_QUERIES):
            asked = queries[first : first + TILE_QUERIES]
            left = self.wide[asked]
            for start in range(0, len(rows), TILE_ROWS):
                held = rows[start : start + TILE_ROWS]
                product = left @ wide[start : start + TILE_ROWS].T
                near = _where(product >= self.limit[asked][:, None])
                if len(near) * FEW > product.size and len(held) > self.k:
                    near = _where(product >= self._tighter(product, asked, held)[:, None])
                if not len(near):
                    continue
                query, row = np.divmod(near, len(held))
                self.raw.append((asked[query], held[row]))
                self.raw_rows += len(near)
                if self.raw_rows > MEASURED:
                    self._measure()

    def _tighter(self, product: np.ndarray, asked: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The limit where k rows of the tile itself are nearer than most; pairs that don't count are taken out of it."""
        if self.read is not None:
            product[~self.read[asked][:, self.group.at[held]]] = -np.inf
        product[np.isnan(product)] = -np.inf
        least = np.partition(product, len(held) - self.k, axis=1)[:, len(held) - self.k].astype(np.float64)
        least -= 2 * (self.group.most_slack + self.slack[asked])
        return np.maximum(self.limit[asked], np.nextafter(least.astype(product.dtype), product.dtype.type(-np.inf)))

    def _measure(self) -> None:
        """Distances of the pairs that may be near enough, as ``meet`` computes them."""
        if not self.raw_rows:
            return
        query, row = (np.concatenate(c) for c in zip(*self.raw, strict=True))
        self.raw, self.raw_rows = [], 0
        if self.read is not None:
            kept = self.read[query, self.group.at[row]]
            query, row = query[kept], row[kept]
        product, step = np.empty(len(query)), max(1, VALUES // max(1, self.matrix.shape[1]))
        for low in range(0, len(query), step):
            some = slice(low, low + step)
            product[some] = np.einsum("ij,ij->i", self.matrix[query[some]], self.group.matrix[row[some]].astype(np.float64))
        if self.metric == "cosine":
            lengths = np.sqrt(self.norms[query] * self.group.norms[row])
            distance = 1.0 - product / np.where(lengths == 0, 1.0, lengths)
        else:
            distance = np.maximum(self.norms[query] + self.group.norms[row] - 2 * product, 0.0)
        distance = np.round(distance, DIGITS)
        kept = (distance <= self.bound[query]) & np.isfinite(distance)
        self.hits.append((query[kept], row[kept], distance[kept]))
        self.hit_rows += int(kept.sum())
        if self.hit_rows > max(POOL, 4 * self.k * len(self.query_ids)):
            self._cut()

    def _cut(self) -> None:
        """The best k of the hits so far, rows being in key order; the bound of a query that has k is the last of them."""
        if not self.hit_rows:
            return
        query, row, distance = (np.concatenate(c) for c in zip(*self.hits, strict=True))
        order = np.lexsort((row, distance, query))
        query = query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query, side="left") < self.k
        order, query = order[kept], query[kept]
        row, distance = row[order], distance[order]
        last = np.flatnonzero(np.concatenate([query[1:] != query[:-1], [True]]))
        full = last[np.diff(last, prepend=-1) == self.k]
        self.bound[query[full]] = np.minimum(self.bound[query[full]], distance[full])
        self.hits, self.hit_rows = [(query, row, distance)], len(query)
        self.limit_to_bound()


def embedded(column: pa.Array) -> np.ndarray:
    """The matrix of a column of vectors of one length."""
    lengths = pc.list_value_length(column)
    if not len(column) or column.null_count or pc.count_distinct(lengths).as_py() != 1:
        return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), lengths[0].as_py())


def group_rows(vectors: DataFrame, most: int, mask: Mask) -> int:
    """Rows of a group of vectors that a task may hold, fewer where they are long."""
    most = most if mask is everything or mask is visible else min(most, MASKED_ROWS)
    first = vectors.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    return most if first is None else max(1, min(most, VECTOR_VALUES // max(1, first[0])))


def meet_in_groups(
    asked: DataFrame,
    filed: DataFrame,
    place: list[str],
    groups: int | None,
    schema: T.StructType,
    keys: list[str],
    carried: list[str],
    k: int,
    max_distance: float,
    metric: str,
    mask: Mask,
    numbers: np.ndarray | None = None,
    of: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Best k of each place's vectors for the queries copied there: a task holds one group of vectors and streams its queries.

    ``place`` names whole-number columns of both sides, with ``groups`` the one number of a group below it. Vectors that have a cell
    (one of ``numbers``) meet the queries that read it by ``of``.
    """
    whole = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in ("part", "query_part")])
    none = lambda other: F.lit(None).cast(other)
    v = filed.select(*place, F.lit(False).alias("asked"), whole(filed).alias("v"))
    q = asked.select(*place, F.lit(True).alias("asked"), whole(asked).alias("q"))
    rows = v.withColumn("q", none(q.schema["q"].dataType)).unionByName(q.withColumn("v", none(v.schema["v"].dataType)))
    dealt = rows.repartition(*place) if groups is None else rows.repartitionById(groups, *place)
    tiled, part_rows = mask is everything or mask is visible, None if of is None else TILE_ROWS

    def plain(batch: pa.RecordBatch, name: str) -> tuple[pd.DataFrame, np.ndarray]:
        column = batch.column(name)
        fields = {f.name: column.field(i) for i, f in enumerate(column.type)}
        matrix = embedded(fields["embedding"])
        return pd.DataFrame({n: c.to_pandas() for n, c in fields.items() if n != "embedding"}), matrix

    def held(parts: list[tuple[pd.DataFrame, np.ndarray]]) -> Group | list[tuple[Block, np.ndarray | None]]:
        frame, matrix = pd.concat([p for p, _ in parts], ignore_index=True), np.concatenate([m for _, m in parts])
        if tiled:
            return Group(frame, matrix, keys, metric, mask, None if of is None else numbers, part_rows)
        frame["embedding"] = list(matrix)
        if of is not None:
            frame = frame.sort_values("cell", kind="stable", ignore_index=True)
        made = [Block(frame.iloc[start : start + SCAN_ROWS], keys) for start in range(0, len(frame), SCAN_ROWS)]
        return [(block, None if of is None else np.searchsorted(numbers, block.rows["cell"].to_numpy())) for block in made]

    def search(frame: pd.DataFrame, matrix: np.ndarray, group) -> pd.DataFrame | None:
        best = _Best(frame, keys, carried, k, max_distance, metric, mask, matrix)
        read = None if of is None else of(best.matrix)
        if tiled:
            best.search(group, None if read is None or read[:, np.unique(group.at)].all() else read)
            return best.result()
        for block, at in group:
            if read is None:
                best.meet(block)
                continue
            own = read[:, np.unique(at)]
            those = np.flatnonzero(own.any(axis=1))
            if len(those):
                best.meet(block, those, None if own[those].all() else read[np.ix_(those, at)])
        return best.result()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, ready = None, [], None
        step = ASKED if tiled else MASKED
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*place, "asked")])
            for low, high in _runs(*keyed):
                some, key = batch.slice(low, high - low), tuple(keyed[:-1, low])
                if key != now:
                    now, stored, ready = key, [], None
                if not keyed[-1, low]:
                    stored.append(plain(some, "v"))
                    continue
                if stored:
                    ready, stored = held(stored), []
                if ready is None:
                    continue
                frame, matrix = plain(some, "q")
                for first in range(0, len(frame), step):
                    out = search(frame.iloc[first : first + step], matrix[first : first + step], ready)
                    if out is not None:
                        yield pa.RecordBatch.from_pandas(out[[f.name for f in schema]], to_arrow_schema(schema), preserve_index=False)

    return dealt.sortWithinPartitions(*place, "asked").mapInArrow(meet, schema)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    k: int,
    max_distance: float = math.inf,
    metric: str = "l2",
    mask: Mask = everything,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
    prepare: Callable[[DataFrame, DataFrame, list[str]], DataFrame] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The ``k`` nearest vectors per query within ``max_distance``: (query_id, rank, distance, keys).

    ``l2`` is the squared distance, ``cosine`` one minus the cosine. Distances
    are compared to nine decimals and ties go by ``keys``. ``mask`` restricts the
    pairs of a block; ``prepare`` may add columns to the vectors that depend on
    the queries of the same block. ``carry`` names further columns to return.
    """
    carried = carry or []
    fields = [queries.schema["query_id"], *[vectors.schema[c] for c in [*keys, *carried]], T.StructField("distance", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    if within(queries, query_block):
        ready = prepare(vectors, queries, []) if prepare else vectors
        batch = queries.toPandas()
        if batch.empty:
            found = queries.sparkSession.createDataFrame([], schema)
        else:

            def scan(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = _Best(batch, keys, carried, k, max_distance, metric, mask)
                for block in blocks:
                    best.add(block)
                out = best.result()
                if out is not None:
                    yield out

            found = ready.mapInPandas(scan, schema)
    else:
        # Both are read several times, and may come from joins.
        queries, vectors = stage(queries, "asked"), stage(vectors, "stored")
        ready = prepare(vectors, queries, []) if prepare else vectors
        # Groups of vectors by shares of queries: the fewest copies of both that keep all cores busy.
        tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
        rows = vectors.count()
        groups = max(1, math.ceil(rows / group_rows(vectors, vector_block, mask)), min(math.ceil(math.sqrt(tasks)), rows // LEAST_ROWS))
        shares = max(1, min(math.ceil(tasks / groups), math.ceil(queries.count() / query_block)))
        across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        place = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
        one = lambda df: df.withColumn("part", F.col("group") * shares + F.col("share")).drop("group", "share")
        filed = one(ready.withColumn("group", place(keys, groups)).withColumn("share", across(shares)))
        asked = one(queries.withColumn("share", place(["query_id"], shares)).withColumn("group", across(groups)))
        found = meet_in_groups(asked, filed, ["part"], groups * shares, schema, keys, carried, k, max_distance, metric, mask)

    return ranked(found, ["query_id"], [F.col("distance"), *[F.col(c) for c in keys]], k)


def dense_search(
    queries: DataFrame,
    vectors: DataFrame,
    acl: DataFrame | None = None,
    k: int = 20,
    max_distance: float = 1.5,
    keys: list[str] | None = None,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
    carry: list[str] | None = None,
) -> DataFrame:
    """Nearest visible chunk vectors per query by squared distance; visibility comes before the search."""
    keys = keys or ["doc_id", "chunk_index"]
    if acl is None:
        plain = vectors.select(*keys, *(carry or []), "embedding")
        return nearest(queries.select("query_id", "embedding"), plain, keys, k, max_distance,
                       query_block=query_block, vector_block=vector_block, carry=carry)
    asked, stored = with_rights(queries, vectors, [*keys, *(carry or [])])
    return nearest(
        asked, stored, keys, k, max_distance, mask=visible, query_block=query_block, vector_block=vector_block,
        prepare=lambda rows, batch, by: attach_grants(rows, acl, batch, by), carry=carry,
    )


def caller_columns() -> list:
    """The caller's context as ``visible`` reads it: ids that no row has where they are missing."""
    return [
        F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
        _number("user_id", -2),
        _number("caller_tenant", -2),
        F.coalesce(F.nullif(F.col("clearance").cast("long"), F.lit(0)), F.lit(1)).alias("clearance"),
    ]


def rights_columns() -> list:
    """The rights of a stored row as ``visible`` reads them."""
    return ["doc_level", _number("owner_id", -1), _number("tenant_id", -1), _number("min_level", 1)]


def _number(name: str, default: int):
    return F.coalesce(F.col(name).cast("long"), F.lit(default)).alias(name)


def with_rights(queries: DataFrame, vectors: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries with their caller's context, and vectors with ``columns`` and the rights of their documents."""
    asked = queries.select("query_id", "embedding", *caller_columns())
    assert set(CONTEXT) <= set(asked.columns)
    return asked, vectors.select(*columns, *([] if "doc_id" in columns else ["doc_id"]), "embedding", *rights_columns())
