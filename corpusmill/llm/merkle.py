"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A parent is the hash of its children's digests as hex text, 64 bytes each: one block of
SHA-256. So it can keep a copy of the hash state as it was before every child. To fold a
changed child upwards, the state of its slot is resumed with the replacement and the siblings right
of it only; what stands left is in the state already.

Leaves of one tree are numbered across the cluster and cut into pages of ``FAN_OUT`` ** ``PAGE_LEVELS``.
A page is one row with all its digests and states; roots of pages are the leaves of the next
round of pages. Paths come down the same way: each page gets the path of its root, so that a leaf is folded
to the top inside one task. The roots of all trees, in order, are the leaves of a last tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import small, stored
from corpusmill.llm.decontaminate import ascii_lower
from corpusmill.llm.ordering import numbered

FAN_OUT = 8
#: Levels of one page: up to FAN_OUT ** PAGE_LEVELS leaves.
PAGE_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _root_bits(prime: int, power: int) -> int:
    """The first 32 bits of the fraction of a prime's square or cube root."""
    wanted = prime << (32 * power)
    low = round(prime ** (1 / power) * 2**32)
    while low**power > wanted:
        low -= 1
    while (low + 1) ** power <= wanted:
        low += 1
    return low & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))]
#: The constants of FIPS 180-4, by their rule.
ROUND = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (8 x n) after one more block (16 x n, words of 32 bits) each."""
    words = list(blocks)
    for t in range(16, 64):
        near, far = words[t - 2], words[t - 15]
        words.append(words[t - 16] + (_turn(far, 7) ^ _turn(far, 18) ^ (far >> np.uint32(3))) + words[t - 7] + (_turn(near, 17) ^ _turn(near, 19) ^ (near >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + words[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def _as_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) as hex text, one block (16 x n words) each."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def _closed(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of states that took ``children`` blocks each: the last block says how long the text was."""
    end = np.zeros((16, states.shape[1]), np.uint32)
    end[0], end[15] = 1 << 31, children.astype(np.uint32) * 512
    return np.ascontiguousarray(absorb(states, end).T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def parents(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the next level, and the state before each child (n x 32 bytes): every ``FAN_OUT`` consecutive nodes have one parent."""
    n = len(digests)
    number = -(-n // FAN_OUT)
    blocks = _as_block(digests)
    widths = np.minimum(n - np.arange(number) * FAN_OUT, FAN_OUT)
    now = np.repeat(START[:, None], number, axis=1)
    before = np.empty((8, n), np.uint32)
    for slot in range(min(FAN_OUT, n)):
        has = np.flatnonzero(widths > slot)
        child = has * FAN_OUT + slot
        before[:, child] = now[:, has]
        now[:, has] = absorb(now[:, has], blocks[:, child])
    return _closed(now, widths), np.ascontiguousarray(before.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def fold(states: np.ndarray, slots: np.ndarray, widths: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Parents' digests (n x 32) with ``own`` in place of the child at ``slots``.

    Resumes ``states`` (n x 32), the states before those children, with ``own`` and what
    stands right of it in ``others`` (n x FAN_OUT x 32, digests by slot).
    """
    now = absorb(np.ascontiguousarray(states.view(">u4").astype(np.uint32).T), _as_block(own))
    for slot in range(1, FAN_OUT):
        right = np.flatnonzero((slots < slot) & (slot < widths))
        if len(right):
            now[:, right] = absorb(now[:, right], _as_block(others[right, slot]))
    return _closed(now, widths)


def levels_above(leaves: int) -> int:
    """Levels between a tree's leaves and its one root."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN_OUT), levels + 1
    return levels


PAGE = "tree bigint, page bigint, levels int, digest binary, digests array<binary>, states array<binary>"
#: One step of a path for each level: the slot, its state, and the digests of the siblings, from left to right.
PATH = "array<struct<slot:int,state:binary,siblings:binary>>"


def _page(nodes: pa.Table, page_levels: int) -> pa.Table:
    """The page of up to FAN_OUT ** ``page_levels`` neighbouring nodes (tree, page, place, n, digest); ``n`` is the number of all nodes of the tree."""
    nodes = nodes.sort_by("place")
    level = np.frombuffer(b"".join(nodes.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    levels = min(levels_above(nodes.column("n")[0].as_py()), page_levels)
    digests, states = [level.tobytes()], []
    for _ in range(levels):
        level, before = parents(level)
        digests.append(level.tobytes())
        states.append(before.tobytes())
    row = {"tree": nodes.column("tree")[0].as_py(), "page": nodes.column("page")[0].as_py(), "levels": levels, "digest": level[0].tobytes(), "digests": digests, "states": states}
    return pa.Table.from_pylist([row], pa.schema([("tree", pa.int64()), ("page", pa.int64()), ("levels", pa.int32()), ("digest", pa.binary()), ("digests", pa.list_(pa.binary())), ("states", pa.list_(pa.binary()))]))


def _rounds(nodes: DataFrame, page_levels: int) -> list[DataFrame]:
    """Stored pages of every round, the leaves' first, of ``nodes`` (tree, place, n, digest); the last round has one page for each tree."""
    made = []
    size = FAN_OUT**page_levels
    nodes = nodes.withColumn("page", F.expr(f"place div {size}"))
    while True:
        pages = stored(nodes.groupBy("tree", "page").applyInArrow(lambda table: _page(table, page_levels), PAGE), "pages")
        made.append(pages)
        most = pages.agg(F.max("page")).first()[0]
        if not most:
            return made
        sizes = nodes.groupBy("tree").agg(F.max("n").alias("n"))
        roots = pages.select("tree", F.col("page").alias("place"), "digest").join(sizes, "tree")
        # what is one node already stays one node, through pages without levels
        nodes = roots.select("tree", "place", F.expr(f"(n + {size - 1}) div {size}").alias("n"), "digest", F.expr(f"place div {size}").alias("page"))
        nodes = stored(nodes, "page-roots")


@dataclass
class Manifest:
    """Stored tables of one dataset version: the trees (lang, tree, n, subroot), the pages of the leaves' rounds, those of the rounds above, and the root."""

    trees: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    page_levels: int = PAGE_LEVELS

    def write(self, path: str) -> None:
        """One folder of Parquet for each table; ``read`` gives the manifest back."""
        self.trees.write.parquet(f"{path}/trees")
        for name, tables in (("rounds", self.rounds), ("top", self.top)):
            for i, pages in enumerate(tables):
                pages.write.parquet(f"{path}/{name}-{i}")
        shape = [(len(self.rounds), len(self.top), self.root, self.page_levels)]
        self.trees.sparkSession.createDataFrame(shape, "rounds int, top int, root string, page_levels int").write.parquet(f"{path}/shape")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        shape = spark.read.parquet(f"{path}/shape").first()
        part = lambda name, n: [spark.read.parquet(f"{path}/{name}-{i}") for i in range(n)]
        return Manifest(spark.read.parquet(f"{path}/trees"), part("rounds", shape["rounds"]), part("top", shape["top"]), shape["root"], shape["page_levels"])


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a row's fields in the order given: `-` for null, else the length in bytes, a colon and the value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered_leaves(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, place, n, doc_id, lang, digest, other) in order of lang and doc_id, nulls first, and the trees (lang, tree, n).

    ``other`` is the leaf with ``tampered`` as text, null if that is the same. Rows of one doc_id are in
    order of their leaves; equal rows stand side by side. A column that isn't there counts as null.
    """
    of = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    digest = leaf_digest({f: of(f) for f in FIELDS})
    other = leaf_digest({f: of(f) if f != "text" else tampered for f in FIELDS}) if tampered is not None else F.lit(None).cast("binary")
    changed = F.when(tampered != of("text"), other) if tampered is not None else other
    own = docs.select(of("doc_id").cast("bigint").alias("doc_id"), of("lang").cast("string").alias("lang"), digest.alias("digest"), changed.alias("other"))
    placed = numbered(stored(own, "leaves"), ["lang"], ["doc_id", "digest"])
    trees = stored(placed.groupBy("lang").agg(F.count("*").alias("n")), "tree-sizes")
    trees = stored(numbered(trees.withColumn("all", F.lit(0)), ["all"], ["lang"], "tree").drop("all"), "trees")
    named = trees.select(F.col("lang").alias("of"), "tree", "n")
    return stored(placed.join(small(named), F.col("lang").eqNullSafe(F.col("of"))).drop("of"), "placed"), trees


def build(leaves: DataFrame, trees: DataFrame, page_levels: int = PAGE_LEVELS) -> Manifest:
    """The manifest of numbered leaves; an empty table has no root."""
    rounds = _rounds(leaves.select("tree", "place", "n", "digest"), page_levels)
    subroots = rounds[-1].select("tree", "digest")
    number = trees.count()
    top = _rounds(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(number).cast("bigint").alias("n"), "digest"), page_levels)
    root = top[-1].first()
    named = trees.join(subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")), "tree").select("lang", "tree", "n", "subroot")
    return Manifest(stored(named, "named-trees"), rounds, top, root["digest"].hex() if root else None, page_levels)


def _steps(page: dict, places: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level of a page, from the leaves up: slot, number of the run's nodes, state and the run's digests by slot, of the nodes over ``places``."""
    at = places
    for digests, states in zip(page["digests"], page["states"], strict=False):
        nodes = np.frombuffer(digests, np.uint8).reshape(-1, 32)
        slot, parent = at % FAN_OUT, at // FAN_OUT
        wide = np.minimum(len(nodes) - parent * FAN_OUT, FAN_OUT)
        run = np.minimum(parent[:, None] * FAN_OUT + np.arange(FAN_OUT), len(nodes) - 1)
        yield slot, wide, np.frombuffer(states, np.uint8).reshape(-1, 32)[at], nodes[run]
        at = parent


def _paths_down(size: int):
    """Every node of a page with its path to the top: its own steps, then the page's."""

    def run(pages: pa.Table) -> pa.Table:
        out: dict[str, list] = {"tree": [], "place": [], "path": []}
        for page in pages.to_pylist():
            number = len(page["digests"][0]) // 32
            own: list[list[dict]] = [[] for _ in range(number)]
            for slot, wide, state, nodes in _steps(page, np.arange(number)):
                for i, path in enumerate(own):
                    siblings = b"".join(nodes[i, s].tobytes() for s in range(wide[i]) if s != slot[i])
                    path.append({"slot": int(slot[i]), "state": state[i].tobytes(), "siblings": siblings})
            out["tree"] += [page["tree"]] * number
            out["place"] += [page["page"] * size + i for i in range(number)]
            out["path"] += [steps + (page["path"] or []) for steps in own]
        step = pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())])
        return pa.table({"tree": pa.array(out["tree"], pa.int64()), "place": pa.array(out["place"], pa.int64()), "path": pa.array(out["path"], pa.list_(step))})

    def batches(parts):
        for batch in parts:
            for i in range(batch.num_rows):  # one page at a time
                yield from run(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return batches


def _with_paths(rounds: list[DataFrame], above: DataFrame | None, size: int) -> DataFrame:
    """Pages of the first round with ``path``, the steps from each page's root to the top; ``above`` has the paths of the trees' roots (tree, path)."""
    last = rounds[-1]
    pages = last.join(above, "tree", "left") if above is not None else last.withColumn("path", F.lit(None).cast(PATH))
    for below in reversed(rounds[:-1]):
        down = stored(pages.mapInArrow(_paths_down(size), f"tree bigint, place bigint, path {PATH}"), "paths")
        pages = below.join(down.withColumnRenamed("place", "page"), ["tree", "page"])
    return pages


def _folded(pages: pa.Table, leaves: pa.Table) -> pa.Table:
    """Leaves (doc_id, place, digest, other) of one page folded to the top, with the hash of their siblings."""
    page = pages.to_pylist()[0]
    number = leaves.num_rows
    own = np.frombuffer(b"".join(leaves.column("leaf").to_pylist()), np.uint8).reshape(-1, 32)
    size = len(page["digests"][0]) // 32
    places = leaves.column("place").to_numpy() - page["first"]
    proofs = [hashlib.sha256() for _ in range(number)]
    if size and number:
        for slot, wide, state, nodes in _steps(page, places):
            text = np.stack([HEX[nodes >> 4], HEX[nodes & 15]], axis=-1).reshape(number, FAN_OUT, 64)
            for i, proof in enumerate(proofs):
                line = text[i].tobytes()
                proof.update(line[: 64 * slot[i]] + line[64 * (slot[i] + 1) : 64 * wide[i]])
            own = fold(state, slot, wide, own, nodes)
    for step in page["path"] or []:
        siblings = np.frombuffer(step["siblings"], np.uint8).reshape(-1, 32)
        line = step["siblings"].hex().encode()
        for proof in proofs:
            proof.update(line)
        wide, slot = len(siblings) + 1, step["slot"]
        nodes = np.zeros((1, FAN_OUT, 32), np.uint8)
        nodes[0, [s for s in range(wide) if s != slot]] = siblings
        state = np.frombuffer(step["state"], np.uint8).reshape(1, 32)
        # the step is the same for all leaves of the page, and so is the fold of equal digests
        distinct, back = np.unique(own, axis=0, return_inverse=True)
        many = len(distinct)
        folded = fold(np.repeat(state, many, 0), np.full(many, slot), np.full(many, wide), np.ascontiguousarray(distinct), np.broadcast_to(nodes, (many, FAN_OUT, 32)))
        own = folded[back.reshape(-1)]
    return pa.table({"doc_id": leaves.column("doc_id"), "tree": leaves.column("tree"), "leaf": leaves.column("digest"), "proof_sha256": pa.array([p.hexdigest() for p in proofs], pa.string()), "folded_root": pa.array([d.tobytes().hex() for d in own], pa.string())})


FOLDED = "doc_id bigint, tree bigint, leaf binary, proof_sha256 string, folded_root string"


def verify(manifest: Manifest, leaves: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, proof_sha256, folded_root) of leaves (tree, place, doc_id, digest, other).

    Each is folded from ``other``, or from ``digest`` where that is null, over the siblings the manifest
    holds; ``folded_root`` is the manifest's root if, and only if, the leaf is the one it was built of.
    """
    size = FAN_OUT**manifest.page_levels
    tops = _with_paths(manifest.top, None, size)
    above = stored(tops.mapInArrow(_paths_down(size), f"tree bigint, place bigint, path {PATH}").select(F.col("place").alias("tree"), "path"), "tree-paths")
    pages = _with_paths(manifest.rounds, above, size).withColumn("first", F.col("page") * size)
    rows = leaves.select("tree", F.expr(f"place div {size}").alias("page"), "place", "doc_id", "digest", F.coalesce("other", "digest").alias("leaf"))
    return rows.groupBy("tree", "page").cogroup(pages.groupBy("tree", "page")).applyInArrow(lambda a, b: _folded(b, a), FOLDED)


def tampered_text(text: Column, doc_id: Column) -> Column:
    """A to Z in lower case where 3 divides the checksum of the id; other texts as they are."""
    return F.when(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 0, ascii_lower(text)).otherwise(text)


def audit(docs: DataFrame, page_levels: int = PAGE_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``: the manifest of the rows, and each row's fold after tampering.

    Nulls have a mark of their own in a leaf, a null lang a tree of its own, before all
    others; null ids come first in theirs. Equal rows are leaves side by side. Texts are read whole, once. An
    empty table gives no rows; columns other than ``FIELDS`` aren't read.
    """
    leaves, trees = numbered_leaves(docs, tampered_text(F.col("text").cast("string"), F.col("doc_id").cast("bigint")))
    manifest = build(leaves, trees, page_levels)
    names = manifest.trees.select("tree", "subroot")
    folded = verify(manifest, leaves)
    made = folded.join(small(names), "tree")
    root = F.lit(manifest.root).cast("string")
    return made.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
