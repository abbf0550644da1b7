"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import keep

#: Far more rounds than contraction needs; reaching it is an error, never a silent cut.
MOST_ROUNDS = 60
#: Links that are merged at a time inside a task.
LINKS_AT_ONCE = 200_000


def lowest_rows(size: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For every row the lowest row of its component; links are merged as they come, so memory stays in the order of the rows."""
    label = np.arange(size)

    def top() -> None:
        while not np.array_equal(up := label[label], label):
            label[:] = up

    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
            top()
    return label


def _ranks(nodes: np.ndarray, number: int) -> np.ndarray:
    """Each node's rank in the round of this number: another order each time, no two nodes alike."""
    mixed = nodes.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def _merged(number: int, at_once: int):
    """(node, rank, into): for each run of links, its nodes and the node of the lowest rank that the run connects each to."""

    def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ranks = _ranks(nodes, number)
        order = np.argsort(ranks)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[at]
        root = order[lowest_rows(len(nodes), [(at[: len(a)], at[len(a) :])])[place]]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ranks[root]), pa.array(nodes[root])], names=["node", "rank", "into"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                if held and held + part.num_rows > at_once:
                    yield made(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, held = [], 0
                parts.append(tuple(part.column(i).to_numpy() for i in (0, 1)))
                held += part.num_rows
        if held:
            yield made(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def connected_components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share their root.

    Rounds of contraction: inside each task, runs of ``at_once`` links are merged, which
    connects each node to one of its run. One shuffle brings the few that a node was connected
    to together: it joins the lowest of them, and what links this to the others is left for the next
    round. So a node gets one row from a run, however many links it has. The order of the nodes is another in each round, which
    makes long monotone chains improbable: the number of nodes that are left falls by a constant
    share each round. Every round is written to the shared folder; the driver sees only
    whether links are left. A link with a null end is ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    rounds = []
    for number in range(MOST_ROUNDS):
        several = F.array_sort(F.collect_set(F.struct("rank", "into")))
        joined = keep(links.mapInArrow(_merged(number, at_once), "node bigint, rank bigint, into bigint").groupBy("node").agg(several.alias("several")))
        rounds.append(joined.select("node", F.col("several")[0]["into"].alias("into")))
        first, others = F.col("several")[0]["into"], F.slice("several", 2, F.size("several") - 1)["into"]
        links = joined.where(F.size("several") > 1).select(first.alias("a"), F.explode(others).alias("b"))
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"links are left after {MOST_ROUNDS} rounds")
    roots = rounds[-1].withColumnRenamed("into", "root")
    for joined in reversed(rounds[:-1]):  # the nodes of a round are among those of the round before
        later = roots.select(F.col("node").alias("into"), "root")
        roots = joined.join(later, "into", "left").select("node", F.coalesce("root", "into").alias("root"))
    return keep(roots) if len(rounds) > 1 else roots
