"""Queries meet groups of vectors: only pairs that callers see are multiplied, and few rows are copied."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cells, dense
from corpusmill.plans import inputs, retrieval  # noqa: F401
from corpusmill.plans.registry import QUERIES


def made_batch(rng, n_vectors=900, n_queries=140, width=6):
    spots = rng.normal(size=(15, width))
    vectors = (spots[rng.integers(15, size=n_vectors)] + 0.3 * rng.normal(size=(n_vectors, width))).astype(np.float32)
    vectors[5:60] = vectors[4]  # many copies of one vector
    vectors[70], vectors[71] = 0, np.nan
    rows = pd.DataFrame({
        "vec_id": rng.permutation(n_vectors), "tenant_id": rng.integers(-1, 3, n_vectors), "min_level": rng.integers(1, 4, n_vectors),
        "owner_id": rng.integers(-1, 6, n_vectors), "doc_level": rng.choice(["public", "private", None], n_vectors, p=[0.8, 0.1, 0.1]),
        "cell": rng.integers(0, 9, n_vectors),
    })
    rows["granted_to"] = [None if rng.random() < 0.6 else rng.choice(8, rng.integers(0, 4), replace=False) for _ in range(n_vectors)]
    queries = pd.DataFrame({
        "query_id": np.arange(n_queries) // 2, "is_admin": rng.random(n_queries) < 0.1, "user_id": rng.integers(-2, 8, n_queries),
        "caller_tenant": rng.integers(-2, 3, n_queries), "clearance": rng.integers(1, 4, n_queries),
    })
    asked = (vectors[rng.integers(100, n_vectors, n_queries)] + 0.1 * rng.normal(size=(n_queries, width))).astype(np.float32)
    return rows, vectors, queries, asked


def brute(rows, vectors, asked, seen, k, limit, metric):
    a, b = asked.astype(np.float64), vectors.astype(np.float64)
    if metric == "cosine":
        lengths = np.sqrt(np.outer((a**2).sum(1), (b**2).sum(1)))
        distance = 1 - a @ b.T / np.where(lengths == 0, 1, lengths)
    else:
        distance = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    out = []
    for q in range(len(a)):
        near = [(round(d, 6), key) for d, key, s in zip(distance[q], rows["vec_id"], seen[q], strict=True) if s and d <= limit and math.isfinite(d)]
        # Six of nine decimals, as sums come in another order; equal distances by key.
        out += [(q, d) for d, _ in sorted(near)[:k]]
    return sorted(out)


@pytest.mark.parametrize("metric,limit", [("l2", 1.5), ("l2", math.inf), ("cosine", 0.1), ("cosine", math.inf)])
@pytest.mark.parametrize("masked,reads,tile", [(True, False, 4096), (True, True, 16), (False, True, 64), (False, False, 4096)])
def test_best_of_a_group(monkeypatch, metric, limit, masked, reads, tile):
    rng = np.random.default_rng(11)
    rows, vectors, queries, asked = made_batch(rng)
    monkeypatch.setattr(dense, "TILE_ROWS", tile)
    monkeypatch.setattr(dense, "MEASURED", 500)
    monkeypatch.setattr(dense, "POOL", 100)
    mask = dense.visible if masked else dense.everything
    numbers = np.arange(9)
    group = dense.Group(rows, vectors, ["vec_id"], metric, mask, numbers if reads else None, 100 if reads else None)
    read = rng.random((len(queries), 9)) < 0.6 if reads else None
    queries["query_id"] = np.arange(len(queries))
    best = dense._Best(queries, ["vec_id"], [], 7, limit, metric, mask, asked)
    best.search(group, read)
    out = best.result()
    seen = mask(queries, rows)
    if reads:
        seen &= read[:, rows["cell"].to_numpy()]
    found = np.array(sorted(zip(out["query_id"], out["distance"], strict=True)))
    want = np.array(brute(rows, vectors, asked, seen, 7, limit, metric))
    assert found.shape == want.shape and (found[:, 0] == want[:, 0]).all() and np.allclose(found[:, 1], want[:, 1], atol=2e-6)
    # Of equal distances, the first by key.
    exact = dense._Best(queries.assign(embedding=list(asked)), ["vec_id"], [], 7, limit, metric, lambda q, v: mask(q, v))
    plain = rows.assign(embedding=list(vectors)) if not reads else None
    if plain is not None:
        exact.add(plain)
        want = exact.result()
        assert sorted(zip(out["query_id"], out["vec_id"], strict=True)) == sorted(zip(want["query_id"], want["vec_id"], strict=True))


def test_only_pairs_that_callers_see_are_multiplied(monkeypatch):
    rows, vectors, queries, asked = made_batch(np.random.default_rng(4))
    made = []
    multiply = dense._Best._multiply
    monkeypatch.setattr(dense._Best, "_multiply", lambda self, q, r, w: (made.extend((a, b) for a in q for b in r), multiply(self, q, r, w)))
    group = dense.Group(rows, vectors, ["vec_id"], "l2", dense.visible)
    dense._Best(queries, ["vec_id"], [], 5, 1.5, "l2", dense.visible, asked).search(group)
    seen = dense.visible(queries, group.rows)
    assert len(made) == len(set(made)) == seen.sum() < seen.size / 2
    assert all(seen[a, b] for a, b in made)


def test_vectors_and_long_numbers_beyond_single_precision():
    vectors = np.array([[1e20, 0.0], [1e20, 1e18], [3.0, 4.0], [np.inf, 0.0]])
    rows, queries = pd.DataFrame({"vec_id": range(4)}), pd.DataFrame({"query_id": [1, 2]})
    best = dense._Best(queries, ["vec_id"], [], 2, math.inf, "l2", dense.everything, np.array([[1e20, 9e17], [3.0, 4.5]]))
    best.search(dense.Group(rows, vectors, ["vec_id"], "l2", dense.everything))
    out = best.result()
    assert {q: part["vec_id"].tolist()[0] for q, part in out.groupby("query_id")} == {1: 1, 2: 2} and 3 not in set(out["vec_id"])


def test_a_batch_beyond_the_bound_copies_few_rows(spark, monkeypatch):
    """Copies grow with the groups and the cores, not with vectors times batches of queries."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 4)).astype(np.float32)
    frame = lambda name: spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], f"{name} long, embedding array<float>")
    sides = []
    meet = dense.meet_in_groups
    monkeypatch.setattr(dense, "meet_in_groups", lambda asked, filed, *a: (sides.extend([asked, filed]), meet(asked, filed, *a))[1])
    found = dense.nearest(frame("query_id"), frame("vec_id"), ["vec_id"], 1, query_block=60)  # 50 batches
    assert found.where("query_id <> vec_id").count() == 0 and found.count() == 3000
    assert [s.count() <= 4 * 3000 for s in sides] == [True, True]


def test_probed_cells_are_the_nearest_allowed_ones():
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 3))
    centers[20:30] = centers[7]  # equally far from everything
    table = pd.DataFrame({"cell": range(40), "center": list(centers), "radius": rng.random(40), "rows": 1})
    queries = rng.normal(size=(200, 3))
    apart = cells._apart(queries, centers)
    allowed = cells._probed(table, "l2", 1.5, None)(queries)
    for probes in (1, 5, 25, 39):
        nearest = np.argsort(np.where(allowed, apart, np.inf), axis=1, kind="stable")[:, :probes]
        want = np.zeros_like(allowed)
        np.put_along_axis(want, nearest, True, axis=1)
        assert (cells._probed(table, "l2", 1.5, probes)(queries) == (want & allowed)).all()


def test_cells_are_made_once_for_a_query(spark, monkeypatch, tmp_path):
    for name in ("embeddings", "documents", "labels", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("true").write.parquet(str(tmp_path / f"{name}.parquet"))
    calls = []
    build = inputs.build_cells
    monkeypatch.setattr(inputs, "build_cells", lambda *a: (calls.append(1), build(*a))[1])
    assert QUERIES["R3_dense_probed"](spark, str(tmp_path)).agg(F.count("*").alias("n")).first().n > 0
    QUERIES["R3_dense_cells"](spark, str(tmp_path))
    assert len(calls) == 1
