"""Vector search by cells, BM25 where the chunks lie, substrings and linear folds, against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.tables import split_table
from corpusmill.functions.text import begins, groups
from corpusmill.operators import cells, chunking, dense, lexical, substrings
from corpusmill.plans.inputs import Inputs

SMALL = "/root/testdata/sf0.001"


def vectors_of(spark, points, name):
    return spark.createDataFrame([(n, p.tolist()) for n, p in points.items()], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 3
    made = {n: (centers[n % 12] + 0.3 * rng.normal(size=8)).astype(np.float32) for n in range(600)}
    made |= {1000 + n: made[5] for n in range(40)}  # many copies of one vector
    made[2000] = np.zeros(8, dtype=np.float32)
    asked = {n: (made[n] + 0.1 * rng.normal(size=8)).astype(np.float32) for n in range(0, 600, 7)}
    return made, asked


@pytest.mark.parametrize("metric,limit", [("l2", 2.0), ("cosine", 0.02)])
def test_cells_are_exact(spark, points, metric, limit):
    made, asked = points
    stored, queries = vectors_of(spark, made, "vec_id").repartition(3), vectors_of(spark, asked, "query_id")
    exact = dense.nearest(queries, stored, ["vec_id"], 5, limit, metric).collect()
    index = cells.build_cells(stored, 20, metric)
    for part_rows in (16, 10_000):
        found = cells.nearest_in_cells(queries, index, ["vec_id"], 5, limit, part_rows=part_rows).collect()
        assert sorted(map(str, found)) == sorted(map(str, exact))
    assert len(exact) > len(asked)


def test_probes_and_recall(spark, points):
    made, asked = points
    stored, queries = vectors_of(spark, made, "vec_id"), vectors_of(spark, asked, "query_id")
    index = cells.build_cells(stored, 20)
    exact = dense.nearest(queries, stored, ["vec_id"], 20)
    few = cells.nearest_in_cells(queries, index, ["vec_id"], 20, probes=6)
    assert cells.recall(few, exact, ["vec_id"]).first().recall >= 0.95
    whole = cells.nearest_in_cells(queries, index, ["vec_id"], 20, probes=20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, exact.collect()))


def test_recall_with_rights_on_the_given_embeddings(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    exact = dense.dense_search(i.vector_queries(), i.vectors(), i.grants(), keys=["vec_id"])
    number = i.cells().cells.count()
    found = cells.search_cells(i.vector_queries(), i.cells(), i.grants(), keys=["vec_id"], probes=number * 3 // 4)
    assert cells.recall(found, exact, ["vec_id"]).first().recall >= 0.95


def test_cells_on_disk_and_without_rows(spark, points, tmp_path):
    made, asked = points
    stored, queries = vectors_of(spark, made, "vec_id"), vectors_of(spark, asked, "query_id")
    cells.build_cells(stored, 9).write(f"{tmp_path}/cells")
    again = cells.CellIndex.read(spark, f"{tmp_path}/cells")
    found = cells.nearest_in_cells(queries, again, ["vec_id"], 3, 2.0).collect()
    assert sorted(map(str, found)) == sorted(map(str, dense.nearest(queries, stored, ["vec_id"], 3, 2.0).collect()))
    none = cells.build_cells(stored.limit(0))
    assert cells.nearest_in_cells(queries, none, ["vec_id"], 3).count() == 0
    assert cells.nearest_in_cells(queries.limit(0), again, ["vec_id"], 3, 2.0).count() == 0


def test_no_vector_is_copied(spark, points):
    made, asked = points
    stored, queries = vectors_of(spark, made, "vec_id"), vectors_of(spark, asked, "query_id")
    plan = cells.nearest_in_cells(queries, cells.build_cells(stored, 20), ["vec_id"], 5, 2.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Generate" not in plan


def test_queries_go_once_to_each_group_of_cells(spark, points):
    """Copies of queries grow with the groups, of a bounded number of vectors, and not with the cells."""
    made, asked = points
    stored, queries = vectors_of(spark, made, "vec_id"), vectors_of(spark, asked, "query_id")
    index = cells.build_cells(stored, 40)
    shapes = index.cells.toPandas().sort_values("cell", ignore_index=True)
    first, parts = cells._grouped(shapes, 200)
    groups = int((first + parts).max())
    assert 4 <= groups <= 12 < len(shapes)
    copies, filed = cells._by_cells(queries, index.vectors, ["vec_id"], shapes, cells._probed(shapes, "l2", 1e9, None), 200)
    assert copies.count() <= len(asked) * groups and filed.count() == len(made)


def _bm25(texts, questions, k):
    words = {n: t.lower().split() for n, t in texts.items()}
    avg = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in set(ws) for ws in words.values()) for ws in words.values() for w in ws}
    raw = {w: np.log(len(words) - d + 0.5) - np.log(d + 0.5) for w, d in df.items()}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    out = {}
    for q, question in questions.items():
        score = {}
        for n, ws in words.items():
            hit = [w for w in question.lower().split() if w in ws]
            if hit:
                score[n] = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit)
        out[q] = sorted(score, key=lambda n: (-round(score[n], 9), n))[:k]
    return out


def test_bm25_in_place_is_exact(spark, monkeypatch):
    pick = random.Random(2)
    vocabulary = [f"w{int(pick.paretovariate(0.8))}" for _ in range(400)]
    texts = {n: " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(3, 40))) for n in range(300)}
    questions = {q: " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(1, 9))) for q in range(70)} | {99: "nothing"}
    chunks = spark.createDataFrame([(n, 0, f"p{n}", t) for n, t in texts.items()], "doc_id long, chunk_index int, parent_id string, text string").repartition(3)
    asked = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    index = lexical.build_lexical_index(chunks)
    want = _bm25(texts, questions, 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # many blocks, so that bounds leave some out
    try:
        monkeypatch.setattr(lexical, "SCORES", 200)
        found = lexical.bm25_search(asked, index, k=7).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    got = {q: [r.doc_id for r in found if r.query_id == q] for q in questions}
    assert got == want


def test_bm25_leaves_the_index_where_it_is(spark):
    i = Inputs(spark, SMALL)
    for n in (1, 40, 200):
        plan = lexical.bm25_search(i.questions().limit(n), i.lexical(), i.grants())._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("MapInArrow") if "MapInArrow" in plan else plan.index("PythonMapInArrow"):]
        assert "Exchange hashpartitioning" not in below.split("BroadcastExchange")[0]


@pytest.mark.parametrize("k", [None, 2])
def test_holders(spark, k):
    pick = random.Random(4)
    letters = "abé \n"
    docs = {n: "".join(pick.choice(letters) for _ in range(pick.randrange(0, 200))) for n in range(200)}
    docs[500] = "x" * 50_000 + "needle in it" + "y" * 10
    needles = {n: docs[n][5 : 5 + pick.randrange(1, 30)] for n in range(60)} | {70: "needle in it", 71: "nowhere at all", 72: "", 73: None, 74: "é", 75: docs[7][:40] or "a"}
    frame = spark.createDataFrame([*docs.items(), (900, None)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(list(needles.items()), "query_id long, needle string")
    got = {}
    for r in substrings.holders(asked, frame, k).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    for q, needle in needles.items():
        held = sorted(n for n, t in docs.items() if needle is not None and needle in t)
        if needle == "" and k is None:
            assert q not in got
        elif k is None:
            assert got.get(q, set()) == set(held)
        else:
            assert set(held[:k]) <= got.get(q, set()) <= set(held)
    assert substrings.holders(asked, frame.limit(0), k).count() == 0 and substrings.holders(asked.limit(0), frame, k).count() == 0


def test_holders_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "NEEDLES", 3)
    monkeypatch.setattr(substrings, "AT_ONCE", 64)
    docs = spark.createDataFrame([(n, f"text number {n} of many") for n in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(n, f"number {n} of") for n in range(20)], "query_id long, needle string")
    assert sorted((r.query_id, r.doc_id) for r in substrings.holders(asked, docs).collect()) == [(n, n) for n in range(20)]


def _greedy(sizes, limit, base, most):
    out, chars, used = [], 0, 0
    for size in sizes:
        full = used == 0 or chars + size > limit or (most is not None and used >= most)
        chars, used = (base + size, 1) if full else (chars + size, used + 1)
        out.append(full)
    return out


def test_begins_is_greedy(spark):
    pick = random.Random(6)
    rows = [(n, [pick.randrange(0, 40) for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 700)]
    frame = spark.createDataFrame(rows, "n int, sizes array<int>")
    for limit, base, most in ((60, 0, None), (100, 20, 3)):
        got = {r.n: r.f for r in frame.select("n", begins(F.col("sizes"), limit, base, most).alias("f")).collect()}
        assert got == {n: _greedy(sizes, limit, base, most) for n, sizes in rows}
    cut = frame.select("sizes", groups(F.col("sizes"), begins(F.col("sizes"), 60)).alias("g")).collect()
    assert all([x for g in r.g for x in g] == r.sizes for r in cut)


def test_folds_are_linear(spark):
    def seconds(lines):
        table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {n} | {n * 7} |" for n in range(lines))
        elements = [("text", f"short line {n}", 1) for n in range(lines)] + [("table", table, 2)]
        frame = spark.createDataFrame([(1, elements, table)], "doc_id long, elements array<struct<kind:string,text:string,page:int>>, markdown string")
        started = time.time()
        row = frame.select(
            F.size(chunking.parent_windows(chunking.atomic_units(F.col("elements")))).alias("windows"), F.size(split_table(F.col("markdown"))).alias("pieces")
        ).first()
        assert row.pieces == -(-lines // 10) or row.pieces > lines // 10
        return time.time() - started

    seconds(2000)
    assert seconds(32_000) < 30
