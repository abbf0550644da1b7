"""Operators that split one key's history, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import reuse, scale
from corpusmill.streaming import live

START = datetime.datetime(2024, 1, 1)


def log(seed, n=400, questions=2, hours=90, step=1):
    rng = random.Random(seed)
    rows = []
    for event in range(n):
        at = START + datetime.timedelta(seconds=rng.randrange(0, hours * 3600, step))
        rows.append((event, at, f"q{rng.randrange(questions)}"))
    rows += [(n, START, "edge"), (n + 1, START + datetime.timedelta(hours=24), "edge"), (n + 2, START + datetime.timedelta(hours=48, microseconds=1), "edge")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, question string").repartition(3)


def fires(rows, n, window):
    out, held = set(), {}
    for event, at, question in sorted(rows, key=lambda r: (r[1], r[0])):
        times = [t for t in held.get(question, []) if at - t <= window] + [at]
        if len(times) >= n:
            out.add(event)
            times = []
        held[question] = times
    return out


@pytest.mark.parametrize("seed, step", [(1, 1), (2, 1800), (3, 7200)])
@pytest.mark.parametrize("n", [2, 5])
def test_hot_firings(spark, seed, step, n):
    rows = log(seed, step=step)
    found = {r.event_id for r in reuse.hot_firings(frame(spark, rows), n=n).collect()}
    assert found == fires(rows, n, datetime.timedelta(hours=24))


@pytest.mark.parametrize("step", [1, 3600])
def test_trailing_asks(spark, step):
    rows = log(4, step=step)
    found = {r.event_id: r.asks for r in reuse.trailing_asks(frame(spark, rows)).collect()}
    day = datetime.timedelta(hours=24)
    assert found == {e: sum(1 for _, t, p in rows if p == q and at - day <= t <= at) for e, at, q in rows}


def test_latest_before(spark):
    asks, stored = log(6), log(7, n=60)
    left = spark.createDataFrame([(e, t, q) for e, t, q in asks], "event_id long, ts timestamp, key string")
    right = spark.createDataFrame([(e, t, q) for e, t, q in stored], "answer_id long, cached_at timestamp, key string")
    found = {r.event_id: r.answer_id for r in reuse.reuse_exact(left, right, ttl=7200).collect()}
    wanted = {}
    for event, at, key in asks:
        past = [(t, a) for a, t, k in stored if k == key and t <= at]
        best = max(past, default=None)
        wanted[event] = best[1] if best and (at - best[0]).total_seconds() <= 7200 else None
    assert found == wanted


def test_running_without_keys(spark):
    rows = log(8)
    out = scale.running(frame(spark, rows), [], "ts", F.lit(1), "sum", "n", 60_000_000).collect()
    assert {r.event_id: r.n for r in out} == {e: sum(1 for _, t, _q in rows if t <= at) for e, at, _ in rows}


def test_top_n(spark):
    rng = random.Random(9)
    rows = [(n, rng.choice("aab"), rng.random()) for n in range(500)]
    frame_ = spark.createDataFrame(rows, "id long, k string, v double")
    found = {r.id for r in scale.top_n(frame_, ["k"], [F.desc("v")], 40, ["id"], salts=7).collect()}
    wanted = set()
    for key in "ab":
        wanted |= {n for n, _k, _v in sorted((r for r in rows if r[1] == key), key=lambda r: -r[2])[:40]}
    assert found == wanted


def test_small_side_only_hints_small_tables(spark):
    def hinted(df):
        return "hint" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(scale.small_side(spark.range(10), 10))
    assert not hinted(scale.small_side(spark.range(11), 10))


def test_semantic_reuse_isolates_tenants(spark):
    at = START
    asks = spark.createDataFrame([(1, 1, [1.0, 0.0], at), (2, 2, [1.0, 0.0], at)], "query_id long, tenant_id long, embedding array<float>, ts timestamp")
    entries = spark.createDataFrame(
        [(10, "x", 1, [1.0, 0.1], at - datetime.timedelta(hours=1)), (11, "x", 1, [1.0, 0.05], at - datetime.timedelta(hours=2)), (12, "y", 1, [0.0, 1.0], at)],
        "entry_id long, question string, tenant_id long, embedding array<float>, cached_at timestamp",
    )
    found = {r.query_id: r.entry_id for r in reuse.reuse_semantic(asks, entries).collect()}
    assert found == {1: 10}  # the later entry of question x replaced the earlier, nearer one
    shared = {r.query_id: r.entry_id for r in reuse.reuse_semantic(asks, entries, isolate=False).collect()}
    assert shared == {1: 10, 2: 10}
    grid = {r.query_id: r.entry_id for r in reuse.reuse_semantic(asks, entries, isolate=False, query_block=1, vector_block=1).collect()}
    assert grid == shared


@pytest.mark.parametrize("cells", [0, None])
def test_semantic_reuse_meets_entries_of_two_spans(spark, monkeypatch, cells):
    """A query is compared with its tenant's entries of two spans only; the result is that of all pairs."""
    hour = datetime.timedelta(hours=1)
    pick = random.Random(3)
    asks = [(n, pick.randrange(3), [1.0, pick.random()], START + n * 3 * hour) for n in range(200)]
    kept = [(1000 + n, f"q{n}", pick.randrange(3), [1.0, pick.random()], START + n * 3 * hour - hour) for n in range(200)]
    asked = spark.createDataFrame(asks, "query_id long, tenant_id long, embedding array<float>, ts timestamp")
    entries = spark.createDataFrame(kept, "entry_id long, question string, tenant_id long, embedding array<float>, cached_at timestamp")
    exact = sorted(map(str, reuse.reuse_semantic(asked, entries, 0.99, query_block=10_000).collect()))
    seen = []
    search = reuse.nearest_in_cells
    monkeypatch.setattr(reuse, "QUERY_BLOCK", 10)
    monkeypatch.setattr(reuse, "nearest_in_cells", lambda *a, **b: (seen.append((a[0], b["by"])), search(*a, **b))[1])
    assert sorted(map(str, reuse.reuse_semantic(asked, entries, 0.99, cells=cells).collect())) == exact
    assert len(exact) > 50 and seen[0][1] == ["span", "tenant_id"] and seen[0][0].count() == 2 * len(asks)


def test_hot_stream_matches_the_loop(spark, tmp_path):
    rows = sorted(log(12, n=200), key=lambda r: r[1])
    for part in range(4):
        chunk = rows[part * 51 : (part + 1) * 51]
        spark.createDataFrame(chunk, "event_id long, ts timestamp, question string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, question string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = (
        live.hot_questions_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    found = {(r.question, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = {(q, at) for e, at, q in rows if e in fires(rows, 5, datetime.timedelta(hours=24))}
    assert found == wanted
