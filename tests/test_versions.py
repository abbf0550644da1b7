"""The versioned store, update sinks and settled micro-batches."""

import datetime

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from corpusmill.operators import chunking, lexical, models, reuse
from corpusmill.sources import versions
from corpusmill.sources.versions import VersionedIndex
from corpusmill.streaming import ingest, live

T0 = datetime.datetime(2024, 1, 1)


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def build(frame):
    chunks, parents = chunking.build_chunks_text(frame)
    return {"chunks": chunks, "parents": parents, "postings": lexical.index_rows(chunks), "vectors": models.embed(chunks.select("doc_id", "chunk_index", "text")).drop("text")}


def counted(index):
    stats = index.stats.first()
    return {r.term: (r.df, round(r.idf, 9)) for r in index.terms.collect()}, stats.n_chunks, round(stats.avg_tokens, 9)


def test_versions_keep_counts_and_older_states(spark, tmp_path):
    store = VersionedIndex(spark, str(tmp_path / "store"), buckets=4)
    texts = {n: f"alpha number{n} " * 60 for n in range(12)}
    first = store.commit(build(docs(spark, texts)))
    texts |= {3: "beta only", 5: "gamma " * 100}
    store.replace(docs(spark, {n: texts[n] for n in (3, 5)}), build)
    store.purge(docs(spark, {7: "", 8: ""}).select("doc_id"))
    del texts[7], texts[8]
    tables = store.tables()
    want = lexical.build_lexical_index(chunking.build_chunks_text(docs(spark, texts))[0])
    assert counted(store.lexical()) == counted(want)
    for name in ("chunks", "parents", "postings", "vectors"):
        assert {r.doc_id for r in tables[name].select("doc_id").collect()} == set(texts), name
    assert {r.doc_id for r in store.tables(["chunks"], first)["chunks"].select("doc_id").collect()} == set(range(12))
    before = sorted(map(str, store.tables(["chunks"])["chunks"].collect()))
    store.compact()
    assert sorted(map(str, store.tables(["chunks"])["chunks"].collect())) == before and counted(store.lexical()) == counted(want)
    assert len(store.manifest()["commits"]) == 1


def test_documents_of_one_file_are_work_for_several_tasks(spark, tmp_path):
    rows = [(n, f"t{n}", f"text number {n} " * 20, 1, "public", 1, 1) for n in range(200)]
    spark.createDataFrame(rows, ingest.STAGED).coalesce(1).write.parquet(str(tmp_path / "in"))

    def where(texts):
        number = TaskContext.get().partitionId()
        return pd.Series([[float(number)]] * len(texts), index=texts.index)

    ingest.ingest_to_store(spark, str(tmp_path / "in"), str(tmp_path / "store"), 1, where, buckets=2).awaitTermination()
    part = ingest.document_store(spark, str(tmp_path / "store"), 2).tables()
    assert part["vectors"].select("embedding").distinct().count() > 1
    assert part["parents"].select("doc_id").distinct().count() == 200
    assert {(r.status, r.text) for r in part["documents"].collect()} == {("completed", r[2]) for r in rows}


def test_rebuild_keeps_what_has_no_source(spark, tmp_path):
    store = VersionedIndex(spark, str(tmp_path / "store"), buckets=4)
    old = docs(spark, {1: "old one", 2: "old two", 3: "old three"})
    store.commit(build(old))
    tally = store.rebuild(old, docs(spark, {1: "new one", 3: " "}), build).first()
    assert (tally.total, tally.success, tally.failed) == (3, 1, 2)
    assert {r.doc_id: r.text for r in store.tables(["chunks"])["chunks"].collect()} == {1: "new one", 2: "old two", 3: "old three"}


def test_a_number_is_taken_once_and_half_a_manifest_is_none(spark, tmp_path):
    store = VersionedIndex(spark, str(tmp_path / "store"), buckets=2)
    store.commit(build(docs(spark, {1: "one"})), batch="a")
    assert store.commit(build(docs(spark, {2: "two"})), batch="a") == 1
    (tmp_path / "store/_manifest/00000002.json").write_text('{"version": 2, "comm')
    assert store.manifest()["version"] == 1
    with pytest.raises(Exception, match="[Ee]xist"):
        store.commit(build(docs(spark, {3: "three"})))
    assert {r.doc_id for r in store.tables(["chunks"])["chunks"].collect()} == {1}


def test_ingest_into_the_store(spark, tmp_path):
    staged, path = str(tmp_path / "staged"), str(tmp_path / "store")

    def fragile(texts):
        if texts.str.contains("poison").any():
            raise ValueError("no")
        return pd.Series([[1.0, 0.0]] * len(texts), index=texts.index)

    def stage(rows):
        spark.createDataFrame(rows, ingest.STAGED).coalesce(1).write.mode("append").parquet(staged)
        ingest.ingest_to_store(spark, staged, path, 1, fragile, buckets=4).awaitTermination()

    row = lambda n, text: (n, f"t{n}", text, 1, "public", 1, 1)
    stage([row(1, "alpha " * 100), row(2, " "), row(3, "alpha " * 100), row(4, "poison here"), row(5, "poison here")])
    stage([row(6, "alpha " * 100), row(7, "beta")])
    stage([row(7, "gamma")])  # the same number again, with another text
    store = ingest.document_store(spark, path, 4)
    part = store.tables()
    status = {r.doc_id: (r.status, r.reason) for r in part["documents"].collect()}
    assert status == {
        1: ("completed", None), 2: ("failed", "empty text"), 3: ("duplicate", "t1"), 4: ("failed", "model failed"),
        5: ("failed", "model failed"), 6: ("duplicate", "t1"), 7: ("completed", None),
    }
    assert {r.doc_id: r.text for r in part["chunks"].where("doc_id = 7").collect()} == {7: "gamma"}
    assert {r.doc_id for r in part["vectors"].select("doc_id").collect()} == {1, 7} == {r.doc_id for r in part["postings"].select("doc_id").collect()}
    words = {r.term for r in store.lexical().terms.collect()}
    assert "gamma" in words and "beta" not in words and "poison" not in words
    ingest.store_batch(spark.createDataFrame([row(9, "again")], ingest.STAGED), f"{staged}#0", store, fragile)
    assert store.manifest()["version"] == 3  # a batch that is known isn't committed again


def stream_of(spark, folder, schema, parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_update_sink(spark, tmp_path):
    rows = [[(at(0), "GET", "a", "200")] * 3, [(at(70), "GET", "a", "200"), (at(65), "GET", "a", "200")], [(at(71), "POST", "b", "500")], [(at(1), "GET", "a", "200")]]
    stream = stream_of(spark, str(tmp_path / "in"), "ts timestamp, method string, endpoint string, status string", rows)
    counts = live.request_counts_stream(stream)
    sink = live.UpsertSink(str(tmp_path / "out"), ["start", "method", "endpoint", "status"], buckets=2)
    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    want = {(at(0), "GET", 3), (at(60), "GET", 2), (at(60), "POST", 1)}  # the last row came an hour too late and is refused
    read = lambda: {(r.start, r.method, r.n) for r in sink.read(spark, counts.schema).collect()}
    assert read() == want
    sink.compact(spark, counts.schema)
    assert read() == want
    sink(spark.createDataFrame([(at(60), "GET", "a", "200", 9)], counts.schema), 50)
    sink(spark.createDataFrame([(at(60), "GET", "a", "200", 9)], counts.schema), 50)  # runs again
    assert read() == {(at(0), "GET", 3), (at(60), "GET", 9), (at(60), "POST", 1)}


def test_hot_questions_over_triggers(spark, tmp_path):
    schema = "event_id long, ts timestamp, question string"
    rows = [(n, at(7 * n), "q" if n % 3 else "r") for n in range(300)] + [(1000 + n, at(900), "q") for n in range(12)]
    dealt = sorted(rows, key=lambda r: (r[1] + datetime.timedelta(minutes=r[0] % 9), r[0]))
    parts = [dealt[i * 80 : (i + 1) * 80] for i in range(4)]
    sink = live.HotQuestions(str(tmp_path / "hot"), spark.createDataFrame([], schema).schema)
    stream = stream_of(spark, str(tmp_path / "in"), schema, [*parts, [(9999, at(1), "q")]])
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    sink.finish(spark)
    want = reuse.hot_firings(spark.createDataFrame(rows, schema))
    key = lambda frame: sorted((r.question, r.ts, r.event_id) for r in frame.collect())
    assert key(sink.read(spark)) == key(want) and sink.refused(spark) == 1


def test_sketches_are_near_exact(spark, tmp_path):
    rows = [[(at(n % 50), "a", float((n * 37) % 1000)) for n in range(part * 500, part * 500 + 500)] for part in range(3)]
    stream = stream_of(spark, str(tmp_path / "in"), "ts timestamp, endpoint string, latency_s double", rows)
    made = live.latency_sketches_stream(stream, ["endpoint"], "2 hours")
    sink = live.UpsertSink(str(tmp_path / "out"), ["endpoint", "minute"])
    made.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    got = live.sketched_quantiles(sink.read(spark, made.schema), ["endpoint"]).first()
    values = sorted(float((n * 37) % 1000) for n in range(1500))
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        rank = sum(v <= got[name] for v in values) / len(values)
        assert abs(rank - q) < 0.02
    assert got.n == 1500


@pytest.mark.parametrize("narrow", [2_000_000, 20])
@pytest.mark.parametrize("copied", [3, 40])
def test_copies_leave_without_a_shuffle_of_the_tables(spark, tmp_path, monkeypatch, narrow, copied):
    """Of few or most documents, in one pass or bucket by bucket; parents stay, and counts are those of what is left."""
    monkeypatch.setattr(versions, "NARROW_ROWS", narrow)
    rows = [(n, c, f"alpha d{n} c{c} " + ("same" if c >= 70 else "own"), c % 3) for n in range(40) for c in [*range(n % 5), 64, 70, 100_070, 200_000]]
    rows = [(n, c, "alpha twice" if n < copied and c in (70, 100_070) else text, page) for n, c, text, page in rows]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, page int")
    postings = lexical.index_rows(chunks)
    orphans = spark.createDataFrame([(1, 7, 1, [("orphan", 1)]), (39, 9, 1, [("orphan", 1)])], postings.schema)
    parents = spark.createDataFrame([(n, f"p{n}") for n in range(40)], "doc_id long, parent_id string")
    store = versions.VersionedIndex(spark, str(tmp_path / "store"), buckets=4)
    store.commit({"chunks": chunks, "postings": postings.unionByName(orphans), "parents": parents})
    written = []
    commit = store.commit
    monkeypatch.setattr(store, "commit", lambda added, *a, **b: (written.append(added), commit(added, *a, **b))[1])
    versions.drop_copies(store)
    gone = {(n, 100_070 if 70 % 3 else 70) for n in range(copied)}
    want = {(n, c) for n, c, _, _ in rows} - gone
    part = store.tables()
    key = lambda name: [(r.doc_id, r.chunk_index) for r in part[name].select("doc_id", "chunk_index").collect()]
    assert sorted(key("chunks")) == sorted(want)
    # What no chunk stands behind leaves with the copies of its document only.
    assert sorted(key("postings")) == sorted(want | ({(39, 9)} if copied == 3 else set()))
    assert sorted(r.doc_id for r in part["parents"].collect()) == list(range(40))
    assert sorted(map(str, store.tables(["chunks"], 1)["chunks"].collect())) == sorted(map(str, chunks.collect()))
    left = lexical.build_lexical_index(spark.createDataFrame(part["chunks"].toPandas()))
    found = {r.term: r.df for r in store.lexical().terms.where("term <> 'orphan'").collect()}
    assert found == {r.term: r.df for r in left.terms.collect()}
    assert ("parents" in written[0]) == (copied == 3)
    if narrow > 20:
        for table in written[0].values():
            for some in table:
                assert "Exchange hashpartitioning" not in some._jdf.queryExecution().executedPlan().toString()
    elif copied == 40:
        assert [len(t) for t in written[0].values()] == [4, 4]
    store.purge(docs(spark, {2: ""}).select("doc_id"))
    assert not [r for name in part for r in store.tables([name])[name].where("doc_id = 2").collect()]
    assert store.lexical().terms.where("term = 'd2'").count() == 0
