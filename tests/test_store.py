import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, maintenance
from corpusmill.operators.scale import shared_folder
from corpusmill.sources import files, golden, index_store, tables
from corpusmill.streaming import ingest


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\r\nworld".encode())
    (tmp_path / "b.MD").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "blank.txt").write_bytes(b" \n ")
    (tmp_path / "skip.exe").write_bytes(b"x")
    found = files.scan_files(spark, str(tmp_path))
    assert {r.title for r in found.collect()} == {"a", "b", "blank"}
    decoded = {r.title: r for r in files.decode_text(found).collect()}
    assert decoded["a"].text == "héllo\nworld" and decoded["b"].text == "中文内容"
    assert decoded["blank"].warning == files.EMPTY
    assert files.decoded_documents(found).count() == 2


def test_golden_reader_skips_what_it_cannot_use(spark, tmp_path):
    lines = [
        json.dumps({"question": " q1 ", "relevant_doc_ids": [], "key_id": [3, 3, 4], "tags": ["a", "b"]}),
        json.dumps({"question": "q2", "relevant_doc_ids": [1], "note": "n", "must_contain": ["k", 7], "answer": "x"}),
        json.dumps({"question": "", "key_id": [1]}),
        json.dumps({"question": "q", "key_id": []}),
        "{broken", "", "[1]",
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    rows = {r.question: r for r in golden.read_golden(spark, str(tmp_path / "g.jsonl")).collect()}
    assert set(rows) == {"q1", "q2"}
    assert rows["q1"].relevant == [3, 4] and rows["q1"].note == "a/b" and rows["q1"].must_contain == []
    assert rows["q2"].must_contain == ["k", "7"] and rows["q2"].note == "n"
    assert golden.read_golden(spark, str(tmp_path / "g.jsonl"), with_answers=True).count() == 1


def test_bank_reader(spark, tmp_path):
    bank = {"version": "1", "questions": [{"id": f"q{n}", "type": "ab"[n % 2], "q": "?", "trap": False, "reference": ""} for n in range(6)]}
    (tmp_path / "bank.json").write_text(json.dumps(bank, indent=1))
    assert [r.id for r in golden.read_bank(spark, str(tmp_path / "bank.json"), ["b"], 2).collect()] == ["q1", "q3"]


def test_defaults(spark):
    row = tables.with_defaults(spark.createDataFrame([(1, None)], "doc_id long, min_level int")).first()
    assert (row.tenant_id, row.doc_level, row.min_level) == (1, "public", 1)


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def build(frame):
    return dict(zip(["chunks", "parents"], chunking.build_chunks_text(frame)))


def test_store_replaces_and_removes(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.write_index(build(docs(spark, {n: f"text {n} " * 90 for n in range(10)})), path, buckets=4)
    index_store.reingest(spark, path, docs(spark, {3: "short", 99: "new"}), build, buckets=4)
    read = index_store.read_index(spark, path, ["chunks", "parents"])
    assert [r.text for r in read["chunks"].filter("doc_id = 3").collect()] == ["short"]
    assert {r.doc_id for r in read["parents"].select("doc_id").collect()} == {*range(10), 99}
    gone = spark.range(10).select(F.col("id").alias("doc_id"))
    none = {name: table.limit(0) for name, table in build(docs(spark, {0: "x"})).items()}
    index_store.replace_documents(spark, path, gone, none, buckets=4)
    read = index_store.read_index(spark, path, ["chunks", "parents"])
    assert [r.doc_id for r in read["chunks"].collect()] == [99]


def test_dedup_is_idempotent(spark):
    rows = [(n, f"t{n}", f"h{n % 4}") for n in range(12)]
    new = spark.createDataFrame(rows, "id long, title string, file_hash string")
    corpus = spark.createDataFrame([(100, "old", "h3")], "id long, title string, file_hash string")
    accepted, rejected = maintenance.dedup_exact(new, corpus)
    assert {r.id for r in accepted.collect()} == {0, 1, 2}
    assert {r.id: r.existing_title for r in rejected.collect()}[3] == "old"
    again, dropped = maintenance.dedup_exact(accepted, corpus)
    assert again.count() == 3 and dropped.count() == 0


def test_ingest_stream_is_incremental_and_isolates_failures(spark, tmp_path):
    staged, out = str(tmp_path / "staged"), str(tmp_path / "out")

    def stage(rows):
        spark.createDataFrame(rows, ingest.STAGED).coalesce(1).write.mode("append").parquet(staged)
        ingest.ingest_stream(spark, staged, out).awaitTermination()

    row = lambda n, text: (n, f"t{n}", text, 1, "public", 1, 1)
    stage([row(1, "alpha " * 100), row(2, " "), row(3, "alpha " * 100)])
    stage([row(4, "alpha " * 100), row(5, "beta")])
    status = {r.id: (r.status, r.reason) for r in spark.read.parquet(f"{out}/documents").collect()}
    assert status == {
        1: ("completed", None), 2: ("failed", "empty text"), 3: ("duplicate", "t1"), 4: ("duplicate", "t1"), 5: ("completed", None),
    }
    assert {r.doc_id for r in spark.read.parquet(f"{out}/chunks").collect()} == {1, 5}
    assert spark.read.parquet(f"{out}/vectors").count() == spark.read.parquet(f"{out}/chunks").count()
    # A batch that runs again replaces its own output.
    ingest.ingest_batch(spark.createDataFrame([row(4, "alpha " * 100), row(5, "beta")], ingest.STAGED), 1, out)
    assert spark.read.parquet(f"{out}/documents").count() == 5


def test_stages_need_a_shared_folder_on_a_cluster():
    class Session:
        def __init__(self, master, folder):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})

    assert shared_folder(Session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(Session("local[4]", None))
    with pytest.raises(ValueError):
        shared_folder(Session("spark://host:7077", None))
    with pytest.raises(ValueError):
        shared_folder(Session("local-cluster[2,1,1024]", None))
