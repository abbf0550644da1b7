"""Queries for sources and sinks (S1-S10): what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import chunking, evaluation
from corpusmill.operators.scale import shared_folder
from corpusmill.plans.evaluation import HYBRID
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.registry import query
from corpusmill.sources import files, golden, index_store, reports
from corpusmill.streaming import ingest


def _folder(i: Inputs, name: str) -> str:
    return f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _text_files(i: Inputs) -> str:
    """The pages as text files: one per host, named by Spark, written where the cluster can see them."""
    path = _folder(i, "files")
    i.table("pages").select(F.regexp_replace("html", r"[\r\n]+", " ").alias("value")).write.option("lineSep", "\n").text(path)
    return path


@query(
    "S1_scan_files",
    "SELECT CAST(sum(octet_length(encode(regexp_replace(html, '[\\r\\n]+', ' ', 'g'))) + 1) AS BIGINT) AS bytes, true AS titled FROM pages",
)
def _(i: Inputs):
    found = files.scan_files(i.spark, _text_files(i))
    return found.agg(F.sum("file_size").alias("bytes"), F.every((F.length("file_hash") == 64) & ~F.contains("title", F.lit(".txt"))).alias("titled"))


@query(
    "S2_decode_text",
    "SELECT md5(regexp_replace(html, '[\\r\\n]+', ' ', 'g')) AS digest FROM pages",
)
def _(i: Inputs):
    decoded = files.decoded_documents(files.scan_files(i.spark, _text_files(i)))
    lines = decoded.select(F.explode(F.split("text", "\n")).alias("line")).filter("line != ''")
    return lines.select(F.md5(F.col("line").cast("binary")).alias("digest"))


@query(
    "S3_read_golden",
    """SELECT question, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS relevant FROM (
      SELECT b.text AS question, g.doc_id FROM v_golden g JOIN benchmark b ON b.item_id = g.query_id) GROUP BY question""",
)
def _(i: Inputs):
    """Labels written as JSON lines, between lines that must be skipped, and read back."""
    path = _folder(i, "golden")
    labels = i.golden().groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("key_id"))
    rows = labels.join(i.answers(), "query_id").select(
        F.to_json(F.struct(F.col("answer").alias("question"), F.array().cast("array<int>").alias("relevant_doc_ids"), "key_id")).alias("value")
    )
    broken = labels.select(F.concat(F.lit('{"question": '), F.col("query_id").cast("string")).alias("value"))
    empty = labels.select(F.lit('{"question": "x", "key_id": []}').alias("value"))
    rows.unionByName(broken).unionByName(empty).write.text(path)
    read = golden.read_golden(i.spark, path)
    return read.select("question", F.array_join(F.sort_array("relevant"), ",").alias("relevant"))


@query(
    "S4_read_bank",
    "SELECT c_custkey AS id, c_name AS q, c_mktsegment AS type FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def _(i: Inputs):
    """One bank file per nation, in the nested layout of a question bank."""
    path = _folder(i, "bank")
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("q"),
        F.lit(False).alias("trap"), F.lit("").alias("reference"),
    )
    banks = i.table("customer").groupBy("c_nationkey", F.pmod(F.xxhash64("c_custkey"), F.lit(8)).alias("part")).agg(
        F.collect_list(entry).alias("questions")
    )
    lines = banks.select(F.to_json(F.struct(F.lit("1").alias("version"), "questions")).alias("value"))
    # The reader takes one bank per file, so each is a file of its own.
    lines.repartition(400, "value").write.option("maxRecordsPerFile", 1).text(path)
    read = golden.read_bank(i.spark, path, ["BUILDING", "MACHINERY"])
    return read.select(F.col("id").cast("long").alias("id"), "q", "type")


@query("S5_load_tables", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(i: Inputs):
    orders = i.table("orders").groupBy("o_orderstatus")
    return orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "S6_index_store",
    """SELECT 'chunks' AS part, count(*) AS n FROM v_chunk UNION ALL SELECT 'parents', count(*) FROM v_parent
    UNION ALL SELECT 'postings', count(*) FROM v_chunk UNION ALL SELECT 'vectors', count(*) FROM v_chunk UNION ALL SELECT 'terms', count(*) FROM v_idf""",
)
def _(i: Inputs):
    path = _folder(i, "index")
    tables = {"chunks": i.chunks(), "parents": i.parents(), "postings": i.lexical().chunks, "vectors": i.chunk_vectors()}
    index_store.write_index(tables, path, buckets=8)
    out = index_store.read_lexical(i.spark, path).terms.agg(F.count("*").alias("n")).select(F.lit("terms").alias("part"), "n")
    for part, table in index_store.read_index(i.spark, path).items():
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n"))
    return out


@query("S7_write_report", "SELECT query_id, round(recall, 4) AS recall, round(mrr, 4) AS mrr, hit FROM judged_hybrid", HYBRID)
def _(i: Inputs):
    path = _folder(i, "report")
    detail = evaluation.eval_questions(i.results(), i.golden())
    reports.write_report(evaluation.eval_summary(detail), detail, path)
    return i.spark.read.schema("query_id long, recall double, mrr double, hit int").json(f"{path}/detail")


@query(
    "S8_append_stats",
    "SELECT doc_id, count(*) * 2 AS logged FROM (SELECT doc_id FROM documents) GROUP BY doc_id",
)
def _(i: Inputs):
    path = _folder(i, "stats")
    for _time in range(2):
        reports.append_stats(chunking.parse_stats(i.element_docs()), path)
    return i.spark.read.schema("doc_id long").json(path).groupBy("doc_id").agg(F.count("*").alias("logged"))


@query(
    "S9_append_golden",
    """SELECT question, array_to_string(list_sort(list_distinct([conversation_id, v_qa.id, turn])), ',') AS relevant FROM v_qa WHERE (conversation_id + turn) % 7 NOT IN (0, 1)
      AND id = (SELECT min(id) FROM v_qa f WHERE f.question = v_qa.question AND (f.conversation_id + f.turn) % 7 NOT IN (0, 1))""",
)
def _(i: Inputs):
    path = _folder(i, "appended")
    history = i.history()
    none = history.select("question").limit(0)
    outcomes = evaluation.golden_candidates(history, history.select("id"), none)
    added = outcomes.filter("outcome = 'added'")
    # Two appends, as two reviews would make them.
    golden.append_golden(added.filter("question < 'F'"), path)
    golden.append_golden(added.filter("question >= 'F'"), path)
    return golden.read_golden(i.spark, path).select("question", F.array_join(F.sort_array("relevant"), ",").alias("relevant"))


@query(
    "S10_ingest_stream",
    """SELECT sha256(text) AS file_hash, count(*) AS copies, CAST(ceil(max(length(text)) / 300e0) AS BIGINT) AS chunks FROM documents GROUP BY ALL""",
)
def _(i: Inputs):
    """All documents staged as files and ingested by the stream; one row per distinct text."""
    staged, out = _folder(i, "staged"), _folder(i, "ingested")
    rows = i.docs().select(
        "id", "title", F.col("content").alias("text"), "tenant_id", "doc_level", "min_level", F.col("upload_by").alias("owner_id")
    )
    rows.repartition(4, "id").write.parquet(staged)
    ingest.ingest_stream(i.spark, staged, out, files_per_batch=2).awaitTermination()
    docs = i.spark.read.parquet(f"{out}/documents")
    chunks = i.spark.read.parquet(f"{out}/chunks").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks"))
    return (
        docs.join(chunks, "id", "left")
        .groupBy("file_hash")
        .agg(F.count("*").alias("copies"), F.coalesce(F.max("chunks"), F.lit(0)).alias("chunks"))
    )
