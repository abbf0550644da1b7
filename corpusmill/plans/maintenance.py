"""Queries for deduplication, loads, removal and repair (D1-D15)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators import chunking, lexical, maintenance, models, retrieval
from corpusmill.operators.scale import shared_folder, stage
from corpusmill.plans.inputs import FLOOR, Inputs
from corpusmill.plans.oracle_views import VIEWS
from corpusmill.plans.registry import query
from corpusmill.sources import index_store
from corpusmill.sources.versions import VersionedIndex, drop_copies
from corpusmill.streaming import ingest

# The corpus is what a third of the sources delivered; the rest arrives.
IN_CORPUS = "source IN ('src0', 'src3', 'src6', 'src9', 'src12', 'src15', 'src18')"
SPLIT = f"""
    hashed AS (SELECT doc_id AS id, concat('doc ', lang, ' ', doc_id) AS title, sha256(text) AS file_hash, {IN_CORPUS} AS stored FROM documents),
    arrivals AS (SELECT * FROM hashed WHERE NOT stored),
    corpus AS (SELECT * FROM hashed WHERE stored)"""


def _split(i: Inputs):
    rows, stored = i.hashed_docs(), F.expr(IN_CORPUS)
    return rows.filter(~stored).drop("source"), rows.filter(stored).drop("source")


@query(
    "D1_dedup_accepted",
    """SELECT min(id) AS id, arg_min(title, id) AS title FROM arrivals WHERE file_hash NOT IN (SELECT file_hash FROM corpus) GROUP BY file_hash""",
    SPLIT,
)
def _(i: Inputs):
    return maintenance.dedup_exact(*_split(i))[0].select("id", "title")


@query(
    "D1_dedup_rejected",
    """SELECT a.id, a.title, coalesce(c.title, f.title) AS existing_title FROM arrivals a
    JOIN (SELECT file_hash, min(id) AS first_id, arg_min(title, id) AS title FROM arrivals GROUP BY file_hash) f USING (file_hash)
    LEFT JOIN (SELECT file_hash, arg_min(title, id) AS title FROM corpus GROUP BY file_hash) c USING (file_hash)
    WHERE c.title IS NOT NULL OR a.id <> f.first_id""",
    SPLIT,
)
def _(i: Inputs):
    return maintenance.dedup_exact(*_split(i))[1]


@query(
    "D2_plan_load",
    """SELECT id, title, CASE WHEN file_hash IN (SELECT file_hash FROM corpus) OR id > (SELECT min(id) FROM arrivals f WHERE f.file_hash = n.file_hash) THEN 'skip' WHEN title IN (SELECT title FROM corpus) THEN 'replace' ELSE 'insert' END AS action
    FROM (SELECT id, file_hash, CASE WHEN id % 4 = 0 THEN coalesce((SELECT min(title) FROM corpus), '') ELSE title END AS title FROM arrivals) n""",
    SPLIT,
)
def _(i: Inputs):
    new, corpus = _split(i)
    name = corpus.agg(F.min("title")).scalar()
    new = new.withColumn("title", F.when(F.col("id") % 4 == 0, name).otherwise(F.col("title")))
    return maintenance.plan_load(new, corpus).select("id", "title", "action")


def _paged_chunks(i: Inputs):
    """Chunks with a copy of each, some with a page and some without."""
    chunks = i.chunks().select("doc_id", "chunk_index", "text")
    page = F.when(F.col("chunk_index") % 3 == 0, 0).when(F.col("chunk_index") % 3 == 1, 1 + F.col("chunk_index"))
    own = F.struct(F.col("chunk_index"), F.col("text"), page.cast("int").alias("page"))
    copy = F.struct((F.col("chunk_index") + 100_000).alias("chunk_index"), F.concat(F.lit(" "), "text").alias("text"), F.lit(9).alias("page"))
    # One row after the other, so that what is alike lies together where it is written or counted.
    return chunks.select("doc_id", F.inline(F.array(own, copy)))


@query(
    "D3_dedup_chunks",
    """SELECT doc_id, digest, CAST(chunk_index AS INT) AS chunk_index, copies FROM (
      SELECT doc_id, md5(text) AS digest, chunk_index, count(*) OVER w AS copies,
        row_number() OVER (PARTITION BY doc_id, md5(text) ORDER BY page IS NULL OR page = 0, chunk_index) AS place
      FROM (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 0 WHEN chunk_index % 3 = 1 THEN 1 END AS page, text FROM stripped
            UNION ALL SELECT doc_id, chunk_index + 100000, 9, text FROM stripped) WINDOW w AS (PARTITION BY doc_id, md5(text))) WHERE place = 1""",
    "stripped AS (SELECT doc_id, chunk_index, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM v_chunk)",
)
def _(i: Inputs):
    return maintenance.dedup_chunks(_paged_chunks(i))


@query(
    "D3_store_dedup",
    """SELECT doc_id, digest, CAST(chunk_index AS INT) AS chunk_index, true AS indexed FROM (
      SELECT doc_id, md5(text) AS digest, chunk_index, row_number() OVER (PARTITION BY doc_id, md5(text) ORDER BY page IS NULL OR page = 0, chunk_index) AS place
      FROM (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 0 WHEN chunk_index % 3 = 1 THEN 1 END AS page, text FROM stripped
            UNION ALL SELECT doc_id, chunk_index + 100000, 9, text FROM stripped)) WHERE place = 1""",
    "stripped AS (SELECT doc_id, chunk_index, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM v_chunk)",
)
def _(i: Inputs):
    """Copies are taken out of chunks, postings and vectors of a store; ``indexed`` says that a chunk is still in all of them, and nothing else is."""
    copied = lambda rows: rows.withColumn("chunk_index", F.explode(F.array(F.col("chunk_index"), F.col("chunk_index") + 100_000)))
    store = VersionedIndex(i.spark, f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}", buckets=8)
    store.commit({"chunks": _paged_chunks(i), "parents": i.parents(), "postings": copied(i.lexical().chunks), "vectors": copied(i.chunk_vectors())})
    drop_copies(store)
    part = store.tables()
    key = lambda name: part[name].select("doc_id", "chunk_index", F.lit(True).alias(name))
    both = key("postings").join(key("vectors"), ["doc_id", "chunk_index"], "full_outer")
    chunks = part["chunks"].select("doc_id", "chunk_index", F.md5(strip(F.col("text")).cast("binary")).alias("digest"))
    found = chunks.join(both, ["doc_id", "chunk_index"], "full_outer")
    return found.select("doc_id", "digest", "chunk_index", (F.coalesce("postings", F.lit(False)) & F.coalesce("vectors", F.lit(False))).alias("indexed"))


@query(
    "D4_purge",
    """SELECT 'chunks' AS part, count(*) AS n FROM v_chunk WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'parents', count(*) FROM v_parent WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'acl', count(*) FROM v_acl WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(i: Inputs):
    gone = i.table("labels").filter("toxic = 1").select("doc_id")
    tables = {"chunks": (i.chunks(), "doc_id"), "parents": (i.parents(), "doc_id"), "acl": (i.grants(), "document_id")}
    out = None
    for part, table in maintenance.purge(gone, tables).items():
        row = table.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


KEEP = "SELECT doc_id FROM labels WHERE quality = 1"


@query(
    "D5_purge_candidates",
    f"SELECT id, title, file_size FROM v_document WHERE category_id IS NULL AND id NOT IN ({KEEP})",
)
def _(i: Inputs):
    keep = i.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return maintenance.purge_candidates(i.docs(), keep)


@query(
    "D5_purge_totals",
    f"SELECT count(*) AS docs, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM v_document WHERE category_id IS NULL AND id NOT IN ({KEEP})",
)
def _(i: Inputs):
    keep = i.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return maintenance.purge_totals(maintenance.purge_candidates(i.docs(), keep))


@query(
    "D6_reingest",
    """SELECT doc_id, chunk_index, parent_id, md5(text) AS digest FROM v_chunk""",
)
def _(i: Inputs):
    """The stored index after the documents labelled toxic were ingested again."""
    path = f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    index_store.write_index({"chunks": i.chunks(), "parents": i.parents()}, path, buckets=8)
    toxic = i.table("labels").filter("toxic = 1").select("doc_id")
    again = i.text_docs().join(toxic, "doc_id", "left_semi")
    index_store.reingest(
        i.spark, path, again, lambda docs: dict(zip(["chunks", "parents"], chunking.build_chunks_text(docs))), buckets=8
    )
    chunks = index_store.read_index(i.spark, path, ["chunks"])["chunks"]
    return chunks.select("doc_id", "chunk_index", "parent_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "D7_rebuild_tally",
    """SELECT count(*) AS total, count(*) FILTER (id IN (SELECT doc_id FROM v_chunk)) AS success, count(*) FILTER (id NOT IN (SELECT doc_id FROM v_chunk)) AS failed
    FROM v_document WHERE status = 'completed'""",
)
def _(i: Inputs):
    return maintenance.rebuild_tally(i.docs(), i.chunks())


@query(
    "D8_sync_visibility",
    """SELECT c.doc_id, c.chunk_index, coalesce(CASE WHEN toxic = 1 THEN 3 END, tenant_id) AS tenant_id, CASE WHEN toxic = 0 THEN 'private' ELSE doc_level END AS doc_level,
      min_level, l.doc_id IS NOT NULL AS changed FROM v_chunk c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
)
def _(i: Inputs):
    changes = i.table("labels").select(
        "doc_id", F.when(F.col("toxic") == 1, 3).alias("tenant_id"), F.when(F.col("toxic") == 0, "private").alias("doc_level"),
        F.lit(None).cast("int").alias("min_level"),
    )
    rows = maintenance.sync_visibility(i.chunks(), changes)
    return rows.select(
        "doc_id", "chunk_index", F.col("tenant_id").cast("long").alias("tenant_id"), "doc_level",
        F.col("min_level").cast("long").alias("min_level"), "changed",
    )


@query(
    "D9_index_consistency",
    """SELECT doc_id, count(*) AS lexical, CASE WHEN lost THEN 0 ELSE count(*) END AS vector, NOT lost AS consistent
    FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS lost FROM v_chunk) GROUP BY doc_id, lost""",
)
def _(i: Inputs):
    # As if the vectors of the documents labelled toxic had been lost.
    vectors = i.chunk_vectors().join(i.table("labels").filter("toxic = 1"), "doc_id", "left_anti")
    return maintenance.index_consistency(i.lexical().chunks, vectors)


@query(
    "D10_check_dims",
    "SELECT label, CAST(len(embedding) AS INT) AS dims, count(*) AS n, len(embedding) <> 64 AS rebuild FROM embeddings GROUP BY ALL",
)
def _(i: Inputs):
    return maintenance.check_dims(i.table("embeddings"), 64, by="label")


@query(
    "D11_upsert_feedback",
    "SELECT history_id, user_id, arg_max(rating, (created_at, id)) AS rating, max(created_at) AS created_at FROM v_feedback GROUP BY ALL",
)
def _(i: Inputs):
    votes = i.feedback()
    base, changes = votes.filter("rating = 1"), votes.filter("rating = -1")
    rows = maintenance.upsert(base, changes, ["history_id", "user_id"], ["created_at", "id"])
    return rows.select("history_id", "user_id", "rating", "created_at")


@query(
    "D11_upsert_acl",
    "SELECT doc_id % 211 AS document_id, user_id, max(event_id) AS granted_by FROM v_view GROUP BY ALL",
)
def _(i: Inputs):
    views = i.views().select((F.col("doc_id") % 211).alias("document_id"), "user_id", F.col("event_id").alias("granted_by"))
    rows = maintenance.upsert(views.limit(0), views, ["document_id", "user_id"], ["granted_by"])
    return rows


ORPHANS = "history AS (SELECT *, CASE WHEN turn >= 2 THEN conversation_id END AS conv FROM v_qa)"


@query(
    "D12_backfill_conversations",
    "SELECT user_id + 1000000000 AS id, user_id, min(created_at) AS created_at, max(created_at) AS updated_at FROM history WHERE conv IS NULL GROUP BY user_id",
    ORPHANS,
)
def _(i: Inputs):
    return maintenance.backfill_conversations(_orphans(i))[0]


@query("D12_backfill_history", "SELECT id, coalesce(conv, user_id + 1000000000) AS conversation_id FROM history", ORPHANS)
def _(i: Inputs):
    return maintenance.backfill_conversations(_orphans(i))[1].select("id", "conversation_id")


def _orphans(i: Inputs):
    return i.history().withColumn("conversation_id", F.when(F.col("turn") >= 2, F.col("conversation_id")))


@query("D12_backfill_tenant", "SELECT id, CASE WHEN coalesce(tenant_id, 0) = 0 THEN 1 ELSE tenant_id END AS tenant_id FROM v_user")
def _(i: Inputs):
    return maintenance.backfill_tenant(i.users()).select("id", "tenant_id")


@query(
    "D13_cancel_batch",
    """SELECT 'all' AS mode, id FROM v_document WHERE id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'pending', id FROM v_document WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def _(i: Inputs):
    batch = i.table("labels").select(F.col("doc_id").alias("id"))
    done = i.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    out = None
    for mode in ["all", "pending"]:
        rows = maintenance.cancel_batch(i.docs(), batch, done, mode).select(F.lit(mode).alias("mode"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "D14_ingest_report",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN id % 13 = 0 THEN 'blank_name' WHEN id % 13 = 1 THEN 'bad_type'
        WHEN file_hash IN (SELECT file_hash FROM corpus) OR id > (SELECT min(id) FROM arrivals f WHERE f.file_hash = a.file_hash AND id % 13 > 1) THEN 'duplicate'
        WHEN length(title) % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS outcome FROM arrivals a) GROUP BY outcome""",
    SPLIT,
)
def _(i: Inputs):
    new, corpus = _split(i)
    name = F.when(F.col("id") % 13 == 0, " ").when(F.col("id") % 13 == 1, F.concat("title", F.lit(".exe"))).otherwise(F.concat("title", F.lit(".TXT")))
    files = new.select("id", name.alias("name"), "file_hash", (F.length("title") % 2 == 0).alias("ok"))
    return maintenance.ingest_report(files, corpus)


@query(
    "D15_delete_conversations",
    """SELECT 'conversations' AS part, conversation_id AS id FROM v_qa WHERE conversation_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conversation_id
    UNION ALL SELECT 'history', id FROM v_qa WHERE conversation_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def _(i: Inputs):
    gone = i.table("conversations").filter("role = 'system'").select(F.col("conv_id").alias("id"))
    conversations = i.history().select(F.col("conversation_id").alias("id")).distinct()
    left, history = maintenance.delete_conversations(gone, conversations, i.history())
    return left.select(F.lit("conversations").alias("part"), "id").unionByName(history.select(F.lit("history").alias("part"), "id"))


# ---- the versioned store: ingest, purge, changed text, rebuild, retrieval ---

TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"
PURGED, MISSING = "id % 37 = 5", "id % 22 = 3"
#: The documents as the store ends: toxic ones with changed text, some purged, every eleventh rebuilt unless its source is missing.
STORED = {
    "v_document": f"""SELECT * REPLACE (CASE WHEN id IN ({TOXIC}) THEN 'Anew. ' || content
        WHEN id % 11 = 3 AND NOT {MISSING} THEN 'Rebuilt. ' || content ELSE content END AS content)
        FROM ({VIEWS["v_document"]}) WHERE NOT {PURGED}"""
}


def _index_of(docs: DataFrame) -> dict[str, DataFrame]:
    chunks, parents = chunking.build_chunks_text(docs)
    chunks = stage(chunks, "chunks")
    vectors = models.embed(chunks).select(*lexical.CHUNK_KEY, *[c for c in lexical.CARRIED if c in chunks.columns], "embedding")
    return {"chunks": chunks, "parents": parents, "postings": lexical.index_rows(chunks), "vectors": vectors}


_stores: dict[tuple[str, str], tuple[VersionedIndex, DataFrame]] = {}


def _store(i: Inputs) -> tuple[VersionedIndex, DataFrame]:
    """A store and the tally of its rebuild: a store with a first version of all documents, in which toxic ones then change, some are purged and some rebuilt."""
    key = (i.spark.sparkContext.applicationId, i.folder)
    if key in _stores:
        return _stores[key]
    store = VersionedIndex(i.spark, f"{shared_folder(i.spark)}/{key[0]}/store-{uuid.uuid4().hex}", buckets=8)
    docs = i.text_docs()
    store.commit({"chunks": i.chunks(), "parents": i.parents(), "postings": i.lexical().chunks, "vectors": i.chunk_vectors()})
    toxic = docs.join(i.table("labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    store.replace(toxic.withColumn("text", F.concat(F.lit("Anew. "), "text")), _index_of)
    again = docs.where("doc_id % 11 = 3").join(toxic.select("doc_id"), "doc_id", "left_anti")
    sources = again.where("doc_id % 22 <> 3").select("doc_id", F.concat(F.lit("Rebuilt. "), "text").alias("text"))
    tally = stage(store.rebuild(again, sources, _index_of), "tally")
    store.purge(docs.where("doc_id % 37 = 5").select("doc_id"))
    _stores[key] = store, tally
    return _stores[key]


@query("D6_store_chunks", "SELECT doc_id, chunk_index, parent_id, md5(text) AS digest FROM v_chunk", instead=STORED)
def _(i: Inputs):
    """Chunks of the store after changes, a rebuild and a purge."""
    chunks = _store(i)[0].tables(["chunks"])["chunks"]
    return chunks.select("doc_id", "chunk_index", "parent_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("S6_store_terms", "SELECT term, df, round(idf, 6) AS idf FROM v_idf", instead=STORED)
def _(i: Inputs):
    """Frequencies from the stored changes of each commit, nothing counted anew."""
    return _store(i)[0].lexical().terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "D4_store_purge",
    """SELECT 'chunks' AS part, count(*) AS n FROM v_chunk UNION ALL SELECT 'parents', count(*) FROM v_parent
    UNION ALL SELECT 'postings', count(*) FROM v_chunk UNION ALL SELECT 'vectors', count(*) FROM v_chunk""",
    instead=STORED,
)
def _(i: Inputs):
    out = None
    for part, table in _store(i)[0].tables().items():
        row = table.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "D7_store_rebuild",
    f"""SELECT count(*) AS total, count(*) FILTER (doc_id % 22 <> 3) AS success, count(*) FILTER (doc_id % 22 = 3) AS failed
    FROM documents WHERE doc_id % 11 = 3 AND doc_id NOT IN ({TOXIC})""",
)
def _(i: Inputs):
    """Every other source is missing; those documents fail and stay as they were."""
    return _store(i)[1]


@query(
    "R19_store_retrieve",
    """SELECT query_id, CAST(rank AS INT) AS rank, doc_id, title, chunk_index, md5(content) AS content, round(rerank_norm, 6) AS rerank_norm
    FROM v_hits JOIN (SELECT id AS doc_id, title FROM v_document) USING (doc_id)""",
    instead=STORED,
)
def _(i: Inputs):
    """Hybrid retrieval from the store as it is after all of that."""
    store = _store(i)[0]
    part = store.tables()
    corpus = retrieval.Corpus(part["chunks"], part["parents"], i.docs(), store.lexical(), part["vectors"], i.grants())
    hits = retrieval.hybrid_retrieve(i.questions(), corpus, floor=FLOOR)
    return hits.select("query_id", "rank", "doc_id", "title", "chunk_index", F.md5("content").alias("content"), F.round("rerank_norm", 6).alias("rerank_norm"))


# One for each worker, which keeps its words.
_embedder = models.hashing_embedder()


def _picky(texts):
    """A model that fails on texts that begin with a Q or a T."""
    if texts.str.startswith(("Q", "T")).any():
        raise ValueError("not this text")
    return _embedder(texts)


@query(
    "S10_store_ingest",
    """SELECT file_hash, CAST(sum(n) AS BIGINT) AS chunks, bool_or(bad) AS failed FROM (
      SELECT sha256(content) AS file_hash, id, count(c.doc_id) AS n, coalesce(bool_or(c.text[1] IN ('Q', 'T')), false) AS bad
      FROM v_document LEFT JOIN v_chunk c ON c.doc_id = id GROUP BY ALL)
    WHERE id IN (SELECT min(id) FROM v_document GROUP BY sha256(content)) GROUP BY file_hash""",
)
def _(i: Inputs):
    """Documents arrive in several triggers; those the model fails on don't hold up the others. One row for each distinct text."""
    base = f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}"
    staged, path = f"{base}/arrivals-{uuid.uuid4().hex}", f"{base}/store-{uuid.uuid4().hex}"
    rows = i.docs().select("id", "title", F.col("content").alias("text"), "tenant_id", "doc_level", "min_level", F.col("upload_by").alias("owner_id"))
    rows.repartition(3, "id").write.parquet(staged)
    ingest.ingest_to_store(i.spark, staged, path, 1, _picky, buckets=8).awaitTermination()
    part = ingest.document_store(i.spark, path, 8).tables(["documents", "chunks"])
    built = part["chunks"].groupBy("doc_id").agg(F.count("*").alias("n"))
    each = part["documents"].join(built, "doc_id", "left").groupBy("file_hash").agg(F.sum("n").alias("n"), F.max("reason").alias("reason"), F.max(F.col("status") == "failed").alias("failed"))
    whole = i.chunks().groupBy("doc_id").agg(F.count("*").alias("all"))
    # A failed text has no chunks in the store; what it would have had says that nothing else went missing.
    wanted = i.hashed_docs().select(F.col("id").alias("doc_id"), "file_hash").join(whole, "doc_id", "left").groupBy("file_hash").agg(F.max("all").alias("all"))
    both = each.join(wanted, "file_hash")
    failed = F.col("failed") & (F.coalesce("reason", F.lit("")) == "model failed")
    chunks = F.when(failed, F.col("all")).otherwise(F.coalesce("n", F.lit(0)))
    return both.select("file_hash", F.coalesce(chunks, F.lit(0)).cast("bigint").alias("chunks"), failed.alias("failed"))
