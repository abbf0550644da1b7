"""Deduplication, idempotent loads, removal, synchronisation and repair of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, strip
from corpusmill.operators.scale import small_side

EXTENSIONS = ["txt", "pdf", "doc", "docx", "ppt", "pptx", "wps", "rtf", "md"]  # fixed values


def file_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def dedup_exact(new: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of arriving documents by content hash.

    ``new`` has id, title, file_hash and arrival order = id; ``corpus`` id, title,
    file_hash. A copy of a corpus document or of an earlier arrival is rejected
    with the title of what it repeats. The keeper of each hash is an aggregate,
    so a hash shared by a third of the rows is combined before it is shuffled.
    """
    stored = corpus.groupBy("file_hash").agg(F.min_by("title", "id").alias("stored_title"))
    first = new.groupBy("file_hash").agg(F.min("id").alias("first_id"), F.min_by("title", "id").alias("first_title"))
    keepers = first.join(stored, "file_hash", "left")
    judged = new.join(keepers, "file_hash").withColumn(
        "existing_title",
        F.coalesce("stored_title", F.when(F.col("id") != F.col("first_id"), F.col("first_title"))),
    )
    plain = [c for c in new.columns]
    accepted = judged.filter(F.col("existing_title").isNull()).select(plain)
    rejected = judged.filter(F.col("existing_title").isNotNull()).select("id", "title", "existing_title")
    return accepted, rejected


def plan_load(new: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``action``: skip for a known hash, replace for a known title, else insert.

    A hash is known if the corpus before the load or an earlier file (lower id)
    of the load has it. Titles are file names, so a load holds each once.
    """
    hashes = corpus.select("file_hash").distinct().withColumn("_hash", F.lit(True))
    titles = corpus.select("title").distinct().withColumn("_title", F.lit(True))
    first = new.groupBy("file_hash").agg(F.min("id").alias("_first"))
    known = F.coalesce("_hash", F.lit(False)) | (F.col("id") > F.col("_first"))
    action = F.when(known, "skip").when(F.col("_title"), "replace").otherwise("insert")
    return (
        new.join(hashes, "file_hash", "left")
        .join(first, "file_hash")
        .join(titles, "title", "left")
        .withColumn("action", action)
        .drop("_hash", "_title", "_first")
    )


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Keeps one chunk per document and trimmed text: the first with a page, else the first."""
    key = F.md5(strip(F.coalesce("text", F.lit(""))).cast("binary"))
    no_page = F.col("page").isNull() | (F.col("page") == 0)
    kept = chunks.groupBy("doc_id", key.alias("digest")).agg(
        F.min(F.struct(no_page.alias("no_page"), "chunk_index")).alias("k"), F.count("*").alias("copies")
    )
    return kept.select("doc_id", F.col("k.chunk_index").alias("chunk_index"), "digest", "copies")


def purge(doc_ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows of the given documents; values are (table, name of its id column)."""
    gone = doc_ids.select(F.col("doc_id").alias("_gone")).distinct()
    gone = small_side(gone)
    return {name: table.join(gone, F.col(key) == F.col("_gone"), "left_anti") for name, (table, key) in tables.items()}


def purge_candidates(docs: DataFrame, keep: DataFrame, category_id: int | None = None) -> DataFrame:
    """Documents without a category (or of one category) that are not on the keep list."""
    chosen = F.col("category_id").isNull() if category_id is None else F.col("category_id") == category_id
    return docs.filter(chosen).join(keep.select("id"), "id", "left_anti").select("id", "title", "file_size")


def purge_totals(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("docs"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def rebuild_tally(docs: DataFrame, chunks: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Outcome of rebuilding completed documents: one that yields no chunk has failed."""
    todo = docs.filter(F.col("status") == "completed")
    if tenant_id is not None:
        todo = todo.filter(F.col("tenant_id") == tenant_id)
    built = chunks.select(F.col("doc_id").alias("id")).distinct().withColumn("_built", F.lit(True))
    return todo.join(built, "id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_built")).alias("success"),
        F.count_if(F.col("_built").isNull()).alias("failed"),
    )


def sync_visibility(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks with the new tenant, level and minimum of their document; ``changed`` marks the updated ones."""
    fields = ["tenant_id", "doc_level", "min_level"]
    new = small_side(changes.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("changed")))
    values = {c: F.coalesce(f"new_{c}", c) for c in fields}
    values["changed"] = F.coalesce("changed", F.lit(False))
    return chunks.join(new, "doc_id", "left").withColumns(values).drop(*[f"new_{c}" for c in fields])


def index_consistency(lexical: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk counts of both indexes per document, and whether they agree."""
    left = lexical.groupBy("doc_id").agg(F.count("*").alias("lexical"))
    right = vectors.groupBy("doc_id").agg(F.count("*").alias("vector"))
    return (
        left.join(right, "doc_id", "full_outer")
        .fillna(0, ["lexical", "vector"])
        .withColumn("consistent", F.col("lexical") == F.col("vector"))
    )


def check_dims(vectors: DataFrame, expected: int, by: str | None = None) -> DataFrame:
    """Vector sizes in use; any other than ``expected`` calls for a rebuild."""
    keys = ([by] if by else []) + ["dims"]
    return (
        vectors.withColumn("dims", F.size("embedding"))
        .groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("rebuild", F.col("dims") != expected)
    )


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer per key wins. An aggregate, so a hot key is combined before the shuffle."""
    rows = base.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def backfill_conversations(history: DataFrame, offset: int = 1_000_000_000) -> tuple[DataFrame, DataFrame]:
    """(new conversations, history) with one default conversation per user for rows that have none."""
    orphans = history.filter(F.col("conversation_id").isNull())
    created = orphans.groupBy("user_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    )
    new_id = F.col("user_id") + F.lit(offset)
    conversations = created.select(new_id.alias("id"), "user_id", "created_at", "updated_at")
    return conversations, history.withColumn("conversation_id", F.coalesce("conversation_id", new_id))


def backfill_tenant(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tenant_id", F.coalesce(F.nullif(F.col("tenant_id"), F.lit(0)), F.lit(1)))


def cancel_batch(docs: DataFrame, batch: DataFrame, processed: DataFrame, mode: str) -> DataFrame:
    """Documents left after cancelling a batch: ``all`` removes it whole, ``pending`` only what was not processed."""
    if mode not in {"all", "pending"}:
        raise ValueError("mode must be all or pending")
    gone = batch.select("id")
    if mode == "pending":
        gone = gone.join(processed.select("id"), "id", "left_anti")
    return docs.join(gone, "id", "left_anti")


def staging_reason(name: Column, duplicate: Column) -> Column:
    """Why a file is not staged: blank name, file type, duplicate; null if it is."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(is_blank(name), "blank_name").when(~extension.isin(EXTENSIONS), "bad_type").when(duplicate, "duplicate")
    )


def ingest_report(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Outcomes of a batch of files (id, name, file_hash, ok): counts per outcome."""
    stored = corpus.select("file_hash").distinct().withColumn("_stored", F.lit(True))
    # Only files that pass the other tests can be the first of their hash.
    fine = files.filter(staging_reason(F.col("name"), F.lit(False)).isNull())
    first = fine.groupBy("file_hash").agg(F.min("id").alias("first_id"))
    judged = files.join(stored, "file_hash", "left").join(first, "file_hash", "left")
    duplicate = F.coalesce("_stored", F.lit(False)) | F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
    outcome = F.coalesce(staging_reason(F.col("name"), duplicate), F.when(F.col("ok"), "succeeded").otherwise("failed"))
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def delete_conversations(ids: DataFrame, conversations: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, history) without the given conversations."""
    gone = small_side(ids.select(F.col("id").alias("_gone")).distinct())
    return (
        conversations.join(gone, F.col("id") == F.col("_gone"), "left_anti"),
        history.join(gone, F.col("conversation_id") == F.col("_gone"), "left_anti"),
    )
