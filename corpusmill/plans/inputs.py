"""The given tables in the shape the operators expect.

Everything is derived by Spark from the Parquet tables of one scale folder, over
all their rows. The index is built once per session and folder and kept in the
shared checkpoint folder, as a deployment would keep it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.tables import grid_to_markdown
from corpusmill.operators.access import permission_context
from corpusmill.operators.cells import CellIndex, build_cells
from corpusmill.operators.chunking import build_chunks_text
from corpusmill.operators.lexical import LexicalIndex, corpus_size, document_frequency, index_rows, with_idf
from corpusmill.operators.maintenance import file_hash
from corpusmill.operators.models import embed
from corpusmill.operators.ranking import confidence_floor, dynamic_topk
from corpusmill.operators.retrieval import Corpus, retrieve
from corpusmill.operators.scale import small_side, spread, stage
from corpusmill.operators.substrings import holders
from corpusmill.sources.tables import load

ASOF = "2024-01-31 00:00:00"
BASE = 1_704_067_200  # 2024-01-01 00:00:00 UTC
FLOOR = 0.15  # the default scorer seldom reaches the floor meant for a trained one

_kept: dict[tuple[str, str, str], DataFrame] = {}


def seconds_after_base(col) -> Column:
    return F.timestamp_seconds(F.lit(BASE) + col)


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        table = load(self.spark, self.folder, name)
        if name == "events":
            table = table.withColumn("ts", F.col("ts").cast("timestamp"))
        return table

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _kept:
            _kept[key] = stage(build(), name, compression="zstd")
        return _kept[key]

    # ---- people and papers -------------------------------------------------

    def tenants(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"),
            F.col("c_name").alias("username"),
            F.col("c_mktsegment").alias("real_name"),
            F.when(key % 41 != 0, F.col("c_nationkey")).alias("tenant_id"),
            F.when(key % 50 == 0, "admin").otherwise("user").alias("role"),
            F.when(key % 23 == 0, 0).otherwise(1 + key % 4).cast("int").alias("clearance_level"),
            F.when(key % 17 == 0, 0).otherwise(1).alias("status"),
            seconds_after_base((key % 45) * 86_400).alias("created_at"),
        )

    def categories(self) -> DataFrame:
        roots = self.table("region").select(
            (F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"),
            F.lit(0).cast("long").alias("parent_id"), F.col("r_regionkey").alias("sort_order"),
        )
        leaves = self.table("nation").select(
            (F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"),
            (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_nationkey").alias("sort_order"),
        )
        return roots.unionByName(leaves)

    def documents(self) -> DataFrame:
        """The documents on all cores, for work that reads every character."""
        return spread(self.table("documents"))

    def docs(self, documents: DataFrame | None = None) -> DataFrame:
        key = F.col("doc_id")
        return (documents or self.table("documents")).select(
            key.alias("id"),
            F.concat(F.lit("doc "), "lang", F.lit(" "), key.cast("string")).alias("title"),
            F.col("text").alias("content"),
            F.when(key % 9 != 0, 100 + key % 25).alias("category_id"),
            (key % 25).cast("int").alias("tenant_id"),
            F.when(key % 11 == 0, "private").otherwise("public").alias("doc_level"),
            (1 + key % 4).cast("int").alias("min_level"),
            ((key * 7) % 150).alias("upload_by"),
            F.col("n_chars").alias("file_size"),
            F.when(key % 10 == 0, "failed").when(key % 10 == 1, "pending").otherwise("completed").alias("status"),
            seconds_after_base((key % 40) * 86_400).alias("created_at"),
        )

    def hashed_docs(self) -> DataFrame:
        """Ids, titles and content hashes, as the document table stores them."""
        key = F.col("doc_id")
        title = F.concat(F.lit("doc "), "lang", F.lit(" "), key.cast("string"))
        rows = self.table("documents").select(
            key.alias("id"), title.alias("title"), "source", file_hash(F.col("text")).alias("file_hash")
        )
        return self.keep("hashes", lambda: rows)

    def acl(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("labels").filter(F.col("quality") == 1).select(
            key.alias("document_id"), ((key * 13) % 150).alias("user_id"), seconds_after_base(key * 60).alias("created_at")
        )

    def grants(self) -> DataFrame:
        return self.acl().select("document_id", "user_id")

    def history(self) -> DataFrame:
        turns = self.table("conversations")
        asked = turns.filter(F.col("role") == "user")
        replies = turns.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        key = F.col("conv_id") * 1000 + F.col("turn")
        cited = F.concat(
            F.lit('["'), F.col("conv_id").cast("string"), F.lit('","x",'), key.cast("string"), F.lit(',"'),
            F.col("turn").cast("string"), F.lit('"]'),
        )
        rows = asked.join(replies, ["conv_id", "turn"])
        return rows.select(
            key.alias("id"),
            F.col("conv_id").alias("conversation_id"),
            "turn",
            (F.col("conv_id") % 150).alias("user_id"),
            F.col("text").alias("question"),
            "answer",
            (F.length("text") + F.length("answer")).cast("long").alias("token_count"),
            F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit("[broken"))
            .when((F.col("conv_id") + F.col("turn")) % 7 == 1, F.lit("[]"))
            .otherwise(cited)
            .alias("documents"),
            seconds_after_base(key).alias("created_at"),
        )

    def feedback(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").filter(F.col("event_type").isin("purchase", "error")).select(
            key.alias("id"),
            ((key % 150) * 1000 + F.floor(key / 150).cast("long") % 4).alias("history_id"),
            "user_id",
            F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("rating"),
            F.col("ts").alias("created_at"),
        )

    def logins(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("username"),
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("login_status"),
            F.col("ts").alias("created_at"),
        )

    def views(self) -> DataFrame:
        """Who opened which document, one row per event."""
        return self.table("events").select(
            "event_id", "user_id", (F.col("event_id") * 31 % 1009).alias("doc_id"), "ts"
        )

    # ---- traffic -----------------------------------------------------------

    def metrics(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            "ts",
            kind.alias("endpoint"),
            F.when(F.col("user_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
            F.when(kind == "error", "500").otherwise("200").alias("status"),
            (F.col("value") / 100.0).alias("latency_s"),
            F.when(kind == "view", "bm25").when(kind == "click", "vector").when(kind == "signup", "rrf").otherwise("rerank").alias("stage"),
            F.concat(F.lit("l"), (1 + F.col("user_id") % 3).cast("string")).alias("layer"),
            (F.col("value") < 10).alias("hit"),
            F.timestamp_seconds(F.unix_seconds("ts") + F.floor("value").cast("long") * 60).alias("end_second"),
        )

    def query_log(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "ts", "user_id",
            F.concat("event_type", F.lit("  "), (F.col("user_id") % 5).cast("string"), F.lit("?")).alias("question"),
        )

    # ---- questions and labels ----------------------------------------------

    def questions(self, admin: bool = False) -> DataFrame:
        """Benchmark passages as questions, each asked by a user with their own rights (or by an administrator)."""
        key = F.col("item_id")
        asked = self.table("benchmark").select(
            key.alias("query_id"), F.col("text").alias("question"), ((key * 7) % 150).alias("user_id")
        )
        if admin:
            return asked.select(
                "query_id", "question", F.lit(True).alias("is_admin"), "user_id",
                F.lit(None).cast("int").alias("caller_tenant"), F.lit(None).cast("int").alias("clearance"),
            )
        return permission_context(self.users()).join(small_side(asked), "user_id").select(
            "query_id", "question", "is_admin", "user_id", "caller_tenant", "clearance"
        )

    def list_questions(self) -> DataFrame:
        """Questions about lists of documents, worded around each benchmark item's number."""
        key = F.col("query_id")
        number = key.cast("string")
        wording = (
            F.when(key % 5 == 0, F.lit("有哪些文档"))
            .when(key % 5 == 1, F.concat(F.lit("请列出 DOC en "), number))
            .when(key % 5 == 2, F.concat(F.lit("zz"), number, F.lit(" 所有文件")))
            .when(key % 5 == 3, F.concat(F.lit("文档有哪些区别 "), number))
            .otherwise(F.concat(F.lit("qq"), number, F.lit(" 有什么")))
        )
        return self.questions().withColumn("question", wording)

    def golden(self) -> DataFrame:
        """(query_id, doc_id): documents that contain the passage, of one word or more, word for word."""

        def build() -> DataFrame:
            passages = self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
            worded = passages.where(F.col("needle").rlike(r"(?U)[^\s]"))
            return holders(worded, self.documents().select("doc_id", "text")).distinct()

        return self.keep("golden", build)

    def answers(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))

    def keywords(self) -> DataFrame:
        """Words a good hit should show: the second to fourth of each passage, none for every sixth."""
        words = F.slice(F.split("text", " "), 2, 3)
        none = F.array().cast("array<string>")
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 6 == 0, none).otherwise(words).alias("must_contain")
        )

    # ---- documents as elements, grids and chunks ---------------------------

    def element_docs(self) -> DataFrame:
        """Documents as elements: a line with | is a table, a line that ends in '!' an image's text, others text."""
        lines = F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct(
                F.when(F.contains(line, F.lit("|")), "table").when(line.endswith("!"), "image").otherwise("text").alias("kind"),
                line.alias("text"),
                (1 + F.floor(i / 20)).cast("int").alias("page"),
            ),
        )
        return self.documents().select("doc_id", lines.alias("elements"))

    def text_docs(self) -> DataFrame:
        return self.docs(self.documents()).select(
            F.col("id").alias("doc_id"), F.col("content").alias("text"), "tenant_id", "doc_level", "min_level",
            F.col("upload_by").alias("owner_id"),
        )

    def grids(self) -> DataFrame:
        """Documents as grids: lines are rows, commas separate cells."""
        return self.documents().select(
            "doc_id", F.transform(F.split("text", "\n"), lambda line: F.split(line, ",")).alias("grid")
        )

    def markdown(self) -> DataFrame:
        return self.grids().select("doc_id", grid_to_markdown(F.col("grid")).alias("markdown"))

    def chunks(self) -> DataFrame:
        return self.keep("chunks", lambda: build_chunks_text(self.text_docs())[0])

    def parents(self) -> DataFrame:
        return self.keep("parents", lambda: build_chunks_text(self.text_docs())[1])

    def lexical(self) -> LexicalIndex:
        rows = self.keep("postings", lambda: index_rows(self.chunks()))
        # Every word of the corpus is counted once; terms and stats both read the counts.
        frequency = self.keep("frequency", lambda: document_frequency(rows))
        terms, stats = with_idf(frequency, self.keep("size", lambda: corpus_size(rows)))
        return LexicalIndex(rows, self.keep("terms", lambda: terms), self.keep("stats", lambda: stats))

    def chunk_vectors(self) -> DataFrame:
        columns = ["doc_id", "chunk_index", "parent_id", "owner_id", "tenant_id", "doc_level", "min_level"]
        return self.keep("vectors", lambda: embed(self.chunks().select(*columns, "text")).select(*columns, "embedding"))

    def cells(self) -> CellIndex:
        """The given embeddings filed in cells, with the rights of their documents."""
        index = functools.cache(lambda: build_cells(stage(self.vectors(), "rights-vectors")))
        vectors = self.keep("cell-vectors", lambda: index().vectors)
        return CellIndex(vectors, self.keep("cells", lambda: index().cells))

    def corpus(self) -> Corpus:
        return Corpus(self.chunks(), self.parents(), self.docs(), self.lexical(), self.chunk_vectors(), self.grants())

    def vectors(self) -> DataFrame:
        """The given embeddings with the rights of the document of the same number."""
        docs = self.docs().select(
            F.col("id").alias("vec_id"), F.col("upload_by").alias("owner_id"), "tenant_id", "doc_level", "min_level"
        )
        return self.table("embeddings").join(docs, "vec_id", "left").withColumn("doc_id", F.col("vec_id"))

    def vector_queries(self) -> DataFrame:
        key = F.col("vec_id")
        asked = self.table("embeddings").select(key.alias("query_id"), "embedding", ((key * 7) % 150).alias("user_id"))
        return asked.join(permission_context(self.users()), "user_id")

    # ---- results that several reports read ---------------------------------

    def results(self, mode: str = "hybrid", admin: bool = True) -> DataFrame:
        return self.keep(
            f"results-{mode}-{admin}", lambda: retrieve(self.questions(admin), self.corpus(), mode)
        )

    def cut(self) -> DataFrame:
        """Hits with the callers' rights after floor and dynamic cut."""
        return self.keep("cut", lambda: dynamic_topk(confidence_floor(self.results("hybrid", False), FLOOR), 5))

