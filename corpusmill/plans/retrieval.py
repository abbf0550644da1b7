"""Queries for retrieval (R1-R25)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from corpusmill.functions.vectors import squared_l2
from corpusmill.operators import cells, dense, fusion, lexical, models, ranking, retrieval, rewrite
from corpusmill.operators.scale import stage
from corpusmill.plans.inputs import FLOOR, Inputs
from corpusmill.plans.oracle_views import GRANTED, OPEN, WORD, strip
from corpusmill.plans.registry import query


def r6(name: str):
    return F.round(name, 6).alias(name)


def long(name: str):
    return F.col(name).cast("long").alias(name)


# One pass over the words, each step computed once.
TERMS = f"""
    words AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS ws FROM v_chunk),
    freq AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(ws) AS term FROM words) GROUP BY term),
    weighed AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM words) - df + 0.5) - ln(df + 0.5) AS raw FROM freq)"""


@query(
    "R1_lexical_terms",
    "SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM weighed) ELSE raw END, 6) AS idf FROM weighed",
    TERMS,
)
def _(i: Inputs):
    return lexical.build_lexical_index(i.chunks()).terms.select("term", "df", r6("idf"))


@query(
    "R1_lexical_postings",
    "SELECT doc_id, chunk_index, term, tf, CAST(n_tokens AS BIGINT) AS n_tokens FROM v_tf JOIN v_size USING (doc_id, chunk_index)",
)
def _(i: Inputs):
    rows = lexical.index_rows(i.chunks())
    entries = rows.select("doc_id", "chunk_index", "n_tokens", F.explode("terms").alias("t"))
    return entries.select("doc_id", "chunk_index", "t.term", F.col("t.tf").cast("long").alias("tf"), long("n_tokens"))


@query(
    "R1_lexical_stats",
    "SELECT n AS n_chunks, round(avg_tokens, 6) AS avg_tokens, round((SELECT avg(raw) FROM v_raw_idf), 6) AS mean_idf FROM v_stats",
)
def _(i: Inputs):
    return lexical.build_lexical_index(i.chunks()).stats.select("n_chunks", r6("avg_tokens"), r6("mean_idf"))


@query("R2_bm25_search", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, parent_id, round(score, 6) AS score FROM v_bm25")
def _(i: Inputs):
    hits = lexical.bm25_search(i.questions(), i.lexical(), i.grants())
    return hits.select("query_id", "rank", "doc_id", "chunk_index", "parent_id", r6("score"))


# Whole questions, and lists so long that most chunks in them match nothing.
PADDED_K = 300
PADDED = """
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_index) AS rank FROM (
      SELECT query_id, doc_id, chunk_index, coalesce(score, 0e0) AS score FROM v_pair LEFT JOIN v_match USING (query_id, doc_id, chunk_index)))"""


@query(
    "R2_bm25_padded",
    f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, round(score, 6) AS score FROM placed WHERE rank <= {PADDED_K}",
    PADDED,
)
def _(i: Inputs):
    hits = lexical.bm25_search(i.questions(), i.lexical(), i.grants(), PADDED_K, pad_zero=True)
    return hits.select("query_id", "rank", "doc_id", "chunk_index", r6("score"))


VECTOR_PAIRS = f"""
    stored AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, d.upload_by AS owner_id, d.tenant_id, d.doc_level, d.min_level, e.vec_id AS doc_id
               FROM embeddings e LEFT JOIN v_document d ON d.id = e.vec_id),
    asked AS (SELECT e.vec_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS q, c.* FROM embeddings e JOIN v_ctx c ON c.user_id = (e.vec_id * 7) % 150),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
      SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(q, v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS distance
      FROM stored, asked WHERE {OPEN} OR {GRANTED.format(user='asked.user_id')}) WHERE distance <= 1.5)"""


@query("R3_dense_search", "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(distance, 6) AS distance FROM near WHERE rank <= 20", VECTOR_PAIRS)
def _(i: Inputs):
    hits = dense.dense_search(i.vector_queries(), i.vectors(), i.grants(), keys=["vec_id"])
    return hits.select("query_id", "rank", "vec_id", r6("distance"))


@query("R3_dense_cells", "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(distance, 6) AS distance FROM near WHERE rank <= 20", VECTOR_PAIRS)
def _(i: Inputs):
    """Through the index of cells, reading those whose bound allows the greatest distance."""
    hits = cells.search_cells(i.vector_queries(), i.cells(), i.grants(), keys=["vec_id"])
    return hits.select("query_id", "rank", "vec_id", r6("distance"))


@query("R3_dense_probed")
def _(i: Inputs):
    """The nearest three of four cells only; tests measure its recall."""
    index = i.cells()
    hits = cells.search_cells(i.vector_queries(), index, i.grants(), keys=["vec_id"], probes=max(1, index.cells.count() * 3 // 4))
    return hits.select("query_id", "rank", "vec_id", r6("distance"))


@query(
    "R3_dense_chunks",
    "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, round(distance, 6) AS distance FROM v_dense",
)
def _(i: Inputs):
    hits = dense.dense_search(models.embed_queries(i.questions()), i.chunk_vectors(), i.grants())
    return hits.select("query_id", "rank", "doc_id", "chunk_index", r6("distance"))


@query(
    "R4_embed_chunks",
    "SELECT doc_id, chunk_index, count(*) FILTER (v <> 0) AS filled, round(sum(CAST(v AS DOUBLE) * v), 6) AS size, round(sum(CAST(v AS DOUBLE) * (place + 1)), 6) + 0e0 AS weighted FROM (SELECT doc_id, chunk_index, coalesce(v, 0) AS v, coalesce(place, 0) AS place FROM v_chunk LEFT JOIN v_cvec USING (doc_id, chunk_index)) GROUP BY ALL",
)
def _(i: Inputs):
    vectors = models.embed(i.chunks().select("doc_id", "chunk_index", "text"))
    entry = F.col("x").cast("double")
    rows = vectors.select("doc_id", "chunk_index", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("doc_id", "chunk_index").agg(
        F.count_if(F.col("x") != 0).alias("filled"), F.round(F.sum(entry * entry), 6).alias("size"), F.round(F.sum(entry * (F.col("place") + 1)), 6).alias("weighted")
    )


INSTRUCTION = "Given a question, retrieve passages that answer it\nQuery: "


@query(
    "R5_embed_queries",
    """SELECT query_id, 64 AS dims, round(sum((CAST(coalesce(t.v, 0) AS DOUBLE) - coalesce(p.v, 0)) * (CAST(coalesce(t.v, 0) AS DOUBLE) - coalesce(p.v, 0))), 6) AS moved
    FROM (SELECT * FROM vector WHERE told) t FULL JOIN (SELECT * FROM vector WHERE NOT told) p USING (query_id, place) GROUP BY query_id""",
    r"""
    wording AS (SELECT query_id, told, CASE WHEN told THEN 'Given a question, retrieve passages that answer it' || chr(10) || 'Query: ' || question ELSE question END AS text
      FROM v_question, (VALUES (true), (false)) t(told)),
    hashed AS (SELECT query_id, told, CAST('0x' || substr(md5(term), 1, 6) AS INT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 2) AS INT) < 128 THEN 1 ELSE -1 END) AS v
      FROM (SELECT query_id, told, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM wording) GROUP BY ALL),
    vector AS (SELECT query_id, told, place, CAST(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY query_id, told)), 0), 0) AS FLOAT) AS v FROM hashed)""".replace("\\\\", "\\"),
)
def _(i: Inputs):
    """How far the instruction moves each question."""
    plain = models.embed_queries(i.questions()).select("query_id", F.col("embedding").alias("plain"))
    told = models.embed_queries(i.questions(), INSTRUCTION)
    both = told.join(plain, "query_id")
    return both.select("query_id", F.size("embedding").alias("dims"), F.round(squared_l2(F.col("embedding"), F.col("plain")), 6).alias("moved"))


@query(
    "R6_rrf",
    """SELECT query_id, CAST(rank AS INT) AS rank, doc_id, parent_id, chunk_index, round(score, 6) AS score,
      round(coalesce(dense_score, -1), 6) AS dense_score, round(coalesce(sparse_score, -1), 6) AS sparse_score FROM v_fused""",
)
def _(i: Inputs):
    sparse = lexical.bm25_search(i.questions(), i.lexical(), i.grants())
    found = dense.dense_search(models.embed_queries(i.questions()), i.chunk_vectors(), i.grants(), carry=["parent_id"])
    found = found.withColumn("score", F.col("distance"))
    fused = fusion.rrf(found, sparse)
    filled = [F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ["dense_score", "sparse_score"]]
    return fused.select("query_id", "rank", "doc_id", "parent_id", "chunk_index", r6("score"), *filled)


VARIANTS = """
    variant AS (SELECT query_id, 0 AS variant, rank, doc_id, parent_id, chunk_index, 1e0 / (60 + rank) AS score FROM v_bm25
      UNION ALL SELECT query_id, 1, rank, doc_id, parent_id, chunk_index, 1e0 / (60 + rank) FROM v_dense),
    merged AS (SELECT query_id, doc_id, parent_id, chunk_index, sum(score) AS score, min(variant * 1000 + rank) AS first FROM variant GROUP BY ALL)"""


@query(
    "R7_merge_variants",
    """SELECT query_id, doc_id, chunk_index, round(score, 6) AS score,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS INT) AS rank FROM merged""",
    VARIANTS,
)
def _(i: Inputs):
    sparse = lexical.bm25_search(i.questions(), i.lexical(), i.grants()).select("query_id", "rank", *fusion.KEY)
    found = dense.dense_search(models.embed_queries(i.questions()), i.chunk_vectors(), i.grants(), carry=["parent_id"])
    found = found.select("query_id", "rank", *fusion.KEY)
    both = sparse.withColumn("variant", F.lit(0)).unionByName(found.withColumn("variant", F.lit(1)))
    merged = fusion.merge_variants(both.withColumn("score", 1.0 / (60 + F.col("rank"))))
    return merged.select("query_id", "doc_id", "chunk_index", r6("score"), "rank")


@query(
    "R8_rerank",
    """SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, round(rerank_score, 6) AS rerank_score, round(rerank_norm, 6) AS rerank_norm FROM v_rerank""",
)
def _(i: Inputs):
    hits = retrieval.retrieve(i.questions(), i.corpus())
    return hits.select("query_id", "rank", "doc_id", "chunk_index", r6("rerank_score"), r6("rerank_norm"))


@query("R9_confidence_floor", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index FROM v_floor")
def _(i: Inputs):
    kept = ranking.confidence_floor(i.results("hybrid", False), FLOOR)
    return kept.select("query_id", "rank", "doc_id", "chunk_index")


@query(
    "R10_norm_score",
    """SELECT query_id, doc_id, chunk_index, round(CASE WHEN rank <= 4 THEN 1e0 / (1e0 + exp(-rerank_score)) ELSE coalesce(1e0 / (1e0 + dense_score), 0.5) END, 6) AS norm FROM v_rerank""",
)
def _(i: Inputs):
    hits = i.results("hybrid", False).withColumn("rerank_norm", F.when(F.col("rank") <= 4, F.col("rerank_norm")))
    return hits.select("query_id", "doc_id", "chunk_index", F.round(ranking.norm_score(), 6).alias("norm"))


@query("R11_dynamic_topk", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, CAST(k_used AS INT) AS k_used FROM v_cut")
def _(i: Inputs):
    cut = ranking.dynamic_topk(ranking.confidence_floor(i.results("hybrid", False), FLOOR), 5)
    return cut.select("query_id", "rank", "doc_id", "chunk_index", "k_used")


@query(
    "R12_expand_parents",
    "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, md5(content) AS content, md5(child_content) AS child_content FROM v_hits",
)
def _(i: Inputs):
    hits = retrieval.expand_parents(i.cut(), i.parents())
    return hits.select("query_id", "rank", "doc_id", F.md5("content").alias("content"), F.md5("child_content").alias("child_content"))


LISTING = f"""
    asked AS (SELECT *, lower(substring({strip("regexp_replace(question, '有哪些|有什么|列出|列举|清单|请|帮我|帮|都|什么|多少(个|份|类|种|篇)|文档|资料|文件|知识库|请问|关于|内容|类型|标题', '', 'g')")}, 1, 20)) AS keyword,
        regexp_matches(question, '(文档|资料|文件|知识库).{{0,6}}(有哪些|有什么|清单|列出)|列出.{{0,8}}(所有|全部)|(所有|全部).{{0,4}}(文档|资料|文件)') AS strong
      FROM v_list_question WHERE regexp_matches(question, '有哪些|有什么|列出|列举|清单|全部|所有|多少(个|份|类|种|篇)|都有什么|包含哪些')
        AND NOT regexp_matches(question, '区别|不同|对比|差异|多久|多少天|多少年')),
    seen AS (SELECT w.query_id, w.keyword, w.strong, d.* FROM asked w, (SELECT id AS doc_id, upload_by AS owner_id, * FROM v_document WHERE status = 'completed') d
      WHERE {OPEN} OR {GRANTED.format(user='w.user_id')}),
    titled AS (SELECT * FROM seen WHERE keyword <> '' AND contains(lower(title), keyword)),
    listed AS (SELECT * FROM titled UNION ALL
      SELECT * FROM seen WHERE (keyword = '' OR strong) AND query_id NOT IN (SELECT query_id FROM titled)),
    listing AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank,
      concat('【文档标题】', title, '。', substring(replace({strip('content')}, chr(10), ' '), 1, 120)) AS content FROM listed)"""


@query("R13_listing_docs", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, content FROM listing WHERE rank <= 15", LISTING)
def _(i: Inputs):
    return retrieval.listing_docs(i.list_questions(), i.docs(), i.grants())


@query("R14_with_titles", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, title FROM v_cut JOIN (SELECT id AS doc_id, title FROM v_document) USING (doc_id)")
def _(i: Inputs):
    return retrieval.with_titles(i.cut(), i.docs()).select("query_id", "rank", "doc_id", "title")


@query(
    "R15_prepend_listing",
    """SELECT query_id, doc_id, listed, CAST(row_number() OVER (PARTITION BY query_id ORDER BY listed DESC, rank) AS INT) AS rank FROM (
      SELECT query_id, doc_id, rank, true AS listed FROM listing WHERE rank <= 15 UNION ALL
      SELECT query_id, doc_id, rank, false FROM v_cut WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM listing WHERE rank <= 15))""",
    LISTING,
)
def _(i: Inputs):
    listing = retrieval.listing_docs(i.list_questions(), i.docs(), i.grants())
    both = retrieval.prepend_listing(listing, i.cut().select("query_id", "rank", "doc_id"))
    return both.select("query_id", "doc_id", "listed", "rank")


RULE_WORDS = ["传唤的时限是多久", "几名民警到场", "听证需要多少钱", "当场处罚适用条件", "讯问时限", "Nothing of the kind"]
RULE_VARIANTS = [
    "继续盘问 12小时 24小时 48小时 传唤 询问查证 8小时", "一名以上人民警察 人数", "听证 四千元 个人罚款",
    "当场处罚 违法事实确凿 一名以上人民警察 五百元以下", "讯问 犯罪嫌疑人 12小时 24小时", None,
]


def _rule_questions(i: Inputs):
    """Each conversation turn with one of the worded questions in front."""
    words = F.array(*[F.lit(w) for w in RULE_WORDS])
    key = F.col("conv_id") * 1000 + F.col("turn")
    place = (key % len(RULE_WORDS)).cast("int")
    return i.table("conversations").select(
        key.alias("query_id"), F.concat(F.get(words, place), F.lit(" "), F.col("text")).alias("question"), "text"
    )


def _rule_sql(values: list) -> str:
    key = f"(conv_id * 1000 + turn) % {len(values)}"
    return f"CASE {key} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values) if v) + " END"


@query(
    "R16_expand_rules",
    f"""SELECT conv_id * 1000 + turn AS query_id, 0 AS variant, {_rule_sql(RULE_WORDS)} || ' ' || text AS text FROM conversations
    UNION ALL SELECT conv_id * 1000 + turn, 1, {_rule_sql(RULE_VARIANTS)} FROM conversations WHERE {_rule_sql(RULE_VARIANTS)} IS NOT NULL""",
)
def _(i: Inputs):
    return rewrite.expand_rules(_rule_questions(i))


@query(
    "R17_assemble_variants",
    f"""SELECT query_id, CAST(k - 1 AS INT) AS variant, variants[k] AS text FROM (
      SELECT conv_id * 1000 + turn AS query_id, list_concat([{_rule_sql(RULE_WORDS)} || ' ' || text, text, concat(text, '?')],
        CASE WHEN {_rule_sql(RULE_VARIANTS)} IS NULL THEN CAST([] AS VARCHAR[]) ELSE [{_rule_sql(RULE_VARIANTS)}] END) AS variants FROM conversations) t,
      LATERAL unnest(range(1, len(variants) + 1)) u(k)""",
)
def _(i: Inputs):
    reply = F.to_json(F.array("text", F.lit("  "), "question", F.concat("text", F.lit("?")), F.lit("one too many")))
    return rewrite.assemble_variants(_rule_questions(i).withColumn("reply", reply))


@query(
    "R18_substring_search",
    """SELECT query_id, doc_id, title, md5(substring(content, 1, 500)) AS digest, score FROM (
      SELECT query_id, d.id AS doc_id, title, content, CASE WHEN contains(lower(content), lower(b.question)) THEN 0.5e0 ELSE 0.3e0 END AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY contains(lower(content), lower(b.question)) DESC, d.id) AS place
      FROM v_document d, v_question b WHERE status = 'completed') WHERE place <= 5""",
)
def _(i: Inputs):
    hits = retrieval.substring_search(i.questions(), i.docs(i.documents()))
    return hits.select("query_id", "doc_id", "title", F.md5("content").alias("digest"), "score")


@query(
    "R19_hybrid_retrieve",
    """SELECT query_id, CAST(rank AS INT) AS rank, doc_id, title, chunk_index, md5(content) AS content, round(rerank_norm, 6) AS rerank_norm
    FROM v_hits JOIN (SELECT id AS doc_id, title FROM v_document) USING (doc_id)""",
)
def _(i: Inputs):
    hits = retrieval.hybrid_retrieve(i.questions(), i.corpus(), floor=FLOOR)
    return hits.select("query_id", "rank", "doc_id", "title", "chunk_index", F.md5("content").alias("content"), r6("rerank_norm"))


@query(
    "R20_retrieval_stats",
    """SELECT q.query_id, CAST(1 AS BIGINT) AS variants,
      (SELECT count(*) FROM v_dense_list d WHERE d.query_id = q.query_id) AS dense_count,
      (SELECT count(*) FROM v_bm25_list d WHERE d.query_id = q.query_id) AS sparse_count,
      (SELECT count(*) FROM v_fused_list d WHERE d.query_id = q.query_id) AS fused_count,
      (SELECT count(*) FROM v_rerank_list d WHERE d.query_id = q.query_id) AS rerank_count,
      (SELECT count(*) FROM listing d WHERE d.query_id = q.query_id AND rank <= 15) AS enum_docs,
      (SELECT CAST(coalesce(max(k_used), -1) AS INT) FROM v_cut_list d WHERE d.query_id = q.query_id) AS topk_used
    FROM v_list_question q""",
    LISTING,
)
def _(i: Inputs):
    """Every column of the same questions, those about lists."""
    questions = i.list_questions()
    variants = questions.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))
    found, sparse, merged = retrieval.candidates(variants, questions, i.corpus())
    reranked = retrieval.retrieve(questions, i.corpus())  # as ranked, before the floor
    cut = ranking.dynamic_topk(ranking.confidence_floor(reranked, FLOOR), 5)
    listing = retrieval.listing_docs(questions, i.docs(), i.grants())
    stats = retrieval.retrieval_stats(variants, found, sparse, merged, reranked, cut, listing)
    return stats.withColumn("topk_used", F.coalesce("topk_used", F.lit(-1)))


def _rewriter(texts):
    """A model that answers with two rewrites of the question, as JSON."""
    return texts.map(lambda q: json.dumps(["about " + q[:60], "on " + q[19:79]], ensure_ascii=False))


def _rewritten(i: Inputs):
    """Every other question asks for a list; all go through the rewriter, each wording once."""
    lists = i.list_questions().select("query_id", F.col("question").alias("listed"))
    asked = i.questions().join(lists, "query_id")
    questions = asked.withColumn("question", F.when(F.col("query_id") % 2 == 0, F.col("listed")).otherwise(F.col("question"))).drop("listed")
    return questions, stage(rewrite.rewritten(questions, _rewriter), "variants")


RW_LISTING = LISTING.replace("v_list_question", "v_rw_question")


@query(
    "R19_with_rewrites",
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY listed DESC, place) AS INT) AS rank, doc_id, title, listed, md5(content) AS content FROM (
      SELECT query_id, doc_id, rank AS place, true AS listed, content FROM listing WHERE rank <= 15
      UNION ALL SELECT query_id, doc_id, rank, false, content FROM v_hits_rw WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM listing WHERE rank <= 15))
    JOIN (SELECT id AS doc_id, title FROM v_document) USING (doc_id)""",
    RW_LISTING,
)
def _(i: Inputs):
    """Rewrites of a batch fanned into one search and merged; list questions in the same batch."""
    questions, variants = _rewritten(i)
    hits = retrieval.hybrid_retrieve(questions, i.corpus(), variants, floor=FLOOR)
    return hits.select("query_id", "rank", "doc_id", "title", "listed", F.md5("content").alias("content"))


@query(
    "R20_with_rewrites",
    """SELECT q.query_id, CAST(3 AS BIGINT) AS variants,
      (SELECT count(*) FROM v_dense_var d WHERE d.query_id // 10 = q.query_id) AS dense_count,
      (SELECT count(*) FROM v_bm25_var d WHERE d.query_id // 10 = q.query_id) AS sparse_count,
      (SELECT count(*) FROM v_fused_rw d WHERE d.query_id = q.query_id) AS fused_count,
      (SELECT count(*) FROM v_rerank_rw d WHERE d.query_id = q.query_id) AS rerank_count,
      (SELECT count(*) FROM listing d WHERE d.query_id = q.query_id AND rank <= 15) AS enum_docs,
      (SELECT CAST(coalesce(max(k_used), -1) AS INT) FROM v_cut_rw d WHERE d.query_id = q.query_id) AS topk_used
    FROM v_rw_question q""",
    RW_LISTING,
)
def _(i: Inputs):
    questions, variants = _rewritten(i)
    found, sparse, merged = (stage(part, "candidates") for part in retrieval.candidates(variants, questions, i.corpus()))
    head = retrieval.with_text(merged.filter(F.col("rank") <= ranking.FUSION_TOP), questions, i.chunks())
    reranked = stage(ranking.rerank(head), "reranked")
    cut = ranking.dynamic_topk(ranking.confidence_floor(reranked, FLOOR), 5)
    listing = retrieval.listing_docs(questions, i.docs(), i.grants())
    stats = retrieval.retrieval_stats(variants, found, sparse, merged, reranked, cut, listing)
    return stats.withColumn("topk_used", F.coalesce("topk_used", F.lit(-1)))


@query(
    "R21_source_docs",
    """SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS doc_ids FROM (SELECT query_id, doc_id, min(rank) AS rank FROM v_cut GROUP BY ALL) GROUP BY query_id""",
)
def _(i: Inputs):
    return retrieval.source_docs(i.cut()).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(
    "R22_extractive_answer",
    """SELECT q.query_id, CASE WHEN body IS NULL THEN '抱歉，知识库中暂时没有找到相关信息。' ELSE
      concat('根据检索到的相关文档，我为您找到以下信息：', chr(10), chr(10), substring(body, 1, 500), '...', chr(10), chr(10), '如果您需要了解更多详情，请提出更具体的问题。') END AS answer
    FROM v_question q LEFT JOIN (SELECT query_id, string_agg(substring(content, 1, 300), chr(10) ORDER BY rank) AS body FROM v_hits GROUP BY query_id) USING (query_id)""",
)
def _(i: Inputs):
    return retrieval.extractive_answer(i.questions(), retrieval.expand_parents(i.cut(), i.parents()))


@query(
    "R23_generate",
    """SELECT q.query_id, md5(concat('基于以下文档内容回答用户问题。如果文档中没有相关信息，请说明不知道。', chr(10), chr(10),
      '对话历史（供理解当前问题的指代与语境，不要直接复述）:', chr(10), '无', chr(10), chr(10), '文档内容:', chr(10), coalesce(context, ''),
      chr(10), chr(10), '用户问题: ', question, chr(10), chr(10), '请根据文档内容给出回答：')) AS answer
    FROM v_question q LEFT JOIN (
      SELECT query_id, string_agg(concat('文档', place, ':', chr(10), content), chr(10) || chr(10) ORDER BY place) AS context
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM v_hits) GROUP BY query_id) c USING (query_id)""",
)
def _(i: Inputs):
    """A model whose reply tells every character of its prompt."""
    prompts = retrieval.build_prompt(i.questions(), retrieval.expand_parents(i.cut(), i.parents()))
    answers = models.generate(prompts, lambda texts: texts.map(lambda text: hashlib.md5(text.encode()).hexdigest()))
    return answers.select("query_id", "answer")


@query(
    "R24_request_memo",
    """SELECT event_id, CAST(length(question) AS INT) AS answer_chars, (SELECT count(DISTINCT question || '|' || user_id % 2) FROM v_log) AS calls FROM v_log""",
)
def _(i: Inputs):
    log = i.query_log().withColumn("dialogue", (F.col("user_id") % 2).cast("string"))
    log = log.withColumn("question", F.regexp_replace(F.translate("question", "?", "？"), " +", " "))
    key = [F.col("question"), F.col("dialogue")]
    answered = models.once_per_key(log, key, lambda d: d.withColumn("answer_chars", F.length("question")), ["answer_chars"])
    calls = log.select(*key).distinct().agg(F.count("*")).scalar()
    return answered.select("event_id", "answer_chars", calls.alias("calls"))


@query(
    "R25_bm25_only",
    "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, round(rerank_norm, 6) AS rerank_norm FROM v_rerank_bm25",
)
def _(i: Inputs):
    return retrieval.retrieve(i.questions(), i.corpus(), "bm25").select("query_id", "rank", "doc_id", "chunk_index", r6("rerank_norm"))


@query("R25_no_rerank", "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_index, round(score, 6) AS score FROM v_fused WHERE rank <= 8")
def _(i: Inputs):
    return retrieval.retrieve(i.questions(), i.corpus(), "no_rerank").select("query_id", "rank", "doc_id", "chunk_index", r6("score"))
