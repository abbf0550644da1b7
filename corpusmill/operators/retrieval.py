"""Hybrid retrieval for a batch of questions, and what is made of its hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import dialogue_text, let, strip
from corpusmill.operators.access import CONTEXT, attach_grants, first_visible, visible_columns
from corpusmill.operators.dense import dense_search
from corpusmill.operators.fusion import KEY, merge_variants, rrf
from corpusmill.operators.lexical import LexicalIndex, bm25_search
from corpusmill.operators.models import embed_queries
from corpusmill.operators.ranking import FUSION_TOP, MIN_NORM, RERANK_TOP, confidence_floor, dynamic_topk, overlap_logit, rerank
from corpusmill.operators.scale import BROADCAST_ROWS, at_most, ranked, row_bound, small_side, stage
from corpusmill.operators.substrings import holders

LIST_MAX = 15

# Wording of questions that ask for a list of documents.
LIST_INTENT = r"有哪些|有什么|列出|列举|清单|全部|所有|多少(个|份|类|种|篇)|都有什么|包含哪些"
LIST_VETO = r"区别|不同|对比|差异|多久|多少天|多少年"
LIST_NOISE = (
    r"有哪些|有什么|列出|列举|清单|请|帮我|帮|都|什么|多少(个|份|类|种|篇)"
    r"|文档|资料|文件|知识库|请问|关于|内容|类型|标题"
)
LIST_STRONG = (
    r"(文档|资料|文件|知识库).{0,6}(有哪些|有什么|清单|列出)|列出.{0,8}(所有|全部)|(所有|全部).{0,4}(文档|资料|文件)"
)

# Answer texts.
NO_ANSWER = "抱歉，知识库中暂时没有找到相关信息。"
ANSWER_HEAD = "根据检索到的相关文档，我为您找到以下信息：\n\n"
ANSWER_TAIL = "...\n\n如果您需要了解更多详情，请提出更具体的问题。"
PROMPT = (
    "基于以下文档内容回答用户问题。如果文档中没有相关信息，请说明不知道。\n\n"
    "对话历史（供理解当前问题的指代与语境，不要直接复述）:\n{history}\n\n"
    "文档内容:\n{context}\n\n用户问题: {question}\n\n请根据文档内容给出回答："
)


@dataclass
class Corpus:
    """What retrieval reads: chunks, parents, documents (keyed by id), both indexes, grants.

    ``vectors`` are keyed like chunks and carry parent_id and the permission columns.
    """

    chunks: DataFrame
    parents: DataFrame
    docs: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame
    acl: DataFrame


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcasts by a bound the caller has proven, else after counting."""
    return small_side(df) if rows is None else at_most(df, rows)


def expand_parents(hits: DataFrame, parents: DataFrame, rows: int | None = None) -> DataFrame:
    """``content`` is the parent window, ``child_content`` the chunk; a lost parent leaves the chunk.

    ``rows`` is a known bound on the number of hits.
    """
    windows = parents.select("parent_id", F.col("text").alias("_window"))
    return (
        windows.join(_small(hits, rows), "parent_id", "right")
        .withColumn("content", F.coalesce("_window", "text"))
        .withColumn("child_content", F.col("text"))
        .drop("_window", "text")
    )


def list_keyword(question: Column) -> Column:
    return F.substring(strip(F.regexp_replace(question, LIST_NOISE, "")), 1, 20)


def _grams(text: Column) -> Column:
    """All pieces of one to three characters of a short text."""

    def pieces(whole: Column, size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)))
        return F.transform(places, lambda i: F.substring(whole, i, F.lit(size)))

    return let(text, lambda whole: F.array_distinct(F.concat(*[pieces(whole, size) for size in (1, 2, 3)])))


def listing_docs(queries: DataFrame, docs: DataFrame, acl: DataFrame, requested: int = 5, max_docs: int = LIST_MAX) -> DataFrame:
    """Documents for questions that ask for a list: (query_id, rank, doc_id, content).

    Completed visible documents whose title holds what is left of the question,
    newest first; nothing left means all. If no title matches, a strongly worded
    question lists all, any other none. Titles meet keywords through an equi-join
    on the keyword's first characters, and each task keeps its newest documents
    per query before anything is shuffled.
    """
    limit = max(max_docs, requested or 5)
    asked = (
        queries.filter(F.col("question").rlike(LIST_INTENT) & ~F.col("question").rlike(LIST_VETO))
        .withColumn("keyword", F.lower(list_keyword(F.col("question"))))
        .withColumn("strong", F.col("question").rlike(LIST_STRONG))
    )
    done = docs.filter(F.col("status") == "completed").select(
        F.col("id").alias("doc_id"), "title", F.col("upload_by").alias("owner_id"), "tenant_id", "doc_level", "min_level"
    )
    keyed = asked.filter("keyword != ''").withColumn("gram", F.substring("keyword", 1, 3))
    titled = (
        attach_grants(done, acl, queries)
        .withColumn("gram", F.explode(_grams(F.lower("title"))))
        .join(small_side(keyed), "gram")
        .filter(F.contains(F.lower("title"), F.col("keyword")) & visible_columns())
    )
    by_title = ranked(titled, ["query_id"], [F.desc("doc_id")], limit).select("query_id", "rank", "doc_id")
    # A few rows per question, read twice below; the titles are read once.
    by_title = stage(by_title, "listed-by-title")
    missed = asked.join(by_title.select("query_id").distinct(), "query_id", "left_anti")
    # Questions that list everything differ only in their caller: one list per caller.
    open_ended = missed.filter((F.col("keyword") == "") | F.col("strong"))
    callers = asked.select(*CONTEXT).distinct()
    per_caller = first_visible(done, callers, acl, ["doc_id"], [F.desc("doc_id")], limit)
    everything = per_caller.join(open_ended.select("query_id", "user_id"), "user_id").select("query_id", "rank", "doc_id")
    found = by_title.unionByName(everything)
    n = row_bound(asked)
    texts = docs.select(F.col("id").alias("doc_id"), "title", "content")
    snippet = F.substring(F.replace(strip(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 120)
    return texts.join(at_most(found, None if n is None else n * limit), "doc_id").select(
        "query_id", "rank", "doc_id", F.concat(F.lit("【文档标题】"), "title", F.lit("。"), snippet).alias("content")
    )


def prepend_listing(listing: DataFrame, hits: DataFrame) -> DataFrame:
    """Listed documents first, then the hits on other documents."""
    rest = hits.join(listing.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    both = listing.withColumn("listed", F.lit(True)).unionByName(
        rest.withColumn("listed", F.lit(False)), allowMissingColumns=True
    )
    order = [F.desc("listed"), F.col("rank")]
    return ranked(both, ["query_id"], order, name="_rank").withColumn("rank", F.col("_rank")).drop("_rank")


def with_titles(results: DataFrame, docs: DataFrame, rows: int | None = None) -> DataFrame:
    titles = docs.select(F.col("id").alias("doc_id"), "title")
    return titles.join(_small(results, rows), "doc_id", "right")


def substring_search(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Fallback without an index: documents that hold the question score 0.5, others 0.3.

    Documents are read twice whatever the number of questions (``substrings.holders``), and no
    task returns more than ``k`` of them for a question. Others fill up its
    list in id order, and the first 2k documents are enough for that: a question
    with fewer than k matches has fewer than k among them. A question without words is held by all.
    """
    done = docs.filter(F.col("status") == "completed").select(F.col("id").alias("doc_id"), "title", "content")
    n = row_bound(queries)
    texts = done.select("doc_id", F.lower(F.coalesce("content", F.lit(""))).alias("text"))
    held = holders(queries.select("query_id", F.lower("question").alias("needle")), texts, k)
    hits = ranked(held, ["query_id"], [F.col("doc_id")], k).select("query_id", "doc_id", F.lit(0.5).alias("score"))
    first = done.select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.collect_list("doc_id").alias("ids")).scalar()
    fill = queries.select("query_id", F.explode(first).alias("doc_id")).withColumn("score", F.lit(0.3))
    both = hits.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    top = ranked(both, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
    shown = done.select("doc_id", "title", F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("content"))
    return shown.join(at_most(top, None if n is None else n * k), "doc_id")


def candidates(
    variants: DataFrame, queries: DataFrame, corpus: Corpus, k: int = 20, max_distance: float = 1.5, instruction: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dense, sparse, merged) lists for (query_id, variant, text) rows.

    Every variant of every question is searched in the same two passes.
    """
    context = queries.select("query_id", *CONTEXT)
    # One name for a variant of a question, taken apart again after the searches.
    name = F.concat_ws("|", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("query_id")
    asked = variants.join(context, "query_id").select(name, F.col("text").alias("question"), *CONTEXT)
    kind = queries.schema["query_id"].dataType
    parts = F.split("query_id", r"\|(?=\d+$)")
    split = [parts[0].cast(kind).alias("query_id"), parts[1].cast("int").alias("variant")]
    sparse = bm25_search(asked, corpus.lexical, corpus.acl, k).select(*split, "rank", "score", *KEY)
    found = dense_search(embed_queries(asked, instruction), corpus.vectors, corpus.acl, k, max_distance, carry=["parent_id"])
    dense = found.select(*split, "rank", F.col("distance").alias("score"), *KEY)
    fused = rrf(dense, sparse, by=["query_id", "variant"])
    return dense, sparse, merge_variants(fused)


def with_text(hits: DataFrame, queries: DataFrame, chunks: DataFrame, rows: int | None = None) -> DataFrame:
    """Adds the chunk's text and the question to a small list of hits."""
    texts = chunks.select("doc_id", "chunk_index", "text")
    found = texts.join(_small(hits, rows), ["doc_id", "chunk_index"])
    return found.join(queries.select("query_id", "question"), "query_id")


def _rows_per_query(queries: DataFrame, k: int) -> int:
    """Bound on a list of k hits per query; beyond any broadcast if the batch itself is."""
    n = row_bound(queries)
    return (BROADCAST_ROWS + 1 if n is None else n) * k


def retrieve(
    queries: DataFrame, corpus: Corpus, mode: str = "hybrid", scorer=overlap_logit, k: int = 20
) -> DataFrame:
    """Ranked hits for evaluation, without rewriting, floor or dynamic cut.

    ``hybrid`` fuses and reranks, ``bm25`` reranks the lexical list, ``no_rerank``
    returns the head of the fused list.
    """
    if mode not in {"hybrid", "bm25", "no_rerank"}:
        raise ValueError(f"unknown mode {mode}")
    if mode == "bm25":
        merged = bm25_search(queries, corpus.lexical, corpus.acl, k)
    else:
        variants = queries.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))
        merged = candidates(variants, queries, corpus, k)[2]
    top = RERANK_TOP if mode == "no_rerank" else FUSION_TOP
    hits = with_text(merged.filter(F.col("rank") <= top), queries, corpus.chunks, _rows_per_query(queries, top))
    return hits if mode == "no_rerank" else rerank(hits, scorer)


def hybrid_retrieve(
    queries: DataFrame,
    corpus: Corpus,
    variants: DataFrame | None = None,
    requested: int = 5,
    scorer=overlap_logit,
    listing: bool = True,
    floor: float = MIN_NORM,
) -> DataFrame:
    """Questions with their caller's context to ranked parent windows with titles."""
    if variants is None:
        variants = queries.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))
    merged = candidates(variants, queries, corpus)[2]
    head = merged.filter(F.col("rank") <= FUSION_TOP)
    hits = rerank(with_text(head, queries, corpus.chunks, _rows_per_query(queries, FUSION_TOP)), scorer)
    cut = dynamic_topk(confidence_floor(hits, floor), requested)
    # A few hits per query, read by several branches below: fixed once.
    cut = stage(cut.drop("question"), "hits")
    results = expand_parents(cut, corpus.parents)
    if listing:
        listed = stage(listing_docs(queries, corpus.docs, corpus.acl, requested), "listing")
        marked = listed.withColumn("child_content", F.col("content")).withColumns(
            {"rerank_score": F.lit(999.0), "rerank_norm": F.lit(1.0)}
        )
        results = prepend_listing(marked, results)
    return with_titles(results, corpus.docs)


def retrieval_stats(
    variants: DataFrame, dense: DataFrame, sparse: DataFrame, merged: DataFrame, reranked: DataFrame, cut: DataFrame, listing: DataFrame
) -> DataFrame:
    """Per query: variants searched, sizes of each stage's list, and the k that was used."""
    steps = {
        "variants": variants,
        "dense_count": dense,
        "sparse_count": sparse,
        "fused_count": merged,
        "rerank_count": reranked,
        "enum_docs": listing,
    }
    counts = None
    for name, step in steps.items():
        part = step.groupBy("query_id").agg(F.count("*").alias(name))
        counts = part if counts is None else counts.join(part, "query_id", "left")
    used = cut.groupBy("query_id").agg(F.max("k_used").alias("topk_used"))
    return counts.join(used, "query_id", "left").fillna(0, list(steps))


def source_docs(results: DataFrame) -> DataFrame:
    """Distinct documents of each query in the order of their first hit."""
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda d: d["doc_id"]).alias("doc_ids"))


def _by_rank(results: DataFrame, part: Column, extra: list[Column] | None = None) -> DataFrame:
    """Per query, ``part`` of its few results as an array in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return results.groupBy("query_id").agg(F.transform(ordered, lambda p: p["part"]).alias("parts"), *(extra or []))


def context_text(results: DataFrame) -> DataFrame:
    """Contents of each query's hits, numbered and joined by blank lines."""
    parts = _by_rank(results, F.coalesce("content", F.lit("")))
    numbered = F.transform("parts", lambda text, i: F.concat(F.lit("文档"), (i + 1).cast("string"), F.lit(":\n"), text))
    return parts.select("query_id", F.array_join(numbered, "\n\n").alias("context"))


def build_prompt(queries: DataFrame, results: DataFrame, template: str = PROMPT) -> DataFrame:
    """The model's prompt per query; ``queries`` may carry ``turns`` of the conversation."""
    turns = F.col("turns") if "turns" in queries.columns else F.lit(None).cast("array<struct<question:string,answer:string>>")
    filled = F.lit(template)
    # Fields are cut out of the template first, so braces inside a text stay as they are.
    order = sorted(["history", "context", "question"], key=lambda f: template.index("{%s}" % f))
    rest, pieces = template, []
    for field in order:
        before, rest = rest.split("{%s}" % field, 1)
        pieces += [F.lit(before), {"history": dialogue_text(turns), "context": F.coalesce("context", F.lit("")), "question": F.col("question")}[field]]
    filled = F.concat(*pieces, F.lit(rest))
    return queries.join(context_text(results), "query_id", "left").select("query_id", filled.alias("prompt"))


def extractive_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Answer without a model: heads of the hits in a fixed frame, or an apology."""
    heads = _by_rank(results, F.substring(F.coalesce("content", F.lit("")), 1, 300))
    body = F.substring(F.array_join("parts", "\n"), 1, 500)
    answer = F.when(F.col("parts").isNull(), F.lit(NO_ANSWER)).otherwise(
        F.concat(F.lit(ANSWER_HEAD), body, F.lit(ANSWER_TAIL))
    )
    return queries.select("query_id").join(heads, "query_id", "left").select("query_id", answer.alias("answer"))
