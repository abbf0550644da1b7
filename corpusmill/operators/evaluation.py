"""Quality of retrieval and of answers against labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import json_ids, normalize_cjk, split_facts, strip
from corpusmill.functions.vectors import cosine
from corpusmill.operators.models import BatchModel, embed
from corpusmill.operators.scale import ranked, small_side

SEMANTIC_COVER = 0.82
GRID_K = (3, 5, 8)
VERDICT = "struct<total:double>"


def ranked_docs(results: DataFrame, k: int = 5) -> DataFrame:
    """Distinct documents per query in order of their first hit, cut at ``k``."""
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return ranked(first, ["query_id"], [F.col("first")], k, "place").drop("first")


def eval_questions(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """Per labelled question: recall, reciprocal rank and hit over its first ``k`` documents.

    ``golden`` has one row per (query_id, relevant doc_id).
    """
    relevant = golden.select("query_id", "doc_id").distinct()
    found = ranked_docs(results, k)
    return (
        relevant.join(found, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(
            (F.count("place") / F.count("*")).alias("recall"),
            F.coalesce(1.0 / F.min("place"), F.lit(0.0)).alias("mrr"),
            F.when(F.count("place") > 0, 1).otherwise(0).alias("hit"),
        )
    )


def eval_summary(per_question: DataFrame) -> DataFrame:
    return per_question.agg(
        F.count("*").alias("n"),
        F.avg("recall").alias("recall"),
        F.avg("mrr").alias("mrr"),
        F.avg("hit").alias("hit_rate"),
    )


def keyword_hit(results: DataFrame, keywords: DataFrame) -> DataFrame:
    """Share of each question's ``must_contain`` found in all its retrieved texts; null without keywords."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    blobs = results.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("blob"))
    found = F.size(F.filter("must_contain", lambda kw: F.contains(F.coalesce("blob", F.lit("")), kw)))
    return (
        keywords.join(blobs, "query_id", "left")
        .withColumn("kw_total", F.size("must_contain"))
        .withColumn("kw_found", found)
        .select("query_id", "kw_found", "kw_total", F.try_divide("kw_found", "kw_total").alias("kw_hit"))
    )


def worst_cases(per_question: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` lowest by keyword hit (null counts as 1), then by rank; perfect ones are dropped afterwards."""
    lowest = per_question.orderBy(F.coalesce("kw_hit", F.lit(1.0)), "mrr", "query_id").limit(n)
    return lowest.filter(~((F.coalesce("kw_hit", F.lit(1.0)) == 1.0) & (F.col("mrr") == 1.0)))


def compare_modes(results: dict[str, DataFrame], golden: DataFrame, k: int = 5) -> DataFrame:
    """The summary of each retrieval mode on the same questions."""
    out = None
    for mode, hits in results.items():
        row = eval_summary(eval_questions(hits, golden, k)).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _grid(results: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits copied to each (k, parent on/off) they belong to, with the text that setting shows."""
    windows = parents.select("parent_id", F.col("text").alias("window"))
    # A few hits per question go to the parents, never the other way.
    hits = windows.join(small_side(results), "parent_id", "right")
    settings = [
        F.struct(F.lit(k).alias("k"), F.lit(on).alias("parent")) for k in GRID_K for on in ("on", "off")
    ]
    return (
        hits.withColumn("setting", F.explode(F.array(*settings)))
        .filter(F.col("rank") <= F.col("setting.k"))
        .select(
            "query_id", "doc_id", "rank", "setting.k", "setting.parent",
            F.when(F.col("setting.parent") == "on", F.coalesce("window", "text")).otherwise(F.col("text")).alias("shown"),
        )
    )


def ablate_context(
    results: DataFrame,
    parents: DataFrame,
    golden: DataFrame,
    answers: DataFrame,
    semantic: bool = False,
    model: BatchModel | None = None,
) -> DataFrame:
    """Per (k, parent): share of answer facts the context covers, share of questions with a relevant document.

    A fact is covered if the context holds it or, with ``semantic``, if their
    vectors are close. ``answers`` is (query_id, answer); questions without facts
    are left out.
    """
    facts = answers.select("query_id", split_facts(F.col("answer")).alias("facts")).filter(F.size("facts") > 0)
    grid = _grid(results, parents).join(facts.select("query_id"), "query_id", "left_semi")
    relevant = golden.select("query_id", "doc_id").distinct().withColumn("relevant", F.lit(True))
    ordered = F.array_sort(F.collect_list(F.when(F.length("shown") > 0, F.struct("rank", "shown"))))
    shown = (
        grid.join(relevant, ["query_id", "doc_id"], "left")
        .groupBy("query_id", "k", "parent")
        .agg(
            normalize_cjk(F.array_join(F.transform(ordered, lambda r: r["shown"]), "\n\n")).alias("context"),
            F.max(F.coalesce("relevant", F.lit(False))).alias("doc_hit"),
        )
    )
    # A question without hits still counts its facts in every setting.
    settings = [F.struct(F.lit(k).alias("k"), F.lit(on).alias("parent")) for k in GRID_K for on in ("on", "off")]
    asked = facts.withColumn("s", F.explode(F.array(*settings))).select("query_id", "facts", "s.*")
    rows = asked.join(shown, ["query_id", "k", "parent"], "left")
    if semantic:
        fact_vectors = embed(facts.select(F.explode("facts").alias("fact")).distinct(), "fact", model)
        contexts = embed(rows.withColumn("context", F.coalesce("context", F.lit(""))), "context", model)
        near = (
            contexts.select("query_id", "k", "parent", "embedding", F.explode("facts").alias("fact"))
            .join(fact_vectors.withColumnRenamed("embedding", "fact_vector"), "fact")
            .withColumn("near", (cosine(F.col("fact_vector"), F.col("embedding")) >= SEMANTIC_COVER).cast("int"))
        )
        covered = near.groupBy("query_id", "k", "parent").agg(F.sum("near").alias("covered"))
        rows = rows.join(covered, ["query_id", "k", "parent"])
    else:
        rows = rows.withColumn(
            "covered", F.size(F.filter("facts", lambda fact: F.contains(F.coalesce("context", F.lit("")), fact)))
        )
    return rows.groupBy("k", "parent").agg(
        (F.sum("covered") / F.sum(F.size("facts"))).alias("fact_coverage"),
        F.avg(F.coalesce("doc_hit", F.lit(False)).cast("int")).alias("doc_recall"),
        F.sum(F.size("facts")).alias("facts"),
    )


def best_config(report: DataFrame) -> DataFrame:
    """The setting with the greatest coverage, then document recall; ties by k, then parent on."""
    return report.orderBy(F.desc("fact_coverage"), F.desc("doc_recall"), "k", F.desc("parent")).limit(1)


def judge_summary(scores: DataFrame) -> DataFrame:
    """Judged answers and mean score per model, in all and per question type; 0 and null are not judged."""
    judged = scores.filter(F.coalesce("total", F.lit(0)) != 0)
    typed = judged.withColumn("scope", F.explode(F.array(F.lit("all"), "type")))
    return typed.groupBy("model", "scope").agg(
        F.count("*").alias("judged"), F.round(F.avg("total"), 2).alias("mean_total")
    )


def paired_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses, ties and mean difference over (qid, rep) pairs; null counts as 0."""
    left = a.select("qid", "rep", F.coalesce("total", F.lit(0)).alias("a"))
    right = b.select("qid", "rep", F.coalesce("total", F.lit(0)).alias("b"))
    delta = F.col("a") - F.col("b")
    return left.join(right, ["qid", "rep"]).agg(
        F.count_if(delta > 0).alias("wins"),
        F.count_if(delta < 0).alias("losses"),
        F.count_if(delta == 0).alias("ties"),
        F.round(F.avg(delta), 4).alias("mean_delta"),
    )


def randomize_pairs(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Puts each (qid, rep) pair of answers in an order that depends on the seed and the pair only."""
    swap = F.pmod(F.xxhash64(F.lit(seed), "qid", "rep"), F.lit(2)) == 1
    return pairs.select(
        "qid", "rep", swap.alias("swapped"),
        F.when(swap, F.col("answer_b")).otherwise(F.col("answer_a")).alias("first"),
        F.when(swap, F.col("answer_a")).otherwise(F.col("answer_b")).alias("second"),
    )


def run_matrix(bank: DataFrame, repeats: int, models: list[str], types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Every question of the bank (id, type, q) for every repeat and model."""
    chosen = bank if not types else bank.filter(F.col("type").isin(types))
    if limit:
        chosen = chosen.orderBy("id").limit(limit)
    runs = chosen.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return runs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def golden_candidates(history: DataFrame, selected: DataFrame, golden: DataFrame) -> DataFrame:
    """Outcome per selected answer: ``added`` with its document ids, ``duplicate`` or ``no_document``.

    Answers come in id order. A question that is blank, known or already added
    is a duplicate; one whose answer cites no document is not added.
    """
    rows = history.join(selected.select("id").distinct(), "id", "left_semi").select(
        "id", strip(F.coalesce("question", F.lit(""))).alias("question"), json_ids(F.col("documents")).alias("key_id")
    )
    known = golden.select(strip(F.col("question")).alias("question")).distinct().withColumn("known", F.lit(True))
    marked = rows.join(known, "question", "left")
    fresh = marked.filter(F.col("known").isNull() & (F.col("question") != "") & (F.size("key_id") > 0))
    first = fresh.groupBy("question").agg(F.min("id").alias("added_id"))
    outcome = (
        F.when((F.col("question") == "") | F.col("known") | F.coalesce(F.col("added_id") < F.col("id"), F.lit(False)), "duplicate")
        .when(F.size("key_id") == 0, "no_document")
        .otherwise("added")
    )
    return marked.join(first, "question", "left").select("id", "question", "key_id", outcome.alias("outcome"))


def golden_candidate_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


