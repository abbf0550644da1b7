import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dense, fusion, lexical, models, ranking, retrieval, rewrite
from corpusmill.plans.inputs import Inputs

RANKED = "query_id long, doc_id long, parent_id string, chunk_index int, rank int, score double"


def ranked(spark, docs, query=1):
    return spark.createDataFrame([(query, d, f"p{d}", 0, n + 1, 0.5) for n, d in enumerate(docs)], RANKED)


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_rrf_sums_ranks_of_both_lists(spark):
    out = fusion.rrf(ranked(spark, [1, 2, 3]), ranked(spark, [3, 1, 4])).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 3, 2, 4]
    assert out[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert out[2].sparse_score is None and out[3].dense_score is None


def test_rrf_ties_keep_dense_then_sparse_order(spark):
    assert order(fusion.rrf(ranked(spark, [5, 6]), ranked(spark, [7, 8]))) == [5, 7, 6, 8]


def test_rrf_empty_sides_weights_and_k(spark):
    none = ranked(spark, [1]).limit(0)
    assert order(fusion.rrf(ranked(spark, [4, 2]), none)) == [4, 2]
    assert order(fusion.rrf(none, ranked(spark, [4, 2]))) == [4, 2]
    assert fusion.rrf(none, none).count() == 0
    assert order(fusion.rrf(ranked(spark, [1, 2]), ranked(spark, [2, 1]), w_sparse=3.0)) == [2, 1]
    assert fusion.rrf(ranked(spark, [1]), none, k=0).first().score == 1.0
    with pytest.raises(ValueError):
        fusion.rrf(none, none, k=-1)


def test_merge_variants_adds_scores_and_keeps_first_payload(spark):
    rows = [(1, 0, 1, 10, "a", 0, 0.3, "first"), (1, 1, 1, 20, "b", 0, 0.4, "x"), (1, 1, 2, 10, "a", 0, 0.2, "second")]
    frame = spark.createDataFrame(rows, "query_id long, variant int, rank int, doc_id long, parent_id string, chunk_index int, score double, text string")
    out = fusion.merge_variants(frame).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6), r.text) for r in out] == [(10, 0.5, "first"), (20, 0.4, "x")]


def test_rules(spark):
    asked = spark.createDataFrame([(1, "传唤的时限是多久"), (2, "几名民警到场"), (3, "Where is it")], "query_id long, question string")
    out = rewrite.expand_rules(asked).orderBy("query_id", "variant").collect()
    assert [(r.query_id, r.variant) for r in out] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert out[3].text == "一名以上人民警察 人数"


def test_variants_keep_original_first_and_cap(spark):
    asked = spark.createDataFrame([(1, "q", '["q", "a", " ", "a", "b"]'), (2, "q", None)], "query_id long, question string, reply string")
    out = rewrite.assemble_variants(asked).orderBy("query_id", "variant").collect()
    assert [(r.query_id, r.text) for r in out] == [(1, "q"), (1, "a"), (1, "a"), (2, "q")]
    off = rewrite.assemble_variants(asked, enabled=False)
    assert off.count() == 2


def test_model_is_called_once_per_key_and_in_small_batches(spark):
    frame = spark.createDataFrame([(n, f"q{n % 3}") for n in range(30)], "id long, question string")
    seen = []
    out = models.once_per_key(frame, [F.col("question")], lambda d: seen.append(d.count()) or d.withColumn("r", F.length("question")), ["r"])
    assert seen == [3] and out.count() == 30

    def fragile(texts):
        if len(texts) > 4:
            raise RuntimeError("too many")
        return texts.str.upper()

    replies = models.generate(frame.select("id", F.col("question").alias("prompt")), fragile)
    assert {r.answer for r in replies.collect()} == {"Q0", "Q1", "Q2"}


def hits(spark, norms, query=1):
    rows = [(query, n + 1, v, None) for n, v in enumerate(norms)]
    return spark.createDataFrame(rows, "query_id long, rank int, rerank_norm double, dense_score double")


@pytest.mark.parametrize(
    "norms, kept",
    [([0.95, 0.6, 0.5, 0.5, 0.5, 0.5], 3), ([0.9] * 8, 5), ([0.5, 0.4, 0.3, 0.2], 3), ([0.7, 0.65, 0.6, 0.55, 0.5, 0.5], 5), ([0.9], 1)],
)
def test_dynamic_topk(spark, norms, kept):
    assert ranking.dynamic_topk(hits(spark, norms), 5).count() == kept


def test_dynamic_topk_without_request(spark):
    assert ranking.dynamic_topk(hits(spark, [0.9] * 8), None).count() == 8


def test_floor(spark):
    assert ranking.confidence_floor(hits(spark, [0.9, 0.5, 0.4])).count() == 2
    assert [r["rank"] for r in ranking.confidence_floor(hits(spark, [0.4, 0.3])).collect()] == [1]
    assert [r["rank"] for r in ranking.confidence_floor(hits(spark, [None, None])).collect()] == [1]


def brute(queries, vectors, k, limit):
    out = {}
    for q, v in queries.items():
        near = sorted((round(float(((v - w) ** 2).sum()), 9), n) for n, w in vectors.items())
        out[q] = [n for d, n in near if d <= limit][:k]
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_block": 4, "vector_block": 16}])
def test_nearest_is_exact_in_both_plans(spark, blocks):
    rng = np.random.default_rng(7)
    vectors = {n: rng.normal(size=6).astype(np.float32) for n in range(80)}
    vectors |= {100 + n: vectors[3] for n in range(30)}  # many copies of one vector
    queries = {n: (vectors[n] + 0.01 * rng.normal(size=6)).astype(np.float32) for n in range(10)}
    left = spark.createDataFrame([(q, v.tolist()) for q, v in queries.items()], "query_id long, embedding array<float>")
    right = spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()], "vec_id long, embedding array<float>").repartition(3)
    out = dense.dense_search(left, right, k=5, max_distance=4.0, keys=["vec_id"], **blocks).orderBy("query_id", "rank").collect()
    found = {q: [r.vec_id for r in out if r.query_id == q] for q in queries}
    assert found == brute(queries, vectors, 5, 4.0)


def test_both_plans_respect_rights(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    one = dense.dense_search(i.vector_queries(), i.vectors(), i.grants(), keys=["vec_id"])
    grid = dense.dense_search(i.vector_queries(), i.vectors(), i.grants(), keys=["vec_id"], query_block=90, vector_block=70)
    assert sorted(map(str, one.collect())) == sorted(map(str, grid.collect()))


def test_bm25_plans_agree(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    def rows(**options):
        found = lexical.bm25_search(i.questions(), i.lexical(), i.grants(), **options)
        return sorted(str(r) for r in found.withColumn("score", F.round("score", 6)).collect())
    assert rows() == rows(max_broadcast=1)


def test_bm25_prefers_rare_words_and_floors_common_ones(spark):
    rng = random.Random(1)
    texts = ["common " + " ".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20)] + ["common rare"]
    chunks = spark.createDataFrame([(n, 0, f"p{n}", t) for n, t in enumerate(texts)], "doc_id long, chunk_index int, parent_id string, text string")
    index = lexical.build_lexical_index(chunks)
    mean = index.stats.first().mean_idf
    assert index.terms.filter("term = 'common'").first().idf == pytest.approx(0.25 * mean)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, question string")
    top = lexical.bm25_search(asked, index, k=3).orderBy("rank").collect()
    assert top[0].doc_id == 20 and len(top) == 3


def test_prompt_keeps_braces_of_texts(spark):
    asked = spark.createDataFrame([(1, "what is {context}?"), (2, "none")], "query_id long, question string")
    found = spark.createDataFrame([(1, 2, "second {question}"), (1, 1, "first")], "query_id long, rank int, content string")
    prompts = {r.query_id: r.prompt for r in retrieval.build_prompt(asked, found).collect()}
    assert "文档1:\nfirst\n\n文档2:\nsecond {question}\n\n用户问题: what is {context}?" in prompts[1]
    answers = {r.query_id: r.answer for r in retrieval.extractive_answer(asked, found).collect()}
    assert answers[2] == retrieval.NO_ANSWER and "first\nsecond" in answers[1]


def test_retrieve_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        retrieval.retrieve(None, None, "nope")


def test_words_of_a_long_text_are_counted_in_its_row(spark):
    texts = {1: "b a b c a b", 2: "", 3: "x " * 5000 + " ".join(f"w{n}" for n in range(3000)), 4: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("chunk_index", F.lit(0))
    counted = {r.doc_id: {t.term: t.tf for t in r.terms or []} for r in lexical.index_rows(rows).collect()}
    assert counted[1] == {"a": 2, "b": 3, "c": 1} and counted[2] == {} and counted[4] == {}
    assert counted[3] == {"x": 5000, **{f"w{n}": 1 for n in range(3000)}}
