"""Queries for the evaluation of retrieval and answers (E1-E14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import parse_verdict
from corpusmill.operators import evaluation, models
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.registry import query


def r6(name: str):
    return F.round(name, 6).alias(name)


def _judged(source: str, top: str) -> str:
    return f"""
    docs_{source} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM (
      SELECT query_id, doc_id, min(rank) AS first FROM {top} GROUP BY ALL)),
    judged_{source} AS (SELECT g.query_id, count(place) / count(*)::DOUBLE AS recall, coalesce(1e0 / min(place), 0) AS mrr, CASE WHEN count(place) > 0 THEN 1 ELSE 0 END AS hit
      FROM v_golden g LEFT JOIN (SELECT * FROM docs_{source} WHERE place <= 5) d USING (query_id, doc_id) GROUP BY g.query_id)"""


HYBRID = _judged("hybrid", "v_rerank_all")
CALLERS = _judged("callers", "v_rerank")
BM25 = _judged("bm25", "v_rerank_bm25_all")
FUSED = _judged("no_rerank", "(SELECT * FROM v_fused_all WHERE rank <= 8)")


def _summary(source: str) -> str:
    return f"SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM judged_{source}"


@query("E1_eval_questions", "SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, hit FROM judged_hybrid", HYBRID)
def _(i: Inputs):
    rows = evaluation.eval_questions(i.results(), i.golden())
    return rows.select("query_id", r6("recall"), r6("mrr"), "hit")


@query("E1_eval_questions_of_callers", "SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, hit FROM judged_callers", CALLERS)
def _(i: Inputs):
    rows = evaluation.eval_questions(i.results("hybrid", False), i.golden())
    return rows.select("query_id", r6("recall"), r6("mrr"), "hit")


@query("E2_eval_summary", _summary("hybrid"), HYBRID)
def _(i: Inputs):
    rows = evaluation.eval_summary(evaluation.eval_questions(i.results(), i.golden()))
    return rows.select("n", r6("recall"), r6("mrr"), r6("hit_rate"))


KEYWORDS = """
    wanted AS (SELECT item_id AS query_id, CASE WHEN item_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(text, ' ')[2:4] END AS words FROM benchmark),
    blob AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS blob FROM v_rerank_all GROUP BY query_id),
    found AS (SELECT query_id, CAST(len(list_filter(words, lambda w: contains(coalesce(blob, ''), w))) AS INT) AS kw_found, CAST(len(words) AS INT) AS kw_total
      FROM wanted LEFT JOIN blob USING (query_id))"""


@query(
    "E3_keyword_hit",
    "SELECT query_id, kw_found, kw_total, round(kw_found / nullif(kw_total, 0)::DOUBLE, 6) AS kw_hit FROM found",
    KEYWORDS,
)
def _(i: Inputs):
    rows = evaluation.keyword_hit(i.results(), i.keywords())
    return rows.select("query_id", "kw_found", "kw_total", r6("kw_hit"))


@query(
    "E4_worst_cases",
    """SELECT query_id, round(kw, 6) AS kw, round(mrr, 6) AS mrr FROM (
      SELECT query_id, coalesce(kw_found / nullif(kw_total, 0)::DOUBLE, 1) AS kw, mrr FROM judged_callers JOIN found USING (query_id) ORDER BY kw, mrr, query_id LIMIT 8)
    WHERE NOT (kw = 1 AND mrr = 1)""",
    CALLERS + "," + KEYWORDS.replace("v_rerank_all", "v_rerank"),
)
def _(i: Inputs):
    """Ranks and keywords of the same run, that of the callers."""
    results = i.results("hybrid", False)
    judged = evaluation.eval_questions(results, i.golden())
    rows = evaluation.worst_cases(judged.join(evaluation.keyword_hit(results, i.keywords()), "query_id"))
    return rows.select("query_id", F.round(F.coalesce("kw_hit", F.lit(1.0)), 6).alias("kw"), r6("mrr"))


@query(
    "E5_compare_modes",
    f"SELECT 'hybrid' AS mode, * FROM ({_summary('hybrid')}) UNION ALL SELECT 'bm25', * FROM ({_summary('bm25')}) UNION ALL SELECT 'no_rerank', * FROM ({_summary('no_rerank')})",
    HYBRID + "," + BM25 + "," + FUSED,
)
def _(i: Inputs):
    modes = {mode: i.results(mode) for mode in ["hybrid", "bm25", "no_rerank"]}
    rows = evaluation.compare_modes(modes, i.golden())
    return rows.select("mode", "n", r6("recall"), r6("mrr"), r6("hit_rate"))


ABLATION = r"""
    fact AS (SELECT query_id, fact FROM (SELECT item_id AS query_id, regexp_replace(p, '^\s+|\s+$', '', 'g') AS fact
      FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[；;。!\n]')) AS p FROM benchmark)) WHERE length(fact) >= 2),
    setting AS (SELECT k, parent FROM (VALUES (3), (5), (8)) a(k), (VALUES ('on'), ('off')) b(parent)),
    shown AS (SELECT query_id, k, parent, string_agg(CASE WHEN parent = 'on' THEN coalesce(p.text, r.text) ELSE r.text END, chr(10) || chr(10) ORDER BY rank) AS context,
        bool_or((query_id, r.doc_id) IN (SELECT (query_id, doc_id) FROM v_golden)) AS doc_hit
      FROM v_rerank_all r LEFT JOIN v_parent p USING (parent_id), setting WHERE rank <= k GROUP BY ALL),
    report AS (SELECT k, parent, sum(covered) / sum(facts)::DOUBLE AS fact_coverage, avg(doc_hit::INT) AS doc_recall, CAST(sum(facts) AS BIGINT) AS facts FROM (
      SELECT query_id, s.k, s.parent, count(*) AS facts, count(*) FILTER (contains(coalesce(context, ''), fact)) AS covered, coalesce(bool_or(doc_hit), false) AS doc_hit
      FROM fact, setting s LEFT JOIN shown USING (query_id, k, parent) GROUP BY ALL) GROUP BY ALL)"""
ABLATION = ABLATION.replace("FROM fact, setting s LEFT JOIN", "FROM (SELECT * FROM fact, setting) s LEFT JOIN")


@query(
    "E6_ablate_context",
    "SELECT k, parent, round(fact_coverage, 6) AS fact_coverage, round(doc_recall, 6) AS doc_recall, facts FROM report",
    ABLATION,
)
def _(i: Inputs):
    rows = evaluation.ablate_context(i.results(), i.parents(), i.golden(), i.answers())
    return rows.select("k", "parent", r6("fact_coverage"), r6("doc_recall"), "facts")


SEMANTIC = (
    ABLATION
    + r""",
    told AS (SELECT s.query_id, s.k, s.parent, coalesce(context, '') AS context, coalesce(doc_hit, false) AS doc_hit
      FROM (SELECT DISTINCT query_id, k, parent FROM fact, setting) s LEFT JOIN shown USING (query_id, k, parent)),
    wording AS (SELECT context AS t FROM told UNION SELECT fact FROM fact),
    hashed AS (SELECT t, CAST('0x' || substr(md5(term), 1, 6) AS INT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 2) AS INT) < 128 THEN 1 ELSE -1 END) AS v
      FROM (SELECT t, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS term FROM wording) GROUP BY ALL),
    vector AS (SELECT t, place, CAST(CAST(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY t)), 0), 0) AS FLOAT) AS DOUBLE) AS v FROM hashed),
    size AS (SELECT t, sqrt(sum(v * v)) AS size FROM vector GROUP BY t),
    near AS (SELECT f.query_id, c.k, c.parent, f.fact, c.doc_hit,
        coalesce((SELECT sum(a.v * b.v) FROM vector a JOIN vector b USING (place) WHERE a.t = f.fact AND b.t = c.context), 0)
          / (coalesce(x.size, 0) * coalesce(y.size, 0) + 1e-9) >= 0.82 AS covered
      FROM fact f JOIN told c USING (query_id) LEFT JOIN size x ON x.t = f.fact LEFT JOIN size y ON y.t = c.context),
    semantic AS (SELECT k, parent, sum(covered) / sum(facts)::DOUBLE AS fact_coverage, avg(doc_hit::INT) AS doc_recall, CAST(sum(facts) AS BIGINT) AS facts FROM (
      SELECT query_id, k, parent, count(*) AS facts, count(*) FILTER (covered) AS covered, bool_or(doc_hit) AS doc_hit FROM near GROUP BY ALL) GROUP BY ALL)""".replace("\\\\", "\\")
)


@query("E7_ablate_semantic", "SELECT k, parent, round(fact_coverage, 6) AS fact_coverage, round(doc_recall, 6) AS doc_recall, facts FROM semantic", SEMANTIC)
def _(i: Inputs):
    rows = evaluation.ablate_context(i.results(), i.parents(), i.golden(), i.answers(), semantic=True)
    return rows.select("k", "parent", r6("fact_coverage"), r6("doc_recall"), "facts")


@query(
    "E8_best_config",
    "SELECT k, parent, round(fact_coverage, 6) AS fact_coverage FROM report ORDER BY report.fact_coverage DESC, doc_recall DESC, k, parent DESC LIMIT 1",
    ABLATION,
)
def _(i: Inputs):
    best = evaluation.best_config(evaluation.ablate_context(i.results(), i.parents(), i.golden(), i.answers()))
    return best.select("k", "parent", r6("fact_coverage"))


SCORES = """
    score AS (SELECT 'A' AS model, c_custkey AS qid, rep, c_mktsegment AS type, CASE WHEN c_custkey % 13 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) * rep % 11 END AS total FROM customer, (VALUES (1), (2)) r(rep)
      UNION ALL SELECT 'B', c_custkey, rep, c_mktsegment, (c_custkey * 7 + rep) % 11 FROM customer, (VALUES (1), (2)) r(rep))"""


def _scores(i: Inputs):
    bank = i.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), "c_acctbal")
    runs = evaluation.run_matrix(bank, 2, ["A", "B"]).withColumnRenamed("id", "qid")
    first = F.when(F.col("qid") % 13 != 0, F.floor(F.abs("c_acctbal")).cast("long") * F.col("rep") % 11)
    total = F.when(F.col("model") == "A", first).otherwise((F.col("qid") * 7 + F.col("rep")) % 11)
    return runs.select("model", "qid", "rep", "type", total.alias("total"))


@query(
    "E9_judge_summary",
    """SELECT model, scope, count(*) AS judged, round(avg(total), 2) AS mean_total FROM (
      SELECT model, 'all' AS scope, total FROM score UNION ALL SELECT model, type, total FROM score) WHERE total <> 0 GROUP BY ALL""",
    SCORES,
)
def _(i: Inputs):
    return evaluation.judge_summary(_scores(i))


@query(
    "E10_paired_compare",
    """SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 4) AS mean_delta
    FROM (SELECT coalesce(a.total, 0) - coalesce(b.total, 0) AS d FROM score a JOIN score b USING (qid, rep) WHERE a.model = 'A' AND b.model = 'B')""",
    SCORES,
)
def _(i: Inputs):
    scores = _scores(i)
    return evaluation.paired_compare(scores.filter("model = 'A'"), scores.filter("model = 'B'"))


@query("E11_randomize_pairs")
def _(i: Inputs):
    answers = i.history().select(F.col("id").alias("qid"), F.col("turn").alias("rep"), F.col("question").alias("answer_a"), F.col("answer").alias("answer_b"))
    return evaluation.randomize_pairs(answers)


@query("E11_pairs_kept", "SELECT id AS qid, turn AS rep, least(question, answer) AS lower, greatest(question, answer) AS upper FROM v_qa")
def _(i: Inputs):
    """Whatever the order, both answers of a pair are shown, once each."""
    answers = i.history().select(F.col("id").alias("qid"), F.col("turn").alias("rep"), F.col("question").alias("answer_a"), F.col("answer").alias("answer_b"))
    shown = evaluation.randomize_pairs(answers)
    return shown.select("qid", "rep", F.least("first", "second").alias("lower"), F.greatest("first", "second").alias("upper"))


@query(
    "E12_run_matrix",
    """SELECT c_custkey AS id, c_mktsegment AS type, rep, model FROM customer, (VALUES (1), (2), (3)) r(rep), (VALUES ('A'), ('B')) m(model) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def _(i: Inputs):
    bank = i.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    return evaluation.run_matrix(bank, 3, ["A", "B"], types=["BUILDING", "MACHINERY"])


CANDIDATES = """
    known AS (SELECT DISTINCT question FROM v_qa JOIN v_feedback f ON f.history_id = v_qa.id AND rating = 1),
    picked AS (SELECT id, regexp_replace(CASE WHEN turn = 3 THEN '' ELSE question END, '^\\s+|\\s+$', '', 'g') AS question,
        CASE WHEN (conversation_id + turn) % 7 IN (0, 1) THEN '' ELSE concat(conversation_id, ',', id, ',', turn) END AS key_id
      FROM v_qa WHERE id IN (SELECT history_id FROM v_feedback WHERE rating = -1)),
    verdict AS (SELECT id, question, key_id, CASE WHEN question = '' OR question IN (SELECT question FROM known)
        OR EXISTS (SELECT 1 FROM picked e WHERE e.question = p.question AND e.id < p.id AND e.key_id <> '') THEN 'duplicate' WHEN key_id = '' THEN 'no_document' ELSE 'added' END AS outcome FROM picked p)"""


def _outcomes(i: Inputs):
    history = i.history()
    votes = i.feedback()
    liked = history.join(votes.filter("rating = 1").select(F.col("history_id").alias("id")), "id", "left_semi")
    selected = votes.filter("rating = -1").select(F.col("history_id").alias("id"))
    blanked = history.withColumn("question", F.when(F.col("turn") == 3, "").otherwise(F.col("question")))
    return evaluation.golden_candidates(blanked, selected, liked)


@query("E13_golden_candidates", "SELECT id, question, key_id, outcome FROM verdict", CANDIDATES)
def _(i: Inputs):
    return _outcomes(i).withColumn("key_id", F.array_join("key_id", ","))


@query("E13_golden_candidate_counts", "SELECT outcome, count(*) AS n FROM verdict GROUP BY outcome", CANDIDATES)
def _(i: Inputs):
    return evaluation.golden_candidate_counts(_outcomes(i))


@query(
    "E14_judge",
    "SELECT id, CAST(length(answer) % 11 AS DOUBLE) AS total FROM v_qa",
)
def _(i: Inputs):
    """A judge that scores by length; its replies go through the verdict parser."""
    pairs = i.history().select("id", F.col("answer").alias("judge_prompt"))
    replies = models.judge(pairs, lambda texts: '```json\n{"total": ' + (texts.str.len() % 11).astype(str) + "}\n```")
    verdict, _error = parse_verdict(F.col("reply"), evaluation.VERDICT)
    return replies.select("id", verdict["total"].alias("total"))
