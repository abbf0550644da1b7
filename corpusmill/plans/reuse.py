"""Queries for answer reuse and hot questions (C1-C9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import reuse_key
from corpusmill.operators import models, reuse
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.registry import query
from corpusmill.plans.text import normalized

# Clicks and views ask; purchases and errors are the moments an answer or a retrieval result was stored.
LOG = """
    keyed AS (SELECT event_id, ts, event_type, concat(user_id % 5, '::t', user_id % 7, '::u', user_id) AS key FROM events),
    asks AS (SELECT * FROM keyed WHERE event_type IN ('click', 'view')),
    stored AS (SELECT key, ts AS cached_at, event_id AS answer_id FROM keyed WHERE event_type = 'purchase'),
    contexts AS (SELECT key, ts AS cached_at, event_id AS context_id FROM keyed WHERE event_type = 'error'),
    exact AS (SELECT a.event_id, max(s.cached_at) AS cached_at, arg_max(answer_id, (s.cached_at, answer_id)) AS answer_id FROM asks a JOIN stored s
      ON s.key = a.key AND s.cached_at <= a.ts AND a.ts - s.cached_at <= INTERVAL 24 HOUR GROUP BY a.event_id),
    context AS (SELECT a.event_id, arg_max(context_id, (s.cached_at, context_id)) AS context_id FROM asks a JOIN contexts s
      ON s.key = a.key AND s.cached_at <= a.ts AND a.ts - s.cached_at <= INTERVAL 6 HOUR GROUP BY a.event_id)"""


def _keyed(i: Inputs):
    user = F.col("user_id")
    key = reuse_key((user % 5).cast("string"), user % 7, user)
    return i.table("events").select("event_id", "ts", "event_type", key.alias("key"))


def _asks(i: Inputs):
    return _keyed(i).filter(F.col("event_type").isin("click", "view")).select("event_id", "ts", "key")


def _stored(i: Inputs, kind: str, name: str):
    return _keyed(i).filter(F.col("event_type") == kind).select("key", F.col("ts").alias("cached_at"), F.col("event_id").alias(name))


@query(
    "C1_reuse_exact",
    "SELECT a.event_id, coalesce(answer_id, -1) AS answer_id, cached_at FROM asks a LEFT JOIN exact USING (event_id)",
    LOG,
)
def _(i: Inputs):
    found = reuse.reuse_exact(_asks(i), _stored(i, "purchase", "answer_id"))
    return found.select("event_id", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"), "cached_at")


ENTRIES = """
    questions AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, conv_id % 4 AS tenant_id FROM conversations WHERE role = 'user'),
    hashed AS (SELECT id, place, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS v FROM (
      SELECT id, CAST('0x' || substr(md5(term), 1, 6) AS INT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 2) AS INT) < 128 THEN 1 ELSE -1 END) AS v
      FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM questions) GROUP BY ALL)),
    size AS (SELECT id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS size FROM hashed GROUP BY id),
    entry AS (SELECT text, tenant_id, max(id) AS id FROM questions WHERE id IN (SELECT id FROM v_qa) GROUP BY ALL),
    near AS (SELECT q.id AS query_id, e.id AS entry_id, round(1 - round(1 - d.dot / (a.size * b.size), 9), 4) AS similarity, round(1 - d.dot / (a.size * b.size), 9) AS distance
      FROM questions q JOIN entry e ON e.tenant_id = q.tenant_id AND e.id <= q.id + 3600 AND q.id + 3600 - e.id <= 86400
      JOIN (SELECT x.id AS l, y.id AS r, sum(CAST(x.v AS DOUBLE) * y.v) AS dot FROM hashed x JOIN hashed y USING (place) GROUP BY ALL) d ON d.l = q.id AND d.r = e.id
      JOIN size a ON a.id = q.id JOIN size b ON b.id = e.id),
    semantic AS (SELECT query_id, arg_min(entry_id, (distance, entry_id)) AS entry_id, arg_min(similarity, (distance, entry_id)) AS similarity
      FROM near WHERE distance <= 0.08 + 1e-9 GROUP BY query_id)"""


def _semantic(i: Inputs):
    """Every user turn asks an hour after it was stored, if it was answered."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    turns = i.table("conversations").filter("role = 'user'").select(
        key.alias("id"), F.col("text").alias("question"), (F.col("conv_id") % 4).alias("tenant_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + key).alias("at"),
    )
    turns = models.embed(turns, "question")
    answered = turns.join(i.history().select("id"), "id", "left_semi")
    entries = answered.select(F.col("id").alias("entry_id"), "question", "tenant_id", "embedding", F.col("at").alias("cached_at"))
    asks = turns.select(F.col("id").alias("query_id"), "tenant_id", "embedding", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return asks, entries


@query("C2_reuse_semantic", "SELECT query_id, entry_id, similarity FROM semantic", ENTRIES)
def _(i: Inputs):
    return reuse.reuse_semantic(*_semantic(i))


@query("C2_reuse_semantic_cells", "SELECT query_id, entry_id, similarity FROM semantic", ENTRIES)
def _(i: Inputs):
    return reuse.reuse_semantic(*_semantic(i), cells=0)


@query(
    "C3_reuse_context",
    "SELECT a.event_id, coalesce(context_id, -1) AS context_id FROM asks a LEFT JOIN context USING (event_id)",
    LOG,
)
def _(i: Inputs):
    found = reuse.reuse_context(_asks(i), _stored(i, "error", "context_id"))
    return found.select("event_id", F.coalesce("context_id", F.lit(-1)).alias("context_id"))


# User turns ask an hour after they were stored. Two of five have an exact answer, one a stored retrieval result;
# the semantic layer has all answered turns.
SERVED = (
    ENTRIES
    + f""",
    turns AS (SELECT *, concat_ws('::', {normalized('text')}, 't' || tenant_id) AS key FROM questions),
    exact AS (SELECT q.id AS query_id, arg_max(a.id, (a.id, a.id)) AS answer_id FROM turns q JOIN turns a ON a.key = q.key AND a.id % 5 < 2
      AND a.id <= q.id + 3600 AND q.id + 3600 - a.id <= 86400 GROUP BY q.id),
    context AS (SELECT q.id AS query_id, arg_max(a.id, (a.id, a.id)) AS context_id FROM turns q JOIN turns a ON a.key = q.key AND a.id % 5 = 2
      AND a.id <= q.id + 3600 AND q.id + 3600 - a.id <= 21600 GROUP BY q.id),
    served AS (SELECT q.id AS query_id, CASE WHEN e.answer_id IS NOT NULL THEN 'exact' WHEN s.entry_id IS NOT NULL THEN 'semantic'
        WHEN c.context_id IS NOT NULL THEN 'context' ELSE 'miss' END AS layer, coalesce(e.answer_id, s.entry_id, c.context_id, -1) AS served_id
      FROM questions q LEFT JOIN exact e ON e.query_id = q.id LEFT JOIN context c ON c.query_id = q.id LEFT JOIN semantic s ON s.query_id = q.id)"""
)


def _served(i: Inputs):
    key = F.col("conv_id") * 1000 + F.col("turn")
    turns = i.table("conversations").filter("role = 'user'").select(
        key.alias("id"), reuse_key(F.col("text"), F.col("conv_id") % 4).alias("key"), F.timestamp_seconds(F.lit(1_704_067_200) + key).alias("at")
    )
    asks = turns.select(F.col("id").alias("query_id"), "key", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    stored = lambda these, name: turns.filter(these).select("key", F.col("at").alias("cached_at"), F.col("id").alias(name))
    exact = reuse.reuse_exact(asks, stored("id % 5 < 2", "answer_id"))
    context = reuse.reuse_context(asks, stored("id % 5 = 2", "context_id"))
    return reuse.reuse_cascade(asks, exact, reuse.reuse_semantic(*_semantic(i)), context)


@query("C4_reuse_cascade", "SELECT query_id, layer, served_id FROM served", SERVED)
def _(i: Inputs):
    return _served(i).withColumn("served_id", F.coalesce("served_id", F.lit(-1)))


@query(
    "C5_hot_questions",
    """SELECT event_id, question, ts, asks FROM (SELECT event_id, question, ts,
      count(*) OVER (PARTITION BY question ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS asks FROM v_log) WHERE asks >= 5""",
)
def _(i: Inputs):
    hot = reuse.hot_questions(i.query_log())
    return hot.select("event_id", "question", "ts", F.col("asks").cast("long").alias("asks"))


# The counter of each question, one ask after the other.
FIRINGS = """asked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ts, event_id) AS n FROM v_log),
    walk AS (
      SELECT question, ts, event_id, n, [epoch_us(ts)] AS times, false AS fired FROM asked WHERE n = 1
      UNION ALL
      SELECT a.question, a.ts, a.event_id, a.n,
        CASE WHEN len(list_filter(w.times, lambda t: epoch_us(a.ts) - t <= 86400000000)) >= 4 THEN CAST([] AS BIGINT[])
             ELSE list_append(list_filter(w.times, lambda t: epoch_us(a.ts) - t <= 86400000000), epoch_us(a.ts)) END,
        len(list_filter(w.times, lambda t: epoch_us(a.ts) - t <= 86400000000)) >= 4
      FROM walk w JOIN asked a ON a.question = w.question AND a.n = w.n + 1)"""


@query("C5_hot_firings", "SELECT question, ts, event_id FROM walk WHERE fired", FIRINGS)
def _(i: Inputs):
    return reuse.hot_firings(i.query_log())


@query(
    "C6_warmup_candidates",
    "SELECT question, count(*) AS asks FROM v_log GROUP BY question HAVING count(*) >= 3 ORDER BY asks DESC, question LIMIT 50",
)
def _(i: Inputs):
    return reuse.warmup_candidates(i.query_log())


def _entries(i: Inputs):
    kind = F.col("event_type")
    layer = F.when(kind == "purchase", "exact").when(kind == "click", "semantic").otherwise("context")
    return i.table("events").select(
        layer.alias("layer"), F.col("event_id").alias("entry_id"), F.col("ts").alias("used_at"), "user_id"
    )


STORED = """
    entries AS (SELECT CASE event_type WHEN 'purchase' THEN 'exact' WHEN 'click' THEN 'semantic' ELSE 'context' END AS layer, event_id AS entry_id, ts AS used_at, user_id FROM events)"""


@query(
    "C7_retain_latest",
    """SELECT layer, entry_id, used_at FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY used_at DESC, entry_id DESC) AS n FROM entries)
    WHERE n <= CASE layer WHEN 'exact' THEN 1000 WHEN 'semantic' THEN 500 ELSE 300 END""",
    STORED,
)
def _(i: Inputs):
    return reuse.retain_latest(_entries(i), {"exact": 1000, "semantic": 500, "context": 300}).drop("user_id")


@query(
    "C8_reuse_stats",
    """SELECT layer, hits, misses, round(100e0 * hits / greatest(hits + misses, 1), 2) AS hit_rate FROM (
      SELECT 'exact' AS layer, count(*) FILTER (layer = 'exact') AS hits, count(*) FILTER (layer <> 'exact') AS misses FROM served
      UNION ALL SELECT 'semantic', count(*) FILTER (layer = 'semantic'), count(*) FILTER (layer IN ('context', 'miss')) FROM served
      UNION ALL SELECT 'context', count(*) FILTER (layer = 'context'), count(*) FILTER (layer = 'miss') FROM served
      UNION ALL SELECT 'overall', count(*) FILTER (layer <> 'miss'), count(*) FILTER (layer = 'miss') FROM served)""",
    SERVED,
)
def _(i: Inputs):
    return reuse.reuse_stats(_served(i))


@query(
    "C9_invalidate",
    """SELECT entry_id, layer, NOT EXISTS (SELECT 1 FROM v_document d WHERE d.tenant_id = user_id % 40 AND d.created_at > used_at) AS alive FROM entries""",
    STORED,
)
def _(i: Inputs):
    entries = _entries(i).select("entry_id", "layer", F.col("used_at").alias("cached_at"), (F.col("user_id") % 40).alias("tenant_id"))
    changes = i.docs().select(F.col("tenant_id").cast("long").alias("tenant_id"), F.col("created_at").alias("changed_at"))
    return reuse.invalidate(entries, changes).select("entry_id", "layer", "alive")


