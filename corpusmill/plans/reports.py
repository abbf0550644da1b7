"""Queries for the relational reports (Q1-Q21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import reports
from corpusmill.plans.inputs import ASOF, Inputs
from corpusmill.plans.registry import query

CALLER = 7


@query(
    "Q1_dashboard",
    """SELECT (SELECT count(*) FROM v_user) AS users, (SELECT count(*) FROM v_user WHERE role = 'admin') AS admins,
      (SELECT count(*) FROM v_user WHERE role = 'user') AS normal_users, (SELECT count(*) FROM v_document) AS docs,
      (SELECT count(*) FROM v_document WHERE status = 'completed') AS completed_docs, (SELECT count(*) FROM v_category) AS categories,
      (SELECT count(*) FROM v_qa) AS questions, (SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) FROM v_qa) AS tokens""",
)
def _(i: Inputs):
    return reports.dashboard(i.users(), i.docs(), i.categories(), i.history())


@query(
    "Q2_daily_stats",
    """SELECT CAST(day AS DATE) AS day, (SELECT count(*) FROM v_user WHERE CAST(created_at AS DATE) = day) AS new_users,
      (SELECT count(*) FROM v_document WHERE CAST(created_at AS DATE) = day) AS new_docs, (SELECT count(*) FROM v_qa WHERE CAST(created_at AS DATE) = day) AS questions
    FROM (SELECT unnest(range(DATE '2024-01-02', DATE '2024-02-01', INTERVAL 1 DAY)) AS day)""",
)
def _(i: Inputs):
    return reports.daily_stats(i.users(), i.docs(), i.history(), ASOF, 30)


COUNTS = "SELECT c.id, c.name, count(d.id) AS doc_count FROM v_category c LEFT JOIN v_document d ON d.category_id = c.id GROUP BY ALL"


@query("Q3_category_counts", COUNTS)
def _(i: Inputs):
    return reports.category_counts(i.categories(), i.docs())


@query("Q3_category_chart", COUNTS + " HAVING count(d.id) > 0")
def _(i: Inputs):
    return reports.category_counts(i.categories(), i.docs(), nonempty=True)


@query(
    "Q4_user_activity",
    """SELECT u.id, u.username, count(h.id) AS question_count FROM v_user u LEFT JOIN v_qa h ON h.user_id = u.id
    GROUP BY ALL ORDER BY question_count DESC, u.id LIMIT 10""",
)
def _(i: Inputs):
    return reports.user_activity(i.users(), i.history())


@query(
    "Q5_token_usage",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS questions, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 4) AS avg_tokens
    FROM v_qa WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '2024-01-31' GROUP BY day""",
)
def _(i: Inputs):
    return reports.token_usage(i.history(), ASOF, 30)


@query(
    "Q6_login_log",
    """SELECT id, username, login_status, created_at, count(*) OVER () AS total FROM v_login WHERE contains(lower(username), 'er#00000001')
    ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(i: Inputs):
    return reports.login_log(i.logins(), "ER#00000001", page=2).drop("user_id")


@query(
    "Q6_login_log_after",
    """SELECT id, username, login_status, created_at, count(*) OVER () AS total FROM v_login WHERE contains(lower(username), 'er#00000001')
    ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(i: Inputs):
    """The second page, sought by the last row of the first one."""
    first = reports.login_log(i.logins(), "ER#00000001").select("created_at", "id").collect()
    last = min((r.created_at, r.id) for r in first)
    return reports.login_log(i.logins(), "ER#00000001", after=last).drop("user_id")


@query(
    "Q7_system_metrics",
    """SELECT count(*) FILTER (status = 'pending') AS docs_pending, count(*) FILTER (status = 'processing') AS docs_processing,
      count(*) FILTER (status = 'completed') AS docs_completed, count(*) FILTER (status = 'failed') AS docs_failed, count(*) AS docs,
      (SELECT count(*) FROM v_user) AS users, (SELECT count(*) FROM v_qa) AS questions,
      (SELECT count(*) FROM v_feedback WHERE rating = 1) AS likes, (SELECT count(*) FROM v_feedback WHERE rating = -1) AS dislikes,
      (SELECT count(*) FROM v_feedback) AS feedback, (SELECT round(sum((rating = 1)::INT) / count(*)::DOUBLE, 4) FROM v_feedback) AS satisfaction
    FROM v_document""",
)
def _(i: Inputs):
    return reports.system_metrics(i.docs(), i.users(), i.history(), i.feedback())


@query(
    "Q8_feedback_summary",
    """SELECT count(*) FILTER (rating = 1) AS likes, count(*) FILTER (rating = -1) AS dislikes, count(*) AS total,
      round(count(*) FILTER (rating = 1) / greatest(count(*), 1)::DOUBLE, 4) AS satisfaction FROM v_feedback""",
)
def _(i: Inputs):
    return reports.feedback_summary(i.feedback())


@query(
    "Q8_feedback_report",
    """SELECT f.id, f.history_id, h.question, substring(h.answer, 1, 300) AS answer, u.username, f.created_at
    FROM v_feedback f JOIN v_qa h ON h.id = f.history_id LEFT JOIN v_user u ON u.id = f.user_id
    WHERE rating = -1 ORDER BY f.created_at DESC, f.id DESC LIMIT 20""",
)
def _(i: Inputs):
    return reports.feedback_report(i.feedback(), i.history(), i.users())


@query(
    "Q9_list_documents",
    """SELECT d.id, d.title, c.name AS category, u.username AS uploader, t.name AS tenant, d.status, d.total FROM (
      SELECT *, count(*) OVER () AS total FROM v_document, v_ctx x WHERE x.user_id = 50 AND x.is_admin AND status = 'completed'
        AND (contains(lower(title), 'in') OR contains(lower(content), 'in')) ORDER BY id DESC LIMIT 10 OFFSET 10) d
    LEFT JOIN v_category c ON c.id = d.category_id LEFT JOIN v_user u ON u.id = d.upload_by LEFT JOIN v_tenant t ON t.id = d.tenant_id""",
)
def _(i: Inputs):
    rows = reports.list_documents(
        i.docs(), i.users(), i.grants(), i.categories(), i.tenants(), 50, keyword="In", status="completed", page=2
    )
    return rows.select("id", "title", "category", "uploader", "tenant", "status", "total")


@query(
    "Q9_list_documents_after",
    """SELECT id, title, total FROM (SELECT id, title, count(*) OVER () AS total FROM v_document, v_ctx x WHERE x.user_id = 50 AND x.is_admin AND status = 'completed'
        AND (contains(lower(title), 'in') OR contains(lower(content), 'in')) ORDER BY id DESC LIMIT 10 OFFSET 10)""",
)
def _(i: Inputs):
    page = lambda **at: reports.list_documents(
        i.docs(), i.users(), i.grants(), i.categories(), i.tenants(), 50, keyword="In", status="completed", **at
    )
    last = page().agg(F.min("id")).first()[0]
    return page(after=(last,)).select("id", "title", "total")


@query(
    "Q9_list_documents_of_caller",
    """SELECT id, title, total FROM (SELECT id, title, count(*) OVER () AS total FROM v_document d, v_ctx x WHERE x.user_id = 7 AND (
        coalesce(upload_by = 7, false) OR coalesce(tenant_id = caller_tenant AND doc_level = 'public' AND min_level <= clearance, false)
        OR id IN (SELECT document_id FROM v_acl WHERE v_acl.user_id = 7)) ORDER BY id DESC LIMIT 10)""",
)
def _(i: Inputs):
    rows = reports.list_documents(i.docs(), i.users(), i.grants(), i.categories(), i.tenants(), CALLER)
    return rows.select("id", "title", "total")


@query(
    "Q10_qa_history",
    """SELECT h.id, h.user_id, u.username, question, answer, h.created_at, total,
      CASE WHEN documents = '[broken' OR documents = '[]' THEN '' ELSE concat(conversation_id, ',x,', h.id, ',', turn) END AS document_ids
    FROM (SELECT *, count(*) OVER () AS total FROM v_qa ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 20) h LEFT JOIN v_user u ON u.id = h.user_id""",
)
def _(i: Inputs):
    rows = reports.qa_history(i.history(), i.users(), 0, page=3)
    return rows.withColumn("document_ids", F.array_join("document_ids", ","))


@query(
    "Q10_qa_history_of_user",
    "SELECT id, question, count(*) OVER () AS total FROM v_qa WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10",
)
def _(i: Inputs):
    return reports.qa_history(i.history(), i.users(), CALLER).select("id", "question", "total")


@query(
    "Q11_conversation_list",
    """SELECT conversation_id AS id, any_value(user_id) AS user_id, count(*) AS message_count, max(created_at) AS updated_at, arg_max(question, id) AS last_question
    FROM v_qa GROUP BY conversation_id""",
)
def _(i: Inputs):
    rows = reports.conversation_list(reports.conversations_from_history(i.history()), i.history())
    return rows.select("id", "user_id", "message_count", "updated_at", "last_question")


@query(
    "Q12_transcript",
    """SELECT h.conversation_id, h.id, h.question, h.answer, h.created_at, coalesce(docs, '') AS documents FROM v_qa h LEFT JOIN (
      SELECT c.id, string_agg(concat(cited, '=', coalesce(title, '')), ';' ORDER BY pos) AS docs
      FROM v_cited c LEFT JOIN (SELECT id AS doc_id, title FROM v_document) d ON d.doc_id = c.cited GROUP BY c.id) USING (id)""",
)
def _(i: Inputs):
    rows = reports.transcript(i.history(), i.docs())
    shown = F.transform("documents", lambda d: F.concat(d["id"].cast("string"), F.lit("="), d["title"]))
    return rows.withColumn("documents", F.array_join(shown, ";"))


@query(
    "Q13_recent_turns",
    """SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS INT) AS turn_no, id, question, answer
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back FROM v_qa) WHERE back <= 3""",
)
def _(i: Inputs):
    return reports.recent_turns(i.history(), 3)


TREE = """tree AS (SELECT id, name, parent_id, 0 AS depth, [lpad(CAST(sort_order AS VARCHAR), 9, '0')] AS path FROM v_category WHERE parent_id = 0
    UNION ALL SELECT c.id, c.name, c.parent_id, t.depth + 1, list_append(t.path, lpad(CAST(c.sort_order AS VARCHAR), 9, '0')) FROM v_category c JOIN tree t ON c.parent_id = t.id)"""


@query("Q14_category_tree", "SELECT id, name, parent_id, depth, CAST(row_number() OVER (ORDER BY path) AS INT) AS place FROM tree", TREE)
def _(i: Inputs):
    tree = reports.category_tree(i.categories())
    # Categories are a small dimension, so one window over them is fine.
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path"))
    return tree.withColumn("place", place).select("id", "name", "parent_id", "depth", "place")


@query("Q15_category_flat", "SELECT id, concat(repeat('— ', depth), name) AS label, depth FROM tree", TREE)
def _(i: Inputs):
    return reports.category_flat(i.categories())


@query(
    "Q16_list_users",
    """SELECT u.id, username, real_name, t.name AS tenant, total FROM (SELECT *, count(*) OVER () AS total FROM v_user
      WHERE contains(lower(username), 'build') OR contains(lower(real_name), 'build') ORDER BY id DESC LIMIT 10) u LEFT JOIN v_tenant t ON t.id = u.tenant_id""",
)
def _(i: Inputs):
    return reports.list_users(i.users(), i.tenants(), "Build").select("id", "username", "real_name", "tenant", "total")


@query(
    "Q17_profiles",
    "SELECT u.id, username, role, coalesce(t.name, '') AS tenant, CAST(clearance_level AS INT) AS clearance_level FROM v_user u LEFT JOIN v_tenant t ON t.id = u.tenant_id",
)
def _(i: Inputs):
    rows = reports.profiles(i.users(), i.tenants())
    return rows.select("id", "username", "role", F.coalesce("tenant", F.lit("")).alias("tenant"), "clearance_level")


@query(
    "Q18_deletable_categories",
    """SELECT id, name FROM (SELECT * FROM v_category UNION ALL SELECT n_nationkey + 200, concat('empty ', n_name), 1, 99 FROM nation)
    WHERE id NOT IN (SELECT parent_id FROM v_category) AND id NOT IN (SELECT category_id FROM v_document WHERE category_id IS NOT NULL)""",
)
def _(i: Inputs):
    empty = i.table("nation").select(
        (F.col("n_nationkey") + 200).cast("long").alias("id"), F.concat(F.lit("empty "), "n_name").alias("name"),
        F.lit(1).cast("long").alias("parent_id"), F.lit(99).alias("sort_order"),
    )
    return reports.deletable_categories(i.categories().unionByName(empty), i.docs())


@query("Q19_view_counts", "SELECT doc_id, count(*) AS view_count FROM v_view GROUP BY doc_id")
def _(i: Inputs):
    return reports.view_counts(i.views())


@query(
    "Q20_conversations_from_history",
    """SELECT conversation_id AS id, any_value(user_id) AS user_id, substring(arg_min(question, id), 1, 50) AS title, min(created_at) AS created_at, max(created_at) AS updated_at
    FROM v_qa GROUP BY conversation_id""",
)
def _(i: Inputs):
    return reports.conversations_from_history(i.history()).select("id", "user_id", "title", "created_at", "updated_at")


@query(
    "Q21_document_detail",
    """SELECT v.event_id, v.doc_id, title, coalesce(c.name, '') AS category, p.username AS uploader, d.status FROM v_view v JOIN v_document d ON d.id = v.doc_id
    JOIN v_ctx x ON x.user_id = v.user_id LEFT JOIN v_category c ON c.id = d.category_id LEFT JOIN v_user p ON p.id = d.upload_by
    WHERE x.is_admin OR d.upload_by = v.user_id OR coalesce(d.tenant_id = x.caller_tenant AND doc_level = 'public' AND min_level <= clearance, false)
      OR EXISTS (SELECT 1 FROM v_acl a WHERE a.document_id = v.doc_id AND a.user_id = v.user_id)""",
)
def _(i: Inputs):
    requests = i.views().select("event_id", "user_id", "doc_id")
    rows = reports.document_detail(requests, i.docs(), i.users(), i.grants(), i.categories())
    return rows.select("event_id", "doc_id", "title", F.coalesce("category", F.lit("")).alias("category"), "uploader", "status")
