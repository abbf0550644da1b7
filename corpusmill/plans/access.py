"""Queries for access control (A1-A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import access
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.oracle_views import GRANTED, OPEN
from corpusmill.plans.registry import query

CALLER = 7
DOC_OPEN = OPEN.replace("owner_id", "upload_by")


@query(
    "A1_visible_chunk_counts",
    f"""SELECT c.user_id, coalesce(n, 0) AS visible FROM v_ctx c LEFT JOIN (
      SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM v_ctx c, (
        SELECT doc_id, owner_id, tenant_id, doc_level, min_level, count(*) AS n FROM v_chunk GROUP BY ALL) d
      WHERE {OPEN} OR {GRANTED.format(user='c.user_id')} GROUP BY user_id) USING (user_id)""",
)
def _(i: Inputs):
    return access.visible_counts(i.chunks(), i.users(), i.grants())


@query(
    "A1_visible_chunks",
    f"""SELECT doc_id, chunk_index, parent_id FROM v_chunk, v_ctx c WHERE user_id = {CALLER} AND ({OPEN} OR {GRANTED.format(user='c.user_id')})""",
)
def _(i: Inputs):
    return access.visible_chunks(i.chunks(), i.users(), i.grants(), CALLER).select("doc_id", "chunk_index", "parent_id")


@query(
    "A2_visible_docs",
    f"""SELECT id, title FROM (SELECT *, id AS doc_id FROM v_document), v_ctx c
    WHERE user_id = {CALLER} AND ({DOC_OPEN} OR {GRANTED.format(user='c.user_id')})""",
)
def _(i: Inputs):
    return access.visible_docs(i.docs(), i.users(), i.grants(), CALLER).select("id", "title")


@query(
    "A3_permission_context",
    """SELECT c.user_id, is_admin, coalesce(caller_tenant, -1) AS caller_tenant, CAST(coalesce(clearance, -1) AS INT) AS clearance,
      CASE WHEN is_admin THEN -1 ELSE coalesce(granted, 0) END AS granted
    FROM v_ctx c LEFT JOIN (SELECT user_id, count(DISTINCT document_id) AS granted FROM v_acl GROUP BY user_id) g USING (user_id)""",
)
def _(i: Inputs):
    rows = access.grant_counts(i.users(), i.grants())
    return rows.select(
        "user_id", "is_admin", F.coalesce("caller_tenant", F.lit(-1)).alias("caller_tenant"),
        F.coalesce("clearance", F.lit(-1)).alias("clearance"), F.coalesce("granted", F.lit(-1).cast("long")).alias("granted"),
    )


@query(
    "A4_can_access",
    f"""SELECT v.event_id, v.user_id, v.doc_id,
      coalesce(d.id IS NOT NULL AND c.user_id IS NOT NULL AND ({DOC_OPEN.replace('user_id', 'v.user_id')} OR {GRANTED.format(user='v.user_id').replace('= doc_id', '= v.doc_id')}), false) AS allowed
    FROM v_view v LEFT JOIN v_document d ON d.id = v.doc_id LEFT JOIN v_ctx c ON c.user_id = v.user_id""",
)
def _(i: Inputs):
    return access.can_access(i.views().select("event_id", "user_id", "doc_id"), i.docs(), i.users(), i.grants())


@query(
    "A5_acl_report",
    "SELECT a.document_id, a.user_id, username, a.created_at FROM v_acl a LEFT JOIN v_user u ON u.id = a.user_id",
)
def _(i: Inputs):
    return access.acl_report(i.acl(), i.users()).select("document_id", "user_id", "username", "created_at")


@query(
    "A6_can_manage",
    """SELECT v.event_id, coalesce(d.id IS NOT NULL AND (u.role = 'admin' OR (d.upload_by = v.user_id AND d.tenant_id = u.tenant_id)), false) AS manageable
    FROM v_view v LEFT JOIN v_document d ON d.id = v.doc_id LEFT JOIN v_user u ON u.id = v.user_id""",
)
def _(i: Inputs):
    pairs = i.views().select("event_id", "user_id", "doc_id")
    return access.can_manage(pairs, i.docs(), i.users()).select("event_id", "manageable")


@query(
    "A7_grantable_users",
    "SELECT id, username FROM v_user WHERE id NOT IN (SELECT user_id FROM v_acl WHERE document_id = 0)",
)
def _(i: Inputs):
    return access.grantable_users(i.users(), i.acl(), 0)


@query("A8_active_users", "SELECT id, username FROM v_user WHERE status = 1")
def _(i: Inputs):
    return access.active_users(i.users()).select("id", "username")
