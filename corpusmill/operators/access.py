"""Who may see what.

A caller sees a chunk or document if they are an administrator, own it, hold an
explicit grant, or share its tenant while it is public and within their
clearance. A caller without a tenant who is no administrator gets only what they
own or were granted.

No operator here forms all (user, document) pairs: counts come from
pre-aggregated classes, grants from equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.scale import NARROW_ROWS, at_most, ranked, small_side, stage, within

CONTEXT = ["is_admin", "user_id", "caller_tenant", "clearance"]


def permission_context(users: DataFrame) -> DataFrame:
    """One row per user: administrators are unrestricted, a missing clearance is 1."""
    admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    return users.select(
        F.col("id").alias("user_id"),
        admin.alias("is_admin"),
        F.when(~admin, F.col("tenant_id")).alias("caller_tenant"),
        F.when(admin, F.lit(None)).otherwise(effective_clearance(F.col("clearance_level"))).cast("int").alias("clearance"),
    )


def grant_counts(users: DataFrame, acl: DataFrame) -> DataFrame:
    """The permission context with the number of documents granted to each user."""
    granted = acl.distinct().groupBy("user_id").agg(F.count("*").alias("granted"))
    context = permission_context(users).join(granted, "user_id", "left")
    return context.withColumn(
        "granted", F.when(~F.col("is_admin"), F.coalesce(F.col("granted"), F.lit(0)))
    )


def effective_clearance(level: Column) -> Column:
    return F.coalesce(F.nullif(level, F.lit(0)), F.lit(1))


def open_to(
    is_admin: Column, user: Column, tenant: Column, clearance: Column, owner: Column, of_tenant: Column, level: Column, min_level: Column
) -> Column:
    """Visible without a grant; false, never null."""
    shared = (of_tenant == tenant) & (level == "public") & (F.coalesce(min_level, F.lit(1)) <= effective_clearance(clearance))
    return F.coalesce(is_admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False)) | F.coalesce(shared, F.lit(False))


def open_columns() -> Column:
    """``open_to`` over rows that carry both a chunk and a caller's context."""
    return open_to(
        F.col("is_admin"),
        F.col("user_id"),
        F.col("caller_tenant"),
        F.col("clearance"),
        F.col("owner_id"),
        F.col("tenant_id"),
        F.col("doc_level"),
        F.col("min_level"),
    )


def attach_grants(
    chunks: DataFrame, acl: DataFrame, callers: DataFrame, by: list[str] | None = None, callers_bound: int | None = None
) -> DataFrame:
    """Adds ``granted_to``: the callers of one query batch who hold a grant on the chunk's document.

    ``callers`` is a bounded batch, so each array is no longer than the batch. What they hold goes to
    the chunks while it is narrow; an index that lies in place is not shuffled for it.
    """
    by = by or []
    distinct = callers.select("user_id", *by).distinct()
    known = small_side(distinct) if callers_bound is None else at_most(distinct, callers_bound)
    held = (
        acl.join(known, "user_id")
        .groupBy(F.col("document_id").alias("doc_id"), *by)
        .agg(F.collect_set("user_id").alias("granted_to"))
    )
    return chunks.join(_narrow(held, known, acl, by), ["doc_id", *by], "left")


def _narrow(held: DataFrame, known: DataFrame, acl: DataFrame, by: list[str]) -> DataFrame:
    """``held`` with a broadcast hint if all grants behind it are few enough, so that no few rows with long arrays pass for small ones."""
    grants = acl.join(known, "user_id").select("document_id", "user_id", *by).distinct()
    return F.broadcast(held) if within(grants, NARROW_ROWS) else held


def visible_columns() -> Column:
    """``open_columns`` or a grant, over chunks that ``attach_grants`` prepared."""
    return open_columns() | F.coalesce(F.array_contains("granted_to", F.col("user_id")), F.lit(False))


def filter_visible(pairs: DataFrame, acl: DataFrame) -> DataFrame:
    """Rows (caller context, document columns) that the caller may see."""
    grants = acl.select(F.col("document_id").alias("doc_id"), "user_id").distinct().withColumn("_granted", F.lit(True))
    return (
        pairs.join(grants, ["doc_id", "user_id"], "left")
        .filter(open_columns() | F.coalesce("_granted", F.lit(False)))
        .drop("_granted")
    )


def _visible_to(rows: DataFrame, users: DataFrame, acl: DataFrame, user_id: int, doc: str, owner: str) -> DataFrame:
    """Rows one caller may see; the caller's context comes from one scalar subquery."""
    context = permission_context(users.filter(F.col("id") == user_id)).select(F.struct(*CONTEXT)).scalar()
    mine = (
        acl.filter(F.col("user_id") == user_id)
        .select(F.col("document_id").alias(doc), F.lit(True).alias("_granted"))
        .distinct()
    )
    seen = open_to(
        context["is_admin"],
        F.lit(user_id),
        context["caller_tenant"],
        context["clearance"],
        F.col(owner),
        F.col("tenant_id"),
        F.col("doc_level"),
        F.col("min_level"),
    )
    return rows.join(mine, doc, "left").filter(seen | F.coalesce("_granted", F.lit(False))).drop("_granted")


def visible_chunks(chunks: DataFrame, users: DataFrame, acl: DataFrame, user_id: int) -> DataFrame:
    """Chunks that one caller may see."""
    return _visible_to(chunks, users, acl, user_id, "doc_id", "owner_id")


def visible_docs(docs: DataFrame, users: DataFrame, acl: DataFrame, user_id: int) -> DataFrame:
    """Documents (keyed by ``id``) that one caller may see."""
    return _visible_to(docs, users, acl, user_id, "id", "upload_by")


def first_visible(
    rows: DataFrame, callers: DataFrame, acl: DataFrame, key: list[str], order: list[Column], n: int
) -> DataFrame:
    """The first ``n`` visible rows of each caller: (user_id, rank, key).

    Taken from the first of each (tenant, level) class, of each owner, of each
    grantee and overall, so no caller meets every row.
    """
    callers = small_side(callers)
    plain = callers.filter(~F.col("is_admin"))
    public = rows.filter(F.col("doc_level") == "public").withColumn("min_level", F.coalesce("min_level", F.lit(1)))
    classes = ranked(public, ["tenant_id", "min_level"], order, n)
    shared = classes.join(
        plain, (F.col("tenant_id") == F.col("caller_tenant")) & (F.col("min_level") <= effective_clearance(F.col("clearance")))
    )
    owned = ranked(rows.join(plain, F.col("owner_id") == F.col("user_id")), ["user_id"], order, n)
    grants = acl.select("user_id", F.col("document_id").alias("doc_id")).distinct().join(plain.select("user_id"), "user_id")
    granted = ranked(rows.select("doc_id", *[c for c in key if c != "doc_id"]).join(grants, "doc_id"), ["user_id"], order, n)
    first = rows.select(*key).orderBy(*order).limit(n).agg(F.collect_list(F.struct(*key)).alias("keys")).scalar()
    admins = callers.filter("is_admin").select("user_id", F.explode(first).alias("k")).select("user_id", "k.*")
    united = admins
    for part in [shared, owned, granted]:
        united = united.unionByName(part.select("user_id", *key))
    return ranked(united.distinct(), ["user_id"], order, n)


def visible_counts(chunks: DataFrame, users: DataFrame, acl: DataFrame) -> DataFrame:
    """Number of chunks each user may see, without forming (user, chunk) pairs.

    Chunks are first counted per document, documents per (tenant, level); a user
    adds their tenant's open classes, then the owned and granted documents that
    those classes do not contain.
    """
    context = permission_context(users)
    docs = chunks.groupBy("doc_id", "owner_id", "tenant_id", "doc_level", "min_level").agg(F.count("*").alias("n"))
    # One row per document, read four times below; the chunks are read once.
    docs = stage(docs, "chunks-per-document")
    classes = (
        docs.filter(F.col("doc_level") == "public")
        .groupBy("tenant_id", F.coalesce("min_level", F.lit(1)).alias("min_level"))
        .agg(F.sum("n").alias("n"))
    )
    tenants = classes.groupBy(F.col("tenant_id").alias("caller_tenant")).agg(
        F.collect_list(F.struct("min_level", "n")).alias("by_level")
    )
    own = (
        docs.join(context.filter(~F.col("is_admin")), F.col("owner_id") == F.col("user_id"))
        .filter(
            ~F.coalesce(
                (F.col("tenant_id") == F.col("caller_tenant"))
                & (F.col("doc_level") == "public")
                & (F.coalesce("min_level", F.lit(1)) <= F.col("clearance")),
                F.lit(False),
            )
        )
        .groupBy("user_id")
        .agg(F.sum("n").alias("own"))
    )
    granted = (
        acl.distinct()
        .join(context.filter(~F.col("is_admin")), "user_id")
        .join(docs, F.col("document_id") == F.col("doc_id"))
        .filter(~open_columns())
        .groupBy("user_id")
        .agg(F.sum("n").alias("granted"))
    )
    total = docs.agg(F.sum("n")).scalar()
    shared = F.aggregate(
        F.filter("by_level", lambda c: c["min_level"] <= F.col("clearance")),
        F.lit(0).cast("long"),
        lambda acc, c: acc + c["n"],
    )
    zero = F.lit(0).cast("long")
    counted = F.coalesce(shared, zero) + F.coalesce("own", zero) + F.coalesce("granted", zero)
    return (
        context.join(tenants, "caller_tenant", "left")
        .join(own, "user_id", "left")
        .join(granted, "user_id", "left")
        .select("user_id", F.when(F.col("is_admin"), F.coalesce(total, zero)).otherwise(counted).alias("visible"))
    )


def can_access(pairs: DataFrame, docs: DataFrame, users: DataFrame, acl: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (user_id, doc_id) pairs; unknown users or documents are refused."""
    grants = acl.select("user_id", F.col("document_id").alias("doc_id")).distinct().withColumn("_granted", F.lit(True))
    facts = docs.select(
        F.col("id").alias("doc_id"), F.col("upload_by").alias("owner_id"), "tenant_id", "doc_level", "min_level",
        F.lit(True).alias("_known"),
    )
    allowed = F.col("_known") & F.col("is_admin").isNotNull() & (open_columns() | F.coalesce("_granted", F.lit(False)))
    return (
        pairs.join(permission_context(users), "user_id", "left")
        .join(facts, "doc_id", "left")
        .join(grants, ["user_id", "doc_id"], "left")
        .select(*pairs.columns, F.coalesce(allowed, F.lit(False)).alias("allowed"))
    )


def acl_report(acl: DataFrame, users: DataFrame) -> DataFrame:
    """Grants with the user's name, newest first."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return acl.join(names, "user_id", "left").orderBy(F.desc("created_at"), "document_id", "user_id")


def can_manage(pairs: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``manageable``: administrators, or owners within the document's tenant."""
    people = users.select(F.col("id").alias("user_id"), (F.col("role") == "admin").alias("_admin"), F.col("tenant_id").alias("_tenant"))
    facts = docs.select(F.col("id").alias("doc_id"), "upload_by", "tenant_id")
    owner = (F.col("upload_by") == F.col("user_id")) & (F.col("tenant_id") == F.col("_tenant"))
    return (
        pairs.join(people, "user_id", "left")
        .join(facts, "doc_id", "left")
        .select(*pairs.columns, F.coalesce(F.col("tenant_id").isNotNull() & (F.col("_admin") | owner), F.lit(False)).alias("manageable"))
    )


def grantable_users(users: DataFrame, acl: DataFrame, document_id: int) -> DataFrame:
    """Users who hold no grant on the document."""
    held = acl.filter(F.col("document_id") == document_id).select(F.col("user_id").alias("id"))
    return users.join(held, "id", "left_anti").select("id", "username")


def active_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("status") == 1)
