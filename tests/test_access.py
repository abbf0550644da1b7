import itertools

from pyspark.sql import functions as F

from corpusmill.operators import access


def test_truth_table(spark):
    """Role, ownership, grant, tenant, level and clearance in all combinations."""
    docs, users, acl, wanted = [], [], [], {}
    cases = itertools.product([True, False], [True, False], [True, False], ["same", "other", "none"], ["public", "private"], [1, 3, None], [0, 2, None])
    for n, (admin, owner, granted, tenant, level, least, clearance) in enumerate(cases):
        mine = {"same": 1, "other": 2, "none": None}[tenant]
        docs.append((n, 1, level, least, n if owner else -5))
        users.append((n, "admin" if admin else "user", mine, clearance))
        if granted:
            acl.append((n, n))
        shared = mine == 1 and level == "public" and (1 if least is None else least) <= (clearance or 1)
        wanted[n] = admin or owner or granted or shared
    docs = spark.createDataFrame(docs, "id long, tenant_id int, doc_level string, min_level int, upload_by long")
    users = spark.createDataFrame(users, "id long, role string, tenant_id int, clearance_level int")
    acl = spark.createDataFrame(acl, "document_id long, user_id long")
    pairs = docs.select(F.col("id").alias("user_id"), F.col("id").alias("doc_id"))
    found = {r.user_id: r.allowed for r in access.can_access(pairs, docs, users, acl).collect()}
    assert found == wanted
    rows = docs.withColumnsRenamed({"id": "doc_id", "upload_by": "owner_id"})
    context = access.permission_context(users)
    paired = rows.join(context, rows["doc_id"] == context["user_id"])
    assert {r.doc_id for r in access.filter_visible(paired, acl).collect()} == {n for n, ok in wanted.items() if ok}
    attached = access.attach_grants(rows, acl, context).join(context, F.col("doc_id") == F.col("user_id"))
    assert {r.doc_id for r in attached.filter(access.visible_columns()).collect()} == {n for n, ok in wanted.items() if ok}


def test_counts_agree_with_lists_and_admins_see_most(spark):
    users = spark.createDataFrame(
        [(1, "admin", None, None), (2, "user", 1, 2), (3, "user", 1, 4), (4, "user", None, 4), (5, "user", 2, 0)],
        "id long, role string, tenant_id int, clearance_level int",
    )
    rows = [(d, c, 1 + d % 3, "private" if d % 4 == 0 else "public", 1 + d % 4, d % 6) for d in range(30) for c in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, tenant_id int, doc_level string, min_level int, owner_id long")
    acl = spark.createDataFrame([(d, 4) for d in range(0, 30, 5)] + [(0, 2), (0, 2), (7, 3)], "document_id long, user_id long")
    counts = {r.user_id: r.visible for r in access.visible_counts(chunks, users, acl).collect()}
    for user in range(1, 6):
        assert access.visible_chunks(chunks, users, acl, user).count() == counts[user]
    assert counts[1] == 90 and all(n <= 90 for n in counts.values())
    raised = users.withColumn("clearance_level", F.lit(4))
    more = {r.user_id: r.visible for r in access.visible_counts(chunks, raised, acl).collect()}
    assert all(more[u] >= counts[u] for u in counts)


def test_grants_of_many_documents_leave_the_index_in_place(spark):
    """Rows of an index are not shuffled for the grants of more documents than a side of any kind may have."""
    chunks = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    acl = spark.range(0, 120_000, 2).select(F.col("id").alias("document_id"), (F.col("id") % 3).alias("user_id"))
    callers = spark.createDataFrame([(0,), (1,), (2,)], "user_id long")
    attached = access.attach_grants(chunks, acl, callers)
    assert "hint" in attached._jdf.queryExecution().logical().toString().lower()
    assert attached.filter("size(granted_to) = 1").count() == 60_000
