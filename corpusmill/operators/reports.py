"""Reports over users, documents, answers, feedback and logins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import contains_keyword, json_ids, strip
from corpusmill.operators.access import can_access, visible_docs
from corpusmill.operators.scale import ranked, stage

NEW_CONVERSATION = "新对话"  # fixed value: title of a conversation without a question
INDENT = "— "  # fixed value: one level of a flattened category tree


def _one_row(parts: list[tuple[DataFrame, list[str]]]) -> list[Column]:
    """Columns of one-row frames as scalar subqueries."""
    return [df.select(name).scalar().alias(name) for df, names in parts for name in names]


def dashboard(users: DataFrame, docs: DataFrame, categories: DataFrame, history: DataFrame) -> DataFrame:
    people = users.agg(
        F.count("*").alias("users"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("role") == "user").alias("normal_users"),
    )
    papers = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("status") == "completed").alias("completed_docs"))
    groups = categories.agg(F.count("*").alias("categories"))
    asked = history.agg(F.count("*").alias("questions"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    rest = _one_row(
        [(papers, ["docs", "completed_docs"]), (groups, ["categories"]), (asked, ["questions", "tokens"])]
    )
    return people.select("users", "admins", "normal_users", *rest)


def _calendar(spark: SparkSession, end: str, days: int) -> DataFrame:
    day = F.explode(F.sequence(F.date_sub(F.to_date(F.lit(end)), days - 1), F.to_date(F.lit(end))))
    return spark.range(1).select(day.alias("day"))


def daily_stats(users: DataFrame, docs: DataFrame, history: DataFrame, end: str, days: int = 30) -> DataFrame:
    """New users, new documents and questions for each of ``days`` days up to ``end``, zeros included."""
    first = F.date_sub(F.to_date(F.lit(end)), days - 1)
    out = _calendar(users.sparkSession, end, days)
    for name, table in {"new_users": users, "new_docs": docs, "questions": history}.items():
        day = F.to_date("created_at")
        counts = table.filter(day.between(first, F.to_date(F.lit(end)))).groupBy(day.alias("day")).agg(F.count("*").alias(name))
        out = out.join(counts, "day", "left")
    return out.fillna(0, ["new_users", "new_docs", "questions"]).orderBy("day")


def category_counts(categories: DataFrame, docs: DataFrame, nonempty: bool = False) -> DataFrame:
    counts = docs.groupBy("category_id").agg(F.count("*").alias("doc_count"))
    out = categories.join(counts, F.col("id") == F.col("category_id"), "left").select(
        "id", "name", F.coalesce("doc_count", F.lit(0)).alias("doc_count")
    )
    if nonempty:
        out = out.filter(F.col("doc_count") > 0)
    return out.orderBy(F.desc("doc_count"), "id")


def user_activity(users: DataFrame, history: DataFrame, limit: int = 10) -> DataFrame:
    """Users who asked most, those without questions included."""
    counts = history.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("question_count"))
    return (
        users.select("id", "username")
        .join(counts, "id", "left")
        .fillna(0, ["question_count"])
        .orderBy(F.desc("question_count"), "id")
        .limit(limit)
    )


def token_usage(history: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """Questions and tokens per day since ``days`` days before ``asof``, newest day first."""
    since = F.to_timestamp(F.lit(asof)) - F.make_dt_interval(F.lit(days))
    recent = history.filter((F.col("created_at") >= since) & (F.col("created_at") <= F.to_timestamp(F.lit(asof))))
    return (
        recent.groupBy(F.to_date("created_at").alias("day"))
        .agg(
            F.count("*").alias("questions"),
            F.sum("token_count").alias("total_tokens"),
            F.round(F.avg("token_count"), 4).alias("avg_tokens"),
        )
        .orderBy(F.desc("day"))
    )


def _page(df: DataFrame, keys: list[str], page: int, limit: int, after: tuple | None = None) -> DataFrame:
    """One page, greatest keys first, with the total number of rows. The keys must tell all rows apart.

    With ``after``, the keys of the last row that was shown, the page begins below it: however far down, no task
    holds more than one page, and rows that arrived meanwhile don't shift it.
    """
    total = df.agg(F.count("*")).scalar()
    order = [F.desc(k) for k in keys]
    if after is None:
        return df.orderBy(*order).offset((page - 1) * limit).limit(limit).withColumn("total", total)
    below = F.struct(*[F.col(k) for k in keys]) < F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
    return df.filter(below).orderBy(*order).limit(limit).withColumn("total", total)


def login_log(
    logs: DataFrame, keyword: str | None = None, page: int = 1, limit: int = 20, wildcards: bool = False, after: tuple | None = None
) -> DataFrame:
    rows = logs if not keyword else logs.filter(contains_keyword(F.col("username"), keyword, wildcards))
    return _page(rows, ["created_at", "id"], page, limit, after)


def system_metrics(docs: DataFrame, users: DataFrame, history: DataFrame, feedback: DataFrame) -> DataFrame:
    """Documents by status, totals and satisfaction (null without feedback) in one row."""
    by_status = docs.agg(
        *[F.count_if(F.col("status") == s).alias(f"docs_{s}") for s in ["pending", "processing", "completed", "failed"]],
        F.count("*").alias("docs"),
    )
    people = users.agg(F.count("*").alias("users"))
    asked = history.agg(F.count("*").alias("questions"))
    votes = feedback.agg(
        F.count_if(F.col("rating") == 1).alias("likes"),
        F.count_if(F.col("rating") == -1).alias("dislikes"),
        F.count("*").alias("feedback"),
    ).withColumn("satisfaction", F.round(F.try_divide("likes", "feedback"), 4))
    rest = _one_row(
        [(people, ["users"]), (asked, ["questions"]), (votes, ["likes", "dislikes", "feedback", "satisfaction"])]
    )
    return by_status.select("*", *rest)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Likes, dislikes and satisfaction (0 without feedback)."""
    return feedback.agg(
        F.count_if(F.col("rating") == 1).alias("likes"),
        F.count_if(F.col("rating") == -1).alias("dislikes"),
        F.count("*").alias("total"),
    ).withColumn("satisfaction", F.round(F.col("likes") / F.greatest("total", F.lit(1)), 4))


def feedback_report(feedback: DataFrame, history: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most recent dislikes with question, head of the answer and user."""
    disliked = feedback.filter(F.col("rating") == -1)
    answers = history.select(F.col("id").alias("history_id"), "question", F.substring(F.coalesce("answer", F.lit("")), 1, 300).alias("answer"))
    names = users.select(F.col("id").alias("user_id"), "username")
    recent = (
        disliked.join(answers.select("history_id"), "history_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    )
    # At most n rows from here on.
    return (
        answers.join(F.broadcast(recent), "history_id")
        .join(names, "user_id", "left")
        .select("id", "history_id", "question", "answer", "username", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def _named(df: DataFrame, table: DataFrame, key: str, name: str, source: str = "name") -> DataFrame:
    return df.join(table.select(F.col("id").alias(key), F.col(source).alias(name)), key, "left")


def list_documents(
    docs: DataFrame,
    users: DataFrame,
    acl: DataFrame,
    categories: DataFrame,
    tenants: DataFrame,
    user_id: int,
    keyword: str | None = None,
    category_id: int | None = None,
    status: str | None = None,
    page: int = 1,
    limit: int = 10,
    wildcards: bool = False,
    after: tuple | None = None,
) -> DataFrame:
    """One page of the documents a caller may see; names are joined to that page only.

    Contents are read once: what the page and its total need of the documents that match is kept.
    """
    seen = visible_docs(docs, users, acl, user_id)
    if category_id is not None:
        seen = seen.filter(F.col("category_id") == category_id)
    if keyword:
        seen = seen.filter(
            contains_keyword(F.col("title"), keyword, wildcards) | contains_keyword(F.col("content"), keyword, wildcards)
        )
    if status:
        seen = seen.filter(F.col("status") == status)
    slim = seen.select("id", "title", "category_id", "upload_by", "tenant_id", "doc_level", "min_level", "file_size", "status")
    rows = _page(stage(slim, "matching-documents") if keyword else slim, ["id"], page, limit, after)
    rows = _named(rows, categories, "category_id", "category")
    rows = _named(rows, users, "upload_by", "uploader", "username")
    return _named(rows, tenants, "tenant_id", "tenant")


def qa_history(history: DataFrame, users: DataFrame, user_id: int, page: int = 1, limit: int = 10, after: tuple | None = None) -> DataFrame:
    """One page of a user's answers, or of all for an administrator, with cited ids parsed."""
    admin = users.filter((F.col("id") == user_id) & (F.col("role") == "admin")).agg(F.count("*") > 0).scalar()
    rows = history.filter(admin | (F.col("user_id") == user_id))
    shown = _page(rows, ["created_at", "id"], page, limit, after)
    ids = F.coalesce(F.from_json("documents", "array<string>"), F.array().cast("array<string>"))
    return _named(shown, users, "user_id", "username", "username").select(
        "id", "user_id", "username", "question", "answer", ids.alias("document_ids"), "created_at", "total"
    )


def conversation_list(conversations: DataFrame, history: DataFrame, user_id: int | None = None) -> DataFrame:
    """Conversations with message count and last question; one user's come most recently used first."""
    own = conversations if user_id is None else conversations.filter(F.col("user_id") == user_id)
    used = history.groupBy(F.col("conversation_id").alias("id")).agg(
        F.count("*").alias("message_count"), F.max_by("question", F.struct("created_at", F.col("id"))).alias("last_question")
    )
    rows = own.join(used, "id", "left").select(
        "id", "user_id", "title", "updated_at",
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("last_question", F.lit("")).alias("last_question"),
    )
    return rows if user_id is None else rows.orderBy(F.desc("updated_at"), "id")


def transcript(history: DataFrame, docs: DataFrame, conversation_id: int | None = None) -> DataFrame:
    """Messages, each with its cited documents as ordered [{id, title}]; one conversation's come by time."""
    rows = history if conversation_id is None else history.filter(F.col("conversation_id") == conversation_id)
    titles = docs.select(F.col("id").alias("cited"), "title")
    cited = rows.select("id", F.posexplode(json_ids(F.col("documents"))).alias("pos", "cited"))
    named = (
        cited.join(titles, "cited", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("cited").alias("id"), F.coalesce("title", F.lit("")).alias("title")))).alias("d"))
        .select("id", F.transform("d", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("documents"))
    )
    none = F.array().cast("array<struct<id:bigint,title:string>>")
    out = (
        rows.drop("documents")
        .join(named, "id", "left")
        .select("conversation_id", "id", "question", "answer", "created_at", F.coalesce("documents", none).alias("documents"))
    )
    return out if conversation_id is None else out.orderBy("created_at", "id")


def recent_turns(history: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` turns of each conversation with ``turn_no`` counting from the oldest of them."""
    last = ranked(history, ["conversation_id"], [F.desc("created_at"), F.desc("id")], n, "back")
    numbered = ranked(last, ["conversation_id"], [F.desc("back")], name="turn_no")
    return numbered.select("conversation_id", "turn_no", "id", "question", "answer")


def turns_array(history: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` turns of each conversation as array<struct<question, answer>>, oldest first."""
    turns = F.array_sort(F.collect_list(F.struct("turn_no", "question", "answer")))
    plain = F.transform(turns, lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer")))
    return recent_turns(history, n).groupBy("conversation_id").agg(plain.alias("turns"))


def category_tree(categories: DataFrame) -> DataFrame:
    """Categories reachable from the roots with depth and pre-order path; siblings by (sort_order, id)."""
    return categories.sparkSession.sql(
        """
        WITH RECURSIVE tree AS (
          SELECT id, name, parent_id, 0 AS depth, array(struct(sort_order, id)) AS path
          FROM {categories} WHERE parent_id = 0
          UNION ALL
          SELECT c.id, c.name, c.parent_id, t.depth + 1, concat(t.path, array(struct(c.sort_order, c.id)))
          FROM {categories} c JOIN tree t ON c.parent_id = t.id
        )
        SELECT id, name, parent_id, depth, path FROM tree
        """,
        categories=categories,
    )


def category_flat(categories: DataFrame) -> DataFrame:
    """The tree in pre-order; names are indented by depth. Categories are a small dimension."""
    tree = category_tree(categories)
    return tree.orderBy("path").select("id", F.concat(F.repeat(F.lit(INDENT), F.col("depth")), "name").alias("label"), "depth")


def list_users(
    users: DataFrame, tenants: DataFrame, keyword: str | None = None, page: int = 1, limit: int = 10, wildcards: bool = False, after: tuple | None = None
) -> DataFrame:
    """One page of users whose user name or real name holds the keyword."""
    names = [c for c in ["username", "real_name"] if c in users.columns]
    rows = users
    if keyword:
        match = F.lit(False)
        for name in names:
            match = match | contains_keyword(F.coalesce(name, F.lit("")), keyword, wildcards)
        rows = users.filter(match)
    return _named(_page(rows, ["id"], page, limit, after), tenants, "tenant_id", "tenant")


def profiles(users: DataFrame, tenants: DataFrame) -> DataFrame:
    return _named(users, tenants, "tenant_id", "tenant").select("id", "username", "role", "tenant_id", "tenant", "clearance_level")


def deletable_categories(categories: DataFrame, docs: DataFrame) -> DataFrame:
    """Categories without child categories and without documents."""
    parents = categories.select(F.col("parent_id").alias("id")).distinct()
    filled = docs.select(F.col("category_id").alias("id")).distinct()
    return categories.join(parents, "id", "left_anti").join(filled, "id", "left_anti").select("id", "name")


def view_counts(views: DataFrame) -> DataFrame:
    return views.groupBy("doc_id").agg(F.count("*").alias("view_count"))


def conversations_from_history(history: DataFrame) -> DataFrame:
    """One conversation per id: title from its first question, updated at its last activity."""
    first = F.substring(strip(F.coalesce("question", F.lit(""))), 1, 50)
    rolled = history.groupBy(F.col("conversation_id").alias("id")).agg(
        F.min_by(first, F.struct("created_at", "id")).alias("title"),
        F.min_by("user_id", F.struct("created_at", "id")).alias("user_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )
    return rolled.withColumn("title", F.when(F.col("title") == "", NEW_CONVERSATION).otherwise(F.col("title")))


def document_detail(
    requests: DataFrame, docs: DataFrame, users: DataFrame, acl: DataFrame, categories: DataFrame
) -> DataFrame:
    """Details for each (user_id, doc_id) request that is allowed."""
    allowed = can_access(requests, docs, users, acl).filter("allowed").drop("allowed")
    detail = docs.select(F.col("id").alias("doc_id"), "title", "category_id", "upload_by", "status", "file_size")
    rows = allowed.join(detail, "doc_id")
    rows = _named(rows, categories, "category_id", "category")
    return _named(rows, users, "upload_by", "uploader", "username")


