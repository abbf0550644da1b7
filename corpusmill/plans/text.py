"""Queries for text normalisation, tables, chunking and context texts (T1-T26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import tables, text
from corpusmill.operators import chunking, reports, retrieval
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.oracle_views import WORD, normalized, strip
from corpusmill.plans.registry import query


def md5(col):
    return F.md5(col.cast("binary"))


@query(
    "T1_normalize_cjk",
    "SELECT doc_id, md5(concat('一名以上 ', text)) AS digest, length(text) + 5 AS chars FROM documents",
)
def _(i: Inputs):
    broken = F.concat(F.lit("一名\n 以上 "), F.col("text"))
    fixed = text.normalize_cjk(broken)
    return i.table("documents").select("doc_id", md5(fixed).alias("digest"), F.length(fixed).cast("long").alias("chars"))


@query(
    "T2_normalize_question",
    f"SELECT conv_id, turn, {normalized('text')} AS question FROM conversations",
)
def _(i: Inputs):
    return i.table("conversations").select("conv_id", "turn", text.normalize_question(F.col("text")).alias("question"))


@query(
    "T3_reuse_key",
    f"""SELECT id, concat_ws('::', {normalized('question')}, 't' || v_user.tenant_id, CASE WHEN turn > 0 THEN 'u' || v_qa.user_id END) AS key
    FROM v_qa JOIN (SELECT id AS user_id, tenant_id FROM v_user) v_user USING (user_id)""",
)
def _(i: Inputs):
    people = i.users().select(F.col("id").alias("user_id"), "tenant_id")
    key = text.reuse_key(F.col("question"), F.col("tenant_id"), F.when(F.col("turn") > 0, F.col("user_id")))
    return i.history().join(people, "user_id").select("id", key.alias("key"))


@query(
    "T4_parse_stats",
    """SELECT doc_id, count(*) FILTER (kind = 'text') AS text_blocks, count(*) FILTER (kind = 'table') AS table_count,
       count(*) FILTER (kind = 'image') AS image_count, CAST(max(page) AS BIGINT) AS pages, '' AS warning FROM v_element GROUP BY doc_id""",
)
def _(i: Inputs):
    stats = chunking.parse_stats(i.element_docs())
    return stats.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ["text_blocks", "table_count", "image_count", "pages"]],
        F.coalesce("warning", F.lit("")).alias("warning"),
    )


@query("T5_element_order", "SELECT doc_id, ord, kind, md5(text) AS digest, page FROM v_element")
def _(i: Inputs):
    rows = chunking.with_order(i.element_docs())
    return rows.select("doc_id", F.col("order").alias("ord"), "kind", md5(F.col("text")).alias("digest"), "page")


@query("T6_grid_to_markdown", "SELECT doc_id, md5(markdown) AS digest, length(markdown) AS chars FROM v_markdown")
def _(i: Inputs):
    return i.markdown().select("doc_id", md5(F.col("markdown")).alias("digest"), F.length("markdown").cast("long").alias("chars"))


@query(
    "T7_split_tables",
    """SELECT doc_id, CAST(piece AS INT) AS piece, md5(text) AS digest FROM (
         SELECT doc_id, 0 AS piece, markdown AS text FROM v_markdown
         WHERE length(markdown) <= 300 OR length(markdown) - length(replace(markdown, chr(10), '')) < 2
         UNION ALL
         SELECT doc_id, piece, concat(any_value(head), chr(10), string_agg(line, chr(10) ORDER BY line_no)) FROM pieces GROUP BY doc_id, piece)""",
    """heads AS (
         SELECT doc_id, concat(line, chr(10), rule) AS head, length(line) + length(rule) AS chars
         FROM v_table_line JOIN v_rule USING (doc_id) JOIN v_markdown USING (doc_id)
         WHERE line_no = 0 AND length(markdown) > 300),
       pieces AS (
         SELECT l.doc_id, l.line_no, l.line, h.head, h.chars, 0 AS piece, h.chars + length(l.line) + 1 AS used, 1 AS held
         FROM v_table_line l JOIN heads h USING (doc_id) WHERE l.line_no = 1
         UNION ALL
         SELECT l.doc_id, l.line_no, l.line, p.head, p.chars,
                CASE WHEN p.used + length(l.line) + 1 > 300 OR p.held >= 10 THEN p.piece + 1 ELSE p.piece END,
                CASE WHEN p.used + length(l.line) + 1 > 300 OR p.held >= 10 THEN p.chars ELSE p.used END + length(l.line) + 1,
                CASE WHEN p.used + length(l.line) + 1 > 300 OR p.held >= 10 THEN 1 ELSE p.held + 1 END
         FROM pieces p JOIN v_table_line l ON l.doc_id = p.doc_id AND l.line_no = p.line_no + 1)""",
)
def _(i: Inputs):
    pieces = i.markdown().select("doc_id", F.posexplode(tables.split_table(F.col("markdown"))).alias("piece", "text"))
    return pieces.select("doc_id", "piece", md5(F.col("text")).alias("digest"))


UNITS = f"""
    el AS (SELECT *, CASE WHEN kind = 'table' THEN 'table' WHEN {strip('text')} = '' THEN 'skip'
                          WHEN kind = 'image' OR length(text) < 300 THEN 'short' ELSE 'long' END AS class FROM v_element),
    walk AS (
      SELECT doc_id, -1 AS ord, CAST('' AS VARCHAR) AS class, CAST('' AS VARCHAR) AS text, 0 AS page, CAST(0 AS BIGINT) AS unit, CAST(0 AS BIGINT) AS next, CAST(0 AS BIGINT) AS held, false AS open
      FROM documents
      UNION ALL
      SELECT e.doc_id, e.ord, e.class, e.text, e.page,
             CASE WHEN e.class = 'short' AND NOT (w.open AND w.held + length(e.text) > 300) THEN w.next ELSE w.next + w.open::INT END,
             CASE e.class WHEN 'skip' THEN w.next WHEN 'table' THEN w.next + w.open::INT + 1
               WHEN 'long' THEN w.next + w.open::INT + (length(e.text) + 299) // 300
               ELSE CASE WHEN w.open AND w.held + length(e.text) > 300 THEN w.next + 1 ELSE w.next END END,
             CASE e.class WHEN 'skip' THEN w.held WHEN 'short' THEN CASE WHEN w.open AND w.held + length(e.text) <= 300 THEN w.held ELSE 0 END + length(e.text) ELSE 0 END,
             CASE e.class WHEN 'skip' THEN w.open ELSE e.class = 'short' END
      FROM walk w JOIN el e ON e.doc_id = w.doc_id AND e.ord = w.ord + 1),
    units AS (
      SELECT doc_id, unit, 'text' AS kind, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, arg_min(page, ord) AS page FROM walk WHERE class = 'short' GROUP BY ALL
      UNION ALL SELECT doc_id, unit, 'table', {strip('text')}, page FROM walk WHERE class = 'table'
      UNION ALL SELECT doc_id, unit + k, 'text', substring(text, CAST(k * 300 + 1 AS INT), 300), page
        FROM walk, LATERAL unnest(range(0, (length(text) + 299) // 300)) u(k) WHERE class = 'long')"""


@query("T8_atomic_units", "SELECT doc_id, CAST(unit AS INT) AS unit, kind, md5(text) AS digest, page FROM units", UNITS)
def _(i: Inputs):
    units = chunking.atomic_units(F.col("elements"))
    rows = i.element_docs().select("doc_id", F.posexplode(units).alias("unit", "u"))
    return rows.select("doc_id", "unit", "u.kind", md5(F.col("u.text")).alias("digest"), "u.page")


@query("T9_recursive_split")
def _(i: Inputs):
    pieces = F.get(chunking.recursive_split(F.array("text"), 300, 30), F.lit(0))
    rows = i.documents().select("doc_id", F.posexplode(pieces).alias("piece", "text"))
    return rows.select("doc_id", "piece", F.length("text").alias("chars"), md5(F.col("text")).alias("digest"))


@query(
    "T10_parent_windows",
    """SELECT doc_id, CAST(window_no AS INT) AS window_no, md5(string_agg(text, chr(10) || chr(10) ORDER BY unit)) AS digest, count(*) AS units
    FROM packed JOIN units USING (doc_id, unit) GROUP BY doc_id, window_no""",
    UNITS
    + """,
    packed AS (
      SELECT doc_id, unit, 0 AS window_no, length(text) AS used FROM units WHERE unit = 0
      UNION ALL
      SELECT u.doc_id, u.unit, CASE WHEN p.used + length(u.text) > 1500 THEN p.window_no + 1 ELSE p.window_no END,
             CASE WHEN p.used + length(u.text) > 1500 THEN 0 ELSE p.used END + length(u.text)
      FROM packed p JOIN units u ON u.doc_id = p.doc_id AND u.unit = p.unit + 1)""",
)
def _(i: Inputs):
    windows = chunking.parent_windows(chunking.atomic_units(F.col("elements")))
    rows = i.element_docs().select("doc_id", F.posexplode(windows).alias("window_no", "units"))
    joined = F.array_join(F.transform("units", lambda u: u["text"]), "\n\n")
    return rows.select("doc_id", "window_no", md5(joined).alias("digest"), F.size("units").cast("long").alias("units"))


@query(
    "T11_build_chunks",
    "SELECT doc_id, chunk_index, window_no, parent_id, md5(text) AS digest, tenant_id, doc_level, min_level, owner_id FROM v_chunk",
)
def _(i: Inputs):
    chunks, _parents = chunking.build_chunks_text(i.text_docs())
    return chunks.select(
        "doc_id", "chunk_index", "window_no", "parent_id", md5(F.col("text")).alias("digest"),
        F.col("tenant_id").cast("long").alias("tenant_id"), "doc_level", F.col("min_level").cast("long").alias("min_level"), "owner_id",
    )


@query("T11_build_parents", "SELECT doc_id, window_no, parent_id, md5(text) AS digest FROM v_parent")
def _(i: Inputs):
    _chunks, parents = chunking.build_chunks_text(i.text_docs())
    return parents.select("doc_id", "window_no", "parent_id", md5(F.col("text")).alias("digest"))


@query("T11_build_chunks_from_elements")
def _(i: Inputs):
    chunks, _parents = chunking.build_chunks(i.element_docs())
    return chunks.select("doc_id", "chunk_index", "window_no", "kind", "page", md5(F.col("text")).alias("digest"))


@query("T12_build_chunks_plain")
def _(i: Inputs):
    chunks, _parents = chunking.build_chunks_plain(i.text_docs())
    return chunks.select("doc_id", "chunk_index", "window_no", "parent_id", md5(F.col("text")).alias("digest"))


@query("T13_build_chunks_flat")
def _(i: Inputs):
    chunks, _parents = chunking.build_chunks_flat(i.text_docs())
    return chunks.select("doc_id", "chunk_index", "parent_id", md5(F.col("text")).alias("digest"))


@query(
    "T14_content_preview",
    f"""SELECT doc_id, md5(content) AS digest, length(content) AS chars FROM (
      SELECT d.doc_id, coalesce({strip("e.content")}, '') AS content FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS content FROM v_element
        WHERE kind IN ('text', 'table') AND {strip('text')} <> '' GROUP BY doc_id) e USING (doc_id))""",
)
def _(i: Inputs):
    rows = chunking.content_preview(i.element_docs())
    return rows.select("doc_id", md5(F.col("content")).alias("digest"), F.length("content").cast("long").alias("chars"))


@query(
    "T15_display_preview",
    f"""SELECT id AS doc_id, small, total_length, md5(CASE WHEN small THEN body ELSE substring(body, 1, 2000) END) AS digest,
      NOT small AND total_length > 2000 AS truncated
    FROM (SELECT id, file_size > 0 AND file_size <= 4096 AS small, {strip('content')} AS body, length({strip('content')}) AS total_length FROM v_document)""",
)
def _(i: Inputs):
    docs = i.docs().withColumnRenamed("id", "doc_id")
    rows = chunking.display_preview(docs, small_bytes=4096)
    return rows.select("doc_id", "small", F.col("total_length").cast("long").alias("total_length"), md5(F.col("text")).alias("digest"), "truncated")


@query(
    "T16_rebuild_content",
    f"""SELECT doc_id, md5(coalesce(string_agg(body, chr(10) ORDER BY window_no) FILTER (body <> ''), '')) AS digest
    FROM (SELECT doc_id, window_no, {strip('text')} AS body FROM v_parent) GROUP BY doc_id""",
)
def _(i: Inputs):
    rows = chunking.rebuild_content(i.chunks(), i.parents())
    return rows.select("doc_id", md5(F.col("content")).alias("digest"))


@query(
    "T17_tokenize",
    f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}')) AS tokens,
      md5(array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ')) AS digest,
      md5(array_to_string(regexp_extract_all(text, '{WORD}'), ' ')) AS cased FROM documents""",
)
def _(i: Inputs):
    tokens, cased = text.tokenize(F.col("text")), text.tokenize(F.col("text"), keep_case=True)
    return i.documents().select(
        "doc_id", F.size(tokens).cast("long").alias("tokens"), md5(F.array_join(tokens, " ")).alias("digest"),
        md5(F.array_join(cased, " ")).alias("cased"),
    )


@query(
    "T18_split_facts",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INT) AS pos, fact FROM (
      SELECT id, k AS pos, {strip('parts[k]')} AS fact
      FROM (SELECT id, regexp_split_to_array(answer, '[；;。!\\n]') AS parts FROM v_qa) t, LATERAL unnest(range(1, len(parts) + 1)) u(k))
    WHERE length(fact) >= 2""",
)
def _(i: Inputs):
    return i.history().select("id", F.posexplode(text.split_facts(F.col("answer"))).alias("pos", "fact"))


LINES = f"""concat_ws(chr(10), CASE WHEN {strip('question')} <> '' THEN '用户：' || substring({strip('question')}, 1, 200) END,
    CASE WHEN {strip('answer')} <> '' THEN '助手：' || substring({strip('answer')}, 1, 300) END)"""


@query(
    "T19_dialogue_text",
    f"""SELECT conversation_id, string_agg(lines, chr(10) ORDER BY created_at) AS dialogue
    FROM (SELECT *, {LINES} AS lines, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back FROM v_qa)
    WHERE back <= 3 GROUP BY conversation_id""",
)
def _(i: Inputs):
    turns = reports.turns_array(i.history(), 3)
    return turns.select("conversation_id", text.dialogue_text(F.col("turns")).alias("dialogue"))


@query(
    "T20_build_prompt",
    """SELECT q.query_id, md5(concat('基于以下文档内容回答用户问题。如果文档中没有相关信息，请说明不知道。', chr(10), chr(10),
      '对话历史（供理解当前问题的指代与语境，不要直接复述）:', chr(10), '无', chr(10), chr(10), '文档内容:', chr(10), coalesce(context, ''),
      chr(10), chr(10), '用户问题: ', question, chr(10), chr(10), '请根据文档内容给出回答：')) AS digest, coalesce(length(context), 0) AS context_chars
    FROM v_question q LEFT JOIN (
      SELECT query_id, string_agg(concat('文档', place, ':', chr(10), content), chr(10) || chr(10) ORDER BY place) AS context
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM v_hits) GROUP BY query_id) c USING (query_id)""",
)
def _(i: Inputs):
    hits = retrieval.expand_parents(i.cut(), i.parents())
    prompts = retrieval.build_prompt(i.questions(), hits)
    context = retrieval.context_text(hits).select("query_id", F.length("context").cast("long").alias("n"))
    return prompts.join(context, "query_id", "left").select(
        "query_id", md5(F.col("prompt")).alias("digest"), F.coalesce("n", F.lit(0)).alias("context_chars")
    )


@query(
    "T21_format_size",
    """SELECT id, CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE)
      WHEN size < 1048576 THEN printf('%.2f KB', size / 1024e0) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576e0)
      WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824e0) ELSE printf('%.2f TB', size / 1099511627776e0) END AS size_text
    FROM (SELECT id, CASE id % 4 WHEN 0 THEN file_size WHEN 1 THEN file_size * file_size WHEN 2 THEN file_size * 1000000000 ELSE 0 END AS size FROM v_document)""",
)
def _(i: Inputs):
    size = F.col("file_size")
    spread = F.when(F.col("id") % 4 == 0, size).when(F.col("id") % 4 == 1, size * size).when(F.col("id") % 4 == 2, size * 1_000_000_000).otherwise(0)
    return i.docs().select("id", text.format_size(spread).alias("size_text"))


@query(
    "T22_mask_secret",
    """SELECT url, CASE WHEN key = '' THEN '' WHEN length(key) > 8 THEN concat(left(key, 4), '****', right(key, 4)) ELSE '****' END AS masked
    FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN left(url, 7) ELSE '' END AS key FROM pages)""",
)
def _(i: Inputs):
    key = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.substring("url", 1, 7)).otherwise("")
    return i.table("pages").select("url", text.mask_secret(key).alias("masked"))


@query(
    "T23_parse_level",
    "SELECT event_id, CASE WHEN k BETWEEN 1 AND 4 AND event_type <> 'error' THEN k ELSE 1 END AS level FROM (SELECT *, CAST(regexp_extract(props, '\\d+') AS INT) AS k FROM events)",
)
def _(i: Inputs):
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_type") == "error", F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit(" "), k))
    return i.table("events").select("event_id", text.parse_level(given).alias("level"))


@query(
    "T24_parse_rewrites",
    f"""SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN list_filter([text, concat(text, '?')], lambda x: {strip('x')} <> '')
      ELSE list_filter(list_transform(string_split({strip('text')}, chr(10)), lambda x: {strip("regexp_replace(x, '^[0-9.*-]+', '')")}), lambda x: x <> '') END, '~') AS variants
    FROM conversations""",
)
def _(i: Inputs):
    listed = F.concat(F.lit("ok: "), F.to_json(F.array("text", F.lit(" "), F.concat("text", F.lit("?")))), F.lit(" done"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda t, n: F.concat((n + 1).cast("string"), F.lit(". "), t)), "\n")
    reply = F.when(F.col("turn") % 2 == 0, listed).otherwise(F.concat(F.lit("输出：\n"), lines))
    return i.table("conversations").select("conv_id", "turn", F.array_join(text.parse_rewrites(reply), "~").alias("variants"))


@query(
    "T25_parse_verdict",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS total,
      CASE WHEN event_type = 'error' THEN concat('verdict {"total": ', CAST(event_id AS VARCHAR)) ELSE '' END AS error FROM events""",
)
def _(i: Inputs):
    good = F.concat(F.lit('verdict:\n```{"total": '), F.col("value").cast("string"), F.lit("}```"))
    bad = F.concat(F.lit('verdict {"total": '), F.col("event_id").cast("string"))
    verdict, error = text.parse_verdict(F.col("reply"), "struct<total:double>")
    rows = i.table("events").withColumn("reply", F.when(F.col("event_type") == "error", bad).otherwise(good))
    return rows.select("event_id", F.coalesce(verdict["total"], F.lit(-1.0)).alias("total"), F.coalesce(error, F.lit("")).alias("error"))


@query("T26_token_proxy", "SELECT id, CAST(token_count AS BIGINT) AS tokens FROM v_qa")
def _(i: Inputs):
    return i.history().select("id", text.token_proxy(F.col("question"), F.col("answer")).cast("long").alias("tokens"))
