"""Common table expressions of the SQL checks, in DuckDB's dialect.

Written from the definitions, not from the Spark plans, over the tables the
driver registers.
"""

# Whitespace as Python sees it; RE2's \s lacks most of it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalized(x: str) -> str:
    return f"regexp_replace(translate({strip(x)}, ',.?!', '，。？！'), '{WS}+', ' ', 'g')"


OPEN = """(is_admin OR coalesce(owner_id = user_id, false)
  OR coalesce(tenant_id = caller_tenant AND doc_level = 'public'
              AND coalesce(min_level, 1) <= coalesce(nullif(clearance, 0), 1), false))"""
GRANTED = "EXISTS (SELECT 1 FROM v_acl a WHERE a.document_id = doc_id AND a.user_id = {user})"
WORD = r"\p{Han}|[\p{L}\p{N}]+"

VIEWS = {
    "v_tenant": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "v_user": """
        SELECT c_custkey AS id, c_name AS username, c_mktsegment AS real_name,
               CASE WHEN c_custkey % 41 <> 0 THEN c_nationkey END AS tenant_id,
               CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
               CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE 1 + c_custkey % 4 END AS clearance_level,
               CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END AS status,
               TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 45 AS INT)) AS created_at
        FROM customer""",
    "v_ctx": """
        SELECT id AS user_id, role = 'admin' AS is_admin,
               CASE WHEN role <> 'admin' THEN tenant_id END AS caller_tenant,
               CASE WHEN role <> 'admin' THEN coalesce(nullif(clearance_level, 0), 1) END AS clearance
        FROM v_user""",
    "v_category": """
        SELECT r_regionkey + 1 AS id, r_name AS name, 0 AS parent_id, r_regionkey AS sort_order FROM region
        UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey + 1, n_nationkey FROM nation""",
    "v_document": """
        SELECT doc_id AS id, concat('doc ', lang, ' ', doc_id) AS title, text AS content,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 100 + doc_id % 25 END AS category_id,
               doc_id % 25 AS tenant_id,
               CASE WHEN doc_id % 11 = 0 THEN 'private' ELSE 'public' END AS doc_level,
               1 + doc_id % 4 AS min_level, (doc_id * 7) % 150 AS upload_by, n_chars AS file_size,
               CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INT)) AS created_at
        FROM documents""",
    "v_acl": """
        SELECT doc_id AS document_id, (doc_id * 13) % 150 AS user_id,
               TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS created_at
        FROM labels WHERE quality = 1""",
    "v_qa": """
        SELECT q.conv_id * 1000 + q.turn AS id, q.conv_id AS conversation_id, q.turn, q.conv_id % 150 AS user_id,
               q.text AS question, a.text AS answer, length(q.text) + length(a.text) AS token_count,
               CASE WHEN (q.conv_id + q.turn) % 7 = 0 THEN '[broken' WHEN (q.conv_id + q.turn) % 7 = 1 THEN '[]'
                    ELSE concat('["', q.conv_id, '","x",', q.conv_id * 1000 + q.turn, ',"', q.turn, '"]') END AS documents,
               TIMESTAMP '2024-01-01' + to_seconds(q.conv_id * 1000 + q.turn) AS created_at
        FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
        WHERE q.role = 'user' AND a.role = 'assistant'""",
    # Cited ids: three per answer unless its list is empty or broken, of which 'x' is not a number.
    "v_cited": """
        SELECT id, conversation_id, p.pos, p.cited
        FROM v_qa, LATERAL (VALUES (0, conversation_id), (1, id), (2, turn)) p(pos, cited)
        WHERE (conversation_id + turn) % 7 NOT IN (0, 1)""",
    "v_feedback": """
        SELECT event_id AS id, (event_id % 150) * 1000 + (event_id // 150) % 4 AS history_id, user_id,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS rating, ts AS created_at
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "v_login": """
        SELECT event_id AS id, user_id, concat('Customer#', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS username,
               CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS login_status, ts AS created_at
        FROM events""",
    "v_view": "SELECT event_id, user_id, event_id * 31 % 1009 AS doc_id, ts FROM events",
    "v_metric": """
        SELECT event_id, ts, event_type AS endpoint, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
               CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / CAST(100 AS DOUBLE) AS latency_s,
               CASE event_type WHEN 'view' THEN 'bm25' WHEN 'click' THEN 'vector' WHEN 'signup' THEN 'rrf' ELSE 'rerank' END AS stage,
               concat('l', 1 + user_id % 3) AS layer, value < 10 AS hit,
               date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT) * 60) AS end_second
        FROM events""",
    "v_minute": """
        SELECT m.*, date_trunc('minute', ts) + to_minutes(CAST(k + 1 AS INT)) AS until, k FROM v_metric m, range(0, 5) r(k)""",
    "v_log": "SELECT event_id, ts, user_id, concat(event_type, ' ', user_id % 5, '？') AS question FROM events",
    "v_question": """
        SELECT b.item_id AS query_id, b.text AS question, c.is_admin, c.user_id, c.caller_tenant, c.clearance
        FROM benchmark b JOIN v_ctx c ON c.user_id = (b.item_id * 7) % 150""",
    "v_question_admin": """
        SELECT item_id AS query_id, text AS question, true AS is_admin, (item_id * 7) % 150 AS user_id,
               CAST(NULL AS INT) AS caller_tenant, CAST(NULL AS INT) AS clearance
        FROM benchmark""",
    "v_list_question": """
        SELECT * REPLACE (CASE query_id % 5 WHEN 0 THEN '有哪些文档' WHEN 1 THEN concat('请列出 DOC en ', query_id)
               WHEN 2 THEN concat('zz', query_id, ' 所有文件') WHEN 3 THEN concat('文档有哪些区别 ', query_id)
               ELSE concat('qq', query_id, ' 有什么') END AS question)
        FROM v_question""",
    "v_golden": """
        SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
        WHERE len(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda w: w <> '')) >= 1""",
    # ---- elements ----
    "v_element": """
        SELECT doc_id, CAST(i - 1 AS INT) AS ord, lines[i] AS text,
               CASE WHEN contains(lines[i], '|') THEN 'table' WHEN ends_with(lines[i], '!') THEN 'image' ELSE 'text' END AS kind,
               CAST(1 + (i - 1) // 20 AS INT) AS page
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) t, LATERAL unnest(range(1, len(lines) + 1)) u(i)""",
    # ---- Markdown tables of the documents' lines and commas ----
    "v_cell": f"""
        SELECT doc_id, r, c, {strip("replace(cells[c], '|', chr(92) || '|')")} AS v, {strip("cells[c]")} <> '' AS filled, len(cells) AS n
        FROM (SELECT doc_id, ord AS r, string_split(text, ',') AS cells FROM v_element) t, LATERAL unnest(range(1, len(cells) + 1)) u(c)""",
    "v_grid_row": """
        SELECT doc_id, r, string_agg(v, ' | ' ORDER BY c) AS body, max(n) AS n FROM v_cell
        GROUP BY doc_id, r HAVING bool_or(filled)""",
    "v_table_line": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS line_no,
               concat('| ', body, repeat(' | ', CAST(max(n) OVER (PARTITION BY doc_id) - n AS INT)), ' |') AS line,
               max(n) OVER (PARTITION BY doc_id) AS width
        FROM v_grid_row""",
    "v_rule": """
        SELECT doc_id, concat('| ', array_to_string(list_transform(range(0, max(width)), lambda x: '---'), ' | '), ' |') AS rule
        FROM v_table_line GROUP BY doc_id""",
    "v_markdown": """
        SELECT d.doc_id, coalesce(m.markdown, '') AS markdown FROM documents d LEFT JOIN (
          SELECT l.doc_id, concat(max(line) FILTER (line_no = 0), chr(10), max(rule),
                 coalesce(chr(10) || string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no > 0), '')) AS markdown
          FROM v_table_line l JOIN v_rule USING (doc_id) GROUP BY l.doc_id) m USING (doc_id)""",
    # ---- chunks ----
    "v_slice": f"""
        SELECT id AS doc_id, CAST(i AS INT) AS chunk_index, CAST(i // 5 AS INT) AS window_no,
               substring(content, CAST(i * 300 + 1 AS INT), 300) AS raw, tenant_id, doc_level, min_level, upload_by AS owner_id
        FROM v_document d, LATERAL unnest(range(0, (length(content) + 299) // 300)) u(i) WHERE {strip('content')} <> ''""",
    "v_chunk": f"""
        SELECT *, CASE WHEN {strip('raw')} = '' THEN raw ELSE {strip('raw')} END AS text,
               sha256(concat(doc_id, '|', window_no)) AS parent_id FROM v_slice""",
    "v_parent": """
        SELECT doc_id, window_no, sha256(concat(doc_id, '|', window_no)) AS parent_id,
               string_agg(raw, chr(10) || chr(10) ORDER BY chunk_index) AS text
        FROM v_slice GROUP BY doc_id, window_no""",
    # ---- BM25 ----
    "v_token": f"""
        SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM v_chunk""",
    "v_tf": "SELECT doc_id, chunk_index, term, count(*) AS tf FROM v_token GROUP BY ALL",
    "v_size": f"""
        SELECT doc_id, chunk_index, len(regexp_extract_all(lower(text), '{WORD}')) AS n_tokens FROM v_chunk""",
    "v_stats": "SELECT count(*) AS n, avg(n_tokens) AS avg_tokens FROM v_size",
    "v_raw_idf": """
        SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
        FROM v_tf, v_stats GROUP BY term""",
    "v_idf": """
        SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM v_raw_idf) ELSE raw END AS idf FROM v_raw_idf""",
}


def _retrieval(suffix: str, source: str) -> dict[str, str]:
    """Views of each retrieval step for one set of questions."""
    s = suffix
    granted = GRANTED.format(user="q.user_id")
    views = {
        f"v_qterm{s}": f"""
            SELECT query_id, term, count(*) AS qtf FROM (
              SELECT query_id, unnest(regexp_extract_all(lower(question), '{WORD}')) AS term FROM {source}) GROUP BY ALL""",
        f"v_pair{s}": f"""
            SELECT query_id, doc_id, chunk_index, parent_id FROM v_chunk, {source} q WHERE {OPEN} OR {granted}""",
        f"v_match{s}": f"""
            SELECT query_id, doc_id, chunk_index,
                   sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * n_tokens / (SELECT avg_tokens FROM v_stats)))) AS score
            FROM v_qterm{s} JOIN v_idf USING (term) JOIN v_tf USING (term) JOIN v_size USING (doc_id, chunk_index) GROUP BY ALL""",
        f"v_bm25{s}": f"""
            SELECT * FROM (SELECT query_id, doc_id, chunk_index, parent_id, score,
                row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_index) AS rank
              FROM v_match{s} JOIN v_pair{s} USING (query_id, doc_id, chunk_index)) WHERE rank <= 20""",
        f"v_dense{s}": f"""
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id, chunk_index) AS rank FROM (
              SELECT p.query_id, p.doc_id, p.chunk_index, p.parent_id,
                     round(greatest(coalesce(q.size, 0) + coalesce(c.size, 0) - 2 * coalesce(x.dot, 0), 0), 9) AS distance
              FROM v_pair{s} p LEFT JOIN (
                  SELECT query_id, doc_id, chunk_index, sum(CAST(a.v AS DOUBLE) * b.v) AS dot
                  FROM v_qvec{s} a JOIN v_cvec b USING (place) GROUP BY ALL) x USING (query_id, doc_id, chunk_index)
                LEFT JOIN (SELECT query_id, sum(CAST(v AS DOUBLE) * v) AS size FROM v_qvec{s} GROUP BY ALL) q USING (query_id)
                LEFT JOIN (SELECT doc_id, chunk_index, sum(CAST(v AS DOUBLE) * v) AS size FROM v_cvec GROUP BY ALL) c USING (doc_id, chunk_index))
              WHERE distance <= 1.5) WHERE rank <= 20""",
        f"v_qhash{s}": f"""
            SELECT query_id, CAST('0x' || substr(md5(term), 1, 6) AS INT) % 64 AS place,
                   sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 2) AS INT) < 128 THEN 1 ELSE -1 END) AS v
            FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}) GROUP BY ALL""",
        f"v_qvec{s}": f"""
            SELECT query_id, place, CAST(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY query_id)), 0), 0) AS FLOAT) AS v FROM v_qhash{s}""",
        f"v_fused{s}": f"""
            SELECT query_id, doc_id, parent_id, chunk_index, score, dense_score, sparse_score,
                   row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, d ASC NULLS LAST, sp ASC NULLS LAST) AS rank
            FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
                         coalesce(a.parent_id, b.parent_id) AS parent_id, coalesce(a.chunk_index, b.chunk_index) AS chunk_index,
                         coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0) AS score,
                         a.distance AS dense_score, b.score AS sparse_score, a.rank AS d, b.rank AS sp
                  FROM v_dense{s} a FULL JOIN v_bm25{s} b
                    ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index)""",
        f"v_qwords{s}": f"SELECT query_id, list_distinct(list(term)) AS words FROM v_qterm{s} GROUP BY query_id",
        f"v_rerank{s}": _rerank(f"v_fused{s}", f"v_qwords{s}"),
        f"v_rerank_bm25{s}": _rerank(f"v_bm25{s}", f"v_qwords{s}"),
        f"v_floor{s}": f"""
            SELECT * FROM (SELECT *, max(rerank_norm) OVER (PARTITION BY query_id) AS best FROM v_rerank{s})
            WHERE rerank_norm >= 0.15 OR (best < 0.15 AND rank = 1)""",
        f"v_cut{s}": f"""
            SELECT * EXCLUDE (top, gap, mean) FROM (
              SELECT *, least(5, CASE WHEN top >= 0.85 AND gap >= 0.15 THEN 3 WHEN mean >= 0.85 THEN 8 WHEN top <= 0.5 THEN 3 ELSE 5 END) AS k_used
              FROM (SELECT *, max(rerank_norm) OVER w AS top, avg(rerank_norm) OVER w AS mean,
                      coalesce(max(rerank_norm) OVER w - nth_value(rerank_norm, 2) OVER (PARTITION BY query_id
                        ORDER BY rerank_norm DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1.0) AS gap
                    FROM v_floor{s} WINDOW w AS (PARTITION BY query_id))) WHERE rank <= k_used""",
        f"v_hits{s}": f"""
            SELECT r.query_id, r.doc_id, r.parent_id, r.chunk_index, r.rank, r.rerank_norm, r.text AS child_content,
                   coalesce(p.text, r.text) AS content, r.k_used
            FROM v_cut{s} r LEFT JOIN v_parent p USING (parent_id)""",
    }
    return views


def _rerank(source: str, words: str) -> str:
    return f"""
        SELECT * EXCLUDE (place), place AS rank, 1e0 / (1e0 + exp(-rerank_score)) AS rerank_norm FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS place FROM (
            SELECT f.* EXCLUDE (rank), f.rank AS fused_rank, c.text,
                   8e0 * len(list_intersect(w.words, regexp_extract_all(lower(c.text), '{WORD}'))) / len(w.words) - 4e0 AS rerank_score
            FROM {source} f JOIN v_chunk c USING (doc_id, chunk_index, parent_id) JOIN {words} w USING (query_id)
            WHERE f.rank <= 15)) WHERE place <= 8"""


VIEWS |= {
    "v_chash": """
        SELECT doc_id, chunk_index, CAST('0x' || substr(md5(term), 1, 6) AS INT) % 64 AS place,
               sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 2) AS INT) < 128 THEN 1 ELSE -1 END) AS v
        FROM (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM v_chunk) GROUP BY ALL""",
    "v_cvec": """
        SELECT doc_id, chunk_index, place,
               CAST(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY doc_id, chunk_index)), 0), 0) AS FLOAT) AS v FROM v_chash""",
}
VIEWS |= _retrieval("", "v_question")
VIEWS |= _retrieval("_all", "v_question_admin")
VIEWS |= _retrieval("_list", "v_list_question")

# ---- questions with rewrites: every other one asks for a list, each has two rewrites ----
VIEWS |= {
    "v_rw_question": """
        SELECT q.* REPLACE (CASE WHEN q.query_id % 2 = 0 THEN l.question ELSE q.question END AS question)
        FROM v_question q JOIN v_list_question l USING (query_id)""",
    "v_var_question": """
        SELECT query_id * 10 + n AS query_id, CASE n WHEN 0 THEN question WHEN 1 THEN 'about ' || substring(question, 1, 60)
               ELSE 'on ' || substring(question, 20, 60) END AS question, is_admin, user_id, caller_tenant, clearance
        FROM v_rw_question, (VALUES (0), (1), (2)) t(n)""",
}
VIEWS |= _retrieval("_var", "v_var_question")
VIEWS |= _retrieval("_rw", "v_rw_question") | {
    "v_fused_rw": """
        SELECT query_id, doc_id, parent_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM (
          SELECT query_id // 10 AS query_id, doc_id, parent_id, chunk_index, sum(score) AS score, min((query_id % 10) * 1000 + rank) AS first
          FROM v_fused_var GROUP BY ALL)""",
}
