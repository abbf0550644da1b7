"""The registered queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import conversation_trie, decontaminate, exact_dedup, merkle, packing, pii, rules, secrets, simhash, slots, toxicity, url_trust, weak_labels
from corpusmill.llm.common import table
from corpusmill.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents").select("doc_id", "text"))


WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query(
    "op9_decontaminate",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT id, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n FROM bw),
lens AS (SELECT DISTINCT n FROM q),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT DISTINCT dw.r, dw.s, dw.n, q.id FROM dw JOIN q ON q.n = dw.n AND array_to_string(dw.w[dw.s:dw.s + dw.n - 1], ' ') = q.win),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hits WHERE id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op4_rules",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS s, w FROM d WHERE len(w) >= 8),
hashed AS (SELECT r, s, array_to_string(w[s:s + 7], ' ') AS h FROM win),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, h) AS n FROM hashed) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations
    FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 3 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
    OR (n_words BETWEEN 30 AND 1000 AND 100 * n_distinct < 40 * n_words) OR 100 * n_capitals > 40 * word_chars OR 100 * n_exclamations > 15 * n_words) AS kept FROM b
""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.ledger(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    measured = [F.col(f"measured.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return entries.select("doc_id", *measured, rules.rejected(1).alias("base_failed"), (~rules.rejected()).alias("kept"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    marked = pii.personal_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    of_base = marked.withColumn("base", F.filter("spans", lambda s: ~s["kind"].startswith("context-")))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return of_base.select("doc_id", *map(number, pii.KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text", "source"))


URL_PARTS_SQL = r"""coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"""


def _op1_sql() -> str:
    """The rules as a table, links from anchors, and the rounds of propagation one after the other."""
    rows = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{action}')" for rule, action in url_trust.RULES)
    host = URL_PARTS_SQL.format("url")
    waves = ["w0 AS MATERIALIZED (SELECT side, host, 1.0::DOUBLE AS mass FROM seeds)"]
    for i in range(url_trust.ROUNDS):
        waves.append(
            f"w{i + 1} AS MATERIALIZED (SELECT side, next AS host, sum(mass * share) * {url_trust.DAMPING} AS mass FROM w{i} JOIN moves USING (side, host) GROUP BY side, next)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(url_trust.ROUNDS + 1))
    return rf"""
WITH rules(rule, rhost, rpath, action) AS (VALUES {rows}),
p AS (SELECT row_number() OVER () AS r, page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (SELECT r, arg_max(rule, (length(rule), rule)) AS rule, arg_max(action, (length(rule), rule)) AS action FROM p JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
ruled AS (SELECT p.*, rule, action FROM p LEFT JOIN fit USING (r)),
counts AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (SELECT CASE WHEN a >= 0.5 * n THEN 1 ELSE -1 END AS side, host FROM counts WHERE a >= 0.5 * n OR b >= 0.5 * n),
tags AS (SELECT host AS a, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*')) AS tag FROM p),
hrefs AS (SELECT a, regexp_extract(tag, '(?i)\shref\s{{0,9}}=\s{{0,9}}["'']?([^"''\s>]+)', 1) AS t FROM tags),
named AS (SELECT a, {URL_PARTS_SQL.format("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS b FROM hrefs WHERE starts_with(t, '//') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')),
links AS (SELECT a, b, count(*) AS weight FROM named WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
moves AS MATERIALIZED (SELECT 1 AS side, a AS host, b AS next, weight / sum(weight) OVER (PARTITION BY a) AS share FROM links
    UNION ALL SELECT -1, b, a, weight / sum(weight) OVER (PARTITION BY b) FROM links),
{", ".join(waves)},
scores AS (SELECT host, {1 - url_trust.DAMPING} * sum(CASE WHEN side = 1 THEN mass ELSE 0 END) AS trust, {1 - url_trust.DAMPING} * sum(CASE WHEN side = -1 THEN mass ELSE 0 END) AS distrust
    FROM ({every}) GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(action, CASE WHEN round(distrust - trust, 9) > {url_trust.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


@query("op1_url_trust", _op1_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.judge(table(spark, folder, "pages"))


@query("op2_secrets")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query("op3_slots")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return slots.shard(table(spark, folder, "documents"))


@query("op5_weak_labels")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.classify(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


#: A list of 256 numbers by which a checksum goes on by one byte, and the unsigned checksum of digits with it.
CRC_TABLE_SQL = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM
    (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i)))"""
CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295)"""


def _op11_sql(levels: int = 9, top_levels: int = 6) -> str:
    """The levels of the trees one after the other, and every row's fold along them."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({{{i}}}::VARCHAR) || ':' || {{{i}}}::VARCHAR, '-')" for i in range(len(merkle.FIELDS))) + ")"
    leaf_of = leaf.format("doc_id", "source", "lang", "n_chars", "text")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = f"CASE WHEN {CRC_SQL.format('doc_id')} % 3 = 0 THEN {leaf.format('doc_id', 'source', 'lang', 'n_chars', lowered)} ELSE {leaf_of} END"

    def climb(tag: str, number: int) -> str:
        made = []
        for k in range(number):
            made.append(
                f"{tag}g{k} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, list(dig ORDER BY pos) AS kids, max(n) > 1 AS grows "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {tag}n{k}) GROUP BY tree, pos // 8)"
            )
            made.append(f"{tag}n{k + 1} AS MATERIALIZED (SELECT tree, pos, CASE WHEN grows THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS dig FROM {tag}g{k})")
            slot = f"kids[1:p.pos % 8], {{0}}, kids[p.pos % 8 + 2:]"
            made.append(
                f"{tag}p{k + 1} AS MATERIALIZED (SELECT r, g.tree, g.pos, CASE WHEN grows THEN sha256(array_to_string(flatten([{slot.format('[own]')}]), '')) ELSE own END AS own, "
                f"proof || CASE WHEN grows THEN array_to_string(flatten([{slot.format('[]')}]), '') ELSE '' END AS proof "
                f"FROM {tag}p{k} p JOIN {tag}g{k} g ON p.tree = g.tree AND p.pos // 8 = g.pos)"
            )
        return ",\n".join(made)

    return rf"""
WITH {CRC_TABLE_SQL},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {leaf_of} AS dig, {own} AS own FROM documents, crc),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, dig, r) - 1 AS pos FROM d),
an0 AS (SELECT tree, pos, dig FROM placed),
ap0 AS (SELECT r, tree, pos, own, '' AS proof FROM placed),
{climb("a", levels)},
bn0 AS (SELECT 0 AS tree, tree AS pos, dig FROM an{levels}),
bp0 AS (SELECT r, 0 AS tree, tree AS pos, own, proof FROM ap{levels}),
{climb("b", top_levels)}
SELECT doc_id, placed.dig AS leaf, an{levels}.dig AS subroot, bn{top_levels}.dig AS root, sha256(bp{top_levels}.proof) AS proof_sha256,
    bp{top_levels}.own AS folded_root, bp{top_levels}.own = bn{top_levels}.dig AS verified
FROM placed JOIN an{levels} USING (tree) JOIN bp{top_levels} USING (r), bn{top_levels}
"""


@query("op11_merkle", _op11_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(table(spark, folder, "documents"))


@query(
    "op13_exact_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) AS place FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM o JOIN g USING (t)
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"), smallest=False)


@query(
    "op12_prefix_trie",
    rf"""
WITH {CRC_TABLE_SQL},
rows_of AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS i, dig, chars
    FROM (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS dig, length(text) AS chars FROM rows_of)),
convs AS MATERIALIZED (SELECT c, {CRC_SQL.format("c")} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM t), crc),
heads AS (SELECT convs.c, any_value(h) AS h, count(t.c) AS hb FROM convs LEFT JOIN t ON t.c = base AND i <= h GROUP BY convs.c),
whole AS (SELECT convs.c, i AS d, dig, chars FROM convs JOIN t ON t.c = base AND i <= h
    UNION ALL SELECT c, i - h + hb, dig, chars FROM heads JOIN t USING (c) WHERE i > h),
keyed AS MATERIALIZED (SELECT c, d, chars, string_agg(dig, '') OVER (PARTITION BY c ORDER BY d) AS k FROM whole UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, count(*) AS n, max(chars) AS chars FROM keyed GROUP BY k, d),
kids AS MATERIALIZED (SELECT left(k, 64 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
spread AS (SELECT unnest(range(0, d + 1)) AS a, nodes.k, (n - 1) * chars AS saved, kids.k IS NULL AS leaf FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT left(k, 64 * a) AS k, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM spread GROUP BY 1),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM keyed GROUP BY c) GROUP BY k)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
    leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes up ON nodes.d > 0 AND up.k = left(nodes.k, 64 * (nodes.d - 1))
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))
