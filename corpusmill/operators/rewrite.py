"""Query variants: model rewrites first, then fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, parse_rewrites
from corpusmill.operators.models import EMBED_BATCH, BatchModel, model_column, once_per_key

EXPANSIONS = 2

# Fixed values: (pattern on the question, variant to add).
RULES = [
    (r"几名(民警|警察|执法人员|警员)|(民警|警察|执法人员|警员)(人数|数量)", "一名以上人民警察 人数"),
    (r"讯问.{0,6}(几个小时|多久|时限)|讯问时限", "讯问 犯罪嫌疑人 12小时 24小时"),
    (r"听证.{0,8}(多少钱|数额|门槛|标准)|多少.{0,4}(钱|元).{0,6}听证", "听证 四千元 个人罚款"),
    (r"(当场处罚|简易程序).{0,14}(条件|适用|情形)", "当场处罚 违法事实确凿 一名以上人民警察 五百元以下"),
    (
        r"传唤.{0,20}时限|(几小时|多久|时限).{0,20}(传唤|继续盘问)|(区别|对比).{0,30}(传唤|盘问)",
        "继续盘问 12小时 24小时 48小时 传唤 询问查证 8小时",
    ),
]


def _with_rules(question: Column, variants: Column, rules: list[tuple[str, str]]) -> Column:
    extra = [F.when(question.rlike(pattern), F.lit(variant)) for pattern, variant in rules]
    if not extra:
        return variants
    # Two rules may name one variant; it is added once, and not if it is there already.
    fired = F.array_distinct(F.array_compact(F.array(*extra)))
    return F.concat(variants, F.filter(fired, lambda v: ~F.array_contains(variants, v)))


def expand_rules(queries: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The question and the variants its rules add: (query_id, variant, text)."""
    question = F.col("question")
    variants = _with_rules(question, F.array(question), rules)
    return queries.select("query_id", F.posexplode(variants).alias("variant", "text"))


def assemble_variants(
    queries: DataFrame, n: int = EXPANSIONS, rules: list[tuple[str, str]] = RULES, enabled: bool = True
) -> DataFrame:
    """Variants from the rewriter's reply in ``reply``: (query_id, variant, text).

    The question comes first, then up to ``n`` rewrites that are neither blank
    nor a copy of it, then rule variants, ``n + 4`` in all.
    """
    question = F.col("question")
    if not enabled:
        return queries.select("query_id", F.lit(0).alias("variant"), question.alias("text"))
    rewrites = F.filter(parse_rewrites(F.col("reply")), lambda q: ~is_blank(q) & (q != question))
    rewritten = F.slice(F.concat(F.array(question), rewrites), 1, n + 1)
    variants = F.slice(_with_rules(question, rewritten, rules), 1, n + 4)
    return queries.select("query_id", F.posexplode(variants).alias("variant", "text"))


def rewritten(
    queries: DataFrame, model: BatchModel, n: int = EXPANSIONS, rules: list[tuple[str, str]] = RULES, prompt: Column | None = None
) -> DataFrame:
    """Variants of every question from a model that rewrites: (query_id, variant, text).

    The model is asked once for each distinct question and dialogue (``dialogue``, if the queries have one); it fails on
    none but its own: a question without a reply keeps its rules. ``prompt`` says what the model reads, else the question after the dialogue.
    """
    dialogue = F.col("dialogue") if "dialogue" in queries.columns else F.lit("")
    asked = queries.select("query_id", "question", F.coalesce(dialogue, F.lit("")).alias("dialogue"))
    reads = prompt if prompt is not None else F.concat_ws("\n", F.nullif(F.col("dialogue"), F.lit("")), "question")
    reply = lambda rows: rows.withColumn("reply", model_column(model, reads, "string", EMBED_BATCH, skip=True))
    answered = once_per_key(asked, [F.col("question"), F.col("dialogue")], reply, ["reply"])
    return assemble_variants(answered.withColumn("reply", F.coalesce("reply", F.lit(""))), n, rules)
