"""Text expressions. Each takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.strip and \s see it, under Java's (?U).
SPACE = r"[\s\x1c-\x1f]"

# Characters between which a line break is an artefact of recognition.
CJK = r"一-鿿　-〿！-￮"

# Marks whose full-width form is used in normalised questions.
HALF_WIDTH = ",.?!"
FULL_WIDTH = "，。？！"

# The text used when a conversation has no earlier turns.
NO_DIALOGUE = "无"

# Lines of a rewriter's output that carry no query.
FILLER_LINES = ["(", ")", "输出：", "输出", "结果："]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once.

    A column that is used inside a lambda would otherwise be put in there by the
    optimizer and computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(col: Column) -> Column:
    return strip(F.coalesce(col, F.lit(""))) == ""


def normalize_cjk(col: Column) -> Column:
    """Removes whitespace between two CJK or full-width characters; null becomes ''."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?U)(?<=[{CJK}]){SPACE}+(?=[{CJK}])", "")


def normalize_question(col: Column) -> Column:
    """Trimmed, with full-width punctuation and single spaces."""
    marked = F.translate(strip(col), HALF_WIDTH, FULL_WIDTH)
    return F.regexp_replace(marked, rf"(?U){SPACE}+", " ")


def reuse_key(question: Column, tenant: Column | None = None, user: Column | None = None) -> Column:
    """Key under which an answer may be reused; parts that are null are left out."""
    parts = [normalize_question(question)]
    if tenant is not None:
        parts.append(F.concat(F.lit("t"), tenant.cast("string")))
    if user is not None:
        parts.append(F.concat(F.lit("u"), user.cast("string")))
    return F.concat_ws("::", *parts)


def tokenize(col: Column, keep_case: bool = False) -> Column:
    """Words as maximal runs of letters and digits; each Han character is its own word."""
    source = F.coalesce(col, F.lit(""))
    if not keep_case:
        source = F.lower(source)
    return F.regexp_extract_all(source, F.lit(r"[\p{IsHan}]|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def slices(col: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters; one linear pass over the text."""
    return F.regexp_extract_all(col, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def split_facts(col: Column) -> Column:
    """Statements of an answer: cut at ； ; 。 ! and line ends, trimmed, two characters or more."""
    parts = F.transform(F.split(normalize_cjk(col), r"[；;。!\n]"), strip)
    return F.filter(parts, lambda part: F.length(part) >= 2)


def dialogue_text(turns: Column, n: int = 3) -> Column:
    """The last ``n`` of an array<struct<question, answer>> in time order, as prompt lines."""
    tail = F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), n)

    def lines(turn: Column) -> Column:
        question = strip(F.coalesce(turn["question"], F.lit("")))
        answer = strip(F.coalesce(turn["answer"], F.lit("")))
        return F.array(
            F.when(question != "", F.concat(F.lit("用户："), F.substring(question, 1, 200))),
            F.when(answer != "", F.concat(F.lit("助手："), F.substring(answer, 1, 300))),
        )

    text = F.array_join(F.flatten(F.transform(tail, lines)), "\n")
    return F.when(turns.isNull() | (F.size(turns) == 0) | (text == ""), F.lit(NO_DIALOGUE)).otherwise(text)


def format_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with two decimals; null or zero is '0 B'."""
    value = size.cast("double")

    def two_decimals(scaled: Column, unit: str) -> Column:
        # Exact halves go to the even digit, as in C's printf; Java's %.2f rounds them up.
        return F.concat(F.call_function("format_number", scaled, F.lit("0.00")), F.lit(f" {unit}"))

    out = F.when(size.isNull() | (value == 0), F.lit("0 B"))
    for step, unit in enumerate(["B", "KB", "MB", "GB"]):
        out = out.when(value < 1024.0 ** (step + 1), two_decimals(value / 1024.0**step, unit))
    return out.otherwise(two_decimals(value / 1024.0**4, "TB"))


def mask_secret(col: Column) -> Column:
    """First and last four characters around ****; short secrets are hidden whole."""
    return (
        F.when(col.isNull() | (col == ""), F.lit(""))
        .when(F.length(col) > 8, F.concat(F.substring(col, 1, 4), F.lit("****"), F.substring(col, -4, 4)))
        .otherwise(F.lit("****"))
    )


def parse_level(col: Column) -> Column:
    """An integer from 1 to 4; anything else is 1."""
    level = strip(col.cast("string")).try_cast("int")
    return F.when(level.between(1, 4), level).otherwise(F.lit(1))


def token_proxy(question: Column, answer: Column) -> Column:
    return F.length(F.coalesce(question, F.lit(""))) + F.length(F.coalesce(answer, F.lit("")))


def parse_rewrites(col: Column) -> Column:
    """Query variants in a model's reply: the outermost [...] as JSON, else its lines.

    JSON entries that are not strings keep their text; list markers at the start
    of a line and filler lines are dropped.
    """
    text = strip(F.coalesce(col, F.lit("")))
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    listed = F.filter(listed, lambda item: ~is_blank(item))
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: strip(F.regexp_replace(line, r"(?U)\A[\d.\-*\s①-⑳]+", "")),
    )
    lines = F.filter(lines, lambda line: (line != "") & ~line.isin(FILLER_LINES))
    return F.coalesce(listed, lines)


def parse_verdict(col: Column, schema: str, error_chars: int = 200) -> tuple[Column, Column]:
    """A judge's reply: (the outermost {...} as a struct, raw text if that fails)."""
    body = F.regexp_extract(F.coalesce(col, F.lit("")), r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(F.when(body != "", body)).isNotNull()
    verdict = F.when(valid, F.from_json(body, schema))
    return verdict, F.when(~valid | (body == ""), F.substring(col, 1, error_chars))


def json_ids(col: Column) -> Column:
    """Ids in a JSON list kept as text: digit-only entries as longs, [] if it cannot be read."""
    items = F.filter(F.from_json(col, "array<string>"), lambda item: item.rlike(r"\A\d+\z"))
    return F.coalesce(F.transform(items, lambda item: item.cast("long")), F.array().cast("array<long>"))


def contains_keyword(col: Column, keyword: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test; with ``wildcards``, % and _ act as in LIKE."""
    if wildcards:
        return col.ilike(f"%{keyword}%")
    return F.contains(F.lower(col), F.lit(keyword.lower()))


# Elements of an array that one fold takes; folds over more go block by block, so that what they gather is copied seldom.
FOLD = 256


def begins(sizes: Column, limit: Column | int, base: Column | int = 0, most: int | None = None) -> Column:
    """array<boolean>: which elements begin a group, if groups take them in order while ``base`` and their sizes stay within ``limit``.

    A group has one element at least and no more than ``most``. Work grows with the number of elements.
    """
    limit, base = (c if isinstance(c, Column) else F.lit(c) for c in (limit, base))

    def state(chars: Column, used: Column, out: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), used.cast("int").alias("used"), out.alias("out"))

    def step(s: Column, size: Column) -> Column:
        full = (s["used"] == 0) | (s["chars"] + size > limit)
        if most is not None:
            full = full | (s["used"] >= most)
        return state(F.when(full, base + size).otherwise(s["chars"] + size), F.when(full, 1).otherwise(s["used"] + 1), F.concat(s["out"], F.array(full)))

    none = F.array().cast("array<boolean>")

    def block(s: Column, some: Column) -> Column:
        folded = F.aggregate(some, state(s["chars"], s["used"], none), step)
        return let(folded, lambda r: state(r["chars"], r["used"], F.concat(s["out"], r["out"])))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / FOLD).cast("int")), lambda b: F.slice(sizes, b * FOLD + 1, FOLD))
    return F.when(F.size(sizes) > 0, F.aggregate(blocks, state(F.lit(0), F.lit(0), none), block, lambda s: s["out"])).otherwise(none)


def groups(items: Column, first: Column) -> Column:
    """``items`` as an array of arrays that begin where ``first`` is true; each group is cut out once."""
    starts = F.filter(F.transform(first, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda s, j: F.slice(items, s + 1, F.coalesce(F.get(at, j + 1), F.size(items)) - s)))
