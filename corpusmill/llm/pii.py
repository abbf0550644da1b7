"""Personal data: validated patterns, and identifiers that contexts learned from them reveal.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. All of them
seed a bootstrap: the words around a seed are lexical patterns; whatever stands in the place of a pattern
that enough seeds share is an instance, whatever its shape. Patterns and
values make a graph, and rounds of scoring pass confidence from values to
patterns and back. Patterns of high confidence mark identifiers in their place which
no base pattern knows, unless the value is a common word, which mostly stands elsewhere. DataFrame operations only.

Regular expressions are linear in the text: repetitions are possessive and matches
start where a run starts. Places come from the lengths of the matches and of the texts
between them, summed in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.llm.common import keep, quoted, small, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text that lacks this can't match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
ROUNDS = 3
#: A pattern counts from so many distinct confirmed values and this share of all its values; it finds new ones from the higher share.
SUPPORT, CONFIDENT, FINDS = 5, 0.5, 0.9
#: A new value stands in the places of such patterns in this share of all its occurrences.
SPECIFIC = 0.5
#: One sign before each base span, by kind, and one for the blanks in it: a span is one word then. In texts they stand for no letter.
MARKS, GLUE = "\ue000\ue001\ue002\ue003", "\ue004"
#: Patterns, or new values, that are looked up in the rows of texts; more of them meet the words in a join.
PATTERNS_AT_ONCE = 20_000
BLANK = r"[ \t\n\x0B\f\r]+"
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Sums of a non-empty array up to and with each element, folded in blocks so that the work stays near linear."""

    def fold(block: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(block, start, lambda sums, x: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x.cast("bigint"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    totals = lambda each: F.transform(each, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return let(
        blocks,
        lambda each: F.flatten(F.zip_with(each, fold(totals(each)), lambda b, upto: let(fold(b), lambda s: F.transform(s, lambda x: x + upto - F.get(s, F.size(s) - 1))))),
    )


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in order: start and end in code points (end exclusive), the match, and the text before and after up to the next match."""
    shape = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
    none = F.from_json(F.lit("[]"), shape)

    def placed(parts: Column) -> Column:
        found, between = parts["found"], parts["between"]
        lengths = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(between, i)))
        return let(
            let(lengths, running_sums),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.char_length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("value"),
                    F.get(between, i).alias("before"),
                    F.get(between, i + 1).alias("after"),
                ),
            ),
        ).cast(shape)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        found,
        lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("between")), placed)),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0),
        lambda s, x: s + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind is one; failing matches are dropped without another try inside them."""
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), by kind as listed and then by start. Kinds may overlap each other."""
    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    none = F.from_json(F.lit("[]"), shape)

    def of(kind: str) -> Column:
        spans = F.transform(
            F.filter(located(text, PATTERNS[kind]), lambda m: valid(kind, m["value"])), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
        ).cast(shape)
        need = NEEDS[kind]
        return F.when(text.contains(need), spans).otherwise(none) if need else spans

    digits = F.when(text.rlike("[0-9]"), F.concat(of("ip"), of("card"), of("phone"))).otherwise(none)
    return F.concat(of("email"), digits)


def _marked(kind: str, mark: str, text: Column) -> Column:
    """``text`` with ``mark`` before every valid match of a kind, and the match as one word."""

    def rebuilt(t: Column) -> Column:
        pieces = F.zip_with(
            F.split(t, PATTERNS[kind], -1),
            F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)),
            lambda gap, m: F.concat(gap, F.when(m.isNull(), F.lit("")).when(valid(kind, m), F.concat(F.lit(mark), F.translate(m, " ", GLUE))).otherwise(m)),
        )
        return F.when(t.rlike(PATTERNS[kind]), F.array_join(pieces, "")).otherwise(t)

    return let(text, rebuilt)


def masked(text: Column) -> Column:
    """``text`` with each base span as one word after the mark of its kind; everything else keeps its place but for the marks before it."""
    made = F.translate(text, MARKS + GLUE, "\ufffd" * 5)
    for kind, mark in zip(KINDS, MARKS, strict=True):
        made = _marked(kind, mark, made)
    return F.when(text.rlike("[@0-9]"), made).otherwise(F.translate(text, MARKS + GLUE, "\ufffd" * 5))


def _kind(word: Column) -> Column:
    """The kind of a marked word, null for others."""
    first = F.regexp_extract(word, f"[{MARKS}]", 0)
    found = F.lit(None).cast("string")
    for kind, mark in zip(KINDS, MARKS, strict=True):
        found = F.when(first == mark, F.lit(kind)).otherwise(found)
    return found


def _value(word: Column) -> Column:
    """A word without the signs around it."""
    return F.regexp_replace(word, r"^[^\p{L}0-9+]+|(?<=[\p{L}0-9])[^\p{L}0-9]+$", "")


def _split(marked: Column) -> Column:
    """(w, c): the words of a masked text, and the same in small letters with every base span as one word."""
    words = F.array_remove(F.split(marked, BLANK), "")
    plain = let(words, lambda w: F.transform(w, lambda x: F.when(x.rlike(f"[{MARKS}]"), F.lit("<id>")).otherwise(F.lower(x))))
    around = F.when(marked.rlike(f"[{MARKS}]"), plain).otherwise(F.array_remove(F.split(F.lower(marked), BLANK), ""))
    return F.struct(words.alias("w"), around.alias("c"))


def _contexts(c: Column, i: Column) -> Column:
    """The patterns around a place: two words before it, and one on each side; null where the text has none."""
    left = F.when(i >= 2, F.concat_ws(" ", F.lit("left"), F.get(c, i - 2), F.get(c, i - 1)))
    both = F.when((i >= 1) & (i + 1 < F.size(c)), F.concat_ws(" ", F.lit("round"), F.get(c, i - 1), F.lit("_"), F.get(c, i + 1)))
    return F.array(left, both)


def _at_places(texts: DataFrame, place: Callable[[Column, Column], Column], pattern: Callable[[Column], Column]) -> DataFrame:
    """(text_key, at, word, l1, pattern) of the words of ``texts`` (text_key, marked) whose place ``place`` (words and their small form, number) and context ``pattern`` allow; others never become rows."""

    def found(both: Column) -> Column:
        w, c = both["w"], both["c"]
        places = F.filter(F.transform(w, lambda x, i: F.when(place(both, i), i)), lambda i: i.isNotNull())
        named = lambda i: F.transform(
            F.filter(_contexts(c, i), pattern), lambda p: F.struct(i.alias("at"), F.get(w, i).alias("word"), F.get(c, i - 1).alias("l1"), p.alias("pattern"))
        )
        return F.flatten(F.transform(places, named))

    return texts.select("text_key", F.inline(let(_split(F.col("marked")), found)))


def _instances_of(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_key, at, value, kind, pattern): what stands in the places of ``patterns`` (pattern, l1); kind is null for what is no base span."""
    some = patterns.limit(PATTERNS_AT_ONCE + 1).collect()
    if len(some) <= PATTERNS_AT_ONCE:
        before, whole = sorted({r["l1"] for r in some}), sorted({r["pattern"] for r in some})
        if not some:
            before = whole = [""]
        met = _at_places(texts, lambda both, i: (i >= 1) & F.get(both["c"], i - 1).isin(before), lambda p: p.isin(whole))
    else:
        every = _at_places(texts, lambda both, i: i >= 1, lambda p: p.isNotNull())
        met = every.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    word = F.col("word")
    return met.select("text_key", "at", _value(F.regexp_replace(word, f"[{MARKS}]", "")).alias("value"), _kind(word).alias("kind"), "pattern").where("value <> ''").distinct()


def _instances(texts: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Instances of the patterns that ``support`` distinct base spans of one kind share.

    In the texts that have base spans, those must be the share ``confident`` of all values in a pattern's places;
    contexts of common words fall here, before all texts are searched for what is left.
    """
    seen = F.col("marked").rlike(f"[{MARKS}]")
    seeds = _at_places(texts.where(seen), lambda both, i: (i >= 1) & F.get(both["w"], i).rlike(f"[{MARKS}]"), lambda p: p.isNotNull())
    shared = seeds.select("pattern", "l1", "word", _kind(F.col("word")).alias("kind")).distinct().groupBy("pattern", "l1", "kind").count().where(F.col("count") >= support)
    patterns = keep(shared.select("pattern", "l1").distinct())
    near = _instances_of(texts.where(seen), patterns).groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    share = near.groupBy("pattern").agg(F.count("*").alias("values"), F.count("kind").alias("named")).where(F.col("named") >= confident * F.col("values"))
    return _instances_of(texts, keep(patterns.join(share.select("pattern"), "pattern")))


def learned_patterns(instances: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, support, confidence): patterns whose values are of one kind, after ``rounds`` of scoring the graph.

    Values weigh 1 for the kind that a base pattern gives them, else what the patterns around
    them make of it: 1 - Π(1 - confidence). A pattern's confidence is the weight of its
    distinct values of a kind by their number. Copies count once.
    """
    graph = keep(instances.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("values"))
    weights = graph.where("seed IS NOT NULL").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("weight"))
    scored = None
    for _ in range(rounds):
        sums = weights.groupBy("pattern", "kind").agg(F.sum("weight").alias("support")).where(F.col("support") >= support)
        scored = keep(
            sums.join(sizes, "pattern").select("pattern", "kind", "support", (F.col("support") / F.col("values")).alias("confidence")).where(F.col("confidence") >= confident)
        )
        if scored.isEmpty():
            break
        reached = graph.join(small(scored), "pattern").where("seed IS NULL").groupBy("value", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("weight"))
        seeds = graph.where("seed IS NOT NULL").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("weight"))
        weights = seeds.union(graph.where("seed IS NULL").select("pattern", "value").join(small(keep(reached)), "value").select("pattern", "value", "kind", "weight"))
    return scored


def contextual(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, finds: float = FINDS, specific: float = SPECIFIC) -> DataFrame:
    """(key, found): of each text, by its hash, the words (at, kind) that learned patterns say are identifiers; texts without any are left out."""
    texts = docs.select(F.xxhash64(text_or_empty()).alias("text_key"), masked(text_or_empty()).alias("marked"))
    instances = keep(_instances(texts, support, confident))
    sure = learned_patterns(instances, support=support, confident=confident).where(F.col("confidence") >= finds)
    # a pattern is of the kind that it is surest of
    surest = keep(sure.groupBy("pattern").agg(F.max(F.struct("confidence", "support", "kind"))["kind"].alias("as_kind")))
    new = keep(instances.where("kind IS NULL").join(small(surest), "pattern").groupBy("text_key", "at", "value").agg(F.min("as_kind").alias("as_kind")))
    within = keep(new.groupBy("value").agg(F.count("*").alias("here")))
    # how often the few new values come at all
    values = within.select("value").limit(PATTERNS_AT_ONCE + 1).collect()
    words = let(_split(F.col("marked")), lambda both: F.transform(both["w"], _value))
    if len(values) <= PATTERNS_AT_ONCE:
        listed = [r["value"] for r in values] or [""]
        anywhere = texts.select("text_key", F.explode(F.filter(words, lambda v: v.isin(listed))).alias("value")) if values else within.select(F.lit(0).alias("text_key"), "value")
    else:
        anywhere = texts.select("text_key", F.explode(words).alias("value")).join(within.select("value"), "value", "left_semi")
    own = within.join(anywhere.groupBy("value").agg(F.count("*").alias("everywhere")), "value").where(F.col("here") >= specific * F.col("everywhere")).select("value")
    found = new.join(small(keep(own)), "value", "left_semi")
    return found.groupBy(F.col("text_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("context-"), "as_kind").alias("kind")))).alias("found"))


def _spans_of(found: Column, text: Column) -> Column:
    """(kind, start, end) of the words ``found`` (at, kind) of a text, by kind and start."""
    shape = "array<struct<kind:string,start:bigint,end:bigint>>"

    def of(both: Column) -> Column:
        marked, words = both["marked"], both["words"]

        def span(f: Column) -> Column:
            word = F.get(words, f["at"])
            marks = F.char_length(F.regexp_replace(F.substring(marked, F.lit(1), word["start"].cast("int")), f"[^{MARKS}]", ""))
            cut = F.char_length(F.regexp_extract(word["value"], r"^[^\p{L}0-9+]*+", 0))
            start = word["start"] - marks + cut
            return F.struct(f["kind"].alias("kind"), start.alias("start"), (start + F.char_length(_value(word["value"]))).alias("end"))

        return F.array_sort(F.transform(found, span)).cast(shape)

    with_words = let(masked(text), lambda m: F.struct(m.alias("marked"), located(m, r"[^ \t\n\x0B\f\r]++").alias("words")))
    return F.when(found.isNotNull(), let(with_words, of)).otherwise(F.from_json(F.lit("[]"), shape))


def personal_spans(docs: DataFrame, **learning) -> DataFrame:
    """All columns of ``docs`` with ``spans``: base spans as in ``base_spans``, then those of kind ``context-…`` by kind and start.

    ``learning`` goes to ``contextual``. A null text counts as empty and has none. Equal texts have equal spans. A column
    named ``spans`` is replaced, others pass whatever their names. An empty table gives no rows.
    """
    found = contextual(docs, **learning)
    own = F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "spans"]).alias("own")
    keyed = docs.select(own, text_or_empty().alias("body"), F.xxhash64(text_or_empty()).alias("text_key")).join(small(keep(found)), F.col("text_key") == F.col("key"), "left")
    # first the spans, then the row's own columns, which may be named like those that make them
    return keyed.select("own", F.concat(base_spans(F.col("body")), _spans_of(F.col("found"), F.col("body"))).alias("spans")).select("own.*", "spans")


def _without_contextual(text: Column, spans: Column) -> Column:
    """``text`` with its contextual spans, which are few and apart, named instead of given."""
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"].startswith("context-")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    cut = lambda a, n: F.substring(text, a, n)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        ordered,
        start,
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.concat(s["out"], cut((s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")), F.lit("[IDENTIFIER]")).alias("out"),
        ),
        lambda s: F.concat(s["out"], cut((s["at"] + 1).cast("int"), F.char_length(text))),
    )
    return F.when(F.size(ordered) > 0, folded).otherwise(text)


def _without(kind: str, text: Column) -> Column:
    """``text`` with the valid matches of a kind named instead of given, joined anew from the texts between."""
    name = F.lit(f"[{kind.upper()}]")

    def rebuilt(t: Column) -> Column:
        pieces = F.zip_with(
            F.split(t, PATTERNS[kind], -1),
            F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)),
            lambda gap, m: F.concat(gap, F.when(m.isNull(), F.lit("")).when(valid(kind, m), name).otherwise(m)),
        )
        return F.when(t.rlike(PATTERNS[kind]), F.array_join(pieces, "")).otherwise(t)

    return let(text, rebuilt)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP], [CARD], [PHONE] or [IDENTIFIER]; other columns and null texts stay.

    Where kinds overlap, the first in the order of ``KINDS`` is replaced and the rest looked for in what is left.
    """
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), "text")
    text = _without_contextual(F.col("text"), F.col("spans"))
    for kind in KINDS:
        text = _without(kind, text)
    clean = F.when(F.size("spans") > 0, text).otherwise(F.col("text"))
    marked = personal_spans(rows).select("row", clean.alias("clean"))
    return marked.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.{quoted(c)}") for c in docs.columns])
