"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores what was measured and one
bit for each rule that failed. A policy is a version and a mask of the rules that
reject; applying another policy, or asking what a rule adds, only combines bits and
never reads a text again. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

#: ASCII whitespace, as Java's regular expressions name it.
GAP = r"[ \t\n\x0B\f\r]+"
WINDOW = 8
#: The measures of a text, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_exclamations")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measures; ``bit`` never changes once given."""

    bit: int
    name: str
    fails: str


#: Integer comparisons throughout, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 3 * word_chars"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "few_distinct_words", "n_words >= 30 AND n_words <= 1000 AND 100 * n_distinct_words < 40 * n_words"),
    Rule(5, "shouting", "100 * n_capitals > 40 * word_chars"),
    Rule(6, "exclamations", "100 * n_exclamations > 15 * n_words"),
    Rule(7, "word_length", "word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words"),
)

#: Policies by version: the bits that reject. Version 1 is the base rules alone.
POLICIES = {1: 0b00000011, 2: 0b01111111}
BASE = POLICIES[1]
CURRENT = 2


def _repeated(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that come twice or more in the text.

    Windows are compared by 64-bit hashes. Texts in which no hash comes twice, most of
    them, end there; in the others the hashes are sorted with their places, so the work
    is in the order of the words (times their logarithm).
    """
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(found, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def twice(ordered: Column) -> Column:
        again = lambda e, other: F.coalesce(e["h"] == F.get(ordered, other)["h"], F.lit(False))
        marked = F.transform(ordered, lambda e, i: F.when(again(e, i + 1) | ((i > 0) & again(e, F.greatest(i - 1, F.lit(0)))), e["p"]))
        return let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(pairs, twice))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes, counted))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def measures(text: Column) -> Column:
    """A struct of ``MEASURES``; a null text counts as empty."""
    full = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(full, GAP), "")
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
        )

    def of_lines(each: Column) -> Column:
        return F.struct(F.size(each).cast("bigint").alias("n"), F.size(F.array_distinct(each)).cast("bigint").alias("distinct"))

    return let(
        F.struct(let(words, of).alias("w"), let(lines, of_lines).alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            _count(full, r"[#*$%&|<>]").alias("n_symbols"),
            (m["l"]["n"] - m["l"]["distinct"]).alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["l"]["n"].alias("n_lines"),
            m["w"]["n_distinct_words"].alias("n_distinct_words"),
            _count(full, r"\p{Lu}").alias("n_capitals"),
            _count(full, "!").alias("n_exclamations"),
        ),
    )


def ledger(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``measured`` (a struct) and ``failures`` (one bit for each rule that fails).

    No shuffle; one row out for each row in, whatever repeats. Columns of these two
    names are replaced.
    """
    names = [c for c in docs.columns if c not in ("measured", "failures")]
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint") for rule in rules]
    # the conditions name measures, so they are evaluated where no column of docs can be in their way
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"), measures(F.col(text)).alias("measured"))
    failing = own.select("_own", "measured", "measured.*")
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return failing.select("_own", "measured", total.alias("failures")).select("_own.*", "measured", "failures")


def rejected(policy: int = CURRENT) -> Column:
    """Whether the bits of ``policy`` reject a row of a ledger."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(entries: DataFrame, policy: int = CURRENT, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(rule, failed, alone, kept, kept_without): what each rule of a policy does, from the counts of the ledger's bit patterns.

    ``alone``: rows only this rule rejects; ``kept_without``: rows kept if it went.
    Patterns are counted before anything is shuffled; there are at most 2^rules.
    """
    mask = POLICIES[policy]
    patterns = entries.groupBy("failures").count()
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules if mask >> r.bit & 1])
    live = F.col("failures").bitwiseAND(F.lit(mask))
    total = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(0))
    return (
        patterns.select("failures", "count", F.explode(listed).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("failures").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
            total(live == F.col("r.bit")).alias("alone"),
            total(live == 0).alias("kept"),
            total((live == 0) | (live == F.col("r.bit"))).alias("kept_without"),
        )
    )
