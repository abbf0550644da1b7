"""Benchmark decontamination with a distributed positional inverted index.

Every window of ``window`` consecutive words of an item is a phrase query. One pass
over the corpus counts the words of the queries. A second makes the postings
(text key, position) of the rarest term of each query, moves them by the term's offset,
and intersects them with the places of the next rarest terms in the same text. Only what
has all rarest terms in place is compared word by word, and the postings that stay are
stored. Proximity matches intersect stored postings within a span instead.

All of it is DataFrame operations. Postings are made and intersected inside the scan, so
no word list is shuffled and a word that fills a third of the corpus isn't one task's
work. Rarest terms are looked up in blocks of a fixed number, one pass for each block.
Texts are told apart by a 64-bit hash: copies share their places, and a repeated or null
``doc_id`` makes no difference.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.llm.common import keep, quoted, small

WINDOW = 10
#: Rarest terms of a query whose lists are intersected before words are compared.
LISTS = 2
#: Rarest terms that one pass over the corpus looks up; more queries take more passes.
TERMS = 20_000
#: Proximity: so many rarest terms of an item within so many words.
NEAR_TERMS = 4
NEAR_SPAN = 30
#: What separates words: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def phrase_queries(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, words, ids): the distinct windows of all items and the ids of the items that have them.

    An item of fewer words than ``window``, but not none, is one window. A null ``item_id``
    still makes windows; it is in no list of ids.
    """
    worded = items.select(F.col("item_id").cast("string").alias("id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        worded.select("id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("id").alias("ids"))
        .select(F.xxhash64(F.array_join("words", " ")).alias("wid"), "words", "ids")
    )


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` comes in the whole corpus; a term that never comes isn't returned."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("n"))


def store_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, text_key, pos): every place of ``terms`` in the corpus, kept in the shared folder. Positions count words from 0."""
    tokens = docs.select(F.xxhash64("text").alias("text_key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return keep(tokens.join(small(terms.select("term").distinct()), "term").select("term", "text_key", "pos"))


def _rarest(terms: DataFrame, by: str, counts: DataFrame, lists: int) -> DataFrame:
    """The ``lists`` rarest (term, off) of each ``by``, numbered from 0 in ``rank``; none for one with a term that never comes."""
    every = Window.partitionBy(by)
    return (
        terms.join(counts, "term", "left")
        .withColumn("absent", F.max(F.col("n").isNull()).over(every))
        .where("NOT absent")
        .withColumn("rank", F.row_number().over(every.orderBy("n", "term", "off")) - 1)
        .where(F.col("rank") < lists)
        .withColumn("all_ranks", F.sum(F.expr("shiftleft(1, rank)")).over(every))
        .select(by, "term", "off", "rank", "all_ranks")
    )


def _posted(terms: list[str], window: int) -> Callable[[Column], Column]:
    """Postings of ``terms`` in an array of words: place, term, and the words around it that a query can cover."""

    def of(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda word, i: F.when(word.isin(terms), i)), lambda i: i.isNotNull())
        low = lambda i: F.greatest(i - (window - 1), F.lit(0))
        return F.transform(
            places, lambda i: F.struct(i.alias("pos"), low(i).alias("low"), F.get(words, i).alias("term"), F.slice(words, low(i) + 1, i - low(i) + window).alias("around"))
        )

    return of


def phrase_places(docs: DataFrame, queries: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(text_key, start, length, ids): every occurrence of every query in the texts of ``docs``, stored once whatever the copies of a text."""
    terms = queries.select("wid", F.posexplode("words").alias("off", "term"))
    counts = keep(term_counts(docs, terms))
    rarest = _rarest(terms, "wid", counts, lists)
    others = F.array_sort(F.collect_list(F.struct("rank", "off", "term")))
    plans = rarest.groupBy("wid").agg(others.alias("lists")).join(queries, "wid").select(
        F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["off"].alias("off"), F.slice("lists", 2, lists).alias("others"), "words", "ids", "wid"
    )
    plans = keep(plans)
    blocks = max(1, math.ceil(plans.select("term").distinct().count() / TERMS))
    found = None
    for block in range(blocks):
        # a block has about as many terms as one pass looks up, whatever the number of queries
        part = plans.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        wanted = [r["term"] for r in part.select("term").distinct().collect()]

        postings = docs.select(F.xxhash64("text").alias("text_key"), F.inline(let(words_of(F.col("text")), _posted(wanted, window))))
        start = F.col("pos") - F.col("off")
        in_place = F.forall("others", lambda o: F.coalesce(F.get("around", F.col("pos") - F.col("off") - F.col("low") + o["off"]) == o["term"], F.lit(False)))
        met = postings.join(small(part.drop("wid")), "term").where((start >= 0) & in_place)
        exact = met.where(F.slice("around", start - F.col("low") + 1, F.size("words")) == F.col("words"))
        exact = exact.select("text_key", start.alias("start"), F.size("words").alias("length"), "ids")
        found = exact if found is None else found.union(exact)
    # text, start and length say which window it is, and so its ids
    return keep(found.dropDuplicates(["text_key", "start", "length"]))


def _by_text(places: DataFrame) -> DataFrame:
    """(_text_key, n_hit, hit_items, hits): what is hit in each text that has any place; as many rows as such texts."""
    spans = places.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"))
    # an item is collected once for a text, however many of its windows are there; one without an id is in no list
    ids = places.select("text_key", F.explode("ids").alias("id")).distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("id")).alias("hit_items"))
    none = F.array().cast("array<string>")
    grouped = spans.join(ids, "text_key", "left").select(F.col("text_key").alias("_text_key"), "hits", F.coalesce("hit_items", none).alias("hit_items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
    return grouped.select("_text_key", F.size(covered).cast("bigint").alias("n_hit"), "hit_items", "hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, hit_items (ids as strings, sorted), hits (start, length) and contaminated.

    A word inside any occurrence of any window is hit. Null and wordless texts have
    neither words nor hits; no items, no hits; an empty table gives no rows. Columns of these names are replaced, others pass whatever their names. Texts
    aren't shuffled unless the caller keeps them.
    """
    places = phrase_places(docs.select("text").where("text IS NOT NULL"), keep(phrase_queries(items, window)), window, lists)
    mine = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hits", "contaminated")]
    own = F.struct(*[F.col(quoted(c)) for c in mine]).alias("own")
    counted = docs.select(own, F.xxhash64("text").alias("key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    joined = counted.join(small(keep(_by_text(places)), 20_000), F.col("key") == F.col("_text_key"), "left")
    return joined.select(
        "own.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce("hits", F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>")).alias("hits"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """(doc_id, item_id, first, last): places where the ``terms`` rarest distinct terms of an item come within ``span`` words, in any order.

    ``first`` and ``last`` are the outer word positions. An item with a word that never
    comes in the corpus, or with fewer distinct terms, uses those that it has.
    """
    bag = items.select(F.col("item_id").alias("wid"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).where("wid IS NOT NULL").distinct()
    counts = keep(term_counts(docs.select("text"), bag))
    known = bag.join(counts.select("term"), "term").withColumn("off", F.lit(0))
    rare = keep(_rarest(known, "wid", counts, terms))
    postings = store_postings(docs.select("text").where("text IS NOT NULL").distinct(), rare)
    placed = postings.join(small(rare), "term").select("text_key", "wid", "pos", "rank", "all_ranks")
    cell = F.floor(F.col("pos") / span)
    near = (
        placed.withColumn("cell", F.explode(F.array(cell, cell - 1)))
        .groupBy("text_key", "wid", "cell", "all_ranks")
        .agg(F.bit_or(F.expr("bigint(shiftleft(1, rank))")).alias("found"), F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("at"))
        .where("found = all_ranks")
    )
    # from each place on, the first place by which every term has come
    ends = F.transform(
        "at",
        lambda a: F.struct(
            a["pos"].alias("first"),
            F.array_max(
                F.transform(
                    F.array_distinct(F.col("at.rank")),
                    lambda r: F.array_min(F.transform(F.filter("at", lambda b: (b["rank"] == r) & (b["pos"] >= a["pos"])), lambda b: b["pos"])),
                )
            ).alias("last"),
            F.size(F.array_distinct(F.transform(F.filter("at", lambda b: b["pos"] >= a["pos"]), lambda b: b["rank"]))).alias("have"),
        ),
    )
    spans = (
        near.select("text_key", "wid", F.size(F.array_distinct(F.col("at.rank"))).alias("need"), F.explode(ends).alias("s"))
        .where((F.col("s.have") == F.col("need")) & (F.col("s.last") - F.col("s.first") < span))
        .select("text_key", F.col("wid").alias("item_id"), "s.first", "s.last")
        .distinct()
    )
    return docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(spans, "text_key").select("doc_id", "item_id", "first", "last").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no window of any item occurs."""
    places = phrase_places(docs.select("text").where("text IS NOT NULL"), keep(phrase_queries(items, window)), window, lists)
    hit = places.select(F.col("text_key").alias("_hit_key")).distinct()
    # the row goes as one value, so that its names meet no others
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own"), F.xxhash64("text").alias("key"))
    return keyed.join(small(keep(hit)), F.col("key") == F.col("_hit_key"), "left_anti").select("own.*")
