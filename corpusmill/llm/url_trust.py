"""URL filter: host and path rules, and trust propagated over the links between hosts.

Rules decide the pages they fit. Hosts whose pages rules mostly allow are seeds of trust,
hosts whose pages they mostly block are seeds of distrust. Trust flows along links as
personalised PageRank, distrust against them, and a page that no rule fits goes by the
scores of its host. DataFrame operations only; hosts, links and scores stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, small

#: (rule, action): host, then the start of the path. A rule fits its host and all subdomains; the longest decides.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DAMPING = 0.85
#: The share of the mass that may be left when it stops, far under the margin, and the rounds until then.
LEFT = 0.001
ROUNDS = math.ceil(math.log(LEFT) / math.log(DAMPING))
#: A host is a seed from this share of its pages on.
SEED_SHARE = 0.5
#: A host is blocked if its distrust exceeds its trust by this much; a seed alone starts with 1 - DAMPING.
MARGIN = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: An anchor up to the next angle bracket, and its address: each reads a page once, whether tags end or not.
ANCHOR = r"(?i)<a\s[^<>]*"
ADDRESS = r"""(?i)\shref\s{0,9}=\s{0,9}["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """(rule, action) of the longest rule that fits, or null. The list of rules is a parameter and becomes one expression."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for rule, action in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, weight): links from host to another host in anchors of ``html``, and their number.

    Only absolute and protocol-relative links name a host; others stay on their own.
    """
    anchors = pages.select(host_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(0))).alias("tag"))
    targets = anchors.select("a", F.regexp_extract("tag", ADDRESS, 1).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    named = targets.where(F.col("to").startswith("//") | F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")).select("a", host_of(full).alias("b"))
    return named.where("a <> '' AND b <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def seeds(judged: DataFrame, share: float = SEED_SHARE) -> DataFrame:
    """(side, host, mass): hosts of which rules allow (side 1) or block (side -1) at least ``share`` of the pages."""
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.sum(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocked"),
    )
    side = F.when(F.col("allowed") >= share * F.col("pages"), 1).when(F.col("blocked") >= share * F.col("pages"), -1)
    return counts.select(side.alias("side"), "host", F.lit(1.0).alias("mass")).where("side IS NOT NULL")


def propagate(start: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that any mass reaches.

    Personalised PageRank as its power series: each round moves ``damping`` of the mass of the last one over
    the links, along them for trust and against them for distrust, and scores add up
    (1 - damping) of it all. Mass of a host without such links ends there. It stops
    when no mass moves, at the latest after ``rounds``, when damping^rounds is left.
    """
    out = links.groupBy("a").agg(F.sum("weight").alias("total"))
    into = links.groupBy("b").agg(F.sum("weight").alias("total"))
    along = links.join(out, "a").select(F.lit(1).alias("side"), F.col("a").alias("host"), F.col("b").alias("next"), (F.col("weight") / F.col("total")).alias("share"))
    against = links.join(into, "b").select(F.lit(-1).alias("side"), F.col("b").alias("host"), F.col("a").alias("next"), (F.col("weight") / F.col("total")).alias("share"))
    moves = keep(along.union(against))
    mass = keep(start)
    waves = [mass]
    for _ in range(rounds):
        mass = keep(
            mass.join(moves, ["side", "host"]).groupBy("side", F.col("next").alias("host")).agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
        )
        if mass.isEmpty():
            break
        waves.append(mass)
    total = waves[0]
    for wave in waves[1:]:
        total = total.union(wave)
    of = lambda side: ((1 - damping) * F.sum(F.when(F.col("side") == side, F.col("mass")).otherwise(0.0)))
    return total.groupBy("host").agg(of(1).alias("trust"), of(-1).alias("distrust"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, margin: float = MARGIN, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    Rules first; else the host is blocked if distrust exceeds trust by more than ``margin``. A host of which rules
    allow and block half of the pages each is a seed of trust. An empty table gives no rows.
    A page without a host, and one whose host no mass reaches, is allowed. Null html has
    no links. Repeated rows count as often as they come; other columns aren't read.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.action")
    scores = propagate(seeds(ruled), host_links(pages), damping, rounds)
    blocked = scores.where(F.round(F.col("distrust") - F.col("trust"), 9) > margin).select("host", F.lit("block").alias("by_host"))
    joined = ruled.join(small(keep(blocked)), "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("action", "by_host", F.lit("allow")).alias("verdict"))
