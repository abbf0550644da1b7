"""Secrets in texts: patterns of keys and tokens, and passwords judged by what they would cost to guess.

Beside the patterns, values that stand where a credential is named are cut into words, dates,
repeats, keyboard walks and brute force at the least cost of guessing; those that are
expensive are secrets, whatever characters they are made of. The ranked words are the likeliest passwords, and after them
those that the corpus itself uses most outside of credential contexts. Whole texts are scanned, row by row, in Arrow batches.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}"),
}
KINDS = (*PATTERNS, "password")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Where a credential is named, and its value.
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_ -]?key|credentials?|auth|login|private[_ -]?key)["']?(?:[ \t]*[:=][ \t]*|[ \t]+is[ \t]+)["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)
#: A value is a secret from this many decimal digits of guesses on.
GUESSES = 8.0
#: Words of the corpus that join the ranked list, the most frequent ones, and how many texts must have one.
CORPUS_WORDS, WORD_TEXTS = 20_000, 3
#: Common words and passwords, the likelier first.
WORDS = (
    "password admin welcome login master secret dragon monkey shadow sunshine princess football baseball letmein trustno one love iloveyou hello "
    "freedom whatever michael jordan superman batman charlie donald jessica summer winter spring autumn flower cookie cheese computer internet "
    "samsung google apple orange banana purple yellow silver golden star angel devil ninja pirate tiger lion eagle falcon killer hunter ranger "
    "soccer hockey tennis guitar music test testing user guest root changeme default example sample demo pass key token house home family friend "
    "happy lucky magic power money the and for you are this that with from have not"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
SWAPS = str.maketrans("4@8310!57$", "aabeloists")
DATES = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)?\d\d", re.A)
YEAR, DAY = math.log10(200), math.log10(200 * 366)
#: Cost of starting another part, and the longest unit of a repeat.
PART, UNIT = 0.3, 16


def _neighbours() -> set[tuple[str, str]]:
    pairs = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    return pairs | {(b, a) for a, b in pairs}


NEXT = _neighbours()


def brute(char: str) -> float:
    """Decimal digits of guesses for one character by its class."""
    return 1.0 if char.isdigit() else math.log10(26) if char.isalpha() and char.isascii() else math.log10(33)


def _repeats(value: str) -> list[list[int]]:
    """For each unit, how many characters from a place on equal those a unit later."""
    n = len(value)
    made = []
    for unit in range(1, min(UNIT, n // 2) + 1):
        equal = [0] * (n + 1)
        for i in range(n - unit - 1, -1, -1):
            equal[i] = equal[i + 1] + 1 if value[i] == value[i + unit] else 0
        made.append(equal)
    return made


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """The least decimal digits of guesses for ``value``, and its parts (kind, text).

    Dynamic programming over places. A part is a ranked word (capitals and digit
    substitutions cost extra), a date, a unit of up to ``UNIT`` characters as often as it is repeated from a place on, a walk over
    neighbouring keys or letters of three or more, or characters tried one by one. Work grows
    with the length times the longest word and unit: walks and characters carry their cheapest start along.
    """
    ranks = RANKS if words is None else words
    longest = max(map(len, ranks), default=0)
    low, plain = value.lower(), value.lower().translate(SWAPS)
    n = len(value)
    if len(low) != n or len(plain) != n:  # a letter whose small form is longer: no words in it
        low = plain = value
    ahead = [0.0, *(brute(c) for c in value)]
    for i in range(n):
        ahead[i + 1] += ahead[i]
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    repeats = _repeats(value)

    def offer(i: int, j: int, cost: float, kind: str) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (i, kind)

    forced, forced_at = math.inf, 0  # the cheapest start of characters tried one by one that end here
    walk, walk_at, walk_from = math.inf, 0, 0  # and of a walk that goes on here, and where its keys begin to be neighbours
    for i in range(n):
        if best[i] + PART - ahead[i] < forced:
            forced, forced_at = best[i] + PART - ahead[i], i
        if forced + ahead[i + 1] < best[i + 1]:
            best[i + 1], back[i + 1] = forced + ahead[i + 1], (forced_at, "brute")
        if i and (low[i - 1], low[i]) not in NEXT:
            walk, walk_from = math.inf, i
        if i - 2 >= walk_from:
            if best[i - 2] - 0.3 * (i - 2) < walk:
                walk, walk_at = best[i - 2] - 0.3 * (i - 2), i - 2
            offer(walk_at, i + 1, PART + math.log10(94) + 0.3 * (i + 1 - walk_at), "walk")
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            swapped = 0
            if rank is None and (rank := ranks.get(plain[i:j])):
                swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if rank:
                capitals = value[i:j] != low[i:j]
                offer(i, j, PART + math.log10(rank + 1) + (0.3 + 0.3 * swapped) * bool(swapped) + 0.5 * capitals, "word")
        if value[i].isdigit() and (date := DATES.match(value, i)):
            offer(i, date.end(), PART + (YEAR if date.end() - i == 4 else DAY), "date")
            if value[i : i + 4].isdigit() and 1900 <= int(value[i : i + 4]) < 2100:
                offer(i, i + 4, PART + YEAR, "date")
        for unit, equal in enumerate(repeats, 1):
            times = equal[i] // unit + 1
            if times >= 2 and (unit > 1 or times >= 3):
                offer(i, i + unit * times, PART + ahead[i + unit] - ahead[i] + math.log10(times), "repeat")
    parts, j = [], n
    while j > 0:
        i, kind = back[j]
        parts.append((kind, value[i:j]))
        j = i
    return best[n], parts[::-1]


RANKS = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}


def corpus_words(docs: DataFrame, number: int = CORPUS_WORDS, texts: int = WORD_TEXTS) -> list[str]:
    """The ``number`` words of three to twenty ASCII letters that most texts use, the likelier first, of those in ``texts`` or more; values in credential contexts don't count.

    Counted over all texts, added up in each task; only the list, of a stated length, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "texts"])
            counts.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                if NAMED.search(text):
                    text = CONTEXT.sub(" ", text)
                counts.update(set(WORD.findall(text.lower())))
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, texts bigint").groupBy("word").agg(F.sum("texts").alias("texts"))
    return [r["word"] for r in counted.where(F.col("texts") >= texts).orderBy(F.desc("texts"), "word").limit(number).collect()]


def find(text: str, guesses: float = GUESSES, words: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets in the order of places; passwords only where no pattern matched."""
    spans = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                spans.append((m.start(), number, m.end()))
    taken = sorted((a, b) for a, _, b in spans)
    ends = list(itertools.accumulate((b for _, b in taken), max))
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m.group(1).rstrip(".)!?:")
        end = start + len(value)
        before = bisect.bisect_left(taken, (end, 0))  # patterns that begin before the value ends
        if not value or before and ends[before - 1] > start:
            continue
        if guess_cost(value, words)[0] >= guesses:
            spans.append((start, len(PATTERNS), end))
    return sorted(spans)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


#: A text without any of these, in small letters, has no credential context.
NAMED = re.compile(r"pass|pwd|pin\b|secret|token|key|credential|auth|login", re.I | re.A)


WORD = re.compile(r"(?<![a-z])[a-z]{3,20}(?![a-z])")


def scan(docs: DataFrame, guesses: float = GUESSES, words: list[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_password, base_sha256, spans) for every row of ``docs``.

    ``words`` come after ``WORDS`` in the ranked list; without them, ``corpus_words`` of ``docs`` do.
    Spans are in code points, by start and then by kind. A null text counts as empty; a null
    ``doc_id`` stays null; repeated rows repeat; an empty table gives no rows; other columns aren't read. Long
    texts and values are read whole, in time that grows with their length.
    """
    more = corpus_words(docs) if words is None else words
    ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *more]))}
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_password bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(1):
                text = value.as_py() or ""
                if NAMED.search(text):
                    spans = find(text, guesses, ranks)
                else:
                    spans = sorted((m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) if k for m in PATTERNS[kind].finditer(text) if len(m.group()) >= LEAST[kind])
                base = [s for s in spans if s[1] < len(PATTERNS)]
                counts = [sum(s[1] == k for s in spans) for k in range(len(KINDS))]
                made.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            columns = list(zip(*made, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns[:4]), *(pa.array(list(c), pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_password", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
