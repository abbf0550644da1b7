"""SimHash near-duplicates: blocked pivot distance tables, exact within the stated number of bits.

A fingerprint has 64 bits. Two link at ``bits`` or fewer differing bits. Cut into
``bits + 2`` blocks, linked fingerprints agree on two blocks at least, so every pair
of blocks is one table of keys, and only fingerprints that share a key are compared.
Each task then has a table of Hamming distances from its fingerprints to ``PIVOTS``
reference fingerprints. By the triangle inequality a pair whose distances to any
pivot differ by more than ``bits`` can't link: the first distance orders the rows of a
key, so that only a window of them meets, the others discard pairs by the maximum
difference, and the survivors are verified on the fingerprints themselves.

Only distinct fingerprints are compared, so copies cost nothing. A key with more
than ``BLOCK`` fingerprints is split into pairs of chunks that go to different
tasks. A task gives each fingerprint one link to the smallest of its part, which
keeps components whole and never lists all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import keep, quoted, release, small, spread_join, stored, text_or_empty
from corpusmill.llm.components import connected_components, lowest_rows

BITS = 3
SHINGLE = 3
SEED = 42
#: Reference fingerprints of the distance tables.
PIVOTS = 16
#: Fingerprints of one key that one task compares; larger keys are split into pairs of chunks of this size.
BLOCK = 4096
#: Near-deduplication: seeds of the word fingerprints that propose pairs, and the shingles and similarity that decide.
PROPOSE_SEEDS = (42,)
VERIFY_SHINGLE = 5
SIMILAR = 0.8
#: Longs of a sketch, and the hashes it can hold: of a larger set it holds a share that halves until they fit.
SKETCH, HELD = 8, 256
#: Standard deviations by which such a share may be off before a pair is dropped; None compares those pairs on whole sets always.
SLACK = 6.0
#: Texts of one class that meet texts of others in one group.
MEET = 1024
#: What tells one meeting from another.
MEETING = ("root", "block", "chunk")
#: Row numbers that may be broadcast, a long each.
BROADCAST_NUMBERS = 500_000
#: Texts of the sample that says which hashes are common, in how many of them a common one is, and the bound of their number.
SAMPLE, OFTEN, COMMON = 4_000, 4, 100_000
#: Hashes whose bits are counted at a time.
AT_ONCE = 200_000


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text between ASCII whitespace, A to Z in lower case; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, repeats included; fewer words make one shingle, none makes none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 1:
        return words
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: a bit is 1 if it is set in over half of them; no hash, no bit."""
    ends = np.cumsum(counts)
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        part = hashes[start : start + AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, [start, start + len(part) - 1], side="right")
        rows = np.arange(first, last + 1)
        rows = rows[counts[rows] > 0]
        starts = np.maximum(ends[rows] - counts[rows] - start, 0)
        ones[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1)


def with_fingerprints(docs: DataFrame, size: int = SHINGLE, seeds: tuple[int, ...] = (SEED,), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, f0, f1, …): one fingerprint of each text's shingles for each seed of XXH64, as signed longs.

    ``text_key`` is a hash of the text as it is. Reads only the two columns named.
    A null text counts as empty; a text without words has the fingerprint zero. A null
    ``doc_id`` stays null.
    """
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[list[np.ndarray]] = [[] for _ in seeds]
            pending: list[list[np.ndarray]] = [[] for _ in seeds]
            counts: list[int] = []

            def flush() -> None:
                for into, parts in zip(done, pending, strict=True):
                    into.append(fingerprints(np.concatenate([*parts, np.empty(0, "<u8")]), np.array(counts, dtype=np.int64)).view(np.int64))
                    parts.clear()
                counts.clear()

            held = 0
            for value in batch.column(2):
                parts = shingles(ascii_words(value.as_py()), size)
                counts.append(len(parts))
                for seed, into in zip(seeds, pending, strict=True):
                    into.append(np.fromiter((xxhash.xxh64_intdigest(part, seed) for part in parts), dtype="<u8", count=len(parts)))
                held += len(parts)
                if held >= AT_ONCE:  # the words of a batch are never held together
                    flush()
                    held = 0
            flush()
            made = [np.concatenate(parts) for parts in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made)], names=["doc_id", "text_key", *names])

    schema = "doc_id bigint, text_key bigint, " + ", ".join(f"{n} bigint" for n in names)
    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_key"), body.alias("text")).mapInArrow(run, schema)


def _blocks(bits: int) -> list[tuple[int, int]]:
    """(offset, width) of ``bits + 2`` blocks of a fingerprint."""
    edges = [round(i * 64 / (bits + 2)) for i in range(bits + 3)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _keys(bits: int):
    """The key in every table: its number above the bits of two blocks."""
    made = []
    for number, ((a, wide_a), (b, wide_b)) in enumerate(itertools.combinations(_blocks(bits), 2)):
        part = lambda offset, wide: F.shiftrightunsigned("f", offset).bitwiseAND(F.lit((1 << wide) - 1))
        key = F.shiftleft(part(a, wide_a), wide_b).bitwiseOR(part(b, wide_b))
        made.append(key.bitwiseOR(F.lit(number << (wide_a + wide_b))) if wide_a + wide_b > 50 else key + F.lit(number << 52))
    return F.array(*made)


def pivots(number: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed rule: the bits of consecutive hashes."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 1) for i in range(number)], dtype=np.uint64)


def _pairs_of(key: np.ndarray, prints: np.ndarray, part: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal keys that link, in blocks; of a split key, only pairs across its two chunks (or inside the one)."""
    refs = pivots()
    table = np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], key))
    key, prints, part, table = key[order], prints[order], part[order], table[order]
    active = np.arange(len(key) - 1)
    for shift in range(1, len(key)):
        active = active[active + shift < len(key)]
        other = active + shift
        near = (key[active] == key[other]) & (table[other, 0] - table[active, 0] <= bits)
        active = active[near]
        if not len(active):
            return
        other = active + shift
        wide = np.abs(table[active] - table[other]).max(axis=1) <= bits
        a, b = active[wide], other[wide]
        real = (np.bitwise_count(prints[a] ^ prints[b]) <= bits) & ((part[a] != part[b]) | (part[a] < 0))
        if real.any():
            yield order[a[real]], order[b[real]]


def _noting_closest(prints: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], closest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passes pairs on and leaves in ``closest`` every row's partner of the fewest differing bits, the lowest of several. A block has a row once on each side."""
    differ = np.full(len(prints), 65)
    for a, b in pairs:
        apart = np.bitwise_count(prints[a] ^ prints[b]).astype(np.int64)
        for row, other in ((a, b), (b, a)):
            better = (apart < differ[row]) | ((apart == differ[row]) & (other < closest[row]))
            closest[row[better]], differ[row[better]] = other[better], apart[better]
        yield a, b


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that cut no (k, pair) in two, of batches sorted by it, with the number of each row's (k, pair)."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            frame = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not frame.num_rows:
                continue
            key = frame.column("k").to_numpy()
            pair = frame.column("pair").to_numpy()
            # the rows of the last key may go on in the next batch
            changes = np.nonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))[0]
            if not len(changes):
                rest = frame.to_batches()[0]
                continue
            cut = int(changes[-1]) + 1
            now, rest = frame.slice(0, cut), frame.slice(cut).combine_chunks().to_batches()[0]
        elif rest is not None:
            now, rest = pa.Table.from_batches([rest]), None
        else:
            return
        key, pair = (now.column(c).to_numpy() for c in ("k", "pair"))
        yield now, np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))])


def _compare(bits: int, closest_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, groups in _whole_keys(batches):
            part = now.column("part").to_numpy()
            prints = now.column("f").to_numpy().view(np.uint64)
            pairs = _pairs_of(groups, prints, part, bits)
            own = np.arange(len(groups))
            closest = own.copy()
            label = lowest_rows(len(groups), _noting_closest(prints, pairs, closest) if closest_too else pairs)
            made = prints.view(np.int64)
            for to in (label, closest):
                linked = np.nonzero(to != own)[0]
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(made[linked]), pa.array(made[to[linked]])], names=["a", "b"])

    return run


def _dealt(keyed: DataFrame, own: str, block: int) -> DataFrame:
    """``keyed`` with ``pair`` and ``part``, dealt and sorted by (k, pair): a key of more than ``block`` rows is split into pairs of chunks, by the hash of ``own``."""
    columns = keyed.columns
    crowded = keep(keyed.groupBy("k").count().where(F.col("count") > block).select("k", F.ceil(F.col("count") / block).cast("int").alias("chunks")))
    whole = (F.lit(0).alias("pair"), F.lit(-1).alias("part"))
    rows = keyed.select(*columns, *whole)
    if not crowded.isEmpty():
        found = keyed.join(small(crowded), "k", "left")
        mine = F.pmod(F.xxhash64(own), F.col("chunks")).cast("int")
        # chunk x of n meets every other chunk once and itself: the pairs (x, y) with x <= y
        other = F.explode(F.expr("sequence(0, chunks - 1)"))
        split = found.where("chunks IS NOT NULL").select(*columns, "chunks", mine.alias("mine"), other.alias("other"))
        split = split.select(
            *columns,
            (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other") + 1).cast("int").alias("pair"),
            F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("part"),
        )
        # rows of a chunk that meet another chunk carry their number, those that meet their own carry -1
        rows = found.where("chunks IS NULL").select(*columns, *whole).union(split)
    return rows.repartition("k", "pair").sortWithinPartitions("k", "pair", own)


def fingerprint_links(prints: DataFrame, bits: int = BITS, block: int = BLOCK, closest_too: bool = False) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``f`` which are joined by pairs at ``bits`` or fewer differing bits.

    Exact: every such pair is connected, directly or over others, and every link joins
    a pair connected by such pairs. With ``closest_too`` each fingerprint also gets a link to its
    closest partner under each key, at most one more for each. The links don't depend on
    the order of rows. Nulls are left out.
    """
    distinct = prints.where("f IS NOT NULL").select("f").distinct()
    keyed = distinct.select("f", F.explode(_keys(bits)).alias("k"))
    return _dealt(keyed, "f", block).mapInArrow(_compare(bits, closest_too), "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints at ``bits``
    or fewer differing bits, the row's own included; null only if all of them are null.
    Equal rows give equal rows; an empty table gives none; other columns aren't read.
    """
    marked = keep(with_fingerprints(docs, size, (seed,), text, key).select("doc_id", F.col("f0").alias("f")))
    first = marked.groupBy("f").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(marked, bits)).select(F.col("node").alias("f"), "root")
    lowest = first.join(roots, "f").groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = keep(first.join(roots, "f", "left").join(lowest, "root", "left").select("f", F.coalesce("component_id", "first_id").alias("component_id")))
    return marked.join(classes, "f", "left").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


class _WordHashes(dict):
    """The hash of each word seen, computed once; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > AT_ONCE:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return made


MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes (32 bits, ascending) of every run of ``size`` word hashes; fewer words make one run, none makes none."""
    if not len(words):
        return np.empty(0, np.int32)
    width = min(size, len(words))
    made = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        made = (made ^ words[i : i + len(made)]) * MIX
        made ^= made >> np.uint64(29)
    return np.unique((made >> np.uint64(32)).astype(np.uint32).view(np.int32))


def share_of(number: int) -> int:
    """How often the share of a set of ``number`` hashes is halved until its sketch holds it."""
    return max(0, (number - 1) // HELD).bit_length()


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ``SKETCH`` places: whether an odd number of the hashes falls there.

    Two sketches differ in no more bits than their sets in hashes, whatever the sets.
    """
    spread = (hashes.view(np.uint32).astype(np.uint64) + np.uint64(1)) * MIX
    halved = share_of(len(hashes))
    taken = spread[((spread >> np.uint64(8)) & np.uint64((1 << halved) - 1)) == 0] if halved else spread
    odd = np.bincount((taken >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(hashes: np.ndarray) -> np.ndarray:
    """An odd sketch of the whole set, on two places or more for each of its hashes: a power of two of longs, so that the longer of two folds to the other's places."""
    places = 64 << max(0, (2 * len(hashes) - 1) // 64).bit_length()
    spread = (hashes.view(np.uint32).astype(np.uint64) + np.uint64(1)) * MIX
    odd = np.bincount(((spread >> np.uint64(32)) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_apart(one: np.ndarray, other: np.ndarray) -> int:
    """The bits in which two wide sketches differ, on the places of the shorter one: never more than their sets in hashes."""
    longs = min(len(one), len(other))
    one, other = (np.bitwise_xor.reduce(x.reshape(-1, longs), axis=0) for x in (one, other))
    return int(np.bitwise_count((one ^ other).view(np.uint64)).sum())


def _most_apart(n, m, similar: float, slack: float | None = SLACK):
    """The bits in which sketches of sets of ``n`` and ``m`` hashes, alike by ``similar``, may differ; for numbers, or arrays of them."""
    apart = (n + m) * (1 - similar) / (1 + similar) + 1e-6
    halved = np.ceil(np.log2(np.maximum((np.maximum(n, 1) - 1) // HELD + 1, 1)))
    mean = apart / 2**halved
    return np.where(halved == 0, apart, np.inf if slack is None else mean + slack * np.sqrt(mean) + slack)


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # the words of a batch are never held together
                sets, prints, held, first = [], [], 0, at
                while at < batch.num_rows and held < AT_ONCE:
                    words = ascii_words(batch.column(2)[at].as_py())
                    hashes = np.fromiter(map(known.__getitem__, words), "<u8", len(words))
                    prints.append(hashes)
                    sets.append(shingle_set(hashes, size))
                    held, at = held + len(words), at + 1
                numbers = np.array([len(s) for s in sets], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)), pa.array(np.concatenate(sets)))
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([odd_sketch(s) for s in sets])), SKETCH).cast(pa.list_(pa.int64()))
                f0 = fingerprints(np.concatenate(prints), np.array([len(p) for p in prints], np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, at - first) for i in (0, 1, 3)), pa.array(f0), pa.array(numbers), sketches, lists],
                    names=["doc_id", "text_key", "row", "f0", "n", "odd", "hashes"],
                )

    return run


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, row, f0, n, odd, hashes): each row's number, fingerprint of single words, the number of its distinct word shingle hashes, their sketch, and they themselves.

    Written to the shared folder in the scan of the texts, so no text is shuffled and later steps read only the columns they need.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty().cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    return stored(rows.mapInArrow(_sketched(size), "doc_id bigint, text_key bigint, row bigint, f0 bigint, n int, odd array<bigint>, hashes array<int>"), "sketches")


def _of_texts(sketches: DataFrame, texts: DataFrame, *columns: str, few: bool = False) -> DataFrame:
    """(text_key, ``columns``) once for each of ``texts`` (text_key, row), from that row; copies of a text meet in no key.

    With ``few`` there are no more than ``BROADCAST_NUMBERS`` texts in all, so those wanted are not counted.
    """
    wanted = texts.select(F.col("row").alias("of"))
    wanted = F.broadcast(wanted) if few else small(wanted, BROADCAST_NUMBERS)
    own = sketches.select("row", "text_key", *columns)
    return own.join(wanted, F.col("row") == F.col("of")).select("text_key", *columns)


def _narrow(sketches: DataFrame, *columns: str) -> DataFrame:
    """(text_key, ``columns``) once for each text, for columns that are short and the same for all copies: these are dropped in the scan, nothing is broadcast."""
    return sketches.select("text_key", *columns).dropDuplicates(["text_key"])


def _ends(pairs: DataFrame) -> DataFrame:
    """(text_key): every text of the pairs once."""
    return pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, columns: list[str], spread: bool = False) -> DataFrame:
    """``pairs`` with the columns of both texts, named after the end; with ``spread`` a text of many pairs is broadcast, else left to adaptive execution."""
    for end in "ab":
        own = sets.select(F.col("text_key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = spread_join(pairs, own, [end]) if spread else pairs.join(own, end)
    return pairs


def _may_be_alike(similar: float, slack: float | None) -> Column:
    """Whether numbers and sketches of two sets allow the similarity; sketches that hold different shares say nothing."""
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similar - 1e-9
    halved = lambda n: F.ceil(F.log2(F.greatest(F.floor((F.col(n) - 1) / HELD) + 1, F.lit(1))))
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("n_a") + F.col("n_b")) * (1 - similar) / (1 + similar) + 1e-6
    mean = most / F.pow(F.lit(2.0), halved("n_a"))
    limit = F.when(halved("n_a") == 0, most).otherwise(mean + slack * F.sqrt(mean) + slack) if slack is not None else F.when(halved("n_a") == 0, most).otherwise(F.lit(float("inf")))
    return sizes & ((halved("n_a") != halved("n_b")) | (apart <= limit))


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        made = [wide_sketch(np.array(lists[i].values)) for i in range(batch.num_rows)]
        ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        wide = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*made, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wide], names=["text_key", "n", "wide"])


def _not_told_apart(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ones, others = batch.column("wide_a"), batch.column("wide_b")
            apart = np.array([wide_apart(np.array(ones[i].values), np.array(others[i].values)) for i in range(batch.num_rows)], np.int64)
            near = (np.minimum(n, m) >= similar * np.maximum(n, m) - 1e-9) & (apart <= (n + m) * (1 - similar) / (1 + similar) + 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def likely(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similar: float = SIMILAR, few: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) that wide sketches, made in the scan of the sets, don't tell apart: all that are alike, whatever the size of the sets, and few that are not."""
    sets = _of_texts(sketches, texts.join(_ends(pairs), "text_key"), "n", "hashes", few=few)
    wide = sets.mapInArrow(_widened, "text_key bigint, n int, wide array<bigint>")
    return _with_both(pairs, wide, ["n", "wide"]).mapInArrow(_not_told_apart(similar), "a bigint, b bigint")


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similar: float = SIMILAR, few: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets of shingle hashes have a Jaccard similarity of ``similar`` or more; sets only move for pairs that are ``likely``."""
    pairs = keep(likely(pairs, sketches, texts, similar, few))
    whole = _with_both(pairs, _of_texts(sketches, texts.join(_ends(pairs), "text_key"), "hashes", few=few), ["hashes"])
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    union = F.size("hashes_a") + F.size("hashes_b") - common
    return whole.where((union == 0) | (common >= union * similar - 1e-9)).select("a", "b")


def _classes(links: DataFrame) -> DataFrame:
    """(text_key, root) of the texts that have a link."""
    return connected_components(links).select(F.col("node").alias("text_key"), "root")


def connecting(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similar: float = SIMILAR, slack: float | None = SLACK, few: bool = False) -> DataFrame:
    """Links among ``pairs`` (a, b), all verified on whole sets, that connect what all of those pairs that are alike would connect.

    Sketches drop most pairs that aren't. Of the others each text's closest is verified first, and after that
    only pairs whose ends aren't linked to the same text yet, so sets are moved about once for each text.
    """
    near = _with_both(pairs, _narrow(sketches, "n", "odd"), ["n", "odd"], spread=True)
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    first = keep(near.where(_may_be_alike(similar, slack)).select("a", "b", apart.alias("apart")))
    ends = first.union(first.select("b", "a", "apart")).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    closest = keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = keep(verified(closest, sketches, texts, similar, few))
    release(sketches.sparkSession)
    # the smallest text that a text is linked to stands for its class; pairs with the same one are connected
    both = found.union(found.select("b", "a"))
    labels = keep(both.groupBy(F.col("a").alias("text_key")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    rest = first.select("a", "b").join(closest, ["a", "b"], "left_anti")
    for end in "ab":
        rest = rest.join(labels.select(F.col("text_key").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    rest = keep(rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"))
    return found if rest.isEmpty() else found.union(verified(rest, sketches, texts, similar, few))


def _common_hashes(sketches: DataFrame, texts: DataFrame, number: int) -> list[int]:
    """Hashes that are in many of a sample by text key of the ``number`` texts, the rarest first: no more than ``COMMON``, whatever the corpus."""
    sample = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(max(1, number // SAMPLE))) == 0)
    hashes = _of_texts(sketches, sample, "hashes", few=number <= BROADCAST_NUMBERS).select(F.explode("hashes").alias("h"))
    top = hashes.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON)
    return [r["h"] for r in sorted(top.collect(), key=lambda r: (r["count"], r["h"]))]


def _prefixes(common: list[int], similar: float):
    """Each text's first hashes in one order for all texts: rare ones by value, then the common ones by how often they come.

    Texts of n and m hashes, alike by ``similar`` or more, share that part of the larger, so
    their first n - ⌈similar · n⌉ + 1 and m - ⌈similar · m⌉ + 1 have one in common.
    """
    values = np.array(common, dtype=np.int32)
    by_value = np.argsort(values)
    ordered = values[by_value]

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, numbers = (batch.column(i).to_numpy() for i in (0, 1))
        hashes = batch.column(2).flatten().to_numpy()
        row = np.repeat(np.arange(len(numbers)), numbers)
        rank = np.zeros(len(hashes), dtype=np.int64)
        if len(ordered):
            at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
            rank = np.where(ordered[at] == hashes, by_value[at] + 1, 0)
        order = np.lexsort((hashes, rank, row))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        prefix = numbers - np.ceil(similar * numbers - 1e-9).astype(np.int64) + 1
        first = place < prefix[row]
        row, place, hashes = row[first], place[first], hashes[order][first]
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(keys[row]), pa.array(numbers[row].astype(np.int32)), pa.array(place.astype(np.int32))], names=["k", "text_key", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # copies in a batch have the same rows
            own = np.unique(batch.column(0).to_numpy(), return_index=True)[1]
            ends = np.cumsum(batch.column(1).to_numpy()[own], dtype=np.int64)
            start = 0
            while start < len(own):  # a batch's hashes are neither copied nor ordered all at once
                end = max(start + 1, int(np.searchsorted(ends, AT_ONCE + (ends[start - 1] if start else 0), side="right")))
                yield taken(batch.take(pa.array(own[start:end])))
                start = end

    return run


def _shared_prefixes(sketches: DataFrame, texts: DataFrame, number: int, similar: float) -> DataFrame:
    """(k, text_key, n, at, rep): prefix hashes that two texts or more have; the number of the text's hashes, the place of this one, and the (text_key, n, at) of the smallest text that has it.

    One shuffle by hash; a hash of one text alone goes in its task and is never stored.
    """
    dealt = sketches.select("text_key", "n", "hashes").mapInArrow(_prefixes(_common_hashes(sketches, texts, number), similar), "k int, text_key bigint, n int, at int").repartition("k")
    ends = dealt.groupBy("k").agg(F.min(F.struct("text_key", "n", "at")).alias("rep"), F.max("text_key").alias("last"))
    several = ends.where("rep.text_key <> last").drop("last")
    return stored(dealt.join(several.hint("merge"), "k").dropDuplicates(["k", "text_key"]), "prefixes")


def _can_be_alike(n: Column, at: Column, m: Column, place: Column, similar: float) -> Column:
    """Whether texts of ``n`` and ``m`` hashes that share one at these places can have enough in common before and after it."""
    most = F.least(at, place) + 1 + F.least(n - at - 1, m - place - 1)
    return (F.least(n, m) >= F.greatest(n, m) * similar - 1e-9) & (most * (1 + similar) >= (n + m) * similar - 1e-9)


def _apart(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)


def _across(similar: float, slack: float | None):
    """What may be alike under one hash: pairs (a, b) of texts that stand alone for their class there, after sizes, places and sketches; and (a, b, class) of a text, or a class, and a class with several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, groups in _whole_keys(batches):
            roots, keys, low, high, at, part = (now.column(c).to_numpy().astype(np.int64) for c in ("root", "text_key", "low", "high", "at", "part"))
            several = now.column("several").to_numpy(zero_copy_only=False)
            sketches = np.array(now.column("odd").combine_chunks().flatten()).reshape(-1, SKETCH).view(np.uint64)
            order = np.lexsort((high, groups))
            groups, roots, keys, low, high, at, part, several, sketches = (x[order] for x in (groups, roots, keys, low, high, at, part, several, sketches))
            found: list[np.ndarray] = []

            def note(a: np.ndarray, b: np.ndarray, kind: int) -> None:
                if len(a):
                    found.append(np.unique(np.stack([a, b, np.full(len(a), kind)], axis=1), axis=0))

            alone = np.flatnonzero(~several)
            active = np.arange(len(alone) - 1)
            for shift in range(1, len(alone)):
                active = active[active + shift < len(alone)]
                a, b = alone[active], alone[active + shift]
                near = (groups[a] == groups[b]) & (high[a] >= similar * high[b] - 1e-9)
                active, a, b = active[near], a[near], b[near]
                if not len(active):
                    break
                most = np.minimum(at[a], at[b]) + np.minimum(high[a] - at[a], high[b] - at[b])
                real = ((part[a] != part[b]) | (part[a] < 0)) & (most * (1 + similar) >= similar * (high[a] + high[b]) - 1e-9)
                a, b = a[real], b[real]
                limit = np.where(np.ceil(np.log2(np.maximum((high[a] - 1) // HELD + 1, 1))) == np.ceil(np.log2(np.maximum((high[b] - 1) // HELD + 1, 1))), _most_apart(high[a], high[b], similar, slack), np.inf)
                real = _apart(sketches, a, b) <= limit
                a, b = a[real], b[real]
                note(np.minimum(keys[a], keys[b]), np.maximum(keys[a], keys[b]), 0)
            starts = np.searchsorted(groups, np.arange(groups[-1] + 2)) if len(groups) else []
            for row in np.flatnonzero(several):
                others = np.arange(starts[groups[row]], starts[groups[row] + 1])
                others = others[(others > row) | ~several[others]]
                fits = (high[others] >= similar * low[row] - 1e-9) & (high[row] >= similar * low[others] - 1e-9) & ((part[others] != part[row]) | (part[row] < 0))
                others = others[fits]
                single = others[~several[others]]
                note(keys[single], np.full(len(single), roots[row]), 1)
                classes = others[several[others]]
                note(np.minimum(roots[classes], roots[row]), np.maximum(roots[classes], roots[row]), 2)
            if found:
                made = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[:, i])) for i in range(3)], names=["a", "b", "kind"])

    return run


def _near_members(texts: pa.Table, members: pa.Table, similar: float, slack: float | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, members, bits apart) for each text: the rows of the members whose sizes and sketches allow the similarity."""
    sizes = members.column("n").to_numpy()
    theirs = np.array(members.column("odd").combine_chunks().flatten()).reshape(-1, SKETCH).view(np.uint64)
    halved = np.array([share_of(n) for n in sizes.tolist()])
    for row, (n, odd) in enumerate(zip(texts.column("n").to_pylist(), texts.column("odd"), strict=True)):
        apart = np.bitwise_count(theirs ^ np.array(odd.values).view(np.uint64)).sum(axis=1, dtype=np.int64)
        limit = np.where(halved == share_of(n), _most_apart(sizes, n, similar, slack), np.inf)
        near = np.flatnonzero((np.minimum(sizes, n) >= similar * np.maximum(sizes, n) - 1e-9) & (apart <= limit))
        yield row, near, apart[near]


def _worth_meeting(similar: float, slack: float | None):
    """The texts of a meeting that may be alike to one of its members, and those members, by sketches: one row for each."""

    def run(key: tuple, texts: pa.Table, members: pa.Table) -> pa.Table:
        come, stay = np.zeros(texts.num_rows, bool), np.zeros(members.num_rows, bool)
        if texts.num_rows and members.num_rows:
            for row, near, _ in _near_members(texts, members, similar, slack):
                come[row] = len(near) > 0
                stay[near] = True
        columns = ["text_key", *MEETING]
        sides = [side.select(columns).filter(pa.array(taken)).append_column("comes", pa.array([comes] * int(taken.sum()), pa.bool_())) for side, taken, comes in ((texts, come, True), (members, stay, False))]
        return pa.concat_tables(sides)

    return run


def _meeting(similar: float, slack: float | None):
    """Of each text of the one side the first link to a text of the other."""

    def run(key: tuple, texts: pa.Table, members: pa.Table) -> pa.Table:
        found = []
        if texts.num_rows and members.num_rows:
            lists, keys = members.column("hashes").combine_chunks(), members.column("text_key").to_pylist()
            sizes = members.column("n").to_pylist()
            own = texts.select(["text_key", "n", "hashes"]).combine_chunks().to_batches()[0]
            for row, near, apart in _near_members(texts, members, similar, slack):
                text, n, mine = own.column(0)[row].as_py(), own.column(1)[row].as_py(), np.array(own.column(2)[row].values)
                for i in near[np.argsort(apart, kind="stable")].tolist():
                    common = len(np.intersect1d(mine, np.array(lists[i].values), assume_unique=True))
                    if common >= similar * (n + sizes[i] - common) - 1e-9:
                        found.append((text, keys[i]))
                        break
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return run


def _met(targets: DataFrame, classes: DataFrame, sketches: DataFrame, texts: DataFrame, similar: float, slack: float | None, meet: int, few: bool) -> DataFrame:
    """Links of texts to classes, of ``targets`` (text_key, root): each text meets all texts of the class (text_key, root), ``meet`` by ``meet``. No more than one link for each meeting leaves the task.

    They meet by their sketches first. Whole sets, which are many times as long, only move for the
    texts and the members that sketches leave in a meeting.
    """
    number = classes.join(targets.select("root").distinct(), "root").groupBy("root").agg(F.ceil(F.count("*") / meet).cast("int").alias("chunks"))
    shapes = targets.groupBy("root").agg(F.ceil(F.count("*") / meet).cast("int").alias("blocks")).join(number, "root")
    shapes = keep(shapes)
    block = lambda n: F.pmod(F.xxhash64("text_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    come = targets.join(shapes, "root").select("text_key", "root", block("blocks").alias("block"), every("chunks").alias("chunk"))
    stay = classes.join(shapes, "root").select("text_key", "root", every("blocks").alias("block"), block("chunks").alias("chunk"))

    def together(come: DataFrame, stay: DataFrame, sets: DataFrame):
        # names of its own for each side, so that the two sides of the meeting are told apart
        left, right = (side.join(sets, "text_key").select(*[F.col(c).alias(c) for c in (*MEETING, *sets.columns)]) for side in (come, stay))
        return left.groupBy(*MEETING).cogroup(right.groupBy(*MEETING))

    worth = together(come, stay, _narrow(sketches, "n", "odd")).applyInArrow(_worth_meeting(similar, slack), "text_key bigint, root bigint, block int, chunk int, comes boolean")
    worth = keep(worth)
    release(sketches.sparkSession)
    sets = _of_texts(sketches, texts.join(worth.select("text_key").distinct(), "text_key"), "n", "odd", "hashes", few=few)
    return together(worth.where("comes"), worth.where("NOT comes"), sets).applyInArrow(_meeting(similar, slack), "a bigint, b bigint")


def _simhash_proposals(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts with equal or close fingerprints of single words: each with the smallest and the closest of its part."""
    proposals = None
    for column in [c for c in rows.columns if c.startswith("f")]:
        nodes = rows.groupBy(F.col(column).alias("f")).agg(F.min("text_key").alias("rep"))
        alike = rows.select("text_key", F.col(column).alias("f")).join(nodes, "f").where("text_key <> rep").select(F.col("rep").alias("a"), F.col("text_key").alias("b"))
        near = fingerprint_links(rows.select(F.col(column).alias("f")), closest_too=True)
        for end in "ab":
            near = near.join(nodes.select(F.col("f").alias(end), F.col("rep").alias(f"rep_{end}")), end)
        both = alike.union(near.select("rep_a", "rep_b"))
        proposals = both if proposals is None else proposals.union(both)
    return proposals


def near_duplicate_links(
    docs: DataFrame, rows: DataFrame, similar: float = SIMILAR, size: int = VERIFY_SHINGLE, block: int = BLOCK, sketches: DataFrame | None = None, slack: float | None = SLACK, meet: int = MEET
) -> DataFrame:
    """Links (a, b) that connect all text keys whose sets of ``size``-word shingles have a Jaccard similarity of ``similar`` or more.

    Every link is such a pair. Cheap proposals come first: SimHash of single words, and for
    each hash of a text's prefix the smallest text that has it too. What these connect is one
    class. Then classes that share a prefix hash are compared: texts that stand alone for their class under the
    hash in pairs, which sketches test where they meet, and classes of several texts as a whole, against
    the texts of the others. So no pair is missed, and neither pairs inside a group of copies nor pairs that only share a passage
    are listed. Sketches of sets of up to ``HELD`` hashes drop no pair; those of larger sets err by chance
    beyond ``slack`` standard deviations, unless it is None.
    """
    sketches = _sketches(docs, size) if sketches is None else sketches
    texts = keep(sketches.groupBy("text_key").agg(F.min("row").alias("row")))
    number = texts.count()
    few = number <= BROADCAST_NUMBERS
    shared = _shared_prefixes(sketches, texts, number, similar)
    release(docs.sparkSession)
    stars = shared.where(_can_be_alike(F.col("n"), F.col("at"), F.col("rep.n"), F.col("rep.at"), similar)).select(F.col("rep.text_key").alias("a"), F.col("text_key").alias("b"))
    proposals = _simhash_proposals(rows).union(stars).where("a <> b")
    proposals = keep(proposals.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = keep(connecting(proposals, sketches, texts, similar, slack, few))
    roots = _classes(found)
    release(docs.sparkSession)
    classed = shared.drop("rep").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    each = classed.groupBy("k", "root").agg(F.count("*").alias("texts"), F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.struct("text_key", "at")).alias("one"))
    # under a hash that only one class has there is nothing to compare
    each = stored(each, "classes")
    mixed = each.groupBy("k").agg(F.count("*").alias("roots")).where("roots > 1").select("k")
    open_rows = keep(each.join(mixed, "k").select("k", "root", (F.col("texts") > 1).alias("several"), "low", "high", "one.text_key", "one.at"))
    release(docs.sparkSession)
    # only texts that stand alone for their class are told apart by sketches
    alone = open_rows.where("NOT several")
    none = F.array_repeat(F.lit(0).cast("bigint"), SKETCH)
    marked = _dealt(alone.join(_narrow(sketches, "odd"), "text_key").unionByName(open_rows.where("several").withColumn("odd", none)), "root", block)
    rest = keep(marked.mapInArrow(_across(similar, slack), "a bigint, b bigint, kind bigint").distinct())
    release(docs.sparkSession)
    pairs = rest.where("kind = 0").select("a", "b").join(proposals, ["a", "b"], "left_anti")
    # sets that were moved go before others come
    found = found.union(keep(verified(keep(pairs), sketches, texts, similar, few)))
    release(docs.sparkSession)
    of_classes = rest.where("kind = 2").select("a", "b")
    targets = rest.where("kind = 1").select(F.col("a").alias("text_key"), F.col("b").alias("root"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("texts"))
    if not of_classes.isEmpty():  # the smaller class goes to the larger one, text by text
        both = of_classes.join(sizes.select(F.col("root").alias("a"), F.col("texts").alias("n_a")), "a").join(sizes.select(F.col("root").alias("b"), F.col("texts").alias("n_b")), "b")
        smaller = both.select(F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("from"), F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("root"))
        targets = targets.union(smaller.join(roots.select("text_key", F.col("root").alias("from")), "from").select("text_key", "root"))
    targets = keep(targets.distinct())
    if targets.isEmpty():
        return found
    found = found.union(keep(_met(targets, roots, sketches, texts, similar, slack, meet, few)))
    release(docs.sparkSession)
    return found


def near_deduplicate(docs: DataFrame, similar: float = SIMILAR, size: int = VERIFY_SHINGLE) -> DataFrame:
    """``docs`` with one row of every group of near copies: the one of the smallest ``doc_id``.

    Groups are the components of ``near_duplicate_links``; equal texts always belong
    together, texts without words too. Nulls: a null text counts as empty, a null ``doc_id``
    comes after all others. Of rows that share ``doc_id`` and text one stays. Columns are
    passed as they are, whatever their names. Whole texts are only shuffled where many rows go.
    """
    sketches = _sketches(docs, size)
    rows = keep(sketches.groupBy("doc_id", "text_key", "f0").agg(F.count("*").alias("times")))
    texts = rows.groupBy("text_key", "f0").agg(F.min("doc_id").alias("doc_id"))
    roots = connected_components(near_duplicate_links(docs, texts, similar, size, sketches=sketches)).select(F.col("node").alias("text_key"), "root")
    release(docs.sparkSession)
    grouped = rows.select("doc_id", "text_key", "times").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = grouped.groupBy("root").agg(F.min(order).alias("first"), F.sum("times").alias("members")).where("members > 1")
    judged = keep(grouped.join(first, "root").select("doc_id", "text_key", "times", (order == F.col("first")).alias("stays")))
    losers = judged.where("NOT stays").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    repeated = judged.where("stays AND times > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    # the row goes as one value, so that its names meet no others
    own = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own")
    keyed = docs.select(own, F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(text_or_empty().cast("string")).alias("text_key"))
    on = F.col("doc").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    kept = keyed.join(small(losers), on, "left_anti")
    if repeated.isEmpty():
        return kept.select("own.*")
    again = kept.join(small(repeated), on, "left_semi").groupBy("doc", "text_key").agg(F.first("own").alias("own")).select("own.*")
    return kept.join(small(repeated), on, "left_anti").select("own.*").unionByName(again)
