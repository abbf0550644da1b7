"""Merkle manifest, prefix trie and tree-merged exact duplicates against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import conversation_trie, exact_dedup, merkle
from corpusmill.llm.common import spread_join, stored
from corpusmill.llm.ordering import numbered

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_places(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 50, i) for i in range(400)] + [(1, 5, 5)] * 300
    frame = stored(spark.createDataFrame(rows, "k int, o int, local int").repartition(5), "test-places")
    got = numbered(frame.withColumn("_row_", F.lit(1)), ["k"], ["o"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.place, r.o))
    assert len(got) == 700 and set(by) == {None, 0, 1, 2}
    for pairs in by.values():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(len(pairs))) and [o for _, o in pairs] == sorted(o for _, o in pairs)
    assert numbered(stored(frame.limit(0), "test-none"), ["k"], ["o"]).count() == 0


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, tree int, run string"


def _docs(n, seed=3):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        text = pick.choice([None, "", "Äb C", "AbC dE", "abc de", "x" * 3000 + "Y", f"Text {i}"])
        rows.append((pick.choice([None, i, i, i]), pick.choice([None, "s"]), pick.choice([None, "en", "de", "é", "Z", "z"][: 2 + i % 5]), pick.choice([None, 5]), text, "clash", 9, None))
    return rows + rows[:4] * 5


def _lowered(text):
    return (text or "").translate(CAPS)


@pytest.mark.parametrize("smallest", [True, False])
def test_duplicate_groups(spark, smallest):
    rows = _docs(120)
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    got = exact_dedup.duplicate_groups(frame, smallest, fan_in=2, range_rows=16).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_lowered(r[4])].append(r[0])
    want = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = (min if smallest else max)(named) if named else None
        want += [(i, keep, len(ids), sha(text)) for i in ids]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(map(sha, groups)) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.duplicate_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [7, 4096])
def test_one_text_in_many_runs_and_batches(spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "RUN_BITS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    frame = spark.range(2000).select((F.col("id") % 900).alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.duplicate_groups(frame.repartition(3), smallest=False, fan_in=3, range_rows=100).toPandas()
    same = got[got.group_size > 1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert len(got) == 2000 and set(same.group_size) == {667} and set(same.keep_id) == {897} and same.kept.sum() == 1 and got.kept.sum() == 1334


def test_states_are_those_of_sha256():
    pick = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 100):
        level = pick.integers(0, 256, (n, 32), dtype=np.uint8)
        above, before = merkle.parents(level)
        runs = [level[i : i + 8] for i in range(0, n, 8)]
        assert [d.tobytes().hex() for d in above] == [sha("".join(c.tobytes().hex() for c in run)) for run in runs]
        at = np.arange(n)
        wide = np.array([len(runs[i // 8]) for i in at])
        others = np.stack([np.pad(runs[i // 8], ((0, 8 - wide[i]), (0, 0))) for i in at])
        new = pick.integers(0, 256, (n, 32), dtype=np.uint8)
        left_wiped = np.where(np.arange(8)[None, :, None] < (at % 8)[:, None, None], 0, others)  # the state holds what stands left
        folded = merkle.fold(before, at % 8, wide, new, left_wiped.astype(np.uint8))
        for i in at:
            line = [c.tobytes().hex() for c in runs[i // 8]]
            line[i % 8] = new[i].tobytes().hex()
            assert folded[i].tobytes().hex() == sha("".join(line))


def _audit(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by the definition."""
    leaf = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))
    changed = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    nodes = [(r[2], r[0], leaf(r, r[4]), leaf(r, r[4].translate(CAPS)) if changed(r) and r[4] is not None else leaf(r, r[4])) for r in rows]
    trees = sorted({n[0] for n in nodes}, key=lambda v: (v is not None, (v or "").encode()))
    proofs, own = {}, {}

    def climb(level, members):
        while len(level) > 1:
            upper, moved = [], []
            for i in range(0, len(level), 8):
                run, here = level[i : i + 8], members[i : i + 8]
                for slot, keys in enumerate(here):
                    for key in keys:
                        proofs[key] += "".join(run[:slot] + run[slot + 1 :])
                        own[key] = sha("".join(run[:slot] + [own[key]] + run[slot + 1 :]))
                upper.append(sha("".join(run)))
                moved.append([k for keys in here for k in keys])
            level, members = upper, moved
        return level[0], members[0]

    tops, below, sub = [], [], {}
    for t in trees:
        mine = sorted((i for i, n in enumerate(nodes) if n[0] == t), key=lambda i: (nodes[i][1] is not None, nodes[i][1] or 0, nodes[i][2]))
        for i in mine:
            proofs[i], own[i] = "", nodes[i][3]
        top, keys = climb([nodes[i][2] for i in mine], [[i] for i in mine])
        tops.append(top)
        below.append(keys)
        sub |= dict.fromkeys(keys, top)
    root = climb(tops, below)[0]
    return Counter((n[1], n[2], sub[i], root, sha(proofs[i]), own[i], own[i] == root) for i, n in enumerate(nodes))


@pytest.mark.parametrize("number,page_levels", [(1, 4), (8, 1), (30, 1), (200, 1), (200, 4)])
def test_audit(spark, number, page_levels):
    rows = _docs(number)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = merkle.audit(frame, page_levels).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == _audit(rows)


def test_manifest_on_disk_and_no_rows(spark, tmp_path):
    frame = spark.createDataFrame(_docs(60), DOCS)
    leaves, trees = merkle.numbered_leaves(frame)
    merkle.build(leaves, trees, 1).write(f"{tmp_path}/m")
    again = merkle.Manifest.read(spark, f"{tmp_path}/m")
    assert all(r.folded_root == again.root for r in merkle.verify(again, leaves).collect())
    other = leaves.withColumn("other", F.unhex(F.sha2(F.lit("x"), 256)))
    assert all(r.folded_root != again.root for r in merkle.verify(again, other).collect())
    assert merkle.audit(frame.limit(0)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, n string"


def _trie(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None]
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, digest(r, x), (r, x)))
    own = {c: [v[3] for v in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        ends[whole[c]].append(c)
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    want = Counter()
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(not any(len(s) == len(q) + 1 and s[: len(q)] == q for s in under) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        parent = members[p[:-1]][0] if p else None
        want[(cs[0], len(p), parent, len(cs), len(kids), leaves, saved, sha(",".join(map(str, ends[p]))))] += 1
    return want


def _conversations():
    pick = random.Random(5)
    rows = []
    for c in [*range(98, 135), *range(205, 225), 300, 407, -3, -150]:
        for t in range(pick.randrange(1, 9)):
            rows.append((c, pick.choice([t, t, t, None]), pick.choice(["user", "user", None]), pick.choice(["a", "a", "a", "bé", None]), 1, None))
    rows += [(100, 50 + i, "user", "same", 1, None) for i in range(40)] + [(110, 50 + i, "user", "same", 1, None) for i in range(30)]
    return [*rows, *rows[:5], (None, 1, "user", "lost", 1, None)]


@pytest.mark.parametrize("block", [4, 4096])
def test_prefix_trie(spark, block):
    rows = _conversations()
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), block).collect()
    assert Counter(map(tuple, got)) == _trie(rows)


def test_prefix_trie_with_colliding_bases_and_without_rows(spark, monkeypatch):
    rows = [(c, t, "user", x, 1, None) for c, texts in {1: "abc", 5: "bac", 9: "cab", 201: "ab"}.items() for t, x in enumerate(texts * 3)]
    real = conversation_trie.bases
    monkeypatch.setattr(conversation_trie, "bases", lambda attempt: [1] * conversation_trie.PARTS if attempt == 0 else real(attempt))
    frame = spark.createDataFrame(rows, TURNS)
    assert Counter(map(tuple, conversation_trie.prefix_trie(frame).collect())) == _trie(rows)
    assert conversation_trie.prefix_trie(frame.limit(0)).count() == 0


def test_spread_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    one = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert sorted(spread_join(many, one, ["k"]).collect()) == sorted(many.join(one, "k").collect())
