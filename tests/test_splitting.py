"""The recursive splitter and what is built on it, by what must hold for any text."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import chunking, evaluation


def _texts():
    pick = random.Random(9)
    words = ["alpha", "béta", "gamma", "d", "ε" * 40, "\n", "\n\n", "。", "end.", "x" * 700]
    return {n: " ".join(pick.choice(words) for _ in range(pick.randrange(0, 300))) for n in range(60)}


def _in_order(pieces, text):
    """Places of the pieces, each at or after the beginning of the one before."""
    at, out = 0, []
    for piece in pieces:
        found = text.find(piece, at)
        assert found >= 0, piece
        out.append(found)
        at = found
    return out


def test_pieces_cover_the_text_in_order():
    for text in _texts().values():
        for size, overlap in ((50, 0), (300, 30), (1500, 150)):
            pieces = chunking.split_text(text, size, overlap)
            assert all(p and p == p.strip() and len(p) <= size for p in pieces)
            places = _in_order(pieces, text)
            covered = set()
            for piece, place in zip(pieces, places, strict=True):
                covered |= set(range(place, place + len(piece)))
            assert all(c.isspace() for i, c in enumerate(text) if i not in covered)
            for (a, p), (b, q) in zip(zip(places, pieces, strict=True), list(zip(places, pieces, strict=True))[1:], strict=False):
                assert b >= a and a + len(p) - b <= overlap + 2, (p, q)


def test_plain_and_flat_builds(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    chunks, parents = chunking.build_chunks_plain(docs)
    windows = {(r.doc_id, r.parent_id): r.text for r in parents.collect()}
    rows = {}
    for r in chunks.orderBy("doc_id", "chunk_index").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        mine = rows.get(doc, [])
        assert [r.chunk_index for r in mine] == list(range(len(mine))) and bool(mine) == bool(text.strip())
        want = [(p, c) for p in chunking.split_text(text, 1500, 150) for c in (chunking.split_text(p, 300, 30) or [p])]
        assert [(windows[doc, r.parent_id], r.text) for r in mine] == want
    flat, own = chunking.build_chunks_flat(docs)
    held = {}
    for r in flat.orderBy("doc_id", "chunk_index").collect():
        held.setdefault(r.doc_id, []).append(r.text)
    assert held == {d: p for d, t in texts.items() if (p := chunking.split_text(t, 500, 50))}
    assert own.count() == flat.count()


def test_chunks_of_elements_keep_tables_and_pages(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {n} | {n} |" for n in range(60))
    elements = [("text", "first words", 1), ("table", table, 2), ("text", "t" * 700, 3), ("image", "", 4), ("image", "seen", 5), ("text", "last", 6)]
    docs = spark.createDataFrame([(1, elements)], "doc_id long, elements array<struct<kind:string,text:string,page:int>>")
    rows = chunking.build_chunks(docs)[0].orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    tables = [r.text for r in rows if r.kind == "table"]
    assert all(t.startswith("| a | b |\n| --- | --- |\n") for t in tables) and sum(t.count("\n") - 1 for t in tables) == 60
    assert "".join(r.text for r in rows if set(r.text) == {"t"}) == "t" * 700
    assert [(r.text, r.page) for r in rows if r.kind == "text"][0] == ("first words", 1) and rows[-1].text == "seen\n\nlast" and rows[-1].page == 5


def test_order_of_pairs_depends_on_seed_and_pair_only(spark):
    pairs = spark.createDataFrame([(n, r, f"a{n}", f"b{n}") for n in range(400) for r in (1, 2)], "qid long, rep int, answer_a string, answer_b string")
    seen = lambda frame, seed=42: {(r.qid, r.rep): r.swapped for r in evaluation.randomize_pairs(frame, seed).collect()}
    first = seen(pairs)
    assert first == seen(pairs.orderBy(F.desc("qid")).repartition(7)) and first != seen(pairs, 7)
    assert 300 < sum(first.values()) < 500
    assert all((r.first, r.second) == ((f"b{r.qid}", f"a{r.qid}") if r.swapped else (f"a{r.qid}", f"b{r.qid}")) for r in evaluation.randomize_pairs(pairs).collect())
