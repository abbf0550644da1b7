import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import tables, text
from corpusmill.operators import chunking


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("一名以\n上", "一名以上"),
        ("一名 以 \n 上", "一名以上"),
        ("不满 16 周岁", "不满 16 周岁"),
        ("词 。\n句", "词。句"),
        ("plain text stays", "plain text stays"),
        (None, ""),
    ],
)
def test_normalize_cjk(spark, given, wanted):
    assert one(spark, given, text.normalize_cjk) == wanted


def test_normalize_question(spark):
    assert one(spark, " 你好,  world?\t ok! a.b　", text.normalize_question) == "你好， world？ ok！ a。b"


def test_tokenize_mixes_scripts(spark):
    assert one(spark, "Hello, 民警2名 x_y", text.tokenize) == ["hello", "民", "警", "2", "名", "x", "y"]


def test_rewrites(spark):
    parse = text.parse_rewrites
    assert one(spark, 'sure: ["a", "b ", " "] ok', parse) == ["a", "b "]
    assert one(spark, "1. first\n- second\n③ third\n输出：\n\n", parse) == ["first", "second", "third"]
    assert one(spark, "[not json\n2) x", parse) == ["[not json", ") x"]


def test_verdict(spark):
    def parts(col):
        verdict, error = text.parse_verdict(col, "struct<total:double>")
        return F.struct(verdict["total"].alias("total"), error.alias("error"))

    assert one(spark, '```json\n{"total": 7}\n```', parts).total == 7
    broken = one(spark, '{"total": ', parts)
    assert broken.total is None and broken.error.startswith('{"total"')
    assert one(spark, "no braces", parts).error == "no braces"


def test_sizes_and_levels_and_secrets(spark):
    assert [one(spark, v, text.format_size, "long") for v in (None, 0, 1023, 1024, 1152, 5 * 1024**4)] == [
        "0 B", "0 B", "1023.00 B", "1.00 KB", "1.12 KB", "5.00 TB",
    ]
    assert [one(spark, v, text.parse_level) for v in ("3", " 4 ", "0", "5", "x", None, "2.5")] == [3, 4, 1, 1, 1, 1, 1]
    assert [one(spark, v, text.mask_secret) for v in ("sk-1234567890", "short", "", None)] == ["sk-1****7890", "****", "", ""]


def test_dialogue(spark):
    kind = "array<struct<question:string,answer:string>>"
    turns = [("q1", "a1"), ("q2", " "), ("q3", "x" * 400), (None, "a4")]
    out = one(spark, turns, text.dialogue_text, kind)
    assert out == "用户：q2\n用户：q3\n助手：" + "x" * 300 + "\n助手：a4"
    assert one(spark, [], text.dialogue_text, kind) == "无"
    assert one(spark, None, text.dialogue_text, kind) == "无"


def test_grid(spark):
    grid = [["a|b", "c\nd"], [" ", None], ["1"], ["2", "3", "4"]]
    out = one(spark, grid, tables.grid_to_markdown, "array<array<string>>")
    assert out == "| a\\|b | c<br>d |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"
    assert one(spark, [[" "]], tables.grid_to_markdown, "array<array<string>>") == ""


@pytest.mark.parametrize("rows, width", [(0, 10), (1, 400), (3, 20), (50, 20), (200, 3)])
def test_split_table(spark, rows, width):
    head, rule = "| name | value |", "| --- | --- |"
    body = [f"| r{n} | {'x' * width} |" for n in range(rows)]
    markdown = "\n".join([head, rule, *body])
    pieces = one(spark, markdown, tables.split_table)
    if len(markdown) <= 300 or rows == 0:
        assert pieces == [markdown]
        return
    assert [line for p in pieces for line in p.split("\n")[2:]] == body
    for piece in pieces:
        lines = piece.split("\n")
        assert lines[:2] == [head, rule]
        assert len(lines) - 2 <= 10
        assert len(lines) == 3 or len(head) + len(rule) + sum(len(r) + 1 for r in lines[2:]) <= 300


def build(spark, elements):
    docs = spark.createDataFrame([(1, elements)], "doc_id long, elements array<struct<kind:string,text:string,page:int>>")
    chunks, parents = chunking.build_chunks(docs)
    return chunks.orderBy("chunk_index").collect(), parents.orderBy("window_no").collect()


def test_packing_keeps_first_page_and_joins_by_blank_line(spark):
    chunks, parents = build(spark, [("text", "one", 1), ("image", "two", 2), ("image", " ", 3), ("text", "three", 4)])
    assert [(c.text, c.page) for c in chunks] == [("one\n\ntwo\n\nthree", 1)]
    assert [p.text for p in parents] == ["one\n\ntwo\n\nthree"]


def test_tables_stay_whole_and_close_the_text_before(spark):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    chunks, parents = build(spark, [("text", "before", 1), ("table", f"\n{table}\n", 2), ("text", "after", 3)])
    assert [(c.kind, c.text, c.page) for c in chunks] == [("text", "before", 1), ("table", table, 2), ("text", "after", 3)]
    assert parents[0].text == f"before\n\n{table}\n\nafter"
    assert {c.parent_id for c in chunks} == {p.parent_id for p in parents}


def test_no_unit_crosses_a_window(spark):
    rng = random.Random(3)
    elements = [("text", "word " * rng.randint(1, 200), n) for n in range(40)]
    chunks, parents = build(spark, elements)
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
    assert all(len(p.text.replace("\n\n", "")) <= 1500 for p in parents)
    assert all(len(c.text) <= 300 for c in chunks)


def test_slices_add_up_to_the_text_and_both_builders_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé \n字𝄞") for _ in range(n)) for n in (1, 299, 300, 301, 1500, 1501, 4000)] + [" \n", "  x" + " " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = docs.select("doc_id", F.array_join(text.slices(F.col("text"), 300), "").alias("joined"))
    assert {r.doc_id: r.joined for r in units.collect()} == dict(enumerate(texts))
    fast = chunking.build_chunks_text(docs)
    slow = chunking.build_chunks(docs.select("doc_id", chunking.text_elements(F.col("text")).alias("elements")))
    for left, right in zip(fast, slow):
        assert sorted(map(str, left.collect())) == sorted(map(str, right.select(left.columns).collect()))


def test_recursive_split_properties():
    rng = random.Random(11)
    for _ in range(60):
        words = [f"w{n}" + "x" * rng.randint(0, 9) for n in range(rng.randint(1, 120))]
        body = "".join(word + rng.choice([" ", " ", "\n", "\n\n"]) for word in words)
        pieces = chunking.split_text(body, 50, 15)
        assert all(0 < len(p) <= 50 and p == p.strip() for p in pieces)
        following = 0
        for piece in pieces:  # whole words, in order, overlapping a little, nothing skipped
            numbers = [words.index(word) for word in piece.split()]
            assert numbers == list(range(numbers[0], numbers[-1] + 1)) and numbers[0] <= following
            assert sum(len(words[n]) for n in range(numbers[0], following)) <= 15
            following = numbers[-1] + 1
        assert following == len(words)
        assert "".join("".join(chunking.split_text(body, 7, 0)).split()) == "".join(words)
    assert chunking.split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert chunking.split_text("x" * 10, 4, 1) == ["xxxx", "xxxx", "xxxx"]
    assert chunking.split_text("", 4, 1) == []


def test_plain_and_flat_builders(spark):
    docs = spark.createDataFrame([(1, "para one. " * 300), (2, "tiny")], "doc_id long, text string")
    chunks, parents = chunking.build_chunks_plain(docs)
    assert chunks.filter("length(text) > 300").count() == 0 and parents.filter("length(text) > 1500").count() == 0
    assert chunks.join(parents, "parent_id", "left_anti").count() == 0
    flat, own = chunking.build_chunks_flat(docs)
    assert flat.count() == own.count() and flat.filter("length(text) > 500").count() == 0
