"""Documents to child chunks and parent windows.

A document is one row whose ``elements`` column is an
array<struct<kind, text, page>> in reading order, so chunking never shuffles:
every step is an expression over that row. Only the overlapping recursive
splitter needs Python; plain text documents avoid it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.tables import split_table
from corpusmill.functions.text import begins, groups, is_blank, let, slices, strip

CHILD_SIZE, CHILD_OVERLAP = 300, 30
PARENT_SIZE, PARENT_OVERLAP = 1500, 150
FLAT_SIZE, FLAT_OVERLAP = 500, 50

UNIT = "struct<kind:string,text:string,page:int>"
SEPARATORS = ["\n\n", "\n", " ", ""]
PERMISSION_COLUMNS = ["tenant_id", "doc_level", "min_level", "owner_id"]


def text_elements(text: Column) -> Column:
    """A plain text file is one text element on page 1; a blank file has none."""
    one = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(1).alias("page")))
    return F.when(is_blank(text), F.array().cast(f"array<{UNIT}>")).otherwise(one)


def with_order(docs: DataFrame) -> DataFrame:
    """One row per element with its position in the document."""
    return docs.select("doc_id", F.posexplode("elements").alias("order", "element")).select(
        "doc_id", "order", "element.kind", "element.text", "element.page"
    )


def parse_stats(docs: DataFrame) -> DataFrame:
    """Per document: elements by kind, pages, and a warning if nothing was read."""

    def count(kind: str) -> Column:
        return F.size(F.filter("elements", lambda e: e["kind"] == kind))

    return docs.select(
        "doc_id",
        count("text").alias("text_blocks"),
        count("table").alias("table_count"),
        count("image").alias("image_count"),
        F.coalesce(F.array_max(F.transform("elements", lambda e: e["page"])), F.lit(0)).alias("pages"),
        F.when(F.size("elements") == 0, F.lit("empty text file")).alias("warning"),
    )


def content_preview(docs: DataFrame, max_chars: int = 4_000_000) -> DataFrame:
    """Text and table elements joined by line ends, trimmed and cut."""
    kept = F.filter("elements", lambda e: e["kind"].isin("text", "table") & ~is_blank(e["text"]))
    joined = strip(F.array_join(F.transform(kept, lambda e: e["text"]), "\n"))
    return docs.select("doc_id", F.substring(joined, 1, max_chars).alias("content"))


def atomic_units(elements: Column, child_size: int = CHILD_SIZE) -> Column:
    """Elements as array<struct<kind, text, page>> of indivisible units.

    Short text is packed while its total stays within ``child_size``; longer text
    is cut into slices of that size; tables are split by rows only. Where units
    begin is found from sizes alone, and their texts are put together once.
    """

    def unit(kind: str, text: Column, page: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), page.cast("int").alias("page"))

    def shaped(element: Column) -> Column:
        text = F.coalesce(element["text"], F.lit(""))
        packs = (element["kind"] == "image") | (F.length(text) < child_size)
        how = F.when(element["kind"] == "table", "table").when(is_blank(text), "blank").when(packs, "packed").otherwise("long")
        return F.struct(how.alias("how"), text.alias("text"), element["page"].alias("page"))

    def units_of(group: Column) -> Column:
        one = F.get(group, F.lit(0))
        table = F.transform(F.filter(split_table(strip(one["text"])), lambda p: ~is_blank(p)), lambda p: unit("table", p, one["page"]))
        long = F.transform(slices(one["text"], child_size), lambda p: unit("text", p, one["page"]))
        page = F.get(F.filter(F.transform(group, lambda e: e["page"]), lambda p: p.isNotNull()), F.lit(0))
        packed = F.array(unit("text", F.array_join(F.transform(group, lambda e: e["text"]), "\n\n"), page))
        return F.when(one["how"] == "table", table).when(one["how"] == "long", long).otherwise(packed)

    def all_units(kept: Column) -> Column:
        # A table or a long text is over the limit by itself, so nothing is packed with it.
        sizes = F.transform(kept, lambda e: F.when(e["how"] == "packed", F.length(e["text"])).otherwise(child_size + 1))
        return F.flatten(F.transform(let(begins(sizes, child_size), lambda f: groups(kept, f)), units_of)).cast(f"array<{UNIT}>")

    return let(F.filter(F.transform(elements, shaped), lambda e: e["how"] != "blank"), all_units)


def parent_windows(units: Column, parent_size: int = PARENT_SIZE) -> Column:
    """Units packed in order into array<array<unit>>; no unit crosses a window."""
    return let(units, lambda us: let(begins(F.transform(us, lambda u: F.length(u["text"])), parent_size), lambda f: groups(us, f)))


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """One text cut at the coarsest separator that yields pieces within ``size``.

    Pieces keep the separator in front, are merged up to ``size``, and start with
    up to ``overlap`` characters of whole pieces of the chunk before.
    """

    def merge(pieces: list[str]) -> list[str]:
        out, held, total = [], [], 0
        for piece in pieces:
            if held and total + len(piece) > size:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(piece) > size):
                    total -= len(held.pop(0))
            held.append(piece)
            total += len(piece)
        out.append("".join(held).strip())
        return [chunk for chunk in out if chunk]

    def cut(body: str, level: int) -> list[str]:
        while SEPARATORS[level] and SEPARATORS[level] not in body:
            level += 1
        mark = SEPARATORS[level]
        if mark:
            first, *rest = body.split(mark)
            pieces = [p for p in [first, *[mark + part for part in rest]] if p]
        else:
            pieces = list(body)
        out, small = [], []
        for piece in pieces:
            if len(piece) < size or not mark:
                small.append(piece)
                continue
            if small:
                out += merge(small)
                small = []
            out += cut(piece, level + 1)
        return out + (merge(small) if small else [])

    return cut(text, 0) if text else []


def recursive_split(col: Column, size: int, overlap: int) -> Column:
    """array<string> column to array<array<string>>: each text split on its own; null stays null."""

    @F.pandas_udf("array<array<string>>")
    def split_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda texts: None
                if texts is None
                else [None if text is None else split_text(text, size, overlap) for text in texts]
            )

    return split_batches(col)


def parent_id(doc_id: Column, window_no: Column) -> Column:
    """Deterministic id, so that rebuilding a document gives the same ids."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), window_no.cast("string")), 256)


def _chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    """``chunks`` is array<struct<window_no, kind, page, text>> per document."""
    kept = [c for c in PERMISSION_COLUMNS if c in docs.columns]
    return docs.select("doc_id", *kept, F.posexplode(chunks).alias("chunk_index", "c")).select(
        "doc_id",
        "chunk_index",
        parent_id(F.col("doc_id"), F.col("c.window_no")).alias("parent_id"),
        F.concat(F.lit("document_"), F.col("doc_id").cast("string")).alias("source"),
        F.col("c.window_no").alias("window_no"),
        F.col("c.kind").alias("kind"),
        F.col("c.page").alias("page"),
        F.col("c.text").alias("text"),
        *kept,
    )


def _parent_rows(docs: DataFrame, texts: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(texts).alias("window_no", "text")).select(
        parent_id(F.col("doc_id"), F.col("window_no")).alias("parent_id"), "doc_id", "window_no", "text"
    )


def build_chunks(
    docs: DataFrame, child_size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP, parent_size: int = PARENT_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of documents with ``elements``; tables stay whole."""
    windows = docs.withColumn("_windows", parent_windows(atomic_units(F.col("elements"), child_size), parent_size))
    units = F.flatten(
        F.transform(
            "_windows",
            lambda window, no: F.transform(
                window,
                lambda u: F.struct(
                    no.alias("window_no"), u["kind"].alias("kind"), u["page"].alias("page"), u["text"].alias("text")
                ),
            ),
        )
    )
    long_text = lambda u: (u["kind"] == "text") & (F.length(u["text"]) > child_size)
    flat = windows.withColumn("_units", units).withColumn(
        "_split",
        recursive_split(F.transform("_units", lambda u: F.when(long_text(u), u["text"])), child_size, overlap),
    )

    def children(u: Column, i: Column) -> Column:
        whole = F.when((u["kind"] == "text") & ~is_blank(u["text"]), strip(u["text"])).otherwise(u["text"])
        split = F.get(F.col("_split"), i)
        texts = F.when(F.size(split) > 0, split).otherwise(F.array(whole))
        return F.transform(
            texts,
            lambda text: F.struct(
                u["window_no"].alias("window_no"), u["kind"].alias("kind"), u["page"].alias("page"), text.alias("text")
            ),
        )

    chunks = _chunk_rows(flat, F.flatten(F.transform("_units", children)))
    joined = F.transform("_windows", lambda w: F.array_join(F.transform(w, lambda u: u["text"]), "\n\n"))
    return chunks, _parent_rows(windows, joined)


def build_chunks_text(
    docs: DataFrame, child_size: int = CHILD_SIZE, parent_size: int = PARENT_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of documents whose ``text`` is their only element.

    Same result as ``build_chunks`` without its fold and without Python: the
    units are the slices of the text, and a window is a fixed number of them.
    """
    if parent_size % child_size:
        raise ValueError("parent_size must be a multiple of child_size")
    per_window = parent_size // child_size
    filled = docs.filter(~is_blank(F.col("text"))).withColumn("_slices", slices(F.col("text"), child_size))
    chunks = F.transform(
        "_slices",
        lambda text, i: F.struct(
            F.floor(i / per_window).cast("int").alias("window_no"),
            F.lit("text").alias("kind"),
            F.lit(1).alias("page"),
            F.when(is_blank(text), text).otherwise(strip(text)).alias("text"),
        ),
    )
    count = F.ceil(F.size("_slices") / per_window).cast("int")
    windows = let(
        F.col("_slices"),
        lambda pieces: F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda w: F.array_join(F.slice(pieces, w * per_window + 1, per_window), "\n\n"),
        ),
    )
    return _chunk_rows(filled, chunks), _parent_rows(filled, windows)


def build_chunks_plain(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) from plain text with overlapping parents and children."""
    parents = docs.withColumn(
        "_parents", F.get(recursive_split(F.array("text"), PARENT_SIZE, PARENT_OVERLAP), F.lit(0))
    )
    split = parents.withColumn("_children", recursive_split(F.col("_parents"), CHILD_SIZE, CHILD_OVERLAP))

    def children(parent: Column, no: Column) -> Column:
        own = F.get(F.col("_children"), no)
        return F.transform(
            F.when(F.size(own) > 0, own).otherwise(F.array(parent)),
            lambda text: F.struct(
                no.alias("window_no"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("page"), text.alias("text")
            ),
        )

    return _chunk_rows(split, F.flatten(F.transform("_parents", children))), _parent_rows(parents, F.col("_parents"))


def build_chunks_flat(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) with one level: each chunk is its own parent."""
    split = docs.withColumn("_parents", F.get(recursive_split(F.array("text"), FLAT_SIZE, FLAT_OVERLAP), F.lit(0)))
    chunks = F.transform(
        "_parents",
        lambda text, no: F.struct(
            no.alias("window_no"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("page"), text.alias("text")
        ),
    )
    return _chunk_rows(split, chunks), _parent_rows(split, F.col("_parents"))


def rebuild_content(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Document text from its parents, in the order of their first chunk."""
    first = chunks.groupBy("parent_id").agg(F.min("chunk_index").alias("first"))
    parts = parents.join(first, "parent_id").select(
        "doc_id", F.struct("first", strip(F.col("text")).alias("text")).alias("part")
    )
    kept = F.filter(F.array_sort(F.collect_list("part")), lambda p: p["text"] != "")
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda p: p["text"]), "\n").alias("content"))


def display_preview(docs: DataFrame, full: bool = False, small_bytes: int = 524_288, head: int = 2000) -> DataFrame:
    """Whole text of small documents, else its head with ``truncated`` set."""
    body = strip(F.coalesce(F.col("content"), F.lit("")))
    small = (F.col("file_size") > 0) & (F.col("file_size") <= small_bytes)
    whole = small | F.lit(full)
    return docs.select(
        "doc_id",
        small.alias("small"),
        F.length(body).alias("total_length"),
        F.when(whole, body).otherwise(F.substring(body, 1, head)).alias("text"),
        (~whole & (F.length(body) > head)).alias("truncated"),
    )
