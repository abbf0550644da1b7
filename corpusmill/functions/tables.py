"""Tables inside documents: one grid or one Markdown table per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import begins, groups, let, strip


def grid_to_markdown(grid: Column) -> Column:
    """array<array<string>> as a Markdown table; the first row that is not blank is the header.

    Blank rows go, short rows are padded, | is escaped and line ends become <br>.
    """
    cell = lambda value: strip(
        F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    )
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(rows: Column, width: Column) -> Column:
        lines = F.transform(
            rows,
            lambda row: line(F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), width - F.size(row)))),
        )
        rule = line(F.array_repeat(F.lit("---"), width))
        table = let(
            lines,
            lambda ls: F.array_join(F.concat(F.slice(ls, 1, 1), F.array(rule), F.slice(ls, 2, F.size(ls))), "\n"),
        )
        return F.when(F.size(rows) > 0, table).otherwise(F.lit(""))

    filled = F.filter(grid, lambda row: F.exists(row, lambda v: strip(F.coalesce(v, F.lit(""))) != ""))
    return let(filled, lambda rows: let(F.array_max(F.transform(rows, F.size)), lambda width: render(rows, width)))


def split_table(markdown: Column, max_chars: int = 300, max_rows: int = 10) -> Column:
    """A large Markdown table as pieces that each repeat the two header lines.

    Rows are taken greedily while a piece stays within both limits; a piece has
    at least one row. Small tables and those without data rows stay whole.
    """
    return let(F.split(markdown, "\n"), lambda lines: _split_lines(markdown, lines, max_chars, max_rows))


def _split_lines(markdown: Column, lines: Column, max_chars: int, max_rows: int) -> Column:
    first_two = F.concat(F.get(lines, F.lit(0)), F.lit("\n"), F.get(lines, F.lit(1)))
    pieces = let(first_two, lambda head: _pieces(lines, head, max_chars, max_rows))
    whole = (F.size(lines) < 3) | (F.length(markdown) <= max_chars)
    return F.when(whole, F.array(markdown)).otherwise(pieces)


def _pieces(lines: Column, head: Column, max_chars: int, max_rows: int) -> Column:
    def cut(rows: Column) -> Column:
        first = begins(F.transform(rows, lambda row: F.length(row) + 1), max_chars, F.length(head) - 1, max_rows)
        return F.transform(let(first, lambda f: groups(rows, f)), lambda piece: F.concat(head, F.lit("\n"), F.array_join(piece, "\n")))

    return let(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), cut)
