"""HTML tables to cells with spans, as a Python table function.

A cell source is one table. What does not hold together is an error with a reason, never a guess at cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Limits of a table that is read at all.
MOST_ROWS, MOST_COLS, MOST_CELLS, MOST_CHARS = 500, 100, 10_000, 200_000
SECTIONS = ("thead", "tbody", "tfoot")
Cell = tuple[int, int, int, int, str]


class Refused(ValueError):
    """The reason why a table is not read."""


class _Grid(HTMLParser):
    """Follows the nesting table > row > cell; level is how far down it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.level, self.tables, self.row = 0, 0, -1
        self.cell: tuple[str, int, int] | None = None
        self.parts: list[str] = []
        self.slots: set[tuple[int, int]] = set()
        self.cells: list[Cell] = []

    @staticmethod
    def need(fine: bool, reason: str) -> None:
        if not fine:
            raise Refused(reason)

    def span(self, attrs: list[tuple[str, str | None]], name: str, most: int) -> int:
        given = [v for k, v in attrs if k == name]
        if not given:
            return 1
        self.need(len(given) == 1 and bool(given[0]) and given[0].strip().isdigit() and int(given[0]) > 0, "bad_span")
        self.need(int(given[0]) <= most, "over_limit")
        return int(given[0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables += 1
            self.need(self.tables == 1, "not_one_table")
            self.level = 1
        elif tag in SECTIONS:
            self.need(self.level >= 1, "misplaced_section")
        elif tag == "tr":
            self.need(self.level == 1, "misplaced_row")
            self.row, self.level = self.row + 1, 2
            self.need(self.row < MOST_ROWS, "over_limit")
        elif tag in ("td", "th"):
            self.need(self.level == 2, "misplaced_cell")
            self.need(len(self.cells) < MOST_CELLS, "over_limit")
            self.cell, self.parts, self.level = (tag, self.span(attrs, "rowspan", MOST_ROWS), self.span(attrs, "colspan", MOST_COLS)), [], 3
        elif tag == "br" and self.level == 3:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.need(self.level == 3 and self.cell[0] == tag, "unclosed")
            self.place()
            self.level = 2
        elif tag == "tr":
            self.need(self.level == 2, "unclosed")
            self.level = 1
        elif tag == "table":
            self.need(self.level == 1, "unclosed")
            self.level = 0

    def place(self) -> None:
        """The cell goes to the first free slot of its row."""
        _, down, right = self.cell
        col = 0
        while (self.row, col) in self.slots:
            col += 1
        self.need(col + right <= MOST_COLS and self.row + down <= MOST_ROWS, "over_limit")
        own = {(self.row + r, col + c) for r in range(down) for c in range(right)}
        self.need(self.slots.isdisjoint(own), "overlap")
        self.slots |= own
        self.cells.append((self.row, col, down, right, "".join(self.parts).strip()))

    def handle_data(self, data: str) -> None:
        if self.level == 3:
            self.parts.append(data)

    def checked(self) -> list[Cell]:
        self.need(self.tables == 1, "not_one_table")
        self.need(self.level == 0, "unclosed")
        self.need(bool(self.cells), "empty")
        rows, cols = (1 + max(s[k] for s in self.slots) for k in (0, 1))
        self.need(rows == self.row + 1, "row_span_past_end")
        self.need(len(self.slots) == rows * cols, "ragged")
        return self.cells


def table_cells(html: str | None) -> list[Cell]:
    """(row, column, row span, column span, text) of every cell of the one table; Refused with a reason else."""
    if html is None or not html.strip():
        raise Refused("empty")
    if len(html) > MOST_CHARS:
        raise Refused("over_limit")
    grid = _Grid()
    grid.feed(html)
    grid.close()
    return grid.checked()


class HtmlTableCells:
    def eval(self, html: str) -> Iterator[tuple[str, int | None, int | None, int | None, int | None, str | None]]:
        try:
            for cell in table_cells(html):
                yield ("ok", *cell)
        except Refused as why:
            yield (str(why), None, None, None, None, None)


def register(spark: SparkSession, name: str = "html_table_cells") -> None:
    """Makes the function callable as `FROM pages, LATERAL html_table_cells(html)`: a row per cell, or one row with the
    reason in `status`."""
    spark.udtf.register(name, udtf(HtmlTableCells, returnType="status string, row int, col int, row_span int, col_span int, text string"))
