"""HTML tables to rectangular grids of cell texts.

Every `tr` of the fragment is a row, in document order, and its own `td` and `th` are its cells; a
cell's text is all text inside it, tables within it included. Row and column spans repeat a text.

Recovery of what isn't closed: a new cell closes the cell before it, a new row closes the row before
it, the end of a table closes what it opened. Comments are no text.

A row span is held for its column until a row reaches that column: a row too short to reach it leaves
it to a later row, and a column span that reaches over it does not use it up. Spans are carried
across all tables of a fragment. What can't be read is a reason, not an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRID = "struct<grid: array<array<string>>, reason: string>"


class _Reader(HTMLParser):
    """Collects rows of (texts, rowspan, colspan). `open` holds, innermost last, each open table part:
    a row's list of cells, and in it the cell that is being read or None."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[list[str], str, str]]] = []
        self.open: list[list] = [[None, None]]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append([None, None])
        elif tag == "tr":
            self.rows.append([])
            self.open[-1] = [self.rows[-1], None]
        elif tag in ("td", "th") and self.open[-1][0] is not None:
            said = dict(reversed(attrs))
            cell = ([], *((said[k] or "") if k in said else "1" for k in ("rowspan", "colspan")))
            self.open[-1][0].append(cell)
            self.open[-1][1] = cell

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and len(self.open) > 1:
            self.open.pop()
        elif tag == "tr":
            self.open[-1] = [None, None]
        elif tag in ("td", "th"):
            self.open[-1][1] = None

    def handle_data(self, data: str) -> None:
        for _, cell in self.open:
            if cell is not None:
                cell[0].append(data)


#: A plain tag: name, attributes without odd characters, and a slash before or after.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z-]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n\r\f"'<>&=`/]+))?)*)[ \t\n\r\f]*(/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f]+)))?""")
#: What these hold is read by rules of their own.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split())
_PARTS = frozenset(("table", "tr", "td", "th"))


def _read(html: str) -> _Reader:
    """The rows of a fragment. One of plain tags only is cut at them by one expression, which is several times
    faster; any other goes through the parser."""
    reader = _Reader()
    cut = _TAG.split(html)  # text, slash, name, attributes, slash, text, ...
    names = [n.lower() for n in cut[2::5]]
    odd = any("<" in text for text in cut[::5]) or not _RAW.isdisjoint(names) or any(close and more for close, more in zip(cut[1::5], cut[3::5], strict=True))
    if odd or any(close and n in _PARTS for close, n in zip(cut[4::5], names, strict=True)):
        reader.feed(html)
        reader.close()
        return reader
    for name, close, more, text in zip(names, cut[1::5], cut[3::5], cut[5::5], strict=True):
        if name in _PARTS:
            if close:
                reader.handle_endtag(name)
            else:
                reader.handle_starttag(name, [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(more)] if more else [])
        if text:
            reader.handle_data(unescape(text) if "&" in text else text)
    return reader


def expand(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of (text, rowspan, colspan) as a rectangular grid."""
    held: dict[int, list] = {}
    grid = []
    for cells in rows:
        line: list[str] = []
        column = 0
        for cell in [*cells, None]:
            while held.get(column, (None, 0))[1]:
                line.append(held[column][0])
                held[column][1] -= 1
                column += 1
            if cell is not None:
                text, down, right = cell
                if down > 1:
                    held |= {c: [text, down - 1] for c in range(column, column + right)}
                line += [text] * right
                column += right
        grid.append(line)
    width = max(map(len, grid), default=0)
    return [line + [""] * (width - len(line)) for line in grid]


def read_grid(html: str | None) -> tuple[list[list[str]] | None, str | None]:
    """The grid, or why there is none: no html, empty html, bad span."""
    if html is None:
        return None, "no html"
    if not html:
        return None, "empty html"
    try:
        return expand([[("".join(text).strip(), int(down), int(right)) for text, down, right in row] for row in _read(html).rows]), None
    except ValueError:
        return None, "bad span"


def html_to_grid(html: Column) -> Column:
    """struct(grid, reason) of an HTML fragment: an Arrow-batched Python function, no shuffle."""

    @F.udf(returnType=_GRID, useArrow=True)
    def grid_of(text: str | None) -> tuple:
        return read_grid(text)

    return grid_of(html)


class HtmlCells:
    """Table function: (row_idx, col_idx, text) of each cell of a fragment's grid."""

    def eval(self, html: str | None) -> Iterator[tuple[int, int, str]]:
        for i, line in enumerate(read_grid(html)[0] or []):
            for j, text in enumerate(line):
                yield i, j, text


html_cells = F.udtf(HtmlCells, returnType="row_idx int, col_idx int, text string")


def register(spark: SparkSession) -> None:
    """Makes html_to_grid(html) and html_cells(html) known to SQL."""
    spark.udf.register("html_to_grid", F.udf(read_grid, returnType=_GRID, useArrow=True))
    spark.udtf.register("html_cells", html_cells)


def grid_to_long(grids: DataFrame, grid: str = "grid") -> DataFrame:
    """One row (row_idx, col_idx, text) for each cell, beside the other columns."""
    rest = [c for c in grids.columns if c != grid]
    rows = grids.select(*rest, F.posexplode(grid).alias("row_idx", "__row"))
    return rows.select(*rest, "row_idx", F.posexplode("__row").alias("col_idx", "text"))


def long_to_grid(cells: DataFrame, *keys: str, grid: str = "grid") -> DataFrame:
    """Grids from long form; what is missing is an empty cell. One shuffle, by the keys."""
    entry = F.struct("row_idx", "col_idx", "text")
    held = cells.groupBy(*keys).agg(F.collect_list(entry).alias("__cells"), F.max("row_idx").alias("__m"), F.max("col_idx").alias("__n"))
    known = F.map_from_entries(F.transform("__cells", lambda c: F.struct(F.struct(c["row_idx"].alias("i"), c["col_idx"].alias("j")), c["text"])))
    at = lambda i, j: F.coalesce(F.try_element_at("__known", F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))), F.lit(""))
    made = F.transform(F.sequence(F.lit(0), "__m"), lambda i: F.transform(F.sequence(F.lit(0), "__n"), lambda j: at(i, j)))
    return held.withColumn("__known", known).select(*keys, made.alias(grid))


def rectangular(rows: Column) -> Column:
    """Ragged rows padded on the right with empty cells."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
