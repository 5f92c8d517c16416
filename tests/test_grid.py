"""HTML to grids: spans, carries, recovery, round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescore.operators.grid import _read, _Reader, grid_to_long, html_cells, html_to_grid, long_to_grid, read_grid, rectangular, register


def grid(html):
    return read_grid(html)[0]


def row(*cells):
    return "<tr>" + "".join(f"<td{c[1:].partition('>')[0] and ' ' + c[1:].partition('>')[0]}>{c.partition('>')[2]}</td>" if c.startswith("[") else f"<td>{c}</td>" for c in cells) + "</tr>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (row("[rowspan=2>A", "B") + row("C"), [["A", "B"], ["A", "C"]]),
        (row("[rowspan=2 colspan=2>H") + "<tr></tr>" + row("A", "B"), [["H", "H"], ["H", "H"], ["A", "B"]]),
        (row("a", "b") + row("c"), [["a", "b"], ["c", ""]]),
        (row("a", "b", "[rowspan=2>X") + row("c") + row("d", "e"), [["a", "b", "X"], ["c", "", ""], ["d", "e", "X"]]),
        (row("a", "[rowspan=2>X") + row("[colspan=2>c") + row("d", "e"), [["a", "X", ""], ["c", "c", ""], ["d", "X", "e"]]),
        (row("[rowspan=9>a"), [["a"]]),
        ("<p>x</p>", []),
        ("<tr></tr>", [[]]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c", ""]]),
        ("<tr><td> a&amp;<b>b</b><br>c<!-- no --> </td><th>&#x41;</th></tr>", [["a&bc", "A"]]),
        ("<table><tr><td>o<table><tr><td>i</td></tr></table>p</td><td>q</td></tr></table>", [["oip", "q"], ["i", ""]]),
        (row("[colspan=0>a", "b"), [["b"]]),
        (row("[rowspan=0>a") + row("b"), [["a"], ["b"]]),
        ("<td>stray</td><tr><td>x</td></tr>", [["x"]]),
    ],
)
def test_cases(html, want):
    assert grid(html) == want


def test_reasons():
    assert read_grid(None) == (None, "no html")
    assert read_grid("") == (None, "empty html")
    assert read_grid("<tr><td rowspan=2px>a</td></tr>") == (None, "bad span")
    assert read_grid("<tr><td colspan=1_0>a</td></tr>")[0] == [["a"] * 10]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.text("ab<&\"' é", max_size=4), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_round_trip(cells):
    from html import escape

    html = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in cells)
    assert grid(html) == [[c.strip() for c in r] for r in cells]


def test_columns(spark):
    df = spark.createDataFrame([(1, row("a", "b") + row("c")), (2, None), (3, "<p>"), (4, "<tr><td rowspan=x>")], "i int, html string")
    got = {r.i: r.g for r in df.select("i", html_to_grid(F.col("html")).alias("g")).collect()}
    assert (got[1].grid, got[1].reason) == ([["a", "b"], ["c", ""]], None)
    assert [got[i].reason for i in (2, 3, 4)] == ["no html", None, "bad span"]
    cells = df.lateralJoin(html_cells(F.col("html").outer())).select("i", "row_idx", "col_idx", "text")
    assert sorted(map(tuple, cells.collect())) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "")]
    back = long_to_grid(cells.filter("text <> ''"), "i")
    assert [tuple(r) for r in back.collect()] == [(1, [["a", "b"], ["c", ""]])]
    assert grid_to_long(back).count() == 4
    register(spark)
    assert spark.sql("SELECT html_to_grid('<tr><td>z</td></tr>').grid g").first().g == [["z"]]
    assert spark.sql("SELECT * FROM html_cells('<tr><td>z</td></tr>')").first().text == "z"
    ragged = spark.createDataFrame([([["a"], ["b", "c"], []],)], "g array<array<string>>")
    assert ragged.select(rectangular(F.col("g")).alias("g")).first().g == [["a", ""], ["b", "c"], ["", ""]]


def test_plain_tags_are_read_as_the_parser_reads_them():
    tags = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th rowspan=2>", "<td colspan='2' class=x>", '<TD ROWSPAN="2">', "<td rowspan>", "<td rowspan=''>", "<br/>", "<b>", "a", "&amp;", "&lt", "x & y", "\n"]
    odd = ["<!-- c -->", "<script>", "</script>", "<td/>", "<", ">", "</td x>", "<td rowspan=2 rowspan=3>", "<td a=b/c>", "<tr/>", "<p", "<title>", "</title>", "<td rowspan = 2>", "<td rowspan=&#50;>", "</", "<td\x0browspan=2>", "<td é=2>"]
    draw = random.Random(8)
    rows = lambda reader: [[("".join(text), down, right) for text, down, right in row] for row in reader.rows]
    for k in range(20_000):
        html = "".join(draw.choices(tags + odd * (k % 2), k=draw.randint(1, 14)))
        whole = _Reader()
        whole.feed(html)
        whole.close()
        assert rows(_read(html)) == rows(whole), html
