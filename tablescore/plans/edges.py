"""Queries on responses and tables that aren't regular, each with its SQL: every branch of every extractor,
and of the reading of HTML tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..operators.grid import html_to_grid
from .fixtures import table

Query = Callable[[SparkSession, str], DataFrame]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def _cell(row: int | Column, column: int, content: Column | None, kind: Column | None = None, rows: Column | None = None, columns: int | None = None) -> Column:
    null = lambda c, t: F.lit(None).cast(t) if c is None else c
    parts = {"rowIndex": row if isinstance(row, Column) else F.lit(row), "columnIndex": F.lit(column), "content": null(content, "string"), "kind": null(kind, "string"), "rowSpan": null(rows, "int"), "columnSpan": F.lit(columns).cast("int")}
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def _by(key: Column, *cases: Column) -> Column:
    """cases[key mod their number]"""
    out = F.lit(None).cast("string")
    for k, case in enumerate(cases):
        out = F.when(key % len(cases) == k, case).otherwise(out)
    return out


def _broken() -> tuple[Column, Column]:
    return F.lit("{broken"), F.lit(None).cast("string")


def structured_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, header kinds, rows from the end, escapes, where the tables are, what is wrong."""
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "rowHeader").when(key % 3 == 1, "STUBHEADER")
    cells = lambda row: F.array(_cell(0, 0, F.col("p_name"), F.lit("columnHeader"), columns=2), _cell(-1, 0, F.concat("p_type", F.lit("'s")), kind, (key % 3).cast("int")), _cell(row, 1, F.concat(F.lit('<&">\n'), "p_brand")))
    whole = lambda rows=2, row=1: F.struct(F.lit(rows).cast("int").alias("rowCount"), F.lit(2).alias("columnCount"), cells(row).alias("cells"))
    other = F.struct(F.lit(2).alias("rowCount"), F.lit(2).alias("columnCount"), F.array(_cell(0, 0, F.lit("late"))).alias("cells"))
    small = F.struct(F.lit(3).alias("rowCount"), F.lit(1).alias("columnCount"), F.array(_cell(0, 0, F.lit("small"))).alias("cells"))
    contents = lambda *tables: F.array(F.struct(F.array(*tables).alias("tables")))
    wrap = lambda c: F.struct(c.alias("contents"))
    raw = _by(
        key, _json(analyzeResult=wrap(contents(whole(row=7)))), _json(contents=contents(whole())), F.concat(F.lit('{"analyzeResult":{},'), F.substring(_json(contents=contents(whole())), F.lit(2), F.lit(1 << 30))),
        _json(contents=contents(whole(rows=None))), *_broken(), _json(contents=F.array().cast("array<string>")), _json(analyzeResult=wrap(F.concat(contents(small), contents(whole(), other)))),
    )
    return table(spark, sf_dir, "part").select("p_partkey", extract(raw, "structured").alias("t")).select("p_partkey", "t.html", "t.reason")


_STRUCTURED = """
WITH h AS (SELECT p_partkey, '<table><tr><th colspan="2">' || p_name || '</th></tr><tr>' || CASE p_partkey % 3 WHEN 2 THEN '<td rowspan="2">' ELSE '<th>' END
  || p_type || '&#x27;s' || CASE p_partkey % 3 WHEN 2 THEN '</td>' ELSE '</th>' END || '<td>&lt;&amp;&quot;&gt; ' || p_brand || '</td></tr></table>' AS html FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 8 IN (1, 2, 7) THEN html END AS html,
  CASE p_partkey % 8 WHEN 0 THEN 'cell outside its table' WHEN 3 THEN 'table without counts' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'missing file' END AS reason FROM h
"""


def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are doubled, missing or outside, spans as they are, check boxes, what is wrong."""
    key, boxes = F.col("p_partkey"), F.concat("p_name", F.lit(" :selected:<&:unselected:"))
    last = [_cell(1, 1, F.col("p_brand")), _cell(5, 5, F.lit("out"))]
    first = [_cell(1, 0, F.col("p_type"), F.lit("rowHeader"), F.lit(1)), _cell(1, 0, F.lit("second"))]
    head = _cell(0, 0, boxes, F.lit("columnHeader"), columns=2)
    whole = lambda *cells, rows=2: F.struct(F.lit(rows).cast("int").alias("rowCount"), F.lit(2).alias("columnCount"), F.array(*cells).alias("cells"))
    raw = _by(
        key, _json(tables=F.array().cast("array<string>")), _json(tables=F.array(whole(head, _cell(1, 0, None)))), _json(tables=F.array(whole(head, rows=None))), _json(tables=F.array(whole(*last, head))),
        _json(tables=F.array(whole(_cell(0, 0, F.lit("small")), rows=1), whole(*last, *first, head), whole(head))), *_broken(),
    )
    return table(spark, sf_dir, "part").select("p_partkey", extract(raw, "layout").alias("t")).select("p_partkey", "t.html", "t.reason")


_LAYOUT = """
SELECT p_partkey, CASE WHEN p_partkey % 7 IN (3, 4) THEN '<table><tr><th colspan=''2''>' || p_name || ' <&</th></tr><tr>'
    || CASE p_partkey % 7 WHEN 4 THEN '<td rowspan=''1''>' || p_type || '</td>' ELSE '' END || '<td>' || p_brand || '</td></tr></table>' END AS html,
  CASE p_partkey % 7 WHEN 0 THEN 'no tables' WHEN 1 THEN 'cell without place or content' WHEN 2 THEN 'table without counts' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'missing file' END AS reason FROM part
"""


def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of other types, ties, empty texts, failures, and both places of segments."""
    key = F.col("o_orderkey")
    one, two = F.concat(F.lit("<table>#"), "o_custkey", F.lit("</table>")), F.concat(F.lit("<table>"), "o_orderpriority", F.lit("</table>"))
    long = F.concat(F.lit("not a table, and longer than any"), one, two)
    tie = F.concat(F.lit("<TABLE>#"), "o_custkey", F.lit("</TABLE>"))

    def entries(kind: str, text: Callable[[Column], Column], *pairs: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(k).alias(kind), *text(x)) for k, x in pairs))

    def shapes(make: Callable[..., Column]) -> list[Column]:
        return [make(("Text", long), ("Table", two)), make(("Table", two), ("Table", one), ("Table", tie)), make(("Table", F.lit(""))), make(("Title", long))]

    block = lambda *pairs: F.array(F.struct(entries("type", lambda x: [x.alias("content")], *pairs).alias("blocks")))
    part = lambda *pairs: F.array(F.struct(entries("segment_type", lambda x: [x.alias("html")], *pairs).alias("segments")))
    item = lambda *pairs: entries("type", lambda x: [F.struct(x.alias("text_as_html")).alias("metadata")], *pairs)
    result = lambda chunks: F.struct(chunks.alias("chunks"))
    good = F.lit("Succeeded")
    raw = {
        "chunks": _by(key, *(_json(result=result(x)) for x in shapes(block)), _json(error=F.lit("no"), result=result(block(("Table", one)))), F.lit('{"result":{}}'), *_broken()),
        "segments": _by(key, *(_json(status=good, output=x) for x in shapes(part)), _json(status=F.lit("Failed"), output=part(("Table", one))), _json(status=good, output=result(part(("Table", one)))), *_broken()),
        "elements": _by(key, *(_json(elements=x) for x in shapes(item)), F.lit("{}"), F.lit('{"elements":[]}'), *_broken()),
    }
    found = table(spark, sf_dir, "orders").select("o_orderkey", *(extract(x, k).alias(k) for k, x in raw.items()))
    return found.select("o_orderkey", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in raw for c in ("html", "reason")))


_TYPED = """
WITH t AS (SELECT o_orderkey, o_orderkey % 8 AS k, '<table>#' || o_custkey || '</table>' AS one, '<table>' || o_orderpriority || '</table>' AS two FROM orders),
b AS (SELECT *, CASE k WHEN 0 THEN two WHEN 1 THEN CASE WHEN length(two) >= length(one) THEN two ELSE one END END AS html, CASE k WHEN 6 THEN 'not JSON' WHEN 7 THEN 'missing file' END AS reason FROM t)
SELECT o_orderkey, html AS chunks_html, coalesce(reason, CASE k WHEN 5 THEN 'no chunks' END) AS chunks_reason, CASE k WHEN 5 THEN one ELSE html END AS segments_html, reason AS segments_reason,
  html AS elements_html, reason AS elements_reason FROM b
"""


def message_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal table in what a model said about each document's first line."""
    line = F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit(""))
    said = [F.concat(F.lit("```html\n<table>"), line, F.lit("</table>\n```")), F.concat(F.lit("<table border=1>"), line, F.lit("</table>")), F.concat(F.lit("0123456789<table>"), line), F.lit(None).cast("string")]
    raw = _by(F.col("doc_id"), *(_json(html_table=x) for x in said), *_broken())
    return table(spark, sf_dir, "documents").select("doc_id", extract(raw, "message").alias("t")).select("doc_id", "t.html", "t.reason")


_MESSAGE = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<table>' || coalesce(string_split(text, chr(10))[1], '') || '</table>' WHEN 2 THEN '' END AS html,
  CASE doc_id % 6 WHEN 3 THEN 'no html_table' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'missing file' END AS reason FROM documents
"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that aren't objects, other formats, empty and null contents, ties of size and of length."""
    text = lambda c: F.concat(F.lit("<table><tr><td>"), c, F.lit("</td></tr></table>"))
    wide = F.concat(F.lit("<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td>"), "p_brand", F.lit("</td></tr></table>"))
    entry = lambda content, kind="html": _json(format=F.lit(kind), content=content)
    pages = lambda *entries: F.concat(F.lit('{"pages":[7,{"tables":["x",'), F.concat_ws(",", *entries), F.lit("]}]}"))
    raw = _by(
        F.col("p_partkey"), pages(entry(text(F.concat("p_name", "p_name", "p_name"))), entry(F.concat(F.lit(" "), wide, F.lit("\n")), "HTML")), pages(entry(text(F.col("p_name")), "markdown"), entry(F.lit("  "))),
        pages(F.lit('{"format":"html","content":null}')), pages(entry(text(F.col("p_brand"))), entry(text(F.concat("p_brand", F.lit("!")))), entry(text(F.concat("p_brand", F.lit("?"))))), F.lit('{"pages":[]}'), *_broken(),
    )
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", extract(F.col("raw"), "pages").alias("t")).select("p_partkey", "t.html", "t.reason")


_PAGES = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td>' || p_brand || '</td></tr></table>' WHEN 2 THEN 'None'
  WHEN 3 THEN '<table><tr><td>' || p_brand || '!</td></tr></table>' END AS html, CASE p_partkey % 7 WHEN 5 THEN 'not JSON' WHEN 6 THEN 'missing file' END AS reason FROM part
"""


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G1h, N9: row spans that wait, are jumped over or hang over, entities, cells left open, bad spans."""
    name = F.col("n_name")
    html = _by(
        F.col("n_nationkey"),
        F.concat(F.lit("<tr><td>a<td>b<td rowspan=2>"), name, F.lit("<tr><td>c<tr><td>d<td>e")),
        F.concat(F.lit("<tr><td>a</td><td rowspan=2>"), name, F.lit("</td></tr><tr><td colspan=2>c</td></tr><tr><td>d</td><td>e</td></tr>")),
        F.concat(F.lit("<tr><td rowspan=5>"), name, F.lit("</td><td>x</td></tr>")),
        F.concat(F.lit("<table><tr><td>&lt;b&gt; &amp; &eacute;&#233;&#xe9; "), name, F.lit("</td></tr></table>")),
        F.concat(F.lit("<table><tr><td>a <b>"), name, F.lit("</b> <table><tr><td>in</td></tr></table></td><!-- no text --></tr></table>")),
        F.lit("<tr><td rowspan=x>1</td></tr>"),
        F.lit(""),
        F.lit(None).cast("string"),
    )
    read = table(spark, sf_dir, "nation").select("n_nationkey", html_to_grid(html).alias("g"))
    return read.select("n_nationkey", F.array_join(F.transform("g.grid", lambda r: F.array_join(r, "|")), "/").alias("grid"), "g.reason")


_GRID = """
SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'a|b|' || n_name || '/c||/d|e|' || n_name WHEN 1 THEN 'a|' || n_name || '|/c|c|/d|' || n_name || '|e' WHEN 2 THEN n_name || '|x'
    WHEN 3 THEN '<b> & ééé ' || n_name WHEN 4 THEN 'a ' || n_name || ' in/in' END AS grid,
  CASE n_nationkey % 8 WHEN 5 THEN 'bad span' WHEN 6 THEN 'empty html' WHEN 7 THEN 'no html' END AS reason FROM nation
"""

ALL: dict[Query, str] = {structured_edges: _STRUCTURED, layout_edges: _LAYOUT, typed_entries: _TYPED, message_tables: _MESSAGE, page_edges: _PAGES, grid_edges: _GRID}
