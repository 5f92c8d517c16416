"""The engine's registered queries: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.align import cell_match_score, table_similarity
from ..functions.text import data_url, normalize_cell, normalize_grid, output_path, retry_delay, slice_table, strip_captions
from ..operators.explain import align_cells, align_rows
from ..operators.extract import extract
from ..operators.grid import grid_to_long, html_cells, html_to_grid, long_to_grid
from ..operators.report import leaderboard, with_missing
from ..operators.score import row_pairs, score_tables
from ..sources.documents import todo
from . import edges, outside
from .fixtures import order_grids, order_pairs, table

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(score: str = "score") -> Column:
    return F.round(F.col(score).cast("double"), 6)


# --- alignment and scores -----------------------------------------------------------------------


def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on all orders, batched."""
    return score_tables(order_pairs(spark, sf_dir)).select("l_orderkey", _rounded().alias("score"))


def table_similarity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on all orders, as nested Catalyst folds."""
    return order_pairs(spark, sf_dir).select("l_orderkey", F.round(table_similarity(F.col("truth"), F.col("prediction")), 6).alias("score"))


def table_similarity_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = order_grids(spark, sf_dir)
    return score_tables(grids.withColumn("prediction", F.col("truth"))).select("l_orderkey", "score")


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on all pairs of nation names: a stated table against itself."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    other = names.select(F.col("n_nationkey").alias("m_nationkey"), F.col("n_name").alias("m_name"))
    return names.crossJoin(F.broadcast(other)).select("n_nationkey", "m_nationkey", F.round(cell_match_score(F.col("n_name"), F.col("m_name")).cast("double"), 6).alias("score"))


def nw_cell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2's score of every pair of rows of every order's two grids, batched."""
    pairs = align_cells(order_pairs(spark, sf_dir))
    return pairs.select("l_orderkey", F.col("truth_row").alias("i"), F.col("prediction_row").alias("j"), _rounded().alias("score"))


def row_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 in long form, batched."""
    pairs = row_pairs(order_pairs(spark, sf_dir))
    return pairs.select("l_orderkey", F.col("truth_row").alias("i"), F.col("prediction_row").alias("j"), _rounded().alias("score"))


def alignment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the path behind the score."""
    return align_rows(order_pairs(spark, sf_dir)).groupBy("l_orderkey").agg(F.count("*").cast("int").alias("aligned_rows"))


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: which row was held against which."""
    return align_rows(order_pairs(spark, sf_dir)).select("l_orderkey", "place", "truth_row", "prediction_row")


def alignment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned cells of every pair of rows, ~ for a gap."""
    cells = lambda c: F.array_join(c, "|", "~").alias(c)
    pairs = align_cells(order_pairs(spark, sf_dir))
    return pairs.select("l_orderkey", F.col("truth_row").alias("i"), F.col("prediction_row").alias("j"), cells("truth_cells"), cells("prediction_cells"))


def missing_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ground truth stays; two orders in seven have no prediction."""
    pairs = order_pairs(spark, sf_dir)
    found = pairs.filter(F.col("l_orderkey") % 7 > 1).select("l_orderkey", "prediction")
    return score_tables(with_missing(pairs.drop("prediction"), found, "l_orderkey")).select("l_orderkey", _rounded().alias("score"), "reason")


def provider_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over eight made-up providers, one for each change; two orders in seven have no score."""
    scores = missing_prediction(spark, sf_dir).withColumn("provider", F.concat(F.lit("p"), (F.col("l_orderkey") % 8).cast("string")))
    return leaderboard(scores, "provider").select("provider", "tables", "unscored", F.round("mean_score", 5).alias("mean_score"), "min_score", "max_score", "median_score")


# --- grids --------------------------------------------------------------------------------------


def _html(grid: Column) -> Column:
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, line), ""), F.lit("</table>"))


def grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: grid to HTML to grid, in long form."""
    html = order_grids(spark, sf_dir).select("l_orderkey", html_to_grid(_html(F.col("truth"))).alias("g"))
    return grid_to_long(html.select("l_orderkey", F.col("g.grid").alias("grid")))


def grid_cells_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1's table function, and cells back to grids: the number of cells and the text of each order's grid."""
    html = order_grids(spark, sf_dir).select("l_orderkey", _html(F.col("truth")).alias("html"))
    cells = html.lateralJoin(html_cells(F.col("html").outer())).select("l_orderkey", "row_idx", "col_idx", "text")
    grids = long_to_grid(cells, "l_orderkey")
    return grids.select("l_orderkey", F.size("grid").alias("n_rows"), F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "/").alias("cells"))


def grid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1e-G1g: a region's name spans its nations' rows."""
    names = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    each = names.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("ns"))
    line = lambda n, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<th rowspan="), F.size("ns"), F.lit(">"), F.col("r_name"), F.lit("</th>"))).otherwise(""), F.lit("<td colspan=2>"), n, F.lit("</td></tr>"))
    grid = html_to_grid(F.array_join(F.transform("ns", line), "")).alias("g")
    rows = each.select("r_regionkey", grid).select("r_regionkey", F.posexplode("g.grid").alias("row_idx", "r"))
    return rows.select("r_regionkey", "row_idx", F.col("r")[0].alias("region"), F.col("r")[1].alias("nation"), F.col("r")[2].alias("nation_again"))


def grid_ragged_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1h: rows of one to three cells, padded."""
    row = F.concat(F.lit("<tr>"), F.repeat(F.concat(F.lit("<td>"), F.col("n_name"), F.lit("</td>")), F.col("n_nationkey") % 3 + 1), F.lit("</tr>"))
    each = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("h")))).alias("rows"))
    html = each.select("n_regionkey", F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda x: x["h"]), ""), F.lit("</table>")).alias("h"))
    return grid_to_long(html.select("n_regionkey", html_to_grid(F.col("h"))["grid"].alias("grid")))


def pages_without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row, no grid."""
    pages = table(spark, sf_dir, "pages").select("page_id", html_to_grid(F.col("html")).alias("g"))
    return pages.select("page_id", F.size("g.grid").alias("n_rows"))


# --- extraction from responses --------------------------------------------------------------------


def _customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, tables): each customer's order grids, in order of their keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    grids = order_grids(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return grids.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "truth"))), lambda x: x["truth"]).alias("tables"))


def _cells(grid: Column, **more: Callable[[Column, Column, Column], Column]) -> Column:
    cell = lambda t, i, j: F.struct(i.alias("rowIndex"), j.alias("columnIndex"), *((f(t, i, j)).alias(k) for k, f in more.items()))
    cells = F.flatten(F.transform(grid, lambda r, i: F.transform(r, lambda t, j: cell(t, i, j))))
    return F.struct(F.size(grid).alias("rowCount"), F.lit(5).alias("columnCount"), cells.alias("cells"))


def cu_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of a customer's tables of structured cells."""
    one = lambda g: _cells(g, content=lambda t, i, j: F.when(j == 3, F.concat(F.lit('<&"\n'), t)).otherwise(t), kind=lambda t, i, j: F.when(j == 0, F.lit("rowHeader")).otherwise("content"))
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform("tables", one).alias("tables"))).alias("contents")).alias("analyzeResult")))
    return _customer_tables(spark, sf_dir).select("o_custkey", extract(raw, "structured")["html"].alias("html"))


def azure_grid_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of a customer's tables of layout cells."""
    one = lambda g: _cells(g, content=lambda t, i, j: F.when(j == 3, F.concat(t, F.lit(":selected:"))).otherwise(t), kind=lambda t, i, j: F.when(i == 0, F.lit("columnHeader")))
    raw = F.to_json(F.struct(F.transform("tables", one).alias("tables")))
    return _customer_tables(spark, sf_dir).select("o_custkey", extract(raw, "layout")["html"].alias("html"))


def longest_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of a customer's HTML tables, in three shapes."""
    html = F.transform("tables", _html)
    blocks = F.struct(F.struct(F.array(F.struct(F.transform(html, lambda h: F.struct(F.lit("Table").alias("type"), h.alias("content"))).alias("blocks"))).alias("chunks")).alias("result"))
    parts = F.struct(F.lit("Succeeded").alias("status"), F.array(F.struct(F.transform(html, lambda h: F.struct(F.lit("Table").alias("segment_type"), h.alias("html"))).alias("segments"))).alias("output"))
    items = F.struct(F.transform(html, lambda h: F.struct(F.lit("Table").alias("type"), F.struct(h.alias("text_as_html")).alias("metadata"))).alias("elements"))
    shapes = {"chunks": blocks, "segments": parts, "elements": items}
    return _customer_tables(spark, sf_dir).select("o_custkey", *(extract(F.to_json(x), k)["html"].alias(f"{k}_html") for k, x in shapes.items()))


def ranked_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest grid, then the longest text, of a customer's HTML tables."""
    tables = F.transform("tables", lambda g: F.struct(F.lit("HTML").alias("format"), F.concat(F.lit("\n "), _html(g)).alias("content")))
    raw = F.to_json(F.struct(F.array(F.struct(tables.alias("tables"))).alias("pages")))
    return _customer_tables(spark, sf_dir).select("o_custkey", extract(raw, "pages")["html"].alias("html"))


def html_table_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field as it is; every third response has a null, every fifth is no JSON."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    good = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("html_table")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("{broken")).otherwise(good)
    both = orders.select("o_orderkey", extract(raw, "field").alias("a"), extract(raw, "field_tolerant").alias("b"))
    return both.select("o_orderkey", "a.html", "a.reason", F.col("b.reason").alias("tolerant_reason"))


def slice_table_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 on all document texts, a table put around every second one."""
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ok <table>"), "text", F.lit("</table> end"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", slice_table(wrapped).alias("html"))


def strip_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S23."""
    html = F.concat(F.lit("<table><caption>a\nb</caption>"), "p_name", F.lit("<caption>"), "p_brand", F.lit("</caption></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", strip_captions(html).alias("html"))


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of semi-structured text."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# --- text, sources --------------------------------------------------------------------------------


def normalize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 on all lines of all documents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "cell"))
    return lines.select("doc_id", "line", normalize_cell(F.col("cell")).alias("cell"))


def normalized_grid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 mapped over grids: the characters left in each order's cells."""
    grid = normalize_grid(F.col("truth"))
    return order_grids(spark, sf_dir).select("l_orderkey", F.char_length(F.array_join(F.flatten(grid), "")).alias("chars"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18."""
    path = F.concat(F.lit("/d/pdfs/"), "lang", F.lit("_pdfs/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", output_path(path, "azure").alias("output"))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a response; those of even ids have one."""
    path = F.concat(F.lit("/d/azure/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("output")
    docs = table(spark, sf_dir, "documents").select("doc_id", path)
    return todo(docs, docs.filter("doc_id % 2 = 0")).select("doc_id", "output")


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 on all document texts."""
    return table(spark, sf_dir, "documents").select("doc_id", data_url(F.encode("text", "utf-8")).alias("url"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made of order columns, some absent, some not numbers, some not positive."""
    ms = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, "soon")
    s = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 50 - 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(retry_delay(ms, s, F.col("o_custkey") % 7), 6).alias("seconds"))


ALL: list[Query] = [
    table_score, table_similarity_fold, table_similarity_identity, cell_scores, nw_cell_score, row_pair_matrix, alignment_length, alignment_rows, alignment_cells,
    missing_prediction, provider_leaderboard, grid_round_trip, grid_cells_udtf, grid_spans, grid_ragged_pad, pages_without_tables, cu_table_html, azure_grid_html,
    longest_html_table, ranked_html_table, html_table_field, slice_table_literal, strip_caption, event_props_json, normalize_cells, normalized_grid_sizes, output_paths,
    resume_todo, data_urls, retry_delays,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in [*ALL, *edges.ALL, *outside.ALL]}
