"""DuckDB SQL for the queries of .queries, on the same tables."""

from __future__ import annotations

from . import edges, outside

_LINES = """
lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity::BIGINT, l_returnflag, l_linestatus) - 1 AS i,
    [l_partkey::VARCHAR, l_suppkey::VARCHAR, l_quantity::BIGINT::VARCHAR, l_returnflag, l_linestatus] AS line FROM lineitem),
grids AS (SELECT l_orderkey, list(line ORDER BY i) AS truth FROM lines GROUP BY l_orderkey)"""

_PAIRS = (
    _LINES
    + """,
pairs AS (
  SELECT l_orderkey, truth, CASE
    WHEN l_orderkey % 8 = 1 AND len(truth) > 1 THEN truth[2:]
    WHEN l_orderkey % 8 = 2 AND len(truth) > 1 THEN truth[:len(truth) - 1]
    WHEN l_orderkey % 8 = 3 AND len(truth) > 2 THEN list_concat(truth[:len(truth) // 2], truth[len(truth) // 2 + 2:])
    WHEN l_orderkey % 8 = 4 THEN list_transform(truth, lambda r: [r[1], r[3], r[2], r[4], r[5]])
    WHEN l_orderkey % 8 = 5 THEN list_transform(truth, lambda r: list_concat([substr(r[1], 2)], r[2:5]))
    WHEN l_orderkey % 8 = 6 THEN list_transform(truth, lambda r: list_append(r, 'x'))
    WHEN l_orderkey % 8 = 7 THEN list_concat(truth[1:1], truth)
    ELSE truth END AS prediction FROM grids)"""
)

_CELL = "(CASE WHEN {a} = {b} THEN 1 ELSE -1 + 2 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE) END)::FLOAT"


def _nw(a: str, b: str) -> str:
    """Score of the free-end-gap alignment of two lists; a DP row carries the last column's best in front."""
    cell = _CELL.format(a="x", b=f"{b}[j]")
    row = f"list_reduce(range(1, len({b}) + 1), lambda now, j: list_append(now, greatest(held[j + 1] + {cell}, held[j + 2] - 1::FLOAT, now[-1] - 1::FLOAT)), [held[1], 0::FLOAT])"
    fold = f"list_reduce({a}, lambda held, x: list_transform([{row}], lambda r: list_concat([greatest(r[1], r[-1])], r[2:]))[1], list_resize([]::FLOAT[], len({b}) + 2, 0::FLOAT))"
    return f"list_max({fold})"


_MATRIX = f"SELECT l_orderkey, truth, prediction, i, j, {_nw('t', 'p')} + 5::FLOAT AS score FROM (SELECT l_orderkey, truth, prediction, unnest(range(len(truth))) AS i, truth[i + 1] AS t FROM pairs) CROSS JOIN LATERAL (SELECT unnest(range(len(prediction))) AS j, prediction[j + 1] AS p)"

# The row DP as recursion over places (i, j) of each order would be slow; a fold over rows carries {s, l} structs.
_POINTS = """
m AS (SELECT l_orderkey, i, list(score ORDER BY j) AS line FROM matrix GROUP BY l_orderkey, i),
mm AS (SELECT l_orderkey, list(line ORDER BY i) AS m, len(any_value(line)) AS n FROM m GROUP BY l_orderkey),
folded AS (
  SELECT l_orderkey, n, list_reduce(m, lambda held, line:
    list_transform([list_reduce(range(1, n + 1), lambda now, j: list_append(now,
        CASE WHEN held[j + 1].s + line[j] >= held[j + 2].s - 3::FLOAT AND held[j + 1].s + line[j] >= now[-1].s - 3::FLOAT THEN {'s': held[j + 1].s + line[j], 'l': held[j + 1].l + 1}
             WHEN held[j + 2].s >= now[-1].s THEN {'s': held[j + 2].s - 3::FLOAT, 'l': held[j + 2].l + 1}
             ELSE {'s': now[-1].s - 3::FLOAT, 'l': now[-1].l + 1} END),
        [held[1], {'s': 0::FLOAT, 'l': held[2].l + 1}])],
      lambda r: list_concat([CASE WHEN r[-1].s > r[1].s THEN r[-1] ELSE r[1] END], r[2:]))[1],
    list_concat([{'s': 0::FLOAT, 'l': n::BIGINT}], list_transform(range(n + 1), lambda k: {'s': 0::FLOAT, 'l': k}))) AS h FROM mm),
finals AS (
  SELECT l_orderkey, h[1] AS best, h[-1] AS corner, list_filter(h[2:], lambda p: p.s = list_max(list_transform(h[2:], lambda q: q.s)))[1] AS last FROM folded),
points AS (
  SELECT l_orderkey, CASE WHEN last.s > greatest(corner.s, best.s) THEN last WHEN best.s > corner.s THEN best ELSE corner END AS p FROM finals)"""

_SCORES = f"WITH {_PAIRS}, matrix AS ({_MATRIX}), {_POINTS}, scores AS (SELECT l_orderkey, round(least(1, p.s::DOUBLE / (p.l * 10)), 6) AS score FROM points)"



def _way(a: str, n: str, score: str, gap: int) -> str:
    """Score and moves (D, U, L) of the alignment of a list with one of n members: {s, p}. In `score`, x is the
    member of the first and j the place in the second."""
    row = f"""list_reduce(range(1, {n} + 1), lambda now, j: list_append(now,
        CASE WHEN held[j + 1].s + {score} >= held[j + 2].s + {gap}::FLOAT AND held[j + 1].s + {score} >= now[-1].s + {gap}::FLOAT THEN {{'s': held[j + 1].s + {score}, 'p': held[j + 1].p || 'D'}}
             WHEN held[j + 2].s >= now[-1].s THEN {{'s': held[j + 2].s + {gap}::FLOAT, 'p': held[j + 2].p || 'U'}}
             ELSE {{'s': now[-1].s + {gap}::FLOAT, 'p': now[-1].p || 'L'}} END),
        [held[1], {{'s': 0::FLOAT, 'p': held[2].p || 'U'}}])"""
    begin = f"list_concat([{{'s': 0::FLOAT, 'p': repeat('L', {n})}}], list_transform(range({n} + 1), lambda k: {{'s': 0::FLOAT, 'p': repeat('L', k::BIGINT)}}))"
    held = f"list_reduce({a}, lambda held, x: list_transform([{row}], lambda r: list_concat([CASE WHEN r[-1].s > r[1].s THEN r[-1] ELSE r[1] END], r[2:]))[1], {begin})"
    return f"""list_transform([{held}], lambda h: list_transform([list_filter(h[2:], lambda p: p.s = list_max(list_transform(h[2:], lambda q: q.s)))[1]],
        lambda last: CASE WHEN last.s > greatest(h[-1].s, h[1].s) THEN last WHEN h[1].s > h[-1].s THEN h[1] ELSE h[-1] END)[1])[1]"""


_ROW_WAYS = f"""rows AS (SELECT l_orderkey, i, list(score ORDER BY j) AS line FROM matrix GROUP BY l_orderkey, i),
whole AS (SELECT l_orderkey, list(line ORDER BY i) AS m, len(any_value(line)) AS n FROM rows GROUP BY l_orderkey),
steps AS (SELECT l_orderkey, w.p AS p, unnest(range(1, len(w.p) + 1)) AS k FROM (SELECT l_orderkey, {_way('m', 'n', 'x[j]', -3)} AS w FROM whole))"""

_CELL_WAYS = f"""ways AS (SELECT l_orderkey, i, j, t, o, {_way('t', 'len(o)', _CELL.format(a='x', b='o[j]'), -1)}.p AS p
  FROM (SELECT l_orderkey, prediction, unnest(range(len(truth))) AS i, truth[i + 1] AS t FROM pairs) CROSS JOIN LATERAL (SELECT unnest(range(len(prediction))) AS j, prediction[j + 1] AS o))"""


def _side(cells: str, gap: str) -> str:
    return f"array_to_string(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN p[k] <> '{gap}' THEN {cells}[len(replace(p[:k], '{gap}', ''))] ELSE '~' END), '|')"


_BY_CUSTOMER = (
    _LINES
    + """,
tables AS (SELECT o_custkey, l_orderkey, truth, '<table>' || array_to_string(list_transform(truth, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<td>' || c || '</td>'), '') || '</tr>'), '') || '</table>' AS html
  FROM grids JOIN orders ON l_orderkey = o_orderkey),
largest AS (SELECT * FROM tables QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY len(truth) DESC, l_orderkey) = 1)"""
)

_BODY = "'<table>' || array_to_string(list_transform(truth, lambda r, i: '<tr>' || {cells} || '</tr>'), '') || '</table>'"

SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def oracle_sql() -> dict[str, str]:
    irregular = {f.__name__: sql for f, sql in (edges.ALL | outside.ALL).items()}
    return irregular | {
        "table_score": f"{_SCORES} SELECT l_orderkey, score FROM scores",
        "table_similarity_fold": f"{_SCORES} SELECT l_orderkey, score FROM scores",
        "table_similarity_identity": "SELECT DISTINCT l_orderkey, 1.0::DOUBLE AS score FROM lineitem",
        "cell_scores": f"SELECT a.n_nationkey, b.n_nationkey AS m_nationkey, round(({_CELL.format(a='a.n_name', b='b.n_name').removesuffix('::FLOAT')})::DOUBLE, 6) AS score FROM nation a, nation b",
        "nw_cell_score": f"WITH {_PAIRS}, matrix AS ({_MATRIX}) SELECT l_orderkey, i::INT AS i, j::INT AS j, round(score::DOUBLE - 5, 6) AS score FROM matrix",
        "alignment_rows": f"WITH {_PAIRS}, matrix AS ({_MATRIX}), {_ROW_WAYS} SELECT l_orderkey, (k - 1)::INT AS place, CASE WHEN p[k] <> 'L' THEN (len(replace(p[:k], 'L', '')) - 1)::INT END AS truth_row, CASE WHEN p[k] <> 'U' THEN (len(replace(p[:k], 'U', '')) - 1)::INT END AS prediction_row FROM steps",
        "alignment_cells": f"WITH {_PAIRS}, {_CELL_WAYS} SELECT l_orderkey, i::INT AS i, j::INT AS j, {_side('t', 'L')} AS truth_cells, {_side('o', 'U')} AS prediction_cells FROM ways",
        "row_pair_matrix": f"WITH {_PAIRS}, matrix AS ({_MATRIX}) SELECT l_orderkey, i::INT AS i, j::INT AS j, round(score::DOUBLE, 6) AS score FROM matrix",
        "alignment_length": f"WITH {_PAIRS}, matrix AS ({_MATRIX}), {_POINTS} SELECT l_orderkey, p.l::INT AS aligned_rows FROM points",
        "missing_prediction": f"{_SCORES} SELECT l_orderkey, CASE WHEN l_orderkey % 7 > 1 THEN score END AS score, CASE WHEN l_orderkey % 7 <= 1 THEN 'no prediction' END AS reason FROM scores",
        "provider_leaderboard": f"{_SCORES}, given AS (SELECT 'p' || (l_orderkey % 8) AS provider, CASE WHEN l_orderkey % 7 > 1 THEN score END AS score FROM scores) SELECT provider, count(*) AS tables, count(*) - count(score) AS unscored, round(avg(score), 5) AS mean_score, min(score) AS min_score, max(score) AS max_score, quantile_disc(score, 0.5) AS median_score FROM given GROUP BY 1",
        "grid_round_trip": f"WITH {_LINES} SELECT l_orderkey, i::INT AS row_idx, (k - 1)::INT AS col_idx, line[k] AS text FROM (SELECT l_orderkey, i, line, unnest(range(1, 6)) AS k FROM lines)",
        "grid_cells_udtf": f"WITH {_LINES} SELECT l_orderkey, len(truth)::INT AS n_rows, array_to_string(list_transform(truth, lambda r: array_to_string(r, '|')), '/') AS cells FROM grids",
        "grid_spans": "SELECT r_regionkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1)::INT AS row_idx, r_name AS region, n_name AS nation, n_name AS nation_again FROM nation JOIN region ON n_regionkey = r_regionkey",
        "grid_ragged_pad": "WITH r AS (SELECT n_regionkey, n_name, n_nationkey % 3 + 1 AS w, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_idx, max(n_nationkey % 3 + 1) OVER (PARTITION BY n_regionkey) AS most FROM nation) SELECT n_regionkey, row_idx, k::INT AS col_idx, CASE WHEN k < w THEN n_name ELSE '' END AS text FROM (SELECT *, unnest(range(most)) AS k FROM r)",
        "pages_without_tables": "SELECT page_id, 0 AS n_rows FROM pages",
        "cu_table_html": f"""WITH {_BY_CUSTOMER} SELECT o_custkey, {_BODY.format(cells="'<th>' || r[1] || '</th><td>' || r[2] || '</td><td>' || r[3] || '</td><td>&lt;&amp;&quot; ' || r[4] || '</td><td>' || r[5] || '</td>'")} AS html FROM largest""",
        "azure_grid_html": f"""WITH {_BY_CUSTOMER} SELECT o_custkey, {_BODY.format(cells="array_to_string(list_transform(r, lambda c: CASE WHEN i = 1 THEN '<th>' || c || '</th>' ELSE '<td>' || c || '</td>' END), '')")} AS html FROM largest""",
        "longest_html_table": f"WITH {_BY_CUSTOMER}, b AS (SELECT * FROM tables QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY length(html) DESC, l_orderkey) = 1) SELECT o_custkey, html AS chunks_html, html AS segments_html, html AS elements_html FROM b",
        "ranked_html_table": f"WITH {_BY_CUSTOMER}, b AS (SELECT * FROM tables QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY len(truth) DESC, length(html) DESC, l_orderkey) = 1) SELECT o_custkey, html FROM b",
        "html_table_field": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN o_orderpriority END AS html, CASE WHEN o_orderkey % 5 = 0 THEN 'not JSON' END AS reason, NULL::VARCHAR AS tolerant_reason FROM orders",
        "slice_table_literal": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<table>' || text || '</table>' END AS html FROM documents",
        "strip_caption": "SELECT p_partkey, '<table>' || p_name || '</table>' AS html FROM part",
        "event_props_json": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "normalize_cells": f"SELECT doc_id, (k - 1)::INT AS line, regexp_replace(parts[k], '[{SPACES}-]', '', 'g') AS cell FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))",
        "normalized_grid_sizes": "SELECT l_orderkey, sum(length(l_partkey::VARCHAR) + length(l_suppkey::VARCHAR) + length(l_quantity::BIGINT::VARCHAR) + length(l_returnflag) + length(l_linestatus))::INT AS chars FROM lineitem GROUP BY l_orderkey",
        "output_paths": "SELECT doc_id, '/d/azure/' || lang || '_azure/' || doc_id || '.json' AS output FROM documents",
        "resume_todo": "SELECT doc_id, '/d/azure/' || doc_id || '.json' AS output FROM documents WHERE doc_id % 2 = 1",
        "data_urls": "SELECT doc_id, 'data:application/pdf;base64,' || base64(encode(text)) AS url FROM documents",
        "retry_delays": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 = 0 AND o_custkey > 0 THEN o_custkey * 0.001 WHEN o_orderkey % 3 = 0 AND o_custkey % 50 > 10 THEN (o_custkey % 50 - 10)::DOUBLE ELSE least(power(2, o_custkey % 7), 30)::DOUBLE END, 6) AS seconds FROM orders",
    }
