"""Queries of call trees, diagrams, order and metrics of the whole graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.code import extract, resolve
from codeloom.operators import flow, graph
from codeloom.plans.catalog import GRAPH_SQL, NATION_SQL, call_graph, nation_graph, nations, parts, query, table
from codeloom.plans.code_plans import _M, _R, _code, _edges_sql, _parsed, _symbols_sql, _text, _FROM
from codeloom.sources.shared import kept

_ENTRY = f"entry(id, entry_kind) AS (SELECT {_text(_M)}, 'main' FROM {_FROM['s']} UNION ALL SELECT 'firms/__main__.py::__main__::<module>', 'main_guard' UNION ALL SELECT {_text(_R)}, 'exported' FROM {_FROM['r']})"


def _trace_sql(depth: int) -> str:
    """tree: seed, depth, id, place, recursive, caller, line, callee_expr, confidence, control_ctx, kind, omitted, label."""
    return f"""WITH RECURSIVE {_symbols_sql()}, {_edges_sql()},
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY caller ORDER BY line, callee_expr, coalesce(callee, ''), confidence DESC) AS INTEGER) AS at, count(*) OVER (PARTITION BY caller) AS total, coalesce(callee, 'external:' || caller || ':' || line || ':' || callee_expr) AS target FROM code_edges WHERE callee IS NULL OR confidence >= 0.6),
walk(seed, depth, id, place, way, recursive, caller, line, callee_expr, confidence, control_ctx, kind) AS (
  SELECT id, 0, id, CAST([] AS INTEGER[]), [id], false, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), 'symbol' FROM code_symbols WHERE ends_with(id, '::main') OR kind = 'module'
  UNION ALL
  SELECT w.seed, w.depth + 1, e.target, list_append(w.place, e.at), list_append(w.way, e.target), list_contains(w.way, e.target), e.caller, e.line, e.callee_expr, e.confidence, e.control_ctx, CASE WHEN e.callee IS NULL THEN 'external' ELSE 'symbol' END
  FROM walk w JOIN e ON e.caller = w.id WHERE w.depth < {depth} AND NOT w.recursive AND w.kind = 'symbol'),
tree AS (SELECT w.*, row_number() OVER (PARTITION BY seed ORDER BY place) AS position, CASE WHEN w.depth = {depth} AND NOT w.recursive AND w.kind = 'symbol' THEN coalesce((SELECT max(total) FROM e WHERE e.caller = w.id), 0) ELSE 0 END AS omitted, coalesce(s.qualname, w.callee_expr, w.id) AS label, s.file_path, s.start_line, s.end_line FROM walk w LEFT JOIN code_symbols s ON s.id = w.id)"""


def _tree(spark, sf_dir, depth: int = 4, max_nodes: int = 4000):
    parsed, symbols = _code(spark, sf_dir)
    edges = kept(resolve.call_edges(parsed, symbols))
    seeds = symbols.filter("id LIKE '%::main' OR kind = 'module'").select("id")
    return flow.labels(flow.trace_tree(seeds, edges, depth, 0.6, max_nodes), symbols), symbols


@query(_trace_sql(4) + " SELECT seed, position, depth, id, label, kind, recursive, CAST(omitted AS INTEGER) AS omitted, line FROM tree")
def trace_flow(spark, sf_dir):
    tree, _ = _tree(spark, sf_dir)
    return tree.select("seed", "position", "depth", "id", "label", "kind", "recursive", "omitted", "line")


@query(
    _trace_sql(4)
    + """, held AS (SELECT * FROM tree WHERE position < 9), cut AS (SELECT seed, place[1:len(place) - 1] AS up, min(place[len(place)]) AS at FROM tree WHERE position >= 9 GROUP BY 1, 2)
SELECT seed, id, depth, kind, 0 AS count FROM held UNION ALL SELECT c.seed, h.id || '::cap', h.depth + 1, 'collapsed', CAST((SELECT max(total) FROM e WHERE e.caller = h.id) - c.at + 1 AS INTEGER) FROM cut c JOIN held h ON h.seed = c.seed AND h.place = c.up"""
)
def trace_capped(spark, sf_dir):
    """Trees of at most eight nodes, with what each node leaves out."""
    tree, _ = _tree(spark, sf_dir, max_nodes=9)
    return tree.select("seed", "id", "depth", "kind", "count")


@query(
    _trace_sql(4)
    + """ SELECT seed, id AS node, depth, label FROM tree WHERE depth <= 2
UNION ALL SELECT t.seed, t.id || '::collapsed', 3, '...' || count(*) || ' more' FROM tree t JOIN tree b ON b.seed = t.seed AND len(b.place) > 2 AND b.place[1:2] = t.place WHERE t.depth = 2 GROUP BY t.seed, t.id, t.place"""
)
def collapsed_tree(spark, sf_dir):
    tree, _ = _tree(spark, sf_dir)
    return flow.collapse(tree, 4000, 2).select("seed", "node", "depth", "label")


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')"
_CHART = (
    _trace_sql(3)
    + f""", l AS (SELECT t.seed, t.position, '  n' || (t.position - 1) || '["' || {_ESC.format("t.label || CASE WHEN t.recursive THEN ' ↻' ELSE '' END || CASE WHEN t.omitted > 0 THEN ' (...' || t.omitted || ' more)' ELSE '' END")} || '"]'
|| CASE WHEN p.position IS NULL THEN '' ELSE chr(10) || '  n' || (p.position - 1) || ' -->' || CASE WHEN t.control_ctx <> '' THEN '|' || {_ESC.format("t.control_ctx")} || '|' ELSE '' END || ' n' || (t.position - 1) END AS line
FROM tree t LEFT JOIN tree p ON p.seed = t.seed AND len(t.place) > 0 AND p.place = t.place[1:len(t.place) - 1])
SELECT seed, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY position) AS diagram, 0 AS errors FROM l GROUP BY seed"""
)


@query(_CHART)
def flow_diagrams(spark, sf_dir):
    tree, _ = _tree(spark, sf_dir, 3)
    return flow.diagram_errors(flow.flowchart(tree)).withColumn("errors", F.size("errors"))


@query(
    _trace_sql(2)
    + f""", f AS (SELECT seed, id, min(position) AS position FROM tree GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY position) - 1 AS n FROM f),
l AS (SELECT seed, 0 AS part, position, '  participant n' || n || ' as ' || {_ESC.format("id")} AS line FROM n
UNION ALL SELECT t.seed, 1, t.position, '  n' || a.n || '->>n' || b.n || ': ' || {_ESC.format("CASE WHEN t.control_ctx <> '' THEN t.control_ctx ELSE t.label END")} FROM tree t JOIN tree p ON p.seed = t.seed AND len(t.place) > 0 AND p.place = t.place[1:len(t.place) - 1] JOIN n a ON a.seed = t.seed AND a.id = p.id JOIN n b ON b.seed = t.seed AND b.id = t.id)
SELECT seed, 'sequenceDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, position) AS diagram, 0 AS errors FROM l GROUP BY seed"""
)
def sequence_diagrams(spark, sf_dir):
    tree, _ = _tree(spark, sf_dir, 2)
    return flow.diagram_errors(flow.sequence(tree)).withColumn("errors", F.size("errors"))


_BAD = "CASE doc_id % 4 WHEN 0 THEN 'flowchart XY' WHEN 1 THEN 'graph LR' || chr(10) || 'n1[\"' || lang || '\"]' || chr(10) || 'n1[\"b\"]' WHEN 2 THEN 'sequenceDiagram' || chr(10) || 'participant n0 as ' || source || chr(10) || 'n0->>n9: x' ELSE 'flowchart TD' || chr(10) || 'n0[\"a\"]' || chr(10) || 'n0 => n0' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Unknown header' WHEN 1 THEN 'Duplicate node: n1' WHEN 2 THEN 'Undefined arrow end' ELSE 'Invalid line: n0 => n0' END AS errors FROM documents")
def diagram_errors(spark, sf_dir):
    return flow.diagram_errors(table(spark, sf_dir, "documents").select("doc_id", F.expr(_BAD.replace("chr(", "char(")).alias("diagram"))).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query(
    _trace_sql(3)
    + """ SELECT t.seed, t.position, '| ' || coalesce(c.file_path, t.file_path) || ':' || coalesce(t.line, t.start_line) || ' | ' || t.label || CASE WHEN t.recursive THEN ' ↻' ELSE '' END || ' | ' || coalesce(t.control_ctx, '') || ' | ' || CASE WHEN t.caller IS NULL THEN 'root / ' ELSE 'ast / ' || CAST(t.confidence AS VARCHAR) END || ' |' AS row
FROM tree t LEFT JOIN code_symbols c ON c.id = t.caller"""
)
def flow_table(spark, sf_dir):
    return flow.step_table(*_tree(spark, sf_dir, 3))


@query(
    _trace_sql(3)
    + """ SELECT t.seed, t.position, CASE WHEN t.caller IS NULL THEN '[' || t.file_path || ':' || t.start_line || '-' || t.end_line || ']' ELSE '[' || c.file_path || ':' || t.line || '-' || t.line || ']' END AS cite FROM tree t LEFT JOIN code_symbols c ON c.id = t.caller"""
)
def flow_evidence(spark, sf_dir):
    return flow.step_evidence(*_tree(spark, sf_dir, 3)).select("seed", "position", "cite")


@query(
    f"""WITH {_symbols_sql()}, {_edges_sql()} SELECT caller, callee FROM code_edges WHERE callee IS NOT NULL AND confidence >= 0.6 UNION SELECT parent_id, id FROM code_symbols WHERE kind = 'method'
UNION SELECT m.id, s.id FROM code_symbols m JOIN code_symbols s ON s.file_path = m.file_path WHERE m.kind = 'module' AND s.kind IN ('class', 'function')"""
)
def order_graph(spark, sf_dir):
    parsed, symbols = _code(spark, sf_dir)
    return graph.order_graph(symbols, resolve.call_edges(parsed, symbols), 0.6)


@query(f"WITH {_symbols_sql()}, {_ENTRY} SELECT s.id, e.id IS NOT NULL AS is_entrypoint, e.entry_kind FROM code_symbols s LEFT JOIN entry e ON e.id = s.id")
def entry_flags(spark, sf_dir):
    """All flags are cleared, then set for what is an entry point now."""
    parsed, symbols = _code(spark, sf_dir)
    old = symbols.select("id", F.lit(True).alias("is_entrypoint"), F.lit("old").alias("entry_kind"))
    return graph.flagged(old, resolve.entry_points(parsed, symbols))


@query(f"WITH {GRAPH_SQL}, t AS (SELECT * FROM edges WHERE confidence >= 0.6), v AS (SELECT caller AS id FROM t UNION SELECT callee FROM t) SELECT id, (SELECT count(*) FROM w WHERE caller = id AND weight >= 0.6) AS out_degree, round(coalesce((SELECT sum(weight) FROM w WHERE caller = id AND weight >= 0.6), 0), 6) AS out_weight FROM v")
def digraph(spark, sf_dir):
    """Vertices of the graph at the threshold with what leaves them; a caller of externals only stays."""
    vertices, edges = graph.digraph(call_graph(spark, sf_dir), 0.6)
    out = edges.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("out_weight"))
    return vertices.join(out, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.round(F.coalesce("out_weight", F.lit(0.0)), 6).alias("out_weight"))


@query(f"WITH {GRAPH_SQL} SELECT caller, callee, line, confidence, c.p_name AS caller_name, c.p_brand || ':' || line AS location, d.p_name AS callee_name FROM edges JOIN part c ON c.p_partkey = caller LEFT JOIN part d ON d.p_partkey = callee WHERE confidence >= 0.6")
def call_locations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("qualname"), F.col("p_brand").alias("file_path"))
    return graph.located(call_graph(spark, sf_dir).filter("confidence >= 0.6"), p).select("caller", "callee", "line", "confidence", F.col("caller_qualname").alias("caller_name"), "location", F.col("callee_qualname").alias("callee_name"))


@query(f"WITH {GRAPH_SQL} SELECT p_partkey AS id, (SELECT count(DISTINCT caller) FROM edges WHERE callee = p_partkey AND confidence >= 0.6) AS fan_in, (SELECT count(DISTINCT callee) FROM edges WHERE caller = p_partkey AND confidence >= 0.6) AS fan_out FROM part")
def fan_counts(spark, sf_dir):
    fans = graph.fans(call_graph(spark, sf_dir), 0.6)
    return parts(spark, sf_dir).join(fans, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _ranks_sql(vertices: str, edges: str, rounds: int) -> str:
    """pr: id, rank after so many rounds over edges (caller, callee, weight)."""
    steps = [f"v AS MATERIALIZED ({vertices}), g AS MATERIALIZED ({edges}), sh AS MATERIALIZED (SELECT g.caller, g.callee, weight / t AS share FROM g JOIN (SELECT caller, sum(weight) AS t FROM g GROUP BY 1) x ON x.caller = g.caller), k0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for k in range(1, rounds + 1):
        steps.append(f"k{k} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM k{k - 1} WHERE id NOT IN (SELECT caller FROM sh)) / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v LEFT JOIN (SELECT callee, sum(rank * share) AS s FROM k{k - 1} JOIN sh ON caller = id GROUP BY callee) x ON x.callee = v.id)")
    return ", ".join([*steps, f"pr AS (SELECT id, round(rank, 9) AS rank FROM k{rounds})"])


@query(f"WITH {GRAPH_SQL}, {_ranks_sql('SELECT p_partkey AS id FROM part', 'SELECT caller, callee, weight FROM w', 6)} SELECT p_brand AS file, max(rank) AS max_rank FROM pr JOIN part ON p_partkey = id GROUP BY 1")
def file_rank(spark, sf_dir):
    ranks = graph.pagerank(parts(spark, sf_dir), call_graph(spark, sf_dir), 6)
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return ranks.join(files, "id").groupBy("file").agg(F.round(F.max("rank"), 9).alias("max_rank"))


_ORDER_SQL = f"""WITH RECURSIVE {NATION_SQL},
up AS (SELECT DISTINCT a.component AS a, b.component AS b FROM edges JOIN scc a ON a.id = caller JOIN scc b ON b.id = callee WHERE a.component <> b.component),
way(a, n) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT up.a, way.n + 1 FROM way JOIN up ON up.b = way.a),
lay AS (SELECT a AS component, max(n) AS layer FROM way GROUP BY 1),
{_ranks_sql("SELECT n_nationkey AS id FROM nation", "SELECT caller, callee, confidence AS weight FROM edges", 8)},
hit AS (SELECT DISTINCT node AS id FROM reach WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)),
fr AS (SELECT n_regionkey AS file, max(rank) AS file_rank FROM pr JOIN nation ON n_nationkey = id GROUP BY 1),
num AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS k FROM (SELECT DISTINCT component FROM scc)),
o AS (SELECT 'scc-' || k AS scc_id, s.component, max(layer) AS layer, bool_or(h.id IS NOT NULL) AS reachable, max(file_rank) AS file_rank, min('region' || n_regionkey) AS path, count(*) AS members
FROM scc s JOIN num ON num.component = s.component JOIN lay ON lay.component = s.component JOIN nation ON n_nationkey = s.id JOIN fr ON fr.file = n_regionkey LEFT JOIN hit h ON h.id = s.id GROUP BY 1, 2)"""


def _order(spark, sf_dir):
    v, e = nations(spark, sf_dir), kept(nation_graph(spark, sf_dir))
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("region"), "n_regionkey").alias("file"))
    roots = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("id"))
    return v, e, files, roots


@query(_ORDER_SQL + " SELECT row_number() OVER (ORDER BY layer, reachable DESC, file_rank DESC, path, scc_id) AS position, scc_id, component, CAST(layer AS INTEGER) AS layer, reachable, members FROM o")
def processing_order(spark, sf_dir):
    """Callees before callers: by layer, what entry points reach first, then by the rank of the file."""
    v, e, files, roots = _order(spark, sf_dir)
    return graph.processing_order(v, e, files, roots, 8).select("position", "scc_id", "component", "layer", "reachable", "members")


@query(_ORDER_SQL + " SELECT s.id, pr.rank AS pagerank, o.scc_id, CAST(o.layer AS INTEGER) AS layer FROM scc s JOIN o ON o.component = s.component JOIN pr ON pr.id = s.id UNION ALL SELECT -1, 0.0, NULL, NULL")
def graph_metrics(spark, sf_dir):
    """Rank, component and layer written back to every symbol; one outside the graph has rank 0."""
    v, e, files, roots = _order(spark, sf_dir)
    order = graph.processing_order(v, e, files, roots, 8)
    symbols = v.union(spark.createDataFrame([(-1,)], "id int"))
    return graph.with_metrics(symbols, graph.pagerank(v, e, 8), graph.components_strong(v, e), order)


def _labels_sql(rounds: int) -> str:
    steps = ["u AS MATERIALIZED (SELECT a, b, sum(weight) AS weight FROM (SELECT caller AS a, callee AS b, weight FROM w WHERE caller <> callee UNION ALL SELECT callee, caller, weight FROM w WHERE caller <> callee) GROUP BY 1, 2), l0 AS (SELECT p_partkey AS id, p_partkey AS label FROM part)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} AS MATERIALIZED (SELECT l.id, coalesce(n.label, l.label) AS label FROM l{k - 1} l LEFT JOIN (SELECT a, label FROM (SELECT u.a, x.label, row_number() OVER (PARTITION BY u.a ORDER BY round(sum(u.weight), 6) DESC, x.label) AS n FROM u JOIN l{k - 1} x ON x.id = u.b GROUP BY 1, 2) WHERE n = 1) n ON n.a = l.id)")
    return f"WITH {GRAPH_SQL}, {', '.join(steps)} SELECT id, label AS community FROM l{rounds}"


@query(_labels_sql(4))
def communities(spark, sf_dir):
    return graph.communities(parts(spark, sf_dir), call_graph(spark, sf_dir), 4)
