"""Queries of retrieval views, scopes, path evidence and answers without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, retrieval, search
from codeloom.plans.catalog import GRAPH_SQL, call_graph, parts, query, table
from codeloom.sources import models
from codeloom.sources.shared import dealt


@query(
    """WITH s AS (SELECT p_partkey AS id, p_brand || '.py' || chr(10) || p_name || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'about ' || p_type ELSE '' END AS x FROM part),
t AS (SELECT id, x, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT id, x, regexp_extract_all(x, '[A-Z]+[A-Z]|[A-Z]?[a-z]+|\\d+|[A-Z]') AS w FROM s)), f AS (SELECT id, x, lower(word) AS word, min(i) AS i FROM t GROUP BY 1, 2, 3)
SELECT id, lower(x) || chr(10) || string_agg(word, ' ' ORDER BY i) AS search_text FROM f GROUP BY 1, x"""
)
def lexical_view(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".py")).alias("file_path"), F.col("p_name").alias("qualname"), F.lit("").alias("docstring"), F.lit(None).cast("string").alias("raw_code"))
    shown = p.filter("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("about "), "p_type").alias("summary"))
    return retrieval.lexical_view(symbols, shown)


_FOUND = "SELECT l_orderkey AS query_id, l_partkey AS id, round(max(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2"


@query(
    f"""WITH found AS ({_FOUND}), named AS (SELECT o_orderkey AS query_id, 'm/b' || (o_orderkey % 30) || '.py' AS file FROM orders WHERE o_orderkey % 50 = 0),
sym AS (SELECT p_partkey AS id, 'm/b' || (p_partkey % 25) || '.py' AS file, p_size AS start_line FROM part), hit AS (SELECT n.* FROM named n WHERE file IN (SELECT file FROM sym)),
u AS (SELECT h.query_id, s.id, coalesce(f.score, 0.0) AS score, s.start_line FROM hit h JOIN sym s ON s.file = h.file LEFT JOIN found f ON f.query_id = h.query_id AND f.id = s.id UNION ALL SELECT query_id, id, score, 0 FROM found WHERE query_id NOT IN (SELECT query_id FROM hit))
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, start_line, id) AS rank FROM u) WHERE rank <= 5"""
)
def module_scope(spark, sf_dir):
    """Orders as questions; every fiftieth names a module, whose own symbols then replace what was found."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    text = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("what is in m.b"), F.col("o_orderkey") % 30, F.lit("?"))).otherwise("what is it?")
    found = dealt(li.select("l_orderkey", "l_partkey", "l_discount"), li.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.round(F.max("l_discount"), 6).alias("score"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("m/b"), F.col("p_partkey") % 25, F.lit(".py")).alias("file_path"), F.col("p_size").alias("start_line"))
    return retrieval.scoped(o.select(F.col("o_orderkey").alias("query_id"), text.alias("text")), found, symbols, 5)


@query("SELECT s_suppkey AS query_id, 'pkg.s' || s_suppkey AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'the writer' ELSE 'n' || s_nationkey END AS target FROM supplier WHERE s_suppkey % 4 <> 3")
def path_questions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    target = F.when(F.col("s_suppkey") % 3 == 0, "the writer").otherwise(F.concat(F.lit("n"), "s_nationkey"))
    verb = F.element_at(F.array(F.lit("trace "), F.lit("Path from "), F.lit("  flow "), F.lit("explain ")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return retrieval.endpoints(s.select(F.col("s_suppkey").alias("query_id"), F.concat(verb, F.lit("`pkg.s"), "s_suppkey", F.lit("` to "), target, F.lit("?")).alias("text")))


_REACH = "WITH RECURSIVE " + GRAPH_SQL + """, walk(source, id, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT k.source, w.callee, k.hops + 1 FROM walk k JOIN w ON w.caller = k.id AND w.weight >= 0.6 WHERE k.hops < 3), reach AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)"""
_VERBS = ["write", "get", "send", "sign", "persist", "read", "email", "issue"]


def _inferred_sql() -> str:
    verb = "[" + ", ".join(f"'{v}'" for v in _VERBS) + "]"
    group = "CASE WHEN v IN ('write', 'persist') THEN 0 WHEN v IN ('get', 'read') THEN 1 WHEN v IN ('send', 'email') THEN 2 ELSE 3 END"
    return f"""{_REACH}, named AS (SELECT p_partkey AS id, {verb}[p_partkey % 8 + 1] AS v, {verb}[p_size % 8 + 1] AS d FROM part),
g AS (SELECT id, {group} AS gn, {group.replace("v IN", "d IN")} AS gd FROM named), m AS (SELECT r.source AS query_id, r.id, r.hops, CASE WHEN g.gn = r.source % 4 THEN 2 WHEN g.gd = r.source % 4 THEN 1 ELSE 0 END AS score FROM reach r JOIN g ON g.id = r.id WHERE r.id <> r.source),
b AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC, hops DESC) AS k FROM m WHERE score > 0)
SELECT query_id, CASE WHEN count(*) = 1 THEN min(id) END AS target, count(*) AS tied FROM b WHERE k = 1 GROUP BY 1"""


@query(_inferred_sql())
def inferred_targets(spark, sf_dir):
    """What `the step that writes it` means for each part: among what it reaches, by verbs in names, then in docs."""
    p = table(spark, sf_dir, "part")
    verbs = F.array(*map(F.lit, _VERBS))
    edges = call_graph(spark, sf_dir)
    reach = graph.impact(parts(spark, sf_dir), graph.reversed_edges(edges), 3, 0.6).select(F.col("seed").alias("source"), F.col("node").alias("id"), F.col("min_depth").alias("hops"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("source"), F.concat(F.lit("the step that does "), F.element_at(F.array(*map(F.lit, ("store", "find", "deliver", "signing"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("phrase"))
    names = p.select(F.col("p_partkey").alias("id"), F.concat(F.element_at(verbs, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("_rows")).alias("name"), F.concat(F.lit("Will "), F.element_at(verbs, (F.col("p_size") % 8 + 1).cast("int")), F.lit(" all.")).alias("doc"))
    candidates = reach.select(F.col("source").alias("query_id"), "id").join(names, "id")
    return retrieval.inferred_targets(asked, candidates, reach)


@query(
    f"""WITH {GRAPH_SQL}, ends AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END AS source, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey + 1 END AS target, p_partkey % 35 = 14 AS tied FROM part),
lex AS (SELECT query_id, id, rank FROM (SELECT p_partkey AS query_id, unnest([p_partkey, p_partkey + 10, p_partkey + 20]) AS id, unnest([1, 2, 3]) AS rank FROM part)),
e AS (SELECT e.*, w.weight IS NOT NULL AS found, CASE WHEN tied THEN 'ambiguous_source' WHEN source IS NULL THEN 'unresolved_source' WHEN target IS NULL THEN 'unresolved_target' WHEN w.weight IS NULL THEN 'no_path' WHEN query_id % 2 = 0 THEN 'inferred_path' ELSE 'explicit_path' END AS status FROM ends e LEFT JOIN w ON w.caller = e.source AND w.callee = e.target),
rr AS (SELECT query_id, status, 0 AS part, 1 AS place, source AS id, 'graph_path' AS retrieval_source, true AS p FROM e WHERE found AND NOT tied UNION ALL SELECT query_id, status, 0, 2, target, 'graph_path', true FROM e WHERE found AND NOT tied
UNION ALL SELECT l.query_id, e.status, 1, l.rank, l.id, 'lexical', found FROM lex l JOIN e ON e.query_id = l.query_id WHERE NOT (found AND NOT tied AND l.id IN (source, target)))
SELECT query_id, rank, id, retrieval_source, status, false AS requires_batching FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS rank FROM rr) WHERE rank <= 3"""
)
def path_evidence(spark, sf_dir):
    """Path questions between neighbours: the path's blocks first, then the lexical list up to three blocks."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"))
    k = F.col("query_id")
    ends = p.select("query_id", F.when(k % 7 != 0, k).alias("source"), F.when(k % 5 != 0, k + 1).alias("target"), (k % 2 == 0).alias("inferred"), F.when(k % 35 == 14, 2).otherwise(0).alias("source_tied"), F.lit(0).alias("target_tied"))
    paths = graph.weighted(call_graph(spark, sf_dir)).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.array("caller", "callee").alias("path"))
    lexical = p.select("query_id", F.posexplode(F.array(k, k + 10, k + 20)).alias("at", "id")).select("query_id", "id", (F.col("at") + 1).alias("rank"))
    return retrieval.path_evidence(ends, paths, lexical, 3)


_TOP = "f AS (SELECT p_partkey AS query_id, unnest([p_partkey, p_partkey + 3, p_partkey + 6, p_partkey + 9]) AS id, unnest([1, 2, 3, 4]) AS rank FROM part)"


def _top(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("query_id"), F.posexplode(F.array(k, k + 3, k + 6, k + 9)).alias("at", "id"))
    return rows.select("query_id", "id", (F.col("at") + 1).alias("rank"))


@query(
    f"""WITH {GRAPH_SQL}, {_TOP}, b AS (SELECT caller AS id, callee AS near, 0 AS way FROM w WHERE weight >= 0.6 UNION ALL SELECT callee, caller, 1 FROM w WHERE weight >= 0.6),
m AS (SELECT query_id, near AS id, min(row(rank, way, near)) AS pl FROM f JOIN b ON b.id = f.id WHERE rank <= 3 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.query_id = f.query_id AND x.id = b.near) GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, pl) AS rank FROM (SELECT query_id, id, 0 AS part, row(rank, 0, id) AS pl FROM f UNION ALL SELECT query_id, id, 1, pl FROM m)"""
)
def graph_expansion(spark, sf_dir):
    return retrieval.expanded(_top(spark, sf_dir), call_graph(spark, sf_dir), 0.6, 3)


@query(f"WITH {_TOP} SELECT query_id, id, CAST(CASE WHEN query_id % 2 = 0 THEN 5 - rank ELSE rank END AS INTEGER) AS rank FROM f")
def reranked(spark, sf_dir):
    """A model turns the lists around; for odd queries it makes an id up and is not heard."""
    found = _top(spark, sf_dir)
    k = F.col("query_id")
    answers = found.select("query_id").distinct().select("query_id", F.when(k % 2 == 0, F.array(k + 9, k + 6, k + 3, k)).otherwise(F.array(k, k + 3, k + 6, F.lit(-1).cast("long"))).alias("ids"))
    return retrieval.reranked(found, answers)


@query(
    f"""WITH {GRAPH_SQL}, rr AS (SELECT callee AS target, '- ' || p_name || ' [' || p_brand || ':' || p_size || '-' || (p_size + 5) || ']; call-site ' || p_brand || ':' || line AS text, caller FROM edges JOIN part ON p_partkey = caller WHERE confidence >= 0.6)
SELECT p_partkey AS target, '{retrieval.NOTE}' || chr(10) || 'Graph query: callers. Confidence >= 0.6.' || chr(10) || coalesce((SELECT string_agg(text, chr(10) ORDER BY caller) FROM rr WHERE target = p_partkey), 'No matching results within the limits.') AS answer FROM part"""
)
def structural_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = call_graph(spark, sf_dir).filter("confidence >= 0.6")
    own = p.select(F.col("p_partkey").alias("caller"), F.col("p_name").alias("name"), F.expr("'[' || p_brand || ':' || p_size || '-' || (p_size + 5) || ']'").alias("cite"), "p_brand")
    rows = e.join(own, "caller").select(F.col("callee").alias("target"), F.col("caller").alias("position"), "name", "cite", F.concat("p_brand", F.lit(":"), F.col("line")).alias("line"))
    return retrieval.structural_text(rows, "callers", 0.6, p.select(F.col("p_partkey").alias("target")))


_HEX = "CAST('0x' || substr(sha256(x), {0} * 4 + 1, 4) AS BIGINT) / 65535.0::DOUBLE"


@query(
    "WITH t AS (SELECT doc_id, substr(text, 1, 200) AS x FROM documents), h AS (SELECT doc_id, sha256(x) AS hash, x FROM t) SELECT doc_id AS unit_id, hash, CASE WHEN hash IN (SELECT hash FROM h WHERE doc_id % 4 = 0) THEN 'cached' ELSE 'embedded' END AS how, round("
    + _HEX.format(0) + ", 6) AS v0, round(" + _HEX.format(7) + ", 6) AS v7 FROM h"
)
def dense_view(spark, sf_dir):
    """The dense view by content: what the cache has isn't embedded again, and equal texts are embedded once."""
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.substring("text", 1, 200).alias("text"))
    embed = lambda rows: models.embedded(rows, models.HashEmbedder(8))
    cache = embed(units.filter("unit_id % 4 = 0").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"]))
    keys, fresh = retrieval.dense_view(units, cache, embed)
    every = cache.select("hash", "vector", F.lit("cached").alias("how")).unionByName(fresh.select("hash", "vector", F.lit("embedded").alias("how")))
    return keys.join(every, "hash").select("unit_id", "hash", "how", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[7], 6).alias("v7"))


@query(
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 10), u AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id >= 10 AND vec_id < 60)
SELECT q.vec_id AS query_id, u.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 9), u.vec_id) AS rank FROM q, u"""
)
def ranking_matrix(spark, sf_dir):
    """The bench's whole ranking of 50 units for 10 queries."""
    e = table(spark, sf_dir, "embeddings")
    take = lambda a, b: e.filter((F.col("vec_id") >= a) & (F.col("vec_id") < b)).orderBy("vec_id").collect()
    q, u = take(0, 10), take(10, 60)
    order = retrieval.ranking_matrix([r["embedding"] for r in q], [r["embedding"] for r in u])
    return spark.createDataFrame([(q[i]["vec_id"], u[j]["vec_id"], k) for i, row in enumerate(order) for k, j in enumerate(row, 1)], "query_id long, id long, rank long")


@query(f"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM conversations")
def posting_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    counted = search.postings(c, "text").groupBy("id").agg(F.sum("tf").alias("n"))
    return c.select("id").join(counted, "id", "left").select("id.*", F.coalesce("n", F.lit(0)).alias("n_words"))


