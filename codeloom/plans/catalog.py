"""Every query of the engine by name, with SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import budget, evaluation, graph, incremental, search, verify
from codeloom.sources.shared import dealt, ensure_checkpoints

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A call graph from the tables: parts call the parts that most often follow them in an order, at most two each.
GRAPH_SQL = """
p AS (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee FROM lineitem),
c AS (SELECT caller, callee, count(*) AS n FROM p WHERE callee IS NOT NULL GROUP BY 1, 2),
r AS (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY n DESC, callee) AS line FROM c),
edges AS (SELECT caller, callee, line, CASE WHEN line = 1 THEN 0.9 WHEN caller % 2 = 0 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM r WHERE line <= 2),
w AS (SELECT caller, callee, max(confidence) AS weight FROM edges GROUP BY 1, 2)"""


def ranked_calls(spark, sf_dir: str) -> DataFrame:
    """The whole call graph: every pair of a part and one that follows it, with its place by frequency as line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.count()
    pairs = dealt(li, rows, "l_orderkey").select(F.col("l_partkey").alias("caller"), nxt.alias("callee")).filter("callee IS NOT NULL")
    pairs = dealt(pairs, rows, "caller").groupBy("caller", "callee").count()
    line = F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("count"), "callee"))
    confidence = F.when(F.col("line") == 1, 0.9).when(F.col("caller") % 2 == 0, 0.7).otherwise(0.4)
    return pairs.withColumn("line", line).select("caller", "callee", "line", confidence.alias("confidence"))


def call_graph(spark, sf_dir: str) -> DataFrame:
    """The graph of GRAPH_SQL, with at most two callees a part; the queries of whole_graph have no such bound."""
    return ranked_calls(spark, sf_dir).filter("line <= 2")


def parts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def _reach_sql(depth: int, least: float) -> str:
    return f"""
WITH RECURSIVE {GRAPH_SQL},
walk(seed, depth, callee, path) AS (
  SELECT p_partkey, 1, e.callee, [p_partkey, e.callee] FROM part JOIN edges e ON e.caller = p_partkey AND e.confidence >= {least}
  UNION ALL
  SELECT k.seed, k.depth + 1, e.callee, list_append(k.path, e.callee) FROM walk k JOIN edges e ON e.caller = k.callee AND e.confidence >= {least}
  WHERE k.depth < {depth} AND NOT list_contains(k.path, e.callee))"""


@query("WITH " + GRAPH_SQL.strip() + " SELECT caller, callee, weight FROM w WHERE weight >= 0.6")
def graph_edges(spark, sf_dir):
    return graph.weighted(call_graph(spark, sf_dir), 0.6)


@query(_reach_sql(3, 0.6) + " SELECT seed, callee AS node, min(depth) AS min_depth, count(*) AS n_paths FROM walk GROUP BY 1, 2")
def callees_depth3(spark, sf_dir):
    return graph.reached(parts(spark, sf_dir), call_graph(spark, sf_dir), 3, 0.6)


@query(
    f"""
WITH RECURSIVE {GRAPH_SQL},
walk(seed, depth, caller, path) AS (
  SELECT p_partkey, 1, e.caller, [p_partkey, e.caller] FROM part JOIN edges e ON e.callee = p_partkey AND e.confidence >= 0.6
  UNION ALL
  SELECT k.seed, k.depth + 1, e.caller, list_append(k.path, e.caller) FROM walk k JOIN edges e ON e.callee = k.caller AND e.confidence >= 0.6
  WHERE k.depth < 2 AND NOT list_contains(k.path, e.caller))
SELECT seed, caller AS node, min(depth) AS min_depth, count(*) AS n_paths FROM walk GROUP BY 1, 2"""
)
def callers_depth2(spark, sf_dir):
    return graph.reached(parts(spark, sf_dir), graph.reversed_edges(call_graph(spark, sf_dir)), 2, 0.6)


@query(
    f"""
WITH RECURSIVE {GRAPH_SQL},
pairs AS (SELECT p_partkey AS source, p_partkey + 1 AS target FROM part),
walk(source, target, here, path) AS (
  SELECT source, target, source, [source] FROM pairs
  UNION ALL
  SELECT k.source, k.target, w.callee, list_append(k.path, w.callee) FROM walk k JOIN w ON w.caller = k.here
  WHERE len(k.path) <= 5 AND k.here <> k.target AND NOT list_contains(k.path, w.callee)),
best AS (SELECT source, target, path, row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS n FROM walk WHERE here = target)
SELECT p.source, p.target, CAST(len(b.path) - 1 AS INTEGER) AS hops, array_to_string(b.path, '>') AS path
FROM pairs p LEFT JOIN best b ON b.source = p.source AND b.target = p.target AND b.n = 1"""
)
def shortest_path(spark, sf_dir):
    _checkpoints(spark)
    pairs = parts(spark, sf_dir).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return graph.shortest_paths(pairs, call_graph(spark, sf_dir), 5)


@query(
    f"""
WITH {GRAPH_SQL},
t AS (SELECT caller, callee FROM w WHERE weight >= 0.6),
d1 AS (SELECT DISTINCT callee AS seed, caller AS node FROM t WHERE caller <> callee),
d2 AS (SELECT DISTINCT d.seed, t.caller AS node FROM d1 d JOIN t ON t.callee = d.node WHERE t.caller <> d.seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d.seed AND x.node = t.caller)),
a AS (SELECT seed, node, 1 AS min_depth FROM d1 UNION ALL SELECT seed, node, 2 FROM d2)
SELECT seed, min_depth, p_brand AS file, count(*) AS members, min(node) AS first_member FROM a JOIN part ON p_partkey = node
WHERE seed IN (SELECT p_partkey FROM part) GROUP BY 1, 2, 3"""
)
def impact_groups(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return graph.impact_groups(files.select("id"), call_graph(spark, sf_dir), files, 2, 0.6)


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT p_partkey AS id, 1.0::DOUBLE / (SELECT count(*) FROM part) AS rank FROM part)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT p_partkey AS id, 0.15::DOUBLE / (SELECT count(*) FROM part) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT caller FROM sh)) / (SELECT count(*) FROM part) + 0.85::DOUBLE * coalesce(s, 0) AS rank "
            f"FROM part LEFT JOIN (SELECT callee, sum(rank * share) AS s FROM r{k - 1} JOIN sh ON caller = id GROUP BY callee) g ON g.callee = p_partkey)"
        )
    return f"WITH {GRAPH_SQL}, sh AS (SELECT w.caller, w.callee, weight / t AS share FROM w JOIN (SELECT caller, sum(weight) AS t FROM w GROUP BY 1) x ON x.caller = w.caller), " + ", ".join(steps)


@query(
    _pagerank_sql(8)
    + """, top AS (SELECT id, round(rank, 9) AS rank FROM r8 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT id, rank, (SELECT count(*) FROM w WHERE callee = id AND weight >= 0.6) AS fan_in, (SELECT count(*) FROM w WHERE caller = id AND weight >= 0.6) AS fan_out FROM top"""
)
def hubs(spark, sf_dir):
    return graph.hubs(parts(spark, sf_dir), call_graph(spark, sf_dir), 10, 0.6, 8)


@query(f"WITH {GRAPH_SQL} SELECT p_partkey AS id, p_brand AS file FROM part WHERE NOT EXISTS (SELECT 1 FROM w WHERE callee = p_partkey AND weight >= 0.6)")
def dead_candidates(spark, sf_dir):
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return graph.dead(vertices, call_graph(spark, sf_dir), 0.6)


@query(
    f"""
WITH RECURSIVE {GRAPH_SQL},
walk(seed, depth, node, way, place, recursive) AS (
  SELECT p_partkey, 0, p_partkey, [p_partkey], CAST([] AS BIGINT[]), false FROM part
  UNION ALL
  SELECT k.seed, k.depth + 1, e.callee, list_append(k.way, e.callee), list_append(k.place, e.line), list_contains(k.way, e.callee)
  FROM walk k JOIN edges e ON e.caller = k.node AND e.confidence >= 0.6 WHERE k.depth < 3 AND NOT k.recursive)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY place, node) AS position, depth, node, recursive FROM walk"""
)
def trace_preorder(spark, sf_dir):
    return graph.trace(parts(spark, sf_dir), call_graph(spark, sf_dir), 3, 0.6)


NATION_SQL = """
f AS (SELECT s_nationkey AS caller, c_nationkey AS callee, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
edges AS (SELECT caller, callee, 0.9 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY n DESC, callee) AS k FROM f) WHERE k = 1),
reach(source, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.source, e.callee FROM reach r JOIN edges e ON e.caller = r.node),
scc AS (SELECT a.source AS id, min(a.node) AS component FROM reach a JOIN reach b ON a.node = b.source AND a.source = b.node GROUP BY 1)"""


def nation_graph(spark, sf_dir) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    flows = flows.groupBy(F.col("s_nationkey").alias("caller"), F.col("c_nationkey").alias("callee")).count()
    first = F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("count"), "callee"))
    return flows.withColumn("k", first).filter("k = 1").select("caller", "callee", F.lit(0.9).alias("confidence"))


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))


_checkpoints = ensure_checkpoints


@query(f"WITH RECURSIVE {NATION_SQL} SELECT id, component FROM scc")
def strong_components(spark, sf_dir):
    _checkpoints(spark)
    return graph.components_strong(nations(spark, sf_dir), nation_graph(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {NATION_SQL},
up AS (SELECT DISTINCT a.component AS a, b.component AS b FROM edges JOIN scc a ON a.id = caller JOIN scc b ON b.id = callee WHERE a.component <> b.component),
way(a, n) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT up.a, way.n + 1 FROM way JOIN up ON up.b = way.a)
SELECT id, component, (SELECT max(n) FROM way WHERE a = component) AS layer FROM scc"""
)
def graph_layers(spark, sf_dir):
    _checkpoints(spark)
    return graph.layers(nations(spark, sf_dir), nation_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {NATION_SQL} SELECT DISTINCT node AS id FROM reach WHERE source IN (SELECT caller FROM edges JOIN nation ON n_nationkey = caller WHERE n_regionkey = 0) AND (node, true) IN (SELECT e.callee, true FROM reach r JOIN edges e ON e.caller = r.node WHERE r.source IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))")
def entry_descendants(spark, sf_dir):
    _checkpoints(spark)
    roots = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("id"))
    return graph.descendants(roots, nation_graph(spark, sf_dir))


# ---- text and hashes


@query(
    """
WITH t AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT p_partkey, regexp_extract_all(p_name || '_' || p_brand || '_' || p_type, '[A-Z]+[A-Z]|[A-Z]?[a-z]+|\\d+|[A-Z]') AS w FROM part)),
f AS (SELECT p_partkey, lower(word) AS word, min(i) AS i FROM t GROUP BY 1, 2)
SELECT p_partkey, string_agg(word, ' ' ORDER BY i) AS tokens FROM f GROUP BY 1"""
)
def identifier_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(T.split_identifiers(F.concat_ws("_", "p_name", "p_brand", "p_type")), " ").alias("tokens"))


@query(
    """
WITH s AS (SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS x FROM part),
t AS (SELECT p_partkey, x, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT p_partkey, x, regexp_extract_all(x, '[A-Z]+[A-Z]|[A-Z]?[a-z]+|\\d+|[A-Z]') AS w FROM s)),
f AS (SELECT p_partkey, x, lower(word) AS word, min(i) AS i FROM t GROUP BY 1, 2, 3)
SELECT p_partkey, lower(x) || chr(10) || string_agg(word, ' ' ORDER BY i) AS search_text FROM f GROUP BY 1, x"""
)
def search_text_build(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.search_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("search_text"))


@query("SELECT doc_id, sha256(text) AS text_hash, sha256(lang || chr(31) || source || chr(31) || text) AS joined_hash FROM documents")
def fingerprint_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("text_hash"), T.join_hash(F.col("lang"), F.col("source"), F.col("text")).alias("joined_hash"))


@query("SELECT lang, sha256(string_agg(h, chr(31) ORDER BY h)) AS member_hash FROM (SELECT lang, sha256(text) AS h FROM documents) GROUP BY 1")
def member_hashes(spark, sf_dir):
    """A group's hash is over its sorted members, so the members of a group are gathered; groups are files or modules."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return d.groupBy("lang").agg(T.member_hash(F.collect_list("h")).alias("member_hash"))


@query("SELECT doc_id, (length(text) + 3) // 4 AS by_quarter, CAST(ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) AS BIGINT) AS by_ratio FROM documents")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.tokens_by_quarter(F.col("text")).alias("by_quarter"), T.tokens_by_ratio(F.col("text")).alias("by_ratio"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 98) || ' ... ' || right(text, 97) END AS cut FROM documents")
def head_tail_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.head_tail(F.col("text"), 200).alias("cut"))


@query(
    """
SELECT page_id, length(html) AS n_chars,
  CASE WHEN len(string_split(html, chr(10))) = 0 OR html = '' THEN false ELSE length(html) / len(string_split(html, chr(10)))::DOUBLE > 1000 END AS minified,
  octet_length(encode(html)) > 5000 AS too_large, regexp_matches(lower(url), '\\.(pem|key|env)$') AS secret,
  CASE WHEN regexp_matches(lower(url), '\\.py$') THEN 'python' WHEN regexp_matches(lower(url), '\\.(toml|ya?ml|json|ini|cfg|conf)$') THEN 'config' ELSE 'other' END AS language
FROM pages"""
)
def file_filters(spark, sf_dir):
    from codeloom.sources import files

    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.char_length("html").alias("n_chars"), files.is_minified(F.col("html")).alias("minified"), (F.octet_length("html") > 5000).alias("too_large"), files.is_secret(F.col("url")).alias("secret"), files.language_of(F.col("url")).alias("language"))


# ---- retrieval

_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x))"


def _lexical_sql(queries: str, units: str, k: int) -> str:
    return f"""
lq AS (SELECT query_id, {_TERMS.format("text")} AS terms FROM ({queries})),
lt AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM lq),
lp AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({units})) GROUP BY 1, 2),
ls AS (SELECT query_id, id, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) * 0.1::DOUBLE / 1.64493::DOUBLE) / max(n), 6) AS score FROM lt JOIN lp ON lp.term = lt.term GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ls) WHERE rank <= {k})"""


def _grams_sql(name: str, key: str, src: str) -> str:
    return f"""{name} AS (SELECT {key}, name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM ({src}))"""


def _trigram_sql(queries: str, units: str, k: int) -> str:
    return f"""
{_grams_sql("tq", "query_id", queries)},
{_grams_sql("tu", "id", units)},
ts AS (SELECT query_id, id, round(len(list_intersect(q.g, u.g)) / (len(q.g) + len(u.g) - len(list_intersect(q.g, u.g)))::DOUBLE, 6) AS score FROM tq q, tu u),
tri AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ts WHERE score >= 0.3) WHERE rank <= {k})"""


_PART_Q = "SELECT p_partkey AS query_id, p_name AS name, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % 20 = 0"
_PART_U = "SELECT min(p_partkey) AS id, p_name AS name, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part GROUP BY p_name, p_type, p_brand"
_NAME_U = "SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name"


def _part_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    u = p.groupBy("p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return q, u, p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query(f"WITH {_lexical_sql('SELECT item_id AS query_id, text FROM benchmark', 'SELECT doc_id AS id, text FROM documents', 10)} SELECT query_id, id, score, rank FROM lex")
def lexical_rank_or(spark, sf_dir):
    return search.lexical_topk(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 10)


@query(f"WITH {_trigram_sql(_PART_Q, _NAME_U, 5)} SELECT query_id, id, score, rank FROM tri")
def trigram_topk(spark, sf_dir):
    q, _, names = _part_search(spark, sf_dir)
    return search.trigram_topk(q, names, 5)


@query(
    f"WITH {_lexical_sql(_PART_Q, _PART_U, 20)}, {_trigram_sql(_PART_Q, _NAME_U, 20)}, fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / rank), 6) AS score FROM (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM tri) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 5"
)
def lexical_fusion(spark, sf_dir):
    q, u, names = _part_search(spark, sf_dir)
    return search.fused(search.lexical_topk(q, u, 20), search.trigram_topk(q, names, 20), k=5)


def _dense_sql(name: str, distance: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query_id, u.vec_id AS id, round({distance}(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings u WHERE q.vec_id % 20 = 0)) WHERE rank <= {k})"""


def _dense(spark, sf_dir, k, metric):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.dense_topk(e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), e, k, metric)


@query(f"WITH {_dense_sql('c', 'list_cosine_distance', 5)} SELECT query_id, id, distance, rank FROM c")
def dense_topk_cosine(spark, sf_dir):
    return _dense(spark, sf_dir, 5, "cosine")


@query(f"WITH {_dense_sql('c', 'list_distance', 5)} SELECT query_id, id, distance, rank FROM c")
def dense_topk_l2(spark, sf_dir):
    return _dense(spark, sf_dir, 5, "l2")


@query(
    f"WITH {_dense_sql('a', 'list_cosine_distance', 10)}, {_dense_sql('b', 'list_distance', 10)}, fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 5"
)
def rrf_hybrid(spark, sf_dir):
    return search.fused(_dense(spark, sf_dir, 10, "cosine"), _dense(spark, sf_dir, 10, "l2"), constant=60, k=5)


@query(f"WITH {_dense_sql('c', 'list_cosine_distance', 6)} SELECT q.label, round(avg(CASE WHEN u.label = q.label THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS recall, count(*) AS n FROM c JOIN embeddings q ON q.vec_id = query_id JOIN embeddings u ON u.vec_id = c.id WHERE query_id <> c.id GROUP BY 1")
def dense_label_recall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = _dense(spark, sf_dir, 6, "cosine").filter("query_id <> id")
    near = near.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
    return near.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("recall"), F.count("*").alias("n"))


_RUNG = "CASE WHEN CAST(id AS VARCHAR) = query THEN 0 WHEN qualname = query THEN 1 WHEN name = query THEN 2 WHEN ends_with(qualname, '.' || query) THEN 3 ELSE 4 END"
_NATION_NAMES = "SELECT n_nationkey AS id, r_name || '.' || n_name AS qualname, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey"


def _symbols(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.concat_ws(".", "r_name", "n_name").alias("qualname"), F.col("n_name").alias("name"))


@query(f"SELECT query, id, rung, row_number() OVER (PARTITION BY query ORDER BY rung, id) AS rank FROM (SELECT query, id, {_RUNG} AS rung FROM (SELECT DISTINCT n_name AS query FROM nation) q JOIN ({_NATION_NAMES}) s ON contains(lower(qualname), lower(query)))")
def ranked_name_lookup(spark, sf_dir):
    return search.name_lookup(table(spark, sf_dir, "nation").select(F.col("n_name").alias("query")), _symbols(spark, sf_dir))


_PART_NAMES = "SELECT p_partkey AS id, p_brand || '.' || p_name AS qualname, p_name AS name FROM part"


@query(
    f"""
WITH q AS (SELECT DISTINCT p_brand || '.' || p_name AS query FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT p_type FROM part),
m AS (SELECT query, rung, count(*) AS matches, min(id) AS id FROM (SELECT query, id, 1 AS rung FROM q JOIN ({_PART_NAMES}) s ON qualname = query UNION ALL SELECT query, id, 2 FROM q JOIN ({_PART_NAMES}) s ON name = query) GROUP BY 1, 2)
SELECT q.query, rung, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN id END AS id,
       CASE WHEN matches IS NULL THEN 'not found' WHEN matches > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM q LEFT JOIN m ON m.query = q.query"""
)
def symbol_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name").alias("qualname"), F.col("p_name").alias("name"))
    return search.resolve(s.select(F.col("qualname").alias("query")).union(s.select("name")).union(p.select("p_type")), s)


# ---- verification and evaluation

_SPANS = """
e AS (SELECT o_orderkey AS path, o_orderkey % 50 + 1 AS a, o_orderkey % 50 + 10 AS b FROM orders),
x AS (SELECT l_orderkey AS path, l_partkey % 60 + 1 AS a, l_partkey % 60 + 1 + CAST(floor(l_quantity) AS BIGINT) % 8 AS b, l_linenumber * 1000000 + l_partkey AS position FROM lineitem)"""


def _spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    e = o.select("path", (F.col("path") % 50 + 1).alias("a"), (F.col("path") % 50 + 10).alias("b"))
    li = table(spark, sf_dir, "lineitem")
    a = F.col("l_partkey") % 60 + 1
    x = li.select(F.col("l_orderkey").alias("path"), a.alias("a"), (a + F.col("l_quantity").cast("long") % 8).alias("b"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"))
    return o, e, x


@query(
    f"""WITH {_SPANS},
d AS (SELECT path, a, b, min(position) AS position FROM x GROUP BY 1, 2, 3),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position) AS n FROM d) WHERE n <= 5)
SELECT e.path, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.path = e.path AND f.a <= e.b AND e.a <= f.b) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM e"""
)
def overlap_recall(spark, sf_dir):
    return evaluation.span_recall(*_spans(spark, sf_dir))


@query(f"WITH {_SPANS} SELECT e.path, coalesce(round(sum(CASE WHEN x.a >= e.a AND x.b <= e.b THEN 1.0 ELSE 0.0 END::DOUBLE) / nullif(count(x.a), 0), 6), 0.0) AS validity FROM e LEFT JOIN x ON x.path = e.path GROUP BY 1")
def containment_validity(spark, sf_dir):
    o, e, x = _spans(spark, sf_dir)
    return evaluation.citation_validity(o, x.drop("position"), e)


_CITED = "SELECT e.*, lang || ' says so [' || source || '.py:' || CAST(1 + doc_id % 90 AS VARCHAR) || '-' || CAST(5 + doc_id % 97 AS VARCHAR) || '] and [' || lang || '.py:3-' || CAST(doc_id % 7 AS VARCHAR) || ']' AS t FROM documents e"


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = lambda c: c.cast("string")
    text = F.concat(F.col("lang"), F.lit(" says so ["), F.col("source"), F.lit(".py:"), n(1 + F.col("doc_id") % 90), F.lit("-"), n(5 + F.col("doc_id") % 97), F.lit("] and ["), F.col("lang"), F.lit(".py:3-"), n(F.col("doc_id") % 7), F.lit("]"))
    return d.select(F.col("doc_id").alias("answer_id"), text.alias("text"))


@query(f"WITH t AS ({_CITED}), c AS (SELECT doc_id, regexp_extract_all(t, '\\[([^\\[\\]:]+):(\\d+)-(\\d+)\\]', 1) AS p, regexp_extract_all(t, '\\[([^\\[\\]:]+):(\\d+)-(\\d+)\\]', 2) AS a, regexp_extract_all(t, '\\[([^\\[\\]:]+):(\\d+)-(\\d+)\\]', 3) AS b FROM t) SELECT doc_id AS answer_id, unnest(range(0, len(p))) AS position, unnest(p) AS path, CAST(unnest(a) AS BIGINT) AS a, CAST(unnest(b) AS BIGINT) AS b FROM c")
def citation_extract(spark, sf_dir):
    return verify.cited(_answers(spark, sf_dir))


@query(
    """WITH c AS (SELECT doc_id, source || '.py' AS path, 1 + doc_id % 90 AS a, 5 + doc_id % 97 AS b FROM documents UNION ALL SELECT doc_id, lang || '.py', 3, doc_id % 7 FROM documents),
k AS (SELECT DISTINCT source || '.py' AS path, 1 AS a, 60 AS b FROM documents UNION SELECT DISTINCT lang || '.py', 1, 5 FROM documents),
v AS (SELECT c.doc_id, count(*) AS n, sum(CASE WHEN c.a >= 1 AND c.b >= c.a AND k.a <= c.a AND c.b <= k.b THEN 1 ELSE 0 END) AS v FROM c JOIN k ON k.path = c.path GROUP BY 1)
SELECT doc_id AS answer_id, n AS n_citations, CAST(v AS BIGINT) AS n_valid, CASE WHEN v = n THEN 'complete' WHEN v > 0 THEN 'partial' ELSE 'abstained' END AS status FROM v"""
)
def citation_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blocks = d.select(F.concat("source", F.lit(".py")).alias("path"), F.lit(1).alias("a"), F.lit(60).alias("b")).union(d.select(F.concat("lang", F.lit(".py")), F.lit(1), F.lit(5))).distinct()
    return verify.verified(_answers(spark, sf_dir), blocks)


@query("SELECT o_orderpriority AS type, 'price' AS metric, round(avg(o_totalprice), 6) AS mean, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'open', round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE), 6), count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def metric_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("type"), F.explode(F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("open"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "O").cast("double")))).alias("metric", "value"))
    return evaluation.summary(rows)


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS value_a, b.v AS value_b, round(b.v - a.v, 6) AS delta, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' ELSE 'both' END AS side FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k")
def compare_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    run = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value"))
    return evaluation.compare(run("O"), run("F"), "k")


# ---- incremental


@query("WITH o AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE source <> 'src1'), n AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS h FROM documents WHERE source <> 'src2') SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'inserted' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.path = n.path")
def sync_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("source <> 'src1'").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    new = d.filter("source <> 'src2'").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("digest"))
    return incremental.sync(old, new)


@query("WITH u AS (SELECT sha256(text) AS digest, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1) SELECT * FROM u WHERE digest NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')")
def content_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "lang")
    return incremental.to_embed(d, d.filter("lang = 'de'"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4")
def session_window(spark, sf_dir):
    return incremental.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return incremental.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("WITH e AS (SELECT doc_id % 50 AS owner, doc_id AS id, sha256(text) AS h FROM documents), s AS (SELECT doc_id AS id, sha256(CASE WHEN source = 'src3' THEN text || '.' ELSE text END) AS h FROM documents WHERE lang <> 'de') SELECT owner, bool_and(coalesce(e.h = s.h, false)) AS is_current FROM e LEFT JOIN s ON s.id = e.id GROUP BY 1")
def evidence_currency(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = d.filter("lang <> 'de'").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("source") == "src3", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("code_hash"))
    return verify.current(d.select((F.col("doc_id") % 50).alias("owner"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("code_hash")), state)


# ---- budgets, routing, rules


@query(
    """
WITH RECURSIVE t AS (SELECT conv_id, turn, (length(text) + 3) // 4 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g(conv_id, turn, size, i, used, batch) AS (
  SELECT conv_id, turn, size, i, size, 0 FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.size, t.i, CASE WHEN g.used > 0 AND g.used + t.size > 120 THEN t.size ELSE g.used + t.size END, g.batch + CASE WHEN g.used > 0 AND g.used + t.size > 120 THEN 1 ELSE 0 END
  FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1)
SELECT conv_id, turn, size, batch FROM g"""
)
def batch_by_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens_by_quarter(F.col("text")).alias("size"))
    return budget.batched(c, "conv_id", "turn", "size", 120)


_ROUTES = [("structural", r"(^|\s)(who|qui|wer|quien)\s"), ("flow", r"(^|\s)(trace|path|flow|the)\s"), ("explain", r"(^|\s)(explain|que|und)\s")]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in _ROUTES) + " ELSE 'retrieval' END AS route FROM conversations")
def router_classify(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    route = F.lit("retrieval")
    for name, pattern in reversed(_ROUTES):
        route = F.when(F.lower("text").rlike(pattern), name).otherwise(route)
    return c.select("conv_id", "turn", route.alias("route"))


@query("SELECT o_orderpriority AS kind, count(*) AS items, CAST(sum(least(4000, t + 40 * n + 300)) AS BIGINT) AS tokens FROM (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 100) AS BIGINT) AS t FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE n IS NOT NULL GROUP BY 1")
def cost_estimate(spark, sf_dir):
    """Prompt tokens by kind: at most the ceiling for each item, 40 for each callee and a fixed head."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("t"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return o.join(n, "o_orderkey").groupBy("kind").agg(F.count("*").alias("items"), F.sum(F.least(F.lit(4000), F.col("t") + 40 * F.col("n") + 300)).alias("tokens"))


@query(
    "WITH s AS (SELECT doc_id AS id, regexp_split_to_array(text, '\\n+|[.!?]+\\s+') AS p FROM documents), c AS (SELECT id, trim(x) AS claim FROM (SELECT id, unnest(p) AS x FROM s)) "
    + "SELECT id, rule, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM c WHERE regexp_matches(lower(claim), '{p}')" for n, p in verify.CLAIM_RULES)
    + ") GROUP BY 1, 2"
)
def claim_rules(spark, sf_dir):
    found = verify.rule_hits(verify.claims(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")))
    return found.groupBy("id", "rule").agg(F.count("*").alias("n"))
