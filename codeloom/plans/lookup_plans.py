"""Queries of lookups, joins by hash and quote, and evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import evaluation, lookup, verify
from codeloom.plans.catalog import query, table


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 17")
def point_lookup(spark, sf_dir):
    return lookup.by_key(table(spark, sf_dir, "part"), "p_partkey", [17]).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 150, 99999999)")
def multi_lookup(spark, sf_dir):
    return lookup.by_key(table(spark, sf_dir, "part"), "p_partkey", [3, 5, 150, 99999999]).select("p_partkey", "p_name")


@query("SELECT p_brand AS file_path, p_partkey AS id, p_size AS start_line, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part WHERE p_brand = 'Brand#2'")
def symbols_in_file(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("id"), F.col("p_size").alias("start_line"))
    return lookup.in_file(p, "Brand#2").withColumn("position", F.row_number().over(Window.orderBy("start_line", "id")))


@query("SELECT event_id AS path, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'pending' END AS parse_status FROM events WHERE event_type IN ('error', 'view')")
def open_work(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "pending").otherwise("parsed")
    return lookup.open_work(table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), status.alias("parse_status")))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS page FROM documents")
def keyset_pages(spark, sf_dir):
    return lookup.page_numbers(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


_SUPPLIERS = "SELECT s_suppkey AS id, 'n' || s_nationkey || '.' || s_name AS qualname, s_name AS name, 'n' || s_nationkey || '.py' AS file_path, s_suppkey % 40 + 1 AS start_line, s_suppkey % 40 + 9 AS end_line FROM supplier"


@query(
    f"""WITH s AS ({_SUPPLIERS}), q AS (SELECT CAST(s_suppkey AS VARCHAR) AS query FROM supplier WHERE s_suppkey < 5 UNION SELECT 'n' || s_nationkey || '.' || s_name FROM supplier UNION SELECT 'no such name at all' FROM supplier),
x AS (SELECT query, id, 1::BIGINT AS rank, 'exact' AS how FROM q JOIN s ON CAST(id AS VARCHAR) = query),
n AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rung, id) AS rank, 'name' AS how FROM (SELECT query, id, CASE WHEN qualname = query THEN 1 WHEN name = query THEN 2 WHEN ends_with(qualname, '.' || query) THEN 3 ELSE 4 END AS rung FROM q JOIN s ON contains(lower(qualname), lower(query)) WHERE query NOT IN (SELECT query FROM x)))
SELECT f.*, file_path || ':' || start_line || '-' || end_line AS location FROM (SELECT * FROM x UNION ALL SELECT * FROM n WHERE rank <= 100) f JOIN s ON s.id = f.id"""
)
def definition_search(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    qual, file = F.concat(F.lit("n"), "s_nationkey", F.lit("."), "s_name"), F.concat(F.lit("n"), "s_nationkey", F.lit(".py"))
    symbols = s.select(F.col("s_suppkey").alias("id"), qual.alias("qualname"), F.col("s_name").alias("name"), file.alias("file_path"), (F.col("s_suppkey") % 40 + 1).alias("start_line"), (F.col("s_suppkey") % 40 + 9).alias("end_line"))
    q = s.filter("s_suppkey < 5").select(F.col("s_suppkey").cast("string").alias("query")).union(s.select(qual)).union(s.select(F.lit("no such name at all")))
    return lookup.definitions(q, symbols)


@query("SELECT 'document' AS kind, CAST(d.doc_id AS VARCHAR) AS id, v.vec_id FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id % 700 UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), v.vec_id FROM pages JOIN embeddings v ON v.vec_id = page_id * 3 UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), v.vec_id FROM benchmark JOIN embeddings v ON v.vec_id = item_id + 5")
def embedded_units(spark, sf_dir):
    """Three kinds of units in one union, each with the vector of its hash; units whose hash has none fall out."""
    unit = lambda t, key, h: table(spark, sf_dir, t).select(F.lit({"documents": "document", "pages": "page", "benchmark": "item"}[t]).alias("kind"), F.col(key).cast("string").alias("id"), h.alias("embed_hash"))
    units = unit("documents", "doc_id", F.col("doc_id") % 700).union(unit("pages", "page_id", F.col("page_id") * 3)).union(unit("benchmark", "item_id", F.col("item_id") + 5))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hash"), "embedding")
    return lookup.by_hash(units, vectors).select("kind", "id", F.col("embed_hash").alias("vec_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def key_membership(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(c, "o_custkey", "left_semi").join(li, "o_orderkey", "left_anti")


@query("SELECT l_orderkey AS feature, l_linenumber AS position, p_partkey AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey")
def feature_members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("feature"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("id"))
    return lookup.members(li, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("feature", "position", "id", "name")


@query("SELECT user_id, rank, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def hydrated_ranks(spark, sf_dir):
    """Ranked ids first, by a narrow sort; their rows are joined afterwards."""
    from codeloom.operators.search import ranked

    e = table(spark, sf_dir, "events")
    top = ranked(e.select("user_id", "event_id", "value"), "user_id", F.desc("value"), "event_id", k=3).select("user_id", "event_id", "rank")
    return lookup.hydrated(top, e.select("event_id", "event_type", "value"), "event_id").select("user_id", "rank", "event_id", "event_type", "value")


_QUOTES = "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN substr(text, 30, 60) WHEN 1 THEN substr(text, 1, 10) || '@@' ELSE '  ' END AS quote FROM documents"


@query(
    f"""SELECT q.id, q.quote, instr(text, quote) > 0 AND regexp_replace(quote, '\\s', '', 'g') <> '' AS found,
CASE WHEN instr(text, quote) > 0 AND regexp_replace(quote, '\\s', '', 'g') <> '' THEN '[' || source || '.py:' || CAST(7 + length(substr(text, 1, instr(text, quote) - 1)) - length(replace(substr(text, 1, instr(text, quote) - 1), chr(10), '')) AS BIGINT) || '-' ||
CAST(7 + length(substr(text, 1, instr(text, quote) - 1)) - length(replace(substr(text, 1, instr(text, quote) - 1), chr(10), '')) + length(rtrim(quote, chr(10))) - length(replace(rtrim(quote, chr(10)), chr(10), '')) AS BIGINT) || ']' END AS cite
FROM ({_QUOTES}) q JOIN documents ON doc_id = q.id"""
)
def quote_citations(spark, sf_dir):
    """Quotes found in their source, with the lines of their first place."""
    d = table(spark, sf_dir, "documents")
    quotes = d.select(F.col("doc_id").alias("id"), F.expr("CASE doc_id % 3 WHEN 0 THEN substr(text, 30, 60) WHEN 1 THEN substr(text, 1, 10) || '@@' ELSE '  ' END").alias("quote"))
    sources = d.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_code"), F.concat("source", F.lit(".py")).alias("file_path"), F.lit(7).alias("start_line"))
    return lookup.quoted(quotes, sources)


# ---- evaluation


@query("SELECT event_type AS task, round(avg(value) FILTER (event_id % 7 <> 0), 6) AS mean_tokens, round(sum(value) FILTER (event_id % 7 <> 0) / 100.0::DOUBLE, 6) AS per_answer FROM events GROUP BY 1")
def tokens_per_answer(spark, sf_dir):
    """Mean tokens of calls that succeeded; per answer if the number of answers is given."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("value").alias("tokens"), (F.col("event_id") % 7 != 0).alias("ok"))
    return evaluation.tokens_per_answer(calls, "task", 100)


@query("SELECT l_orderkey AS question, CASE WHEN list_sort(list_distinct(list(l_partkey))) = list_sort(list_distinct(list(l_partkey) FILTER (l_linenumber < 5))) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM lineitem GROUP BY 1")
def set_exactness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pairs = li.groupBy(F.col("l_orderkey").alias("question")).agg(F.collect_set("l_partkey").alias("expected"), F.collect_set(F.when(F.col("l_linenumber") < 5, F.col("l_partkey"))).alias("returned"))
    return evaluation.same_set(pairs).select("question", "exact")


@query("WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_partkey ORDER BY l_shipdate, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey AS question, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM o")
def path_exactness(spark, sf_dir):
    """Equal as ordered lists."""
    li = table(spark, sf_dir, "lineitem")
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    return evaluation.same_order(li.groupBy(F.col("l_orderkey").alias("question")).agg(by("l_linenumber").alias("expected"), by("l_shipdate").alias("returned"))).select("question", "exact")


_RAW = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '[' || lang || '\\' || source || '.py:' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 4) || ']' WHEN 1 THEN source || '.py:3-' || (doc_id % 5) WHEN 2 THEN '[' || source || '.py:1-2' WHEN 3 THEN source || '.py:0-2' WHEN 4 THEN source || '.py' ELSE lang || ':8-8' END AS raw FROM documents"


@query(
    f"""WITH r AS ({_RAW}), m AS (SELECT doc_id, raw, regexp_extract(CASE WHEN starts_with(raw, '[') AND ends_with(raw, ']') THEN raw[2:length(raw) - 1] WHEN starts_with(raw, '[') OR ends_with(raw, ']') THEN '' ELSE raw END, '^(.+?):(\\d+)-(\\d+)$', ['p', 'a', 'b']) AS g FROM r),
v AS (SELECT doc_id, g, g.p <> '' AND try_cast(g.a AS BIGINT) >= 1 AND try_cast(g.b AS BIGINT) >= try_cast(g.a AS BIGINT) AS valid FROM m)
SELECT doc_id, coalesce(valid, false) AS valid, CASE WHEN valid THEN replace(g.p, '\\', '/') END AS path, CASE WHEN valid THEN try_cast(g.a AS BIGINT) END AS start_line, CASE WHEN valid THEN try_cast(g.b AS BIGINT) END AS end_line FROM v"""
)
def parsed_spans(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW.removeprefix("SELECT doc_id, ").removesuffix(" AS raw FROM documents").replace("'\\'", "'\\\\'")).alias("raw"))
    return raw.select("doc_id", evaluation.span(F.col("raw")).alias("s")).select("doc_id", "s.*")


@query("SELECT o_orderkey AS question, o_custkey AS reference FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def unresolved_references(spark, sf_dir):
    """Expected references of questions that the index doesn't have: a run fails before it starts if there are any."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_custkey").alias("reference"))
    known = table(spark, sf_dir, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("reference"))
    return evaluation.unresolved(q, known)


@query(
    """WITH r AS (SELECT o_orderstatus AS run, o_orderpriority AS type, o_totalprice AS tokens, o_custkey % 2 AS recall FROM orders)
SELECT type, metric, round(avg(CASE WHEN run = 'O' THEN v END), 6) AS mean_a, round(avg(CASE WHEN run = 'F' THEN v END), 6) AS mean_b, round(avg(CASE WHEN run = 'F' THEN v END) - avg(CASE WHEN run = 'O' THEN v END), 6) AS delta
FROM (SELECT run, type, 'tokens' AS metric, tokens::DOUBLE AS v FROM r UNION ALL SELECT run, type, 'recall', recall::DOUBLE FROM r) WHERE run IN ('O', 'F') GROUP BY 1, 2"""
)
def run_deltas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("type"), F.explode(F.create_map(F.lit("tokens"), F.col("o_totalprice"), F.lit("recall"), (F.col("o_custkey") % 2).cast("double"))).alias("metric", "value"))
    return evaluation.deltas(rows.filter("run = 'O'"), rows.filter("run = 'F'"))


@query(
    """SELECT p_type AS model, count(*) AS calls, CAST(count(*) FILTER (p_size > 25) AS BIGINT) AS valid, round(count(*) FILTER (p_size > 25) / count(*)::DOUBLE, 6) AS valid_rate, round(sum(p_retailprice) / nullif(sum(p_size), 0), 6) AS tokens_per_second,
round(avg(p_retailprice) FILTER (p_size > 25), 6) AS mean_tokens FROM part GROUP BY 1"""
)
def bakeoff_rates(spark, sf_dir):
    calls = table(spark, sf_dir, "part").select(F.col("p_type").alias("model"), (F.col("p_size") > 25).alias("valid"), F.col("p_retailprice").alias("tokens"), F.col("p_size").alias("seconds"))
    return evaluation.rates(calls, "model")


@query("WITH t AS (SELECT conv_id, list_distinct(list(role ORDER BY turn)) AS x, min_by(role, turn) AS first_role FROM conversations GROUP BY 1) SELECT conv_id, CAST(len(x) AS BIGINT) AS n_roles, first_role FROM t")
def first_occurrences(spark, sf_dir):
    """Distinct values in the order of their first place."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("x"))
    return c.select("conv_id", F.size("x").cast("long").alias("n_roles"), F.element_at("x", 1).alias("first_role"))


@query("SELECT event_type AS file_path, CAST(json_extract(props, '$.k') AS BIGINT) AS qualname, count(*) AS twins, min(event_id) AS first_id FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def twin_names(spark, sf_dir):
    """Names that a file defines more than once."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("file_path"), F.from_json("props", "k long")["k"].alias("qualname"), F.col("event_id").alias("id"))
    return e.groupBy("file_path", "qualname").agg(F.count("*").alias("twins"), F.min("id").alias("first_id")).filter("twins > 1")


@query("SELECT l_orderkey AS site, l_partkey AS callee, l_returnflag AS kind, max_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS last_value FROM lineitem GROUP BY 1, 2, 3")
def site_dedupe(spark, sf_dir):
    """One edge for each callee and kind of a call site: the last one."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("callee"), F.col("l_returnflag").alias("kind"), "l_suppkey", F.expr("l_linenumber * 1000000 + l_suppkey").alias("at"))
    return li.groupBy("site", "callee", "kind").agg(F.max_by("l_suppkey", "at").alias("last_value"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE '`' || role || '_' || turn || '`' END AS name, turn % 3 <> 0 AND role || '_' || turn NOT IN (SELECT 'user_' || t FROM range(0, 6) x(t)) AS unknown FROM conversations")
def unknown_identifiers(spark, sf_dir):
    """Names in backquotes that are neither built in nor indexed."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat("role", F.lit("_"), "turn")
    answers = c.select(F.struct("conv_id", "turn").alias("answer_id"), F.when(F.col("turn") % 3 == 0, F.lit("no `3x` or ``code`` here, but `len` and `print`")).otherwise(F.concat(F.lit("see `"), name, F.lit("` there"))).alias("text"))
    symbols = spark.range(6).select(F.concat(F.lit("m.user_"), "id").alias("qualname"), F.concat(F.lit("user_"), "id").alias("name"), F.lit("m.py").alias("file_path"))
    found = verify.unknown_names(answers, symbols, ["len", "print"])
    shown = c.select(F.struct("conv_id", "turn").alias("answer_id"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("`"), name, F.lit("`"))).alias("name"))
    return shown.join(found.select("answer_id", F.lit(True).alias("hit")).distinct(), "answer_id", "left").select("answer_id.*", "name", F.coalesce("hit", F.lit(False)).alias("unknown"))


@query("SELECT doc_id, source || ':' || lang AS top FROM documents WHERE doc_id % 5 = 0")
def insufficient_context(spark, sf_dir):
    """Answers without a valid citation become the first five hits."""
    d = table(spark, sf_dir, "documents")
    answers = d.select(F.col("doc_id").alias("answer_id"), F.lit("text").alias("text"), (F.col("doc_id") % 5).alias("n_valid"))
    hits = d.select(F.col("doc_id").alias("answer_id"), F.posexplode(F.array(*(F.concat("source", F.lit(":"), F.col("lang")) if k == 0 else F.lit(f"hit{k}") for k in range(7)))).alias("position", "line"))
    out = verify.fallback(answers, hits)
    return out.filter("NOT sufficient").select(F.col("answer_id").alias("doc_id"), F.regexp_extract("text", r"Top hits:\n- (.*)\n- hit1\n- hit2\n- hit3\n- hit4$", 1).alias("top"))


