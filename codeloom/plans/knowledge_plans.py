"""Queries of claims, certificates, drafts and published knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, knowledge, verify
from codeloom.plans.catalog import GRAPH_SQL, call_graph, query, table
from codeloom.plans.code_plans import _code, _edges_sql, _symbols_sql
from codeloom.code import resolve
from codeloom.sources.shared import kept

_TEXT = "'# Overview' || chr(10) || 'The first point is ' || source || '. It reads ' || lang || '.' || chr(10) || chr(10) || '## pkg.' || source || '.run' || chr(10) || 'This one writes ' || n_chars || ' rows!' || chr(10) || '- item ' || doc_id || chr(10) || '```py' || chr(10) || 'a. B' || chr(10) || '```' || chr(10) || '`other_' || lang || '` calls it. They end here.'"


@query(
    """WITH d AS (SELECT doc_id AS answer_id, source, lang, n_chars FROM documents)
SELECT answer_id, x[1] AS position, x[2] AS claim FROM (SELECT answer_id, unnest([(0, 'The first point is ' || source || '.'), (1, 'It reads ' || lang || '.'), (2, 'Scope `pkg.' || source || '.run`: This one writes ' || n_chars || ' rows!'), (3, '- item ' || answer_id), (4, '```py' || chr(10) || 'a. B' || chr(10) || '```'), (5, '`other_' || lang || '` calls it.'), (6, 'Scope `other_' || lang || '`: They end here.')]) AS x FROM d)"""
)
def scoped_claims(spark, sf_dir):
    """Claims of answers with headings, lists and code; the heading that names a symbol scopes what follows vaguely."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(_TEXT.replace("chr(", "char(")).alias("text"), F.lit(None).cast("string").alias("subject"))
    return knowledge.scoped_claims(d)


_CODE = "'def f' || doc_id || '(a):' || chr(10) || '    \"\"\"Adds ' || lang || '.\"\"\"' || chr(10) || '    return a + ' || n_chars"


@query(
    """WITH d AS (SELECT doc_id AS answer_id, doc_id % 6 AS k FROM documents)
SELECT answer_id, k = 0 AS complete, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_supported,
CASE k WHEN 2 THEN 'claims omitted or repeated' WHEN 3 THEN 'a supported claim without evidence' WHEN 4 THEN 'a quote that isn''t in the source' WHEN 5 THEN 'claims omitted or repeated' END AS error FROM d"""
)
def review_certificates(spark, sf_dir):
    """Reviews of two claims each: whole, with a quote of documentation only, short, without evidence, misquoted, doubled."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 6).withColumn("id", F.concat(F.lit("f"), "doc_id")).withColumn("code", F.expr(_CODE.replace("chr(", "char(")))
    two = d.select(F.col("doc_id").alias("answer_id"), "k", "id", "lang", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    claims = two.select("answer_id", "position")
    reviews = two.filter("NOT (k = 2 AND position = 1)").select("answer_id", "position", F.lit("supported").alias("verdict"))
    reviews = reviews.unionByName(two.filter("k = 5 AND position = 0").select("answer_id", "position", F.lit("supported").alias("verdict")))
    quote = F.when((F.col("k") == 1) & (F.col("position") == 1), F.concat(F.lit("Adds "), "lang")).when(F.col("k") == 4, F.lit("no such line")).otherwise(F.concat(F.lit("return a + "), "n_chars"))
    evidence = two.filter("NOT (k = 3 AND position = 1)").select("answer_id", "position", "id", quote.alias("quote"))
    return knowledge.certificates(claims, reviews, evidence, d.select("id", F.col("code").alias("raw_code")))


@query("SELECT conv_id AS answer_id, CAST(turn AS INTEGER) AS position, CASE WHEN bool_or(length(text) > 900) OVER (PARTITION BY conv_id, (row_number_ - 1) // 2) THEN 'unsupported' WHEN length(text) % 2 = 0 THEN 'supported' ELSE 'contradicted' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_number_ FROM conversations)")
def claim_reviews(spark, sf_dir):
    """Claims judged two at a time; one over the judge's limit fails its batch."""

    def judge(claims):
        if any(len(c) > 900 for c in claims):
            raise ValueError("too long")
        return ["supported" if len(c) % 2 == 0 else "contradicted" for c in claims]

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("position"), F.col("text").alias("claim"))
    return knowledge.reviewed_in_batches(c, judge)


@query("SELECT l_orderkey AS id, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber = 1) OR count(*) FILTER (l_quantity > 10) = 0 THEN 'abstained' WHEN bool_and(l_linestatus = 'O') AND NOT bool_or(l_tax > 0.07) AND count(*) FILTER (l_quantity > 10) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM lineitem GROUP BY 1")
def answer_status(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_claims"), F.count_if(F.col("l_quantity") > 10).alias("n_supported"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("n_stripped"), F.every(F.col("l_linestatus") == "O").alias("all_reviewed"), F.some(F.col("l_tax") > 0.07).alias("incomplete"))
    return knowledge.decided(a).select("id", "status")


_OLD = "SELECT doc_id AS id, lang AS kind, sha256(text) AS draft_hash, 'complete' AS status, source AS published, 'c' || doc_id AS certificate FROM documents WHERE source <> 'src1'"


@query(f"WITH o AS ({_OLD}), n AS (SELECT doc_id AS id, lang AS kind, sha256(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS draft_hash FROM documents WHERE source <> 'src2') SELECT n.id, n.kind, n.draft_hash, CASE WHEN o.draft_hash = n.draft_hash THEN o.status ELSE 'pending' END AS status, CASE WHEN o.draft_hash = n.draft_hash THEN o.published END AS published, CASE WHEN o.draft_hash = n.draft_hash THEN o.certificate END AS certificate FROM n LEFT JOIN o ON o.id = n.id")
def draft_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("source <> 'src1'").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.sha2("text", 256).alias("draft_hash"), F.lit("complete").alias("status"), F.col("source").alias("published"), F.concat(F.lit("c"), "doc_id").alias("certificate"))
    new = d.filter("source <> 'src2'").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("draft_hash"))
    return knowledge.upsert_drafts(old, new)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND lang <> 'de' THEN 'partial' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN lang <> 'de' END AS saved FROM documents")
def draft_reviews(spark, sf_dir):
    """Reviews are saved only where the draft is still the one that was reviewed."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    drafts = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.sha2("text", 256).alias("draft_hash"), F.lit("pending").alias("status"), none.alias("published"), none.alias("certificate"))
    seen = F.when(F.col("lang") == "de", F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    reviews = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), seen.alias("draft_hash"), F.lit("partial").alias("status"), F.col("source").alias("published"), F.lit("c").alias("certificate"))
    return knowledge.save_reviews(drafts, reviews).select("id", "status", "saved")


@query("WITH s AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 11 = 0 OR doc_id % 4 = 0 THEN 'rejected' WHEN doc_id % 4 = 3 AND lang <> 'fr' AND doc_id % 5 <> 0 THEN 'complete' ELSE 'partial' END AS status FROM documents) SELECT id, status, CASE status WHEN 'complete' THEN source WHEN 'partial' THEN 'This answer is partial.' || chr(10) || chr(10) || source END AS published FROM s")
def publish_drafts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "feature").otherwise("symbol").alias("kind"), F.lit(3).alias("n_claims"), (F.col("doc_id") % 4).alias("n_accepted"), F.col("source").alias("text"), (F.col("doc_id") % 5 == 0).alias("has_excerpt"), (F.col("doc_id") % 11 != 0).alias("is_current"))
    return knowledge.publish(d).select("id", "status", "published")


_SHOWN = "SELECT 'symbol:' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS published, CASE WHEN p_size % 5 = 0 THEN 'g1' ELSE 'g2' END AS guard_version, p_type AS verifier_digest FROM part"


def _drafts(spark, sf_dir):
    drafts = table(spark, sf_dir, "part").select(*(F.expr(x) for x in ("'symbol:' || p_partkey AS id", "CASE p_size % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'rejected' ELSE 'pending' END AS status", "CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS published", "CASE WHEN p_size % 5 = 0 THEN 'g1' ELSE 'g2' END AS guard_version", "p_type AS verifier_digest")))
    current = table(spark, sf_dir, "part").select(F.expr("'symbol:' || p_partkey").alias("owner"), (F.col("p_partkey") % 9 != 0).alias("is_current"))
    return knowledge.published(drafts, current, "g2", "ECONOMY")


@query(f"SELECT id, status, published FROM ({_SHOWN}) s WHERE status IN ('complete', 'partial') AND published <> '' AND guard_version = 'g2' AND verifier_digest = 'ECONOMY' AND id NOT IN (SELECT 'symbol:' || p_partkey FROM part WHERE p_partkey % 9 = 0)")
def published_knowledge(spark, sf_dir):
    return _drafts(spark, sf_dir).select("id", "status", "published")


@query(f"WITH k AS (SELECT id, status, published FROM ({_SHOWN}) s WHERE status IN ('complete', 'partial') AND published <> '' AND guard_version = 'g2' AND verifier_digest = 'ECONOMY' AND id NOT IN (SELECT 'symbol:' || p_partkey FROM part WHERE p_partkey % 9 = 0)) SELECT p_partkey AS id, p_brand, k.published AS summary_short, coalesce(k.status, 'unvalidated') AS knowledge_status FROM part LEFT JOIN k ON k.id = 'symbol:' || p_partkey")
def trusted_rows(spark, sf_dir):
    """Summaries that nobody reviewed are hidden."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.lit("draft").alias("summary_short"))
    return knowledge.trusted(rows, _drafts(spark, sf_dir)).select("id", "p_brand", "summary_short", "knowledge_status")


@query("SELECT doc_id AS id, doc_id % 3 = 0 AND length(text) > 0 AND len(string_split(text, chr(10))) > 1 AS trusted FROM documents")
def source_rehash(spark, sf_dir):
    """Trust needs the file's hash and the symbol's lines as they were recorded."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n", -1)
    symbols = d.select(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".py")).alias("file_path"), F.sha2("text", 256).alias("sha256"), F.lit(2).alias("start_line"), F.lit(2).alias("end_line"), F.when((F.col("text") != "") & (F.size(lines) > 1), F.when(F.col("doc_id") % 3 == 1, F.concat(F.get(lines, F.lit(1)), F.lit("x"))).otherwise(F.get(lines, F.lit(1)))).otherwise("nothing").alias("raw_code"))
    files = d.select(F.concat("doc_id", F.lit(".py")).alias("path"), F.when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return knowledge.rehashed(symbols, files)


_NEAR = f"""WITH {_symbols_sql()}, {_edges_sql()}, strong AS (SELECT caller, callee FROM code_edges WHERE confidence >= 0.6 AND callee IS NOT NULL),
near AS (SELECT id AS target, id, 'target' AS role FROM code_symbols UNION SELECT callee, caller, 'caller' FROM strong UNION SELECT caller, callee, 'callee' FROM strong UNION SELECT parent_id, id, 'method' FROM code_symbols WHERE kind = 'method')"""


@query(_NEAR + " SELECT target, id, role FROM near")
def explain_neighbourhood(spark, sf_dir):
    parsed, symbols = _code(spark, sf_dir)
    return knowledge.neighbourhood(symbols, resolve.call_edges(parsed, symbols), symbols)


@query(_NEAR + " SELECT target, sha256(string_agg(role || ':' || id || ':' || sha256(id), chr(31) ORDER BY role, id) || chr(31) || 'm1') AS key FROM near GROUP BY 1")
def explain_keys(spark, sf_dir):
    """The cache key of an explanation: the neighbourhood's hashes and the model."""
    parsed, symbols = _code(spark, sf_dir)
    near = knowledge.neighbourhood(symbols, resolve.call_edges(parsed, symbols), symbols)
    return knowledge.neighbourhood_keys(near, symbols.select("id", F.sha2("id", 256).alias("code_hash")), F.lit("m1"))


@query(
    f"""WITH {_symbols_sql()}, {_edges_sql()}, strong AS (SELECT caller, callee FROM code_edges WHERE confidence >= 0.6 AND callee IS NOT NULL)
SELECT id AS owner, id FROM code_symbols UNION SELECT caller, callee FROM strong UNION SELECT a.caller, b.callee FROM strong a JOIN strong b ON b.caller = a.callee WHERE b.callee <> a.caller AND b.callee <> a.callee UNION SELECT id, parent_id FROM code_symbols WHERE parent_id IS NOT NULL"""
)
def knowledge_evidence(spark, sf_dir):
    """Evidence of a symbol's draft: itself, what it calls in two steps, and its class."""
    parsed, symbols = _code(spark, sf_dir)
    edges = kept(resolve.call_edges(parsed, symbols))
    reach = graph.reach_ids(symbols.select("id"), edges, 2, 0.6)
    return knowledge.evidence_selection(symbols, reach)


@query("SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 2 = 0 THEN 'file:' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'file' ELSE c_mktsegment END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN sha256(c_name) ELSE sha256(c_mktsegment) END AS code_hash FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 7")
def evidence_hydration(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_nationkey <> 7")
    refs = o.select(F.col("o_orderkey").alias("owner"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("file:"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")).alias("id"))
    symbols = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("kind"), F.sha2("c_mktsegment", 256).alias("code_hash"))
    return knowledge.hydrated_evidence(refs, symbols, c.select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256")))


_ANSWERS = "SELECT doc_id AS answer_id, 'One [' || source || '.py:3-8] two [' || lang || '.py:5-2] three [' || source || '.py:30-99] end' AS text, source, lang FROM documents"
_CHECKED = f"""a AS ({_ANSWERS}), c AS (SELECT answer_id, x[1] AS position, x[2] AS path, x[3] AS a, x[4] AS b, x[5] AS outcome FROM (SELECT answer_id, unnest([(0, source || '.py', 3, 8, CASE WHEN answer_id % 4 = 0 THEN 'stale' WHEN answer_id % 4 = 1 THEN 'unsupported' ELSE 'valid' END), (1, lang || '.py', 5, 2, 'invalid'), (2, source || '.py', 30, 99, 'unsupported')]) AS x FROM a))"""


def _checked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    answers = d.select(F.col("doc_id").alias("answer_id"), F.expr(_ANSWERS.removeprefix("SELECT doc_id AS answer_id, ").removesuffix(" AS text, source, lang FROM documents")).alias("text"))
    blocks = d.select(F.col("doc_id").alias("answer_id"), F.concat("source", F.lit(".py")).alias("path"), F.when(F.col("doc_id") % 4 == 1, 4).otherwise(1).alias("first"), F.lit(99).alias("last"), F.lit("h").alias("code_hash"), F.when(F.col("doc_id") % 4 == 0, "g").otherwise("h").alias("now"))
    files = d.select(F.concat("source", F.lit(".py")).alias("path"), F.lit(50).alias("line_count")).distinct()
    return answers, knowledge.checked_citations(answers, blocks, files)


@query(f"WITH {_CHECKED} SELECT * FROM c")
def checked_citations(spark, sf_dir):
    return _checked(spark, sf_dir)[1]


@query(f"WITH {_CHECKED} SELECT a.answer_id, 'One ' || CASE WHEN outcome = 'valid' THEN '[' || path || ':3-8]' ELSE '' END || ' two  three  end' AS text FROM a JOIN c ON c.answer_id = a.answer_id AND position = 0")
def stripped_answers(spark, sf_dir):
    return knowledge.stripped(*_checked(spark, sf_dir))


@query(f"WITH {GRAPH_SQL}, s AS (SELECT caller, callee FROM w WHERE weight >= 0.6) SELECT p_partkey AS id, CAST((SELECT count(*) FROM s WHERE callee = p_partkey) AS BIGINT) AS callers, sha256(coalesce((SELECT string_agg(sha256(CAST(callee AS VARCHAR)), chr(31) ORDER BY sha256(CAST(callee AS VARCHAR))) FROM s WHERE caller = p_partkey), '')) AS context FROM part")
def context_hashes(spark, sf_dir):
    """The hash over what each symbol calls; when a callee's summary changes, its callers' hashes do."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    e = graph.weighted(call_graph(spark, sf_dir), 0.6)
    return verify.contexts(p, e, p.select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest")))


#: Claims by number, with the rules that turn each down.
_CLAIMS = [
    ("`keep{k}` returns the row.", []),
    ("Sources:", ["only citations"]),
    ("This makes a conditional call to `keep{k}`.", ["unclear call guard", "no subject"]),
    ("The value comes from .", ["place cut off"]),
    ("The method returns rows.", ["unnamed function"]),
    ("`keep{k}` sends the email.", ["delivery as a fact", "delivery by a function that returns its input"]),
    ("`keep{k}` does not send any email.", []),
    ("`keep{k}` has no side effects.", ["assurance or placeholder"]),
    ("raises: none", ["assurance or placeholder"]),
    ("```mermaid\npie\n```", ["diagram by a model"]),
    ("`keep{k}` follows PEP 8.", ["language history"]),
    ("`keep{k}` is thread-safe.", ["concurrency"]),
    ("`keep{k}` stores it securely.", ["outside guarantee"]),
    ("The annotations are evaluated late.", ["annotation lore"]),
    ("`keep{k}` never raises exceptions.", ["no exceptions"]),
    ("`lost{k}` is called.", ["unknown name"]),
    ("`load{k}` raises LostError.", ["unknown exception", "exception that nothing raises"]),
    ("`load{k}` raises KeyError.", ["exception that nothing raises"]),
    ("`load{k}` raises ValueError for {lang}.", []),
    ("The attribute size is set.", ["key called an attribute"]),
    ("`load{k}` modifies its input.", ["change of an input that is copied"]),
]


def _rejections_sql() -> str:
    parts = [f"SELECT doc_id AS answer_id, {i} AS position, '{rule}' AS rule FROM documents" for i, (_, rules) in enumerate(_CLAIMS) for rule in rules]
    return " UNION ALL ".join(parts)


@query(_rejections_sql())
def claim_rejections(spark, sf_dir):
    """Claims about two functions of each document, and why they can't stand."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("doc_id").cast("string").alias("k"), "lang")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("k")), F.lit("{lang}"), F.col("lang"))
    claims = d.select("answer_id", F.posexplode(F.array(*(fill(t) for t, _ in _CLAIMS))).alias("position", "claim"))
    keep, load = "def keep{k}(row):\n    return row\n", "def load{k}(row):\n    out = dict(row)\n    if out['size'] < 0:\n        raise ValueError('{lang}')\n    return out\n"
    one = lambda name, code: d.select("answer_id", fill(name).alias("name"), fill(name).alias("qualname"), fill(code).alias("raw_code"))
    return knowledge.static_rejections(claims, one("keep{k}", keep).union(one("load{k}", load)))
