"""Queries of text functions, hashes and keys, budgets and prompt parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import budget
from codeloom.plans.catalog import _TERMS, query, table


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_TERMS.format('text')}), ' ') AS terms FROM conversations")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


_PADDED = "chr(13) || chr(10) || '  ' || chr(10) || replace(text, '. ', chr(13) || chr(10) || '   ' || chr(13) || chr(10)) || chr(10) || chr(9) || chr(10)"


@query(f"SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace({_PADDED}, '\\r\\n?', chr(10), 'g'), '^([ \\t]*\\n)+', ''), '(\\n[ \\t]*)+$', '')) AS code_hash FROM conversations")
def normalized_code(spark, sf_dir):
    """Hash of code that differs in line ends and outer blank lines only from its normal form."""
    padded = F.concat(F.lit("\r\n  \n"), F.replace("text", F.lit(". "), F.lit("\r\n   \r\n")), F.lit("\n\t\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.normalize_code(padded), 256).alias("code_hash"))


@query(
    """SELECT doc_id, sha256(to_json({'lang': lang, 'n_chars': n_chars, 'source': source})::VARCHAR) AS fingerprint,
sha256(to_json({'dim': 64, 'kind': 'embedding', 'model': source, 'text': sha256(text), 'version': 1})::VARCHAR) AS embed_key,
sha256(to_json({'callees': sha256(lang), 'code': sha256(text), 'kind': 'summary', 'prompt': 'p1', 'version': 1})::VARCHAR) AS context_key,
sha256(to_json({'index': 'v7', 'kind': 'answer', 'model': lang, 'question': lower(trim(regexp_replace('What  is ' || source || ' ', '\\s+', ' ', 'g'))), 'version': 1})::VARCHAR) AS answer_key FROM documents"""
)
def content_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.sha2("text", 256)
    question = F.concat(F.lit("What  is "), "source", F.lit(" "))
    return d.select(
        "doc_id",
        T.fingerprint(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("fingerprint"),
        T.embed_key(F.col("source"), 64, text).alias("embed_key"),
        T.context_key(text, F.sha2("lang", 256), F.lit("p1")).alias("context_key"),
        T.answer_key(question, F.lit("v7"), F.col("lang")).alias("answer_key"),
    )


@query("SELECT p_partkey, p_brand AS inner_type FROM part")
def unwrapped_annotations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = [F.concat(F.lit("Optional["), "p_brand", F.lit("]")), F.concat("p_brand", F.lit(" | None")), F.concat(F.lit("None | "), "p_brand"), F.concat(F.lit("  typing.Optional["), "p_brand", F.lit("] ")), F.col("p_brand")]
    annotation = F.element_at(F.array(*forms), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return p.select("p_partkey", T.unwrap_optional(annotation).alias("inner_type"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')) AS label_hash FROM pages""")
def escaped_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_label(F.col("html")), 256).alias("label_hash"))


@query("SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')[1:25], ' ') AS short, len(array_to_string(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')[1:60], ' ')) AS detailed_chars FROM documents")
def trimmed_words(spark, sf_dir):
    text = F.btrim("text", F.lit(" \t\n\r"))
    return table(spark, sf_dir, "documents").select("doc_id", T.first_words(text, 25).alias("short"), F.char_length(T.first_words(text, 60)).cast("long").alias("detailed_chars"))


_ROOM = T.most_chars(100) - len(T.CUT_MARKER)


@query(
    f"""WITH t AS (SELECT doc_id, 'search_document: ' || text AS x FROM documents)
SELECT doc_id, CASE WHEN ceil(length(x) / 3.2::DOUBLE * 1.15::DOUBLE) <= 100 THEN x ELSE substr(x, 1, {_ROOM}) || {_quote(T.CUT_MARKER)} END AS input,
{_quote(T.EMBEDDING_PREFIXES["qwen3-embedding"][0])} || substr(x, 18, 40) AS question FROM t"""
)
def embedding_inputs(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.embedding_head(T.embedding_text(text, "nomic-embed-text:v1.5"), 100).alias("input"), T.embedding_text(F.substring(text, 1, 40), "qwen3-embedding", True).alias("question"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, to_json({'event': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT)})::VARCHAR AS encoded FROM events")
def nested_attributes(spark, sf_dir):
    """Nested attributes decoded to a struct where they come in, and encoded where they go out."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("p.k").alias("k"))).alias("encoded"))


_PATHS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tests/' || source || '.py' WHEN 1 THEN lang || '/test_' || source || '/x.py' WHEN 2 THEN source || '_test.py' WHEN 3 THEN lang || '/attest/' || source || '.py' ELSE source || '/test' END AS path FROM documents"


def _paths(spark, sf_dir):
    forms = [F.concat(F.lit("tests/"), "source", F.lit(".py")), F.concat("lang", F.lit("/test_"), "source", F.lit("/x.py")), F.concat("source", F.lit("_test.py")), F.concat("lang", F.lit("/attest/"), "source", F.lit(".py")), F.concat("source", F.lit("/test"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int")).alias("path"))


@query(f"SELECT doc_id, path, regexp_matches(path, '(^|/)(tests?|test_[^/]*|[^/]*_test\\.py)(/|$)') AS by_pattern, len(list_filter(string_split(path, '/'), lambda p: p IN ('test', 'tests') OR starts_with(p, 'test_'))) > 0 AS by_part FROM ({_PATHS})")
def test_paths(spark, sf_dir):
    """The two rules for test paths, which differ on purpose: one takes x_test.py, the other doesn't."""
    return _paths(spark, sf_dir).select("doc_id", "path", T.is_test_path(F.col("path")).alias("by_pattern"), T.has_test_part(F.col("path")).alias("by_part"))


# ---- budgets


@query("SELECT conv_id, turn, ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE)::BIGINT AS tokens, ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) + 40 <= 200 AS fits FROM conversations")
def prompt_fits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tokens = T.tokens_by_ratio(F.col("text"))
    return c.select("conv_id", "turn", tokens.alias("tokens"), budget.fits(tokens, F.lit(40), 200).alias("fits"))


@query(
    """WITH p AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn) + 11 AS upto FROM p),
k AS (SELECT *, ceil(upto / 3.2::DOUBLE * 1.15::DOUBLE) + 20 + 50 <= 450 OR turn = 0 AS kept FROM c)
SELECT conv_id, CAST(count(*) FILTER (kept) AS BIGINT) AS n_kept, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS n_dropped, CAST(ceil(max(upto) FILTER (kept) / 3.2::DOUBLE * 1.15::DOUBLE) + 20 AS BIGINT) AS tokens FROM k
WHERE conv_id IN (SELECT conv_id FROM k WHERE turn = 0 AND ceil(upto / 3.2::DOUBLE * 1.15::DOUBLE) + 70 <= 450) GROUP BY 1"""
)
def prompt_assembly(spark, sf_dir):
    """Conversations as prompts: turns are parts, later turns go first if the budget of 450 tokens is short."""
    c = table(spark, sf_dir, "conversations")
    parts = c.select(F.col("conv_id").alias("prompt"), F.col("turn").cast("string").alias("name"), "text", (F.col("turn") + 1).cast("int").alias("priority"), F.lit(False).alias("truncatable"), F.lit(0).alias("least"))
    out = budget.assembled(parts, "the prefix:", context=450, output=50, overhead=20)
    return out.filter("error IS NULL").select(F.col("prompt").alias("conv_id"), F.col("n_kept"), F.col("n_dropped"), "tokens")


@query(
    """WITH t AS (SELECT doc_id, text, ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) > 60 AND len(string_split(rtrim(text, chr(10)), chr(10))) = 1 AS cut, chr(10) || '...[1 lines omitted]' || chr(10) AS m, chr(10) || 'See the file.' AS p FROM documents WHERE length(text) > 0 AND len(string_split(rtrim(text, chr(10)), chr(10))) = 1),
r AS (SELECT *, """ + str(T.most_chars(60)) + """ - length(m) - length(p) AS room FROM t)
SELECT doc_id, CASE WHEN cut THEN substr(text, 1, (room + 1) // 2) || m || right(text, room // 2) || p ELSE text END AS capped FROM r"""
)
def capped_output(spark, sf_dir):
    """Outputs of one line over 60 tokens keep a head, a tail and a pointer; others stay."""
    d = table(spark, sf_dir, "documents").filter("length(text) > 0 AND size(split(rtrim('\n', text), '\n', -1)) = 1")
    return budget.capped(d.select("doc_id", "text"), "text", 60, "See the file.").select("doc_id", F.col("text").alias("capped"))


@query(
    """
WITH RECURSIVE l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, i, ceil(length(line) / 3.2::DOUBLE * 1.15::DOUBLE) + 4 AS size FROM l),
g(doc_id, i, used, part) AS (
  SELECT doc_id, i, size, 0 FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN g.used + s.size > 2000 THEN s.size ELSE g.used + s.size END, g.part + CASE WHEN g.used + s.size > 2000 THEN 1 ELSE 0 END FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1)
SELECT doc_id, part, min(i) AS start_line, max(i) AS end_line FROM g GROUP BY 1, 2"""
)
def file_parts(spark, sf_dir):
    """Files over 2000 tokens as contiguous parts of whole lines."""
    return budget.line_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 2000)


@query(
    """
WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(floor(value * 100) AS BIGINT) + 1 AS chars, CAST(floor(value * 25) AS BIGINT) + CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events),
g(user_id, i, ratio) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 3.2::DOUBLE FROM o
  UNION ALL
  SELECT o.user_id, o.i, CASE WHEN tokens <= 0 OR tokens < 0.6::DOUBLE * ceil(chars / ratio * 1.15::DOUBLE) THEN ratio ELSE 0.9::DOUBLE * ratio + 0.1::DOUBLE * (chars / tokens::DOUBLE) END FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1)
SELECT user_id, round(arg_max(ratio, i), 6) AS ratio FROM g GROUP BY 1"""
)
def calibrated_ratio(spark, sf_dir):
    """The moving ratio of characters to tokens, from calls in order; a call far under its estimate hit a cache."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    calls = e.select("user_id", "ts", "event_id", (F.floor(F.col("value") * 100) + 1).alias("chars"), (F.floor(F.col("value") * 25) + k).alias("tokens"))
    return budget.calibrated(calls, "user_id", ["ts", "event_id"])


@query(
    """
WITH RECURSIVE t AS (SELECT conv_id, turn, ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) + 8 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g(conv_id, i, turn, used, taken, took) AS (
  SELECT conv_id, 0::BIGINT, -1::BIGINT, 0::DOUBLE, 0, false FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, t.turn, used + CASE WHEN used + size <= 300 AND taken < 4 THEN size ELSE 0 END, taken + CASE WHEN used + size <= 300 AND taken < 4 THEN 1 ELSE 0 END, used + size <= 300 AND taken < 4 FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1)
SELECT conv_id, turn FROM g WHERE took"""
)
def rendered_blocks(spark, sf_dir):
    """Blocks that fit 300 tokens, at most four: one that doesn't fit is skipped, later ones may still come."""
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.tokens_by_ratio(F.col("text")).alias("size")))).alias("r"))
    taken = budget.rendered(F.transform("r", lambda x: x["size"]), 300, 8, 4)
    return rows.select("conv_id", F.explode(F.transform(taken, lambda i: F.col("r")[i]["turn"])).alias("turn"))
