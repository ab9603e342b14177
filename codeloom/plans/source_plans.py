"""Queries of sources, sinks, settings, suites and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.plans.catalog import query, table
from codeloom.sources import files, models, suites
from codeloom.sources.shared import scratch
from codeloom.streaming import micro_batches as mb

_TREE = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'src/m' || page_id || '.py' WHEN 1 THEN 'node_modules/x' || page_id || '.js' WHEN 2 THEN 'conf/.env.p' || page_id WHEN 3 THEN 'a/Cargo.lock' WHEN 4 THEN 'gen/out' || page_id || '.py' WHEN 5 THEN 'gen/keep' || page_id || '.TOML' WHEN 6 THEN 'docs/t' || page_id || '.log' WHEN 7 THEN 'bin/b' || page_id || '.dat' ELSE 'c' || page_id || '.yml' END AS path FROM pages"""


@query(
    f"""SELECT path, octet_length(encode(html)) AS size_bytes, sha256(html) AS sha256, CASE WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(lower(path), '\\.(toml|yml)$') THEN 'config' ELSE 'other' END AS language, CAST(len(string_split(html, chr(10))) AS INTEGER) AS line_count
FROM ({_TREE}) t JOIN pages USING (page_id) WHERE page_id % 9 NOT IN (1, 2, 3, 6, 7) AND NOT (page_id % 9 = 4) AND octet_length(encode(html)) <= 6000 AND (html = '' OR length(html) / len(string_split(html, chr(10)))::DOUBLE <= 1000)"""
)
def file_discovery(spark, sf_dir):
    """Which files of a tree are read: no excluded folder, secret, lock file, ignored path, binary, long-lined or large file."""
    p = table(spark, sf_dir, "pages")
    path = F.expr(_TREE.removeprefix("SELECT page_id, ").removesuffix(" AS path FROM pages"))
    content = F.when(F.col("page_id") % 9 == 7, F.concat(F.col("html").cast("binary"), F.lit("\x00").cast("binary"))).otherwise(F.col("html").cast("binary"))
    raw = p.select(path.alias("path"), content.alias("content")).withColumn("size_bytes", F.octet_length("content"))
    kept = files.selected(raw, ["*.log", "gen/*", "!gen/keep*"], 6000)
    return kept.select("path", "size_bytes", "sha256", "language", "line_count")


_IGNORED = ["# comment", "", "*.log", "/build", "docs/**/*.tmp", "!important.log", "cache/"]


@query("SELECT doc_id, doc_id % 7 IN (0, 2, 4, 5) AS ignored FROM documents")
def ignore_rules(spark, sf_dir):
    """Paths under ignore rules: the last rule that matches decides."""
    forms = ["a/x.log", "a/important.log", "build/x.py", "a/build/x.py", "docs/a/b/x.tmp", "q/cache/x", "notes.txt"]
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 7 + 1).cast("int")).alias("path"))
    return d.select("doc_id", files.ignored(F.col("path"), _IGNORED).alias("ignored"))


@query("SELECT event_type AS task, count(*) AS calls, CAST(count(*) FILTER (event_id % 7 <> 0) AS BIGINT) AS valid, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def call_log(spark, sf_dir):
    """Calls appended to two logs in three writes, and read back as one."""
    e = table(spark, sf_dir, "events")
    calls = e.select("event_id", "ts", F.col("event_type").alias("task"), F.col("user_id").cast("string").alias("symbol_id"), F.lit(1).cast("long").alias("est_prompt_tokens"), F.lit(None).cast("long").alias("actual_prompt_tokens"), F.floor("value").cast("long").alias("output_tokens"), F.lit(0.5).alias("latency_s"), F.when(F.col("event_id") % 7 != 0, "ok").otherwise("failed").alias("validation"), F.lit(1).alias("attempt"))
    folder = scratch(spark, "calls")
    for k, name in enumerate(("a", "b", "a")):
        models.append_calls(calls.filter(F.col("event_id") % 3 == k), folder, name)
    back = models.read_calls(spark, folder)
    return back.groupBy("task").agg(F.count("*").alias("calls"), F.count_if(F.col("validation") == "ok").alias("valid"), F.sum("output_tokens").alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) + 100 <= 400 THEN array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5], ' ') END AS reply, CASE WHEN ceil(length(text) / 3.2::DOUBLE * 1.15::DOUBLE) + 100 > 400 THEN 'BudgetExceeded' END AS error FROM conversations")
def model_replies(spark, sf_dir):
    """A stand-in model on prompts that fit; others are refused before they are sent."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    ids = c.select(F.concat_ws(":", "key.conv_id", "key.turn").alias("id"), F.col("text").alias("prompt"), "key")
    out = models.replies(ids, models.EchoGenerator(5), 400, 100)
    return ids.select("id", "key").join(out, "id").select("key.*", "reply", "error")


@query("SELECT item_id, 'v0' AS model, round(CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) / 65535.0::DOUBLE, 6) AS first, round(CAST('0x' || substr(sha256(text), 61, 4) AS BIGINT) / 65535.0::DOUBLE, 6) AS last FROM benchmark")
def embedding_source(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("hash", F.sha2("text", 256))
    v = models.embedded(b.select("hash", "text").dropDuplicates(["hash"]), models.HashEmbedder(16))
    return b.join(v, "hash").select("item_id", F.lit("v0").alias("model"), F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[15], 6).alias("last"))


@query("SELECT * FROM (VALUES ('num_ctx', '4096', 'env'), ('max_file_bytes', '500000', 'default'), ('edge_conf_threshold', '0.75', 'file'), ('retrieval_top_k', '9', 'env'), ('rrf_k', '60', 'default'), ('graph_expansion', 'True', 'file'), ('embed_model', 'nomic-embed-text', 'default')) AS t(name, value, origin)")
def settings(spark, sf_dir):
    import dataclasses

    got, origin = suites.load_settings("edge_conf_threshold = 0.75\ngraph_expansion = true\nretrieval_top_k = 7\n", {"CODELOOM_NUM_CTX": "4096", "CODELOOM_RETRIEVAL_TOP_K": "9"})
    return spark.createDataFrame([(k, str(v), origin[k]) for k, v in dataclasses.asdict(got).items()], "name string, value string, origin string")


@query("SELECT 'q' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'symbol' ELSE 'traversal' END AS type, 'where is ' || n_name || '?' AS question, n_nationkey % 3 = 0 AS verified, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE NULL END AS first_symbol, CASE WHEN n_nationkey % 2 = 1 THEN 2 ELSE -1 END AS path_length FROM nation")
def question_suite(spark, sf_dir):
    """A suite in YAML, made from the nations, read and validated."""
    lines = ["version: 1", "questions:"]
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # a dimension of 25 rows
        k, name = r["n_nationkey"], r["n_name"]
        lines += [f"- id: q{k}", f"  type: {'traversal' if k % 2 else 'symbol'}", f'  question: "where is {name}?"', f"  verified: {str(k % 3 == 0).lower()}"]
        lines += [f'  source: "{name}"', '  target: "x"', f'  expected: {{ordered_symbols: ["{name}", "x"]}}'] if k % 2 else [f'  expected: {{symbols: ["{name}"]}}']
    q = suites.read_suite(spark, "\n".join(lines))
    return q.select("id", "type", "question", "verified", F.get("symbols", F.lit(0)).alias("first_symbol"), F.coalesce(F.size("ordered_symbols"), F.lit(-1)).alias("path_length"))


@query("SELECT c_custkey, c_name, upper(c_mktsegment) AS segment, 2 AS version, '2,3' AS applied FROM customer")
def snapshot_migration(spark, sf_dir):
    """A table of version 1 written, read, migrated in order to version 3, written and read again."""
    folder = scratch(spark, "snapshots")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("kind"))
    suites.write_snapshot(c, folder, "customer", 1)
    steps = {1: lambda df: df.drop("c_name"), 2: lambda df: df.withColumnRenamed("kind", "segment").withColumn("version", F.lit(2)), 3: lambda df: df.withColumn("segment", F.upper("segment"))}
    after, applied = suites.migrate(suites.read_snapshot(spark, folder, "customer", c.schema), 1, steps)
    suites.write_snapshot(after, folder, "customer", applied[-1])
    return suites.read_snapshot(spark, folder, "customer").withColumn("applied", F.lit(",".join(map(str, applied))))


@query("SELECT '{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\"' || CASE WHEN p_size > 25 THEN ',\"size\":' || p_size ELSE '' END || '}' AS value FROM part")
def result_lines(spark, sf_dir):
    """Results as JSON lines, through a file."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    path = scratch(spark, "lines")
    suites.result_lines(p).write.text(path)
    return spark.read.text(path)


@query("SELECT * FROM (VALUES ('spark 4', true), ('adaptive execution', true), ('shared folder', true), ('table part', true), ('table no_such_table', false)) AS t(\"check\", ok)")
def doctor(spark, sf_dir):
    return suites.doctor(spark, sf_dir, ["part", "no_such_table"])


# ---- streams


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    out = scratch(spark, "windows")
    events = mb.table_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = mb.windowed_counts(events, "ts", "event_type", "6 hours", "31 days")
    return mb.latest_output(counts, f"{out}/rows", f"{out}/state").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id AS session, count(*) AS turns, max(turn) AS last_turn, string_agg(turn || ':' || role, ',' ORDER BY turn) FILTER (n <= 4) AS kept FROM t GROUP BY 1")
def stream_session_memory(spark, sf_dir):
    """Conversations as a stream of three batches; the state of a session is its last four turns."""
    out = scratch(spark, "sessions")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role")
    for k in range(3):
        c.filter(F.col("turn") % 3 == k).coalesce(1).write.mode("append").parquet(f"{out}/in")
    memory = mb.session_memory(mb.table_stream(spark, f"{out}/in", "*.parquet"))
    return mb.last_of_each(memory, "session", "turns", f"{out}/rows", f"{out}/state")


@query("SELECT doc_id || '.py' AS path, sha256(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS sha256, lang AS language, CASE WHEN lang = 'fr' AND source <> 'src1' THEN 'pending' END AS parse_status FROM documents")
def stream_file_sync(spark, sf_dir):
    """Two scans as two batches of a stream: what changes between them is pending, what is new or unchanged isn't."""
    out = scratch(spark, "scans")
    d = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".py")).alias("path"), "text", F.col("lang").alias("language"), "source")
    first = d.filter("source <> 'src1'").select("path", F.sha2("text", 256).alias("sha256"), "language", F.lit(1).alias("scanned_at"))
    second = d.select("path", F.sha2(F.when(F.col("language") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"), "language", F.lit(2).alias("scanned_at"))
    for scan in (first, second):
        # each scan is what is new when the stream goes on, so it is one batch of as many files as it has tasks
        scan.write.mode("append").parquet(f"{out}/in")
        files = mb.synced_files(mb.table_stream(spark, f"{out}/in", "*.parquet", 1_000_000), f"{out}/files", f"{out}/state")
    return files
