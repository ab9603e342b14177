"""Benchmark decontamination with DataFrame operations only.

The benchmark's windows (10 words; a shorter item is one window) are cut into blocks. Any window of L words in a
document holds a whole block of (L + 1) // 2 words that starts at a multiple of that number, so only such aligned
blocks of the documents are hashed and looked up in the hash set of the benchmark's blocks, which is broadcast if it
has been counted to be small. The windows that a hit points to are then read from the text and compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import ascii_lower, broadcast_if_small, let, matching, whole_text, written

WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))


def _joined(words: Column, first: Column, n) -> Column:
    return F.array_join(F.slice(words, first + 1, n), " ")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size (words of the window), window (space-joined), each once."""
    words = items.select(F.col("item_id"), words_of(whole_text("text")).alias("w")).filter(F.size("w") > 0)
    sized = words.withColumn("size", F.least(F.size("w"), F.lit(window)))
    return sized.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: _joined(F.col("w"), i, F.col("size")))).alias("window")).distinct()


def _blocks(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, text_hash, size, at, block (hash) of the aligned blocks for windows of each size; a text is parsed once."""
    none = F.array().cast("array<struct<size:int,at:int,block:bigint>>")

    def cut(w: Column, size: int) -> Column:
        b = (size + 1) // 2
        found = F.transform(F.sequence(F.lit(0), F.size(w) - b, F.lit(b)), lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(_joined(w, i, b)).alias("block")))
        return F.when(F.size(w) >= size, found).otherwise(none)

    every = let(words_of(F.col("text")), lambda w: F.flatten(F.array(*(cut(w, n) for n in sizes))))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(every).alias("c")).select("doc_id", "text_hash", "c.size", "c.at", "c.block")


def benchmark_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, size, window: each place in documents (doc_id, text) where a benchmark window stands."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most WINDOW rows
    offsets = F.explode(F.expr("sequence(0, size - (size + 1) div 2)")).alias("offset")
    cut = windows.select("size", F.split("window", " ").alias("w")).select("size", "w", offsets)
    known = cut.select("size", F.col("offset").cast("int").alias("offset"), F.xxhash64(F.expr("array_join(slice(w, cast(offset as int) + 1, cast((size + 1) div 2 as int)), ' ')")).alias("block")).distinct()
    known = broadcast_if_small(written(known, "benchmark-blocks"))
    if not sizes:
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("window")).limit(0)
    places = _blocks(docs, sorted(sizes)).join(known, ["size", "block"]).filter(F.col("at") >= F.col("offset")).select("doc_id", "text_hash", F.struct((F.col("at") - F.col("offset")).alias("at"), "size").alias("place"))
    found = places.groupBy(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash")).agg(F.collect_set("place").alias("places"))
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    read = let(words_of(F.col("text")), lambda w: F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), _joined(w, p["at"], p["size"]).alias("window"))))
    both = texts.join(found, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")))
    read = both.select("doc_id", "text_hash", F.explode(read).alias("r")).select("doc_id", "text_hash", "r.at", "r.size", "r.window")
    return read.join(broadcast_if_small(windows.select("size", "window").distinct()), ["size", "window"], "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit (words within occurrences), n_items, items (their ids as text, sorted, comma-joined), contaminated.

    Null texts have no words. A null item_id adds hit words but no item. A null doc_id passes through, repeated rows count
    each, an empty table of documents gives no rows, an empty benchmark no hits; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    windows = written(benchmark_windows(items, window), "benchmark-windows")
    hits = benchmark_hits(rows, windows)
    by_window = windows.groupBy("size", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    found = hits.join(broadcast_if_small(by_window), ["size", "window"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "size")).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(p["at"], p["at"] + p["size"] - 1)))))
    found = found.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), n_hit.alias("n_hit"), "ids")
    counts = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    n = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"), (n > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window."""
    return matching(docs, decontaminate(docs, items).filter("contaminated"), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ia AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
ib AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ia),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM ib),
sizes AS (SELECT DISTINCT n FROM win),
da AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
occ AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM da) d JOIN win ON win.n = d.n AND win.t = d.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
