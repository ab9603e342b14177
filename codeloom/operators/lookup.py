"""Point, list and page lookups, the definition search, semi-joins by key, and rows by rank."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codeloom.operators import search
from codeloom.operators.order import numbered


def by_key(rows: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of a caller's values, pushed to the scan."""
    return rows.filter(F.col(key).isin(*values)) if values else rows.limit(0)


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("file_path") == path).orderBy("start_line", "id")


def open_work(files: DataFrame) -> DataFrame:
    """Files that are to be parsed: without a status yet, or pending; by path."""
    return files.filter("parse_status IS NULL OR parse_status = 'pending'").orderBy("path")


def pages(rows: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """Bounded pages in key order by keyset: each asks for what lies behind the last key, and nothing is skipped over."""
    last = None
    while page := (rows if last is None else rows.filter(F.col(key) > F.lit(last))).orderBy(key).limit(size).collect():
        yield page
        last = page[-1][key]


def page_numbers(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with page, the number of the keyset page (from 0) that each is on."""
    return numbered(rows, [key], "__place").withColumn("page", F.floor((F.col("__place") - 1) / size).cast("long")).drop("__place")


def definitions(queries: DataFrame, symbols: DataFrame, k: int = 100, near: int = 5) -> DataFrame:
    """query, id, rank, how, location: an exact id, else what a name lookup finds, else the nearest names by trigrams.
    symbols: id, qualname, name, file_path, start_line, end_line."""
    q = queries.select("query").distinct()
    exact = q.join(symbols.select(F.col("id").cast("string").alias("query"), "id"), "query").select("query", "id", F.lit(1).alias("rank"), F.lit("exact").alias("how"))
    rest = q.join(exact.select("query"), "query", "left_anti")
    named = search.name_lookup(rest, symbols, k).select("query", "id", "rank", F.lit("name").alias("how"))
    rest = rest.join(named.select("query").distinct(), "query", "left_anti")
    grams = search.trigram_topk(rest.select(F.col("query").alias("query_id"), F.col("query").alias("name")), symbols.select("id", F.col("qualname").alias("name")), near)
    found = exact.unionByName(named).unionByName(grams.select(F.col("query_id").alias("query"), "id", "rank", F.lit("near").alias("how")))
    place = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return found.join(symbols.select("id", place.alias("location")), "id").select("query", "id", "rank", "how", "location")


def hydrated(ranked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Ranked ids with their rows; the rank column keeps the order, ids without a row fall out."""
    return ranked.join(rows, key)


def by_hash(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """units (kind, id, embed_hash) with the vector of their hash (hash, vector); units of all kinds in one union."""
    return units.join(vectors.withColumnRenamed("hash", "embed_hash"), "embed_hash")


def members(groups: DataFrame, symbols: DataFrame) -> DataFrame:
    """Members (group, id, position) of features with their symbols."""
    return groups.join(symbols, "id")


def quoted(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """evidence (id, quote) with found, and first_line to last_line of the quote's first place; sources: id, raw_code,
    file_path, start_line. A quote of blanks is not found."""
    met = evidence.join(sources, "id", "left")
    at = F.expr("coalesce(instr(raw_code, quote), 0)")
    good = (at > 0) & (F.trim(F.regexp_replace("quote", r"\s", "")) != "")
    before = F.col("start_line") + newlines(F.expr(f"substring(raw_code, 1, coalesce(instr(raw_code, quote), 0) - 1)"))
    after = before + newlines(F.regexp_replace("quote", r"\n+\z", ""))
    cite = F.concat(F.lit("["), F.col("file_path"), F.lit(":"), before.cast("string"), F.lit("-"), after.cast("string"), F.lit("]"))
    return met.withColumn("found", good).withColumn("cite", F.when(good, cite)).select(*evidence.columns, "found", "cite")


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
