"""Line deduplication with levelled sorted runs of line hashes; DataFrame operations only.

Documents come in batches. A batch is summed to (line hash, documents, largest doc_id) and merge-anti-joined with the runs:
lines that no run has become a sorted run of its own, so every hash lies in exactly one run; the others are kept as the
batch's repeats. FAN runs of a level are compacted to one run of the next. A line's total is its run's count and its
repeats'. Hashes have 128 bits. The hot line is summed before each shuffle, and the join of lines with frequent hashes is an
equi-join that adaptive execution splits where one hash is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import BLANKS, ascii_lower, let, whole_text, written

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
BATCHES, FAN = 4, 2
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Runs by level, no hash in two of them, and the repeats of each batch. A row: h1, h2, documents, last_id (largest
    doc_id)."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels, self.repeats = fan, [], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _known(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (r.select(*KEY) for r in self.runs())).hint("merge")

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, doc_id, one row for each line hash of each document."""
        sums = batch.groupBy(*KEY).agg(F.count("*").alias("documents"), F.max("doc_id").alias("last_id"))
        if self.runs():
            sums = written(sums, "line-sums")
            self.repeats.append(written(sums.join(self._known(), KEY, "left_semi"), "line-repeats"))
            sums = sums.join(self._known(), KEY, "left_anti")
        self._put(0, sums)

    def _put(self, level: int, rows: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(written(rows.sortWithinPartitions(*KEY), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fan:
            merged = reduce(DataFrame.unionByName, self.levels[level]).repartition(*KEY)
            self.levels[level] = []
            self._put(level + 1, merged)

    def frequent(self, least: int) -> DataFrame:
        """h1, h2, last_id of lines in at least so many documents."""
        if not self.runs():
            raise ValueError("no batch was added")
        totals = reduce(DataFrame.unionByName, self.runs())
        if self.repeats:
            again = reduce(DataFrame.unionByName, self.repeats).groupBy(*KEY).agg(F.sum("documents").alias("more"), F.max("last_id").alias("later"))
            joined = totals.join(again, KEY, "left")
            totals = joined.select(*KEY, (F.col("documents") + F.coalesce("more", F.lit(0))).alias("documents"), F.greatest("last_id", "later").alias("last_id"))
        return totals.filter(F.col("documents") >= least).select(*KEY, "last_id")


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text_hash, drops (positions from 0 of the lines that go), for documents (doc_id, text) that lose any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    keys = F.filter(F.array_distinct(F.transform("lines", line_key)), lambda k: F.char_length(k) >= least_chars)
    runs = LineRuns()
    for k in range(batches):
        part = keyed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else keyed
        runs.add(part.select("doc_id", F.explode(keys).alias("key")).select("doc_id", *hashed(F.col("key"))))
    frequent = written(runs.frequent(least_documents), "frequent-lines")
    lines = keyed.select("doc_id", "text_hash", F.posexplode(F.transform("lines", line_key)).alias("at", "key")).filter(F.char_length("key") >= least_chars)
    hits = lines.select("doc_id", "text_hash", "at", *hashed(F.col("key"))).join(frequent, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    return hits.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.collect_list("at")).alias("drops"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each row of docs.

    A line's key is stripped of ASCII white space and A-Z lower-cased. A key of at least 20 code points in at least 3
    rows loses its lines everywhere but in the rows with the largest doc_id that has it. Null text is one empty line, a
    null id is smaller than any other, repeated rows count each, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    drops = dropped_lines(rows, **limits).select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "drops")
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left")
    kept = let(lines_of(F.col("text")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda i: F.get(lines, i)), "\n"))
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
