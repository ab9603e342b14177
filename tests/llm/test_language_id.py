import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import language_id as L


@pytest.fixture(scope="module")
def predicted(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    return docs.join(L.op9_language_id(spark, medium), "doc_id").collect()


def test_held_out_accuracy(predicted):
    out = [r for r in predicted if r["held_out"] and r["lang"] is not None]
    assert len(out) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.95


def test_fold_and_scores(predicted):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in predicted)
    assert all(0 <= r["score"] <= 1 for r in predicted)


def test_prediction_uses_the_text_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = L.learn(docs)
    a = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, net).collect()}
    changed = docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert {r["doc_id"] - 1000: r["lang_pred"] for r in L.predict(changed, net).collect()} == a


def test_held_out_labels_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(L.remainder(F.col("doc_id")) == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = L.learn(docs), L.learn(other)
    assert a.languages == b.languages and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))


def test_the_bound_on_hashes_keeps_the_smallest(spark):
    """A table with far more rows than the sample gives the sample that ranking all rows gives."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    usable = docs.filter(L.remainder(F.col("doc_id")) != 2).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(L.HASHES)))
    want = {lang: [r["text"] for r in usable.filter(F.col("lang") == lang).orderBy("h").limit(50).collect()] for lang in "ab"}
    seen = []
    orig = L.cut
    try:
        L.cut = lambda texts: seen.append(texts) or orig(texts)
        L.learn(docs, rows=50, chars=100)
    finally:
        L.cut = orig
    assert sorted(seen[0]) == sorted(t.encode() for ts in want.values() for t in ts)


def test_nulls_empty_long_repeated_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (None, "the cat", None), (4, "the cat " * 200_000, "en"), (5, "le chat et la souris", "fr"), (5, "le chat et la souris", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9)).withColumn("lettered", F.lit("x"))
    got = L.language_id(docs).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    none = L.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert L.language_id(docs.limit(0)).count() == 0
    kept = L.known_language(docs.union(spark.createDataFrame([(None, "?!", "en", 9, "x")], "doc_id long, text string, lang string, score int, lettered string")))
    assert kept.columns == docs.columns and sorted(r["text"][:7] for r in kept.collect()) == sorted(r[1][:7] for r in rows[3:])
