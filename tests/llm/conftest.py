"""Rows with the cases that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

CLASHING = "digest keep_id group_size text_hash lines key at n bucket fp component_id spans window size piece start length part h lettered score full".split()


def cases(docs) -> list[tuple]:
    rng = random.Random(11)
    passage = docs[3][1][:200] + " " + docs[5][1][:700]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    long = " ".join(word() for _ in range(40_000))
    line = "A line that stands in many documents"
    extra = [
        (None, "a text without an id"), (None, None), (None, docs[3][1]), (9001, None), (9002, ""), (9003, "\n\n"), (9004, " \t\r\n\x0b\x0c"), (9005, long), (9006, long), (9007, "x" * 30_000),
        (9008, docs[7][1]), (9008, docs[7][1]), (9009, f"one\n  {line.upper()} \nend"), (9010, f"{line}\n{line}\ntwo"), (9011, f"\t{line}"), (9012, line + " "),
        (9013, "é Ü ß Σ ς İ \U0001f600 \x1c\x1d日本語 é <|endoftext|> <|startoftext|>"), (9014, "before " + passage + " after"), (9015, passage * 2), (9016, "0123456789" * 90), (9017, "word"), (9018, "two words"), (9019, "Word"),
    ]
    return extra + [(i, t) for i, t in docs]


@pytest.fixture(scope="session")
def rows(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    return cases(docs)


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumn("lang", F.lit("en")).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
