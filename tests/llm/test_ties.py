"""Rows that tie on id and text: one of them stays in the exact and the near stage."""

from collections import Counter

import corpus_pipeline

TEXT, OTHER = "the same long text stands here " * 5, "quite another text with its own words in it " * 4
ROWS = [(None, TEXT, "a"), (None, TEXT, "b"), (None, TEXT, "c"), (5, OTHER, "a"), (5, OTHER, "b"), (4, OTHER, "a"), (7, None, "a"), (7, "", "b"), (8, "single", "a")]


def test_one_of_tied_rows_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(4)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in exact.collect()) == Counter({(None, TEXT): 1, (5, OTHER): 1, (7, ""): 1, (8, "single"): 1})
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in near.collect()) == Counter({(None, TEXT): 1, (4, OTHER): 1, (7, ""): 1, (8, "single"): 1})
