"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import pytest

import corpus_pipeline
from codeloom.llm import language_id
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], small).write.parquet(str(base / str(k)))
        tables.append(spark.read.parquet(str(base / str(k))))
    return tables


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns_and_only_lose_rows(stages):
    for before, after in zip(stages[:-1], stages[1:-1]):
        assert after.columns == before.columns
        assert not Counter(map(str, after.collect())) - Counter(map(str, before.collect()))


def test_language(stages, spark):
    kept = {i for i, _ in rows(stages[1])}
    scored = language_id.language_id(stages[0]).collect()
    assert kept == {r["doc_id"] for r in scored if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE}


def test_exact(stages):
    before = rows(stages[1])
    assert Counter(rows(stages[2])) == Counter(r for r, (i, k, _) in zip(before, brute.exact(before)) if i == k)


def test_near(stages):
    before = rows(stages[2])
    assert Counter(rows(stages[3])) == Counter(r for r, (i, _, c) in zip(before, brute.near(before)) if i == c)


def test_benchmark(stages, spark, small):
    before = rows(stages[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert Counter(rows(stages[4])) == Counter(r for r, w in zip(before, brute.contaminated(before, items)) if not w[-1])


def test_packing_holds_all_that_is_left(stages):
    want = Counter()
    for i, t in rows(stages[4]):
        ids = [*brute.ids(t), 1]
        for s in range(0, len(ids), 4096):
            want[i, s, brute.crc(ids[s : s + 4096])] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in stages[5].collect()) == want


def test_run_is_the_stages(stages, spark, small):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).select(*cols).collect())) == Counter(map(tuple, stages[5].select(*cols).collect()))
