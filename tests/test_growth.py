"""What steps make and hold as tables grow: each case fails if a step grows faster than its input, or in one task."""

import functools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.code import extract, resolve
from codeloom.operators import graph, retrieval, search, walks
from codeloom.sources import shared

_PIECES = walks.pieces

FILE = "from a{k} import B{k}\n\n\nclass A{i}:\n    def run(self):\n        pass\n\n\ndef go():\n    x = A{i}()\n    x.run()\n    lost()\n"


def _tree(spark, n):
    rows = [(f"m{i}.py", "python", FILE.format(i=i, k=i % 3)) for i in range(n)] + [(f"a{k}.py", "python", f"class B{k}:\n    pass\n") for k in range(3)]
    return spark.createDataFrame(rows, "path string, language string, source string")


def test_a_method_name_of_many_classes_meets_open_sites_only(spark):
    parsed = extract.parse_files(_tree(spark, 120)).cache()
    symbols = extract.symbol_table(parsed).cache()
    _, found, _ = resolve.candidates(parsed, symbols)
    assert found.count() == 240  # of 120 constructors and 120 typed calls; not the 120 x 120 pairs of x.run and a run
    edges = resolve.call_edges(parsed, symbols)
    got = {(r["resolution"], r["kind"]): r["count"] for r in edges.groupBy("resolution", "kind").count().collect()}
    assert got == {("local", "constructor"): 120, ("typed", "call"): 120, ("external", "call"): 120}


def test_an_open_site_keeps_all_its_candidates(spark):
    rows = [(f"m{i}.py", "python", f"class A{i}:\n    def run(self):\n        pass\n") for i in range(30)] + [("use.py", "python", "def go(x):\n    x.run()\n")]
    parsed = extract.parse_files(spark.createDataFrame(rows, "path string, language string, source string"))
    edges = resolve.call_edges(parsed, extract.symbol_table(parsed)).filter("caller = 'use.py::go'").collect()
    assert {(r["callee"], r["resolution"], r["confidence"]) for r in edges} == {(f"m{i}.py::A{i}.run", "ambiguous", 0.4) for i in range(30)}


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    parsed = extract.parse_files(_tree(spark, 1200).coalesce(1))
    sizes = [r["count"] for r in parsed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1203 and len(sizes) > 8 and max(sizes) < 150


def _brute(near, seed, depth):
    """node -> [least depth, number] of the simple walks from a seed."""
    got, open_ways = {}, [[seed]]
    for d in range(1, depth + 1):
        open_ways = [[*w, b] for w in open_ways for b in near.get(w[-1], ()) if d == 1 or b not in w]
        for w in open_ways:
            got.setdefault(w[-1], [d, 0])[1] += 1
    return got


def _lists(n, rows):
    a, b = (np.array(x, np.int64) for x in zip(*rows))
    return walks.Lists(n, a, b, np.arange(len(a)))


def test_walks_in_pieces_are_all_walks(monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(30)) for _ in range(140)] + [(4, 4), (4, 4), (5, 5)]
    near = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
    want = {(s, v, *x) for s in range(30) for v, x in _brute(near, s, 3).items()}
    for most in (1, 7, 10**6):
        monkeypatch.setattr(walks, "pieces", functools.partial(_PIECES, most=most))
        got = [tuple(map(int, r)) for part in walks._reached(np.arange(30), _lists(30, rows), 3) for r in zip(*part)]
        assert len(got) == len(want) and set(got) == want


def test_shortest_paths_in_small_groups_are_the_least(monkeypatch):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(110)})
    near = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
    want = {}
    for s in range(40):
        ways = [[s]]
        for _ in range(5):
            ways = sorted([*w, b] for w in ways for b in near.get(w[-1], ()) if b not in w)
            for w in ways:
                want.setdefault((s, w[-1]), w)
    ends = np.array([(a, b) for a in range(40) for b in range(40) if a != b])
    for most in (1, 40, 10**6):
        monkeypatch.setattr(walks, "ROWS", most)
        found = walks._shortest(ends[:, 0], ends[:, 1], _lists(40, rows), _lists(40, [(b, a) for a, b in rows]), 5)
        got = {tuple(ends[p]): [int(c[i]) for c in path] for pairs, path in found for i, p in enumerate(pairs)}
        assert got == {k: v for k, v in want.items() if k[0] != k[1]}


@pytest.mark.parametrize("make", [lambda v, e: graph.reached(v, e, 3), lambda v, e: graph.trace(v, e, 3, 0.0), lambda v, e: graph.impact_groups(v, e, v.withColumn("file", F.lit("f")), 2)])
def test_rows_of_walks_are_never_shuffled(spark, make):
    e = spark.createDataFrame([(1, 2, 1, 0.9), (2, 3, 1, 0.9), (900, 1, 1, 0.9)], "caller long, callee long, line int, confidence double")
    plan = make(spark.createDataFrame([(1,), (2,), (3,), (900,)], "id long"), e)._jdf.queryExecution().sparkPlan().toString()
    above, made, _ = plan.partition("MapInArrow")
    assert made and "Exchange" not in above and "Aggregate" not in above and "Join" not in above


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_distances_are_held_by_tiles(metric):
    rng = np.random.default_rng(1)
    mat, v = rng.normal(size=(2048, 16)), rng.normal(size=(20_000, 16))
    v[5000:9000] = v[17]  # a large group of equal vectors
    mat[3] = v[17]
    v[2] = np.nan
    ids, own = np.arange(2048) * 3, rng.permutation(20_000)
    tracemalloc.start()
    got = search._nearest(ids, mat, own, v, 5, metric)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 150e6  # all distances are 328 MB
    for q in (0, 3, 1000, 2047):
        d = np.sqrt(((v - mat[q]) ** 2).sum(1)) if metric == "l2" else 1 - (v @ mat[q]) / (np.sqrt((v * v).sum(1)) * np.sqrt((mat[q] ** 2).sum()))
        want = sorted((x if x == x else 9e9, int(i)) for x, i in zip(np.round(d, 6), own))[:5]
        mine = got[0] == 3 * q
        assert [(float(x), int(i)) for x, i in zip(got[2][mine], got[1][mine])] == [(float(x), i) for x, i in want]


def test_one_block_scores_as_postings_do(spark, small, monkeypatch):
    d = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    d = d.unionByName(spark.createDataFrame([(-5, None), (-6, ""), (-7, "the " * 1500 + "value")], "id long, text string"))
    q = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    q = q.unionByName(q.select((F.col("query_id") + 1000).alias("query_id"), "text")).unionByName(spark.createDataFrame([(-1, "value"), (-2, None), (-3, "zzz none")], "query_id long, text string"))
    block = search.lexical_topk(q, d, 7)
    assert "MapInArrow" in block._jdf.queryExecution().sparkPlan().toString()
    got = Counter(tuple(r) for r in block.collect())
    assert got == Counter(tuple(r) for r in search.lexical_topk(q, None, 7, search.postings(d, "text")).collect())
    twice = d.unionByName(d.filter("id = -7"))  # a unit in two rows is one unit
    assert Counter(tuple(r) for r in search.lexical_topk(q, twice, 7).collect()) == Counter(tuple(r) for r in search.lexical_topk(q, None, 7, search.postings(twice, "text")).collect())


@pytest.mark.parametrize("kind", ["text", "name"])
def test_equal_queries_are_asked_once_and_not_broadcast(spark, kind):
    q = spark.range(4000).select(F.col("id").alias("query_id"), F.concat(F.lit("red bolt "), F.col("id") % 3).alias(kind))
    u = spark.createDataFrame([(1, "red bolt 1"), (2, "blue ring"), (3, "red nut 2")], f"id long, {kind} string")
    df = search.lexical_topk(q, None, 2, search.postings(u, "text")) if kind == "text" else search.trigram_topk(q, u, 2)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    got = df.groupBy("query_id").count().collect()
    assert len(got) == 4000 and len({tuple(r)[1:] for r in df.join(q, "query_id").filter("query_id % 3 = 1").select("query_id", "id", "score", "rank").collect()}) == (2 if kind == "text" else 1)


def test_answers_leave_texts_where_they_are(spark, small):
    from codeloom.plans import every

    seen = []
    listener = search.small
    try:
        search.small = lambda df, rows=search.SMALL_ROWS: seen.append(df.columns) or listener(df, rows)
        assert every.QUERIES["answer_pipeline"](spark, small).count() > 0
    finally:
        search.small = listener
    assert ["query_id", "id", "score", "rank"] in seen


def test_scope_takes_a_modules_first_and_what_was_found(spark):
    rng = random.Random(7)
    symbols = [(i, f"m/b{i % 3}.py", rng.randrange(9)) for i in range(60)]
    found = {(q, rng.randrange(60)): rng.choice([-0.5, 0.0, 0.25, 1.0]) for q in range(20) for _ in range(8)}
    asked = {q: f"m/b{q % 5}.py" if q % 2 else None for q in range(20)}
    want = set()
    for q, file in asked.items():
        rows = [(-found.get((q, i), 0.0), line, i) for i, f, line in symbols if f == file] or [(-s, 0, i) for (p, i), s in found.items() if p == q]
        want |= {(q, x[2], n) for n, x in enumerate(sorted(rows)[:5], 1)}
    questions = spark.createDataFrame([(q, f"what is in {f[:-3].replace('/', '.')}?" if f else "what?") for q, f in asked.items()], "query_id long, text string")
    df = retrieval.scoped(questions, spark.createDataFrame([(*k, s) for k, s in found.items()], "query_id long, id long, score double"), spark.createDataFrame(symbols, "id long, file_path string, start_line int"), 5)
    assert {tuple(r) for r in df.collect()} == want
    assert "windowspecdefinition(file_path" in df._jdf.queryExecution().sparkPlan().toString()  # a module isn't met whole


def test_lists_are_not_broadcast_by_an_estimate(spark):
    lists = spark.range(50).select(F.col("id").alias("query_id"), F.posexplode(F.array("id", F.col("id") + 1)).alias("at", "id")).select("query_id", "id", (F.col("at") + 1).alias("rank"))
    plan = retrieval.expanded(lists, spark.createDataFrame([(1, 2, 0.9)], "caller long, callee long, confidence double"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_ranks_and_fans_make_the_graph_once(spark, small):
    from codeloom.plans import every

    assert "l_orderkey" not in every.QUERIES["hubs"](spark, small)._jdf.queryExecution().sparkPlan().toString()


def test_calls_are_dealt_by_their_number(spark, small, monkeypatch):
    from codeloom.plans import catalog

    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assert catalog.ranked_calls(spark, small).rdd.getNumPartitions() == -(-rows // 100)


def test_a_scan_is_read_by_many_tasks(spark, small, tmp_path, monkeypatch):
    from codeloom.plans import every, source_plans

    spark.read.parquet(f"{small}/documents.parquet").repartition(5).write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(source_plans, "scratch", lambda *_: f"{tmp_path}/scans")
    monkeypatch.setattr(source_plans, "table", lambda spark, at, name: spark.read.option("maxPartitionBytes", 1).parquet(f"{at}/{name}.parquet").repartition(5, "doc_id"))
    got = Counter(tuple(r) for r in every.QUERIES["stream_file_sync"](spark, f"{tmp_path}/sf").collect())
    assert len(list((tmp_path / "scans/in").glob("*.parquet"))) > 2
    monkeypatch.undo()
    assert got == Counter(tuple(r) for r in every.QUERIES["stream_file_sync"](spark, small).collect())
