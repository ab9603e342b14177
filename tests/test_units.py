"""Cases of single operators that the tables don't have."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.code import extract, resolve
from codeloom.functions import text as T
from codeloom.operators import budget, evaluation, flow, graph, knowledge, lookup, maintenance, retrieval
from codeloom.sources import files, models, suites
from codeloom.streaming import micro_batches as mb


def rows(df, *columns):
    return Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# ---- budgets


def test_truncation_keeps_both_ends():
    text = "\n".join(f"line {k} of many lines in this text" for k in range(60))
    cut = budget.truncated(text, 120, "See the log.")
    assert budget.estimate(cut) <= 120 and cut.startswith("line 0") and cut.endswith("See the log.") and "lines omitted" in cut
    longer = [n for n in range(2, 60) if budget.estimate(budget.truncated(text, 120)) > 120]
    assert not longer and budget.truncated("short", 10) == "short"
    assert budget.truncated("x" * 5000, 60).startswith("xx") and budget.estimate(budget.truncated("x" * 5000, 60)) <= 60
    assert budget.truncated("x" * 5000, 1) == ""


def part(name, text, priority, truncatable=False, least=0):
    return {"name": name, "text": text, "priority": priority, "truncatable": truncatable, "least": least}


def test_assembly():
    must, big, last = part("must", "m" * 100, 1), part("big", "b" * 600, 2, True), part("last", "l" * 300, 3)
    assert budget.assemble("p", [must, big, last], 1000) == ("\n\n".join(["p", "m" * 100, "b" * 600, "l" * 300]), [], [])
    prompt, gone, cut = budget.assemble("p", [must, big, last], 150)
    assert gone == ["last"] and cut == ["big"] and budget.estimate(prompt) <= 150
    prompt, gone, cut = budget.assemble("p", [must, big | {"least": 200}, last], 150)
    assert gone == ["last", "big"] and not cut
    with pytest.raises(budget.BudgetExceeded):
        budget.assemble("p", [must], 20)
    with pytest.raises(budget.BudgetExceeded):
        budget.assemble("p" * 500, [], 20)


def test_symbol_splitting():
    code = "def f(a):\n    x = 1\n" + "    y = call(a, x)\n" * 20
    chunks = extract.split_symbol(code, 10, 60)
    assert chunks[0][0] == 11 and chunks[-1][1] == 31 and all(c[2].startswith("def f(a):\n") for c in chunks)
    assert [b + 1 for _, b, _ in chunks[:-1]] == [a for a, _, _ in chunks[1:]]
    assert extract.split_symbol("a = 1\n", 5, 50) == [(5, 5, "a = 1\n")]
    with pytest.raises(budget.BudgetExceeded):
        extract.split_symbol(code, 1, 8)
    with pytest.raises(budget.BudgetExceeded):
        extract.split_symbol("def broken(:\n" * 30, 1, 20)


# ---- code


SOURCE = '''import a.b
import os as system
from . import near
from .pkg import thing as other

__all__ = ["run"]


@app.route("/x")
async def run(x: "Optional[Foo]", *rest: int, **more) -> str:
    """Doc."""
    y: Bar = Bar(1)
    if x:
        for z in rest:
            with open(z) as f:
                await go(f.read())
    try:
        pass
    except ValueError:
        def inner():
            return deep()
    return a() if x.ok() else b()


class K(Base, pkg.Other):
    attr = field()

    def __init__(self, dep: Dep | None):
        self.dep = dep
        self.made = make()
        self.kind: Kind = None


if __name__ == "__main__":
    run([n for n in items()])
'''


def test_extraction():
    got = extract.parse_python("x/mod.py", SOURCE)
    s = {x["qualname"]: x for x in got["symbols"]}
    assert got["parse_error"] is None and got["exports"] == ["run"] and got["main_guard"] and len(got["imports"]) == 4
    assert set(s) == {"run", "run.inner", "K", "K.__init__", "mod::<module>"}
    run = s["run"]
    assert (run["kind"], run["start_line"], run["is_async"], run["docstring"]) == ("function", 9, True, "Doc.")
    assert run["signature"] == "async x: 'Optional[Foo]', *rest: int, **more -> str"
    assert run["param_types"] == {"x": "Foo", "rest": "int"} and run["local_types"] == {"y": "Bar"}
    sites = [(c["expr"], c["kind"], c["control_ctx"]) for c in run["call_sites"]]
    assert sites == [("app.route", "decorator", ""), ("Bar", "call", ""), ("open", "call", "if>for>with"), ("go", "call", "if>for>with"), ("f.read", "call", "if>for>with"), ("x.ok", "call", ""), ("a", "call", "if x.ok()"), ("b", "call", "if not (x.ok())")]
    assert s["run.inner"]["kind"] == "nested" and s["run.inner"]["parent_qualname"] == "run"
    assert s["K"]["bases"] == ["Base", "pkg.Other"] and [c["expr"] for c in s["K"]["call_sites"]] == ["field"]
    assert s["K"]["init_attrs"] == {"dep": "Dep", "made": "make", "kind": "Kind"}
    assert [c["control_ctx"] for c in s["mod::<module>"]["call_sites"]] == ["if", "if>comp"]
    assert "async def run(x: 'Optional[Foo]', *rest: int, **more) -> str:" in got["skeleton"] and "class K(Base, pkg.Other):" in got["skeleton"]


@pytest.mark.parametrize("source", ["def broken(:\n", "x = 1\0", "", "\ufeffx = 1\n"])
def test_odd_sources(source):
    got = extract.parse_python("a.py", source)
    assert got["symbols"] == [] and (got["parse_error"] is None) == (source == "")


@pytest.mark.parametrize(
    "code, want",
    [
        ("def f(self):\n    pass", True), ("def f():\n    '''Doc.'''", True), ("def f():\n    raise NotImplementedError('x')", True), ("def f():\n    raise ValueError", False),
        ("def f(self, x):\n    self.x = x", True), ("def f(self):\n    return self.x", True), ("def f(self, a, b):\n    return g(a, b)", True), ("def f(self, a, b):\n    return g(b, a)", False),
        ("def f(a):\n    return g(a, 1)", False), ("def f(a):\n    return g(k=a)", True), ("def f():\n    return 3", False), ("def f():\n    return", False), ("def f():\n    a()\n    b()", False), ("class C:\n    pass", True), ("not code (", True),
    ],
)
def test_trivial(code, want):
    assert extract.is_trivial("function", "f", code) is want


def test_trivial_by_name_and_kind():
    assert extract.is_trivial("module", "m", "a()\nb()") and extract.is_trivial("method", "__repr__", "def __repr__(self):\n    a()\n    b()")


def test_decoding():
    assert extract.decode_source("# coding: latin-1\né".encode("latin-1")).endswith("é")
    assert extract.decode_source(b"\xef\xbb\xbfx = 1") == "x = 1"
    assert extract.decode_source(b"x = '\xff'") == "x = '\ufffd'"
    assert extract.decode_source(b"# coding: nonsense\nx") == "# coding: nonsense\nx"


TREE = {
    "src/lib/__init__.py": "from .core import Thing as Renamed\nfrom . import util\n",
    "src/lib/core.py": "class Thing:\n    def go(self):\n        self.gone()\n\n    def gone(self):\n        pass\n",
    "src/lib/util.py": "def shared():\n    pass\n\n\ndef shared():\n    return 1\n\n\ndef twice():\n    shared()\n",
    "app.py": "import lib.core\nfrom lib import Renamed, util\n\n\nclass A:\n    def m(self): ...\n\n\nclass B(A):\n    def x(self): ...\n\n\nclass C(B, A):\n    def k(self):\n        self.m()\n        super().x()\n\n\ndef run(t: Renamed):\n    t.go()\n    lib.core.Thing()\n    util.twice()\n    a.close()\n    run()\n\n\ndef other(q):\n    q.shared()\n    q.unseen.k()\n",
}


def edges_of(spark, tree):
    given = spark.createDataFrame([(p, "python", s) for p, s in tree.items()], "path string, language string, source string")
    parsed = extract.parse_files(given)
    symbols = extract.symbol_table(parsed)
    return rows(resolve.call_edges(parsed, symbols), "caller", "callee", "resolution", "confidence"), rows(symbols, "id")


def test_resolution(spark):
    got, ids = edges_of(spark, TREE)
    util = "src/lib/util.py::shared"
    assert (f"{util}@1",) in ids and (f"{util}@5",) in ids
    want = {
        ("src/lib/core.py::Thing.go", "src/lib/core.py::Thing.gone", "self", 0.9): 1,
        ("src/lib/util.py::twice", f"{util}@1", "ambiguous", 0.4): 1,
        ("src/lib/util.py::twice", f"{util}@5", "ambiguous", 0.4): 1,
        ("app.py::C.k", "app.py::A.m", "self", 0.9): 1,
        ("app.py::C.k", "app.py::B.x", "super", 0.9): 1,
        ("app.py::C.k", None, "external", 0.0): 1,
        ("app.py::run", "src/lib/core.py::Thing.go", "typed", 0.8): 1,
        ("app.py::run", "src/lib/core.py::Thing", "import", 0.95): 1,
        ("app.py::run", "src/lib/util.py::twice", "import", 0.95): 1,
        ("app.py::run", None, "external", 0.0): 1,
        ("app.py::run", "app.py::run", "local", 0.9): 1,
        ("app.py::other", f"{util}@1", "ambiguous", 0.4): 1,
        ("app.py::other", f"{util}@5", "ambiguous", 0.4): 1,
        ("app.py::other", "app.py::C.k", "name-unique", 0.75): 1,
    }
    assert got == Counter(want)


def test_resolution_of_nothing(spark):
    got, ids = edges_of(spark, {"a.py": "", "b.py": "def broken(:"})
    assert not got and not ids


def test_entry_points(spark):
    tree = {"a.py": "@cli.command()\ndef one(): ...\n\n\n@celery.task\ndef two(): ...\n\n\n@app.get('/')\ndef three(): ...\n\n\ndef main(): ...\n\n\nclass X:\n    def main(self): ...\n", "p/__main__.py": "def go(): ...\n", "m.py": "__all__ = ['shown']\n\n\ndef shown(): ...\n\n\ndef hidden(): ...\n"}
    parsed = extract.parse_files(spark.createDataFrame([(p, "python", s) for p, s in tree.items()], "path string, language string, source string"))
    got = rows(resolve.entry_points(parsed, extract.symbol_table(parsed)), "id", "entry_kind")
    assert got == Counter({("a.py::one", "cli"): 1, ("a.py::two", "task"): 1, ("a.py::three", "route"): 1, ("a.py::main", "main"): 1, ("p/__main__.py::go", "main_module"): 1, ("m.py::shown", "exported"): 1})


def test_dead_symbols(spark):
    tree = {"a.py": "def unused(): ...\n\n\ndef used(): ...\n\n\nclass Base:\n    def save(self): ...\n\n\nclass Child(Base):\n    def save(self): ...\n    def own(self): ...\n    def __len__(self): ...\n\n\nused()\n", "tests/helper.py": "def help_me(): ...\n"}
    parsed = extract.parse_files(spark.createDataFrame([(p, "python", s) for p, s in tree.items()], "path string, language string, source string"))
    symbols = extract.symbol_table(parsed)
    edges, entries = resolve.call_edges(parsed, symbols), resolve.entry_points(parsed, symbols)
    above = resolve.ancestors(symbols, resolve.class_bases(symbols, resolve.import_map(parsed)))
    names = lambda **k: {r["id"] for r in graph.dead_symbols(symbols, edges, entries, above, parsed, **k).collect()}
    want = {"a.py::unused", "a.py::Base", "a.py::Base.save", "a.py::Child", "a.py::Child.own"}
    assert names() == want and names(include_tests=True) == want | {"tests/helper.py::help_me"}


# ---- graphs and flows


def small_edges(spark):
    rows_ = [("a", "b", "b", 1, 0.9), ("a", None, "print", 2, 0.0), ("a", "c", "c", 3, 0.4), ("b", "a", "a", 1, 0.9), ("b", "d", "d", 2, 0.9), ("d", "e", "e", 1, 0.9)]
    return spark.createDataFrame(rows_, "caller string, callee string, callee_expr string, line int, confidence double").withColumns({"source": F.lit("ast"), "control_ctx": F.lit("")})


def test_trace_marks_recursion_and_omissions(spark):
    seeds = spark.createDataFrame([("a",)], "id string")
    got = flow.trace_tree(seeds, small_edges(spark), 2).orderBy("position").collect()
    assert [(r["depth"], r["id"], r["kind"], r["recursive"], r["omitted"]) for r in got] == [(0, "a", "symbol", False, 0), (1, "b", "symbol", False, 0), (2, "a", "symbol", True, 0), (2, "d", "symbol", False, 1), (1, "external:a:2:print", "external", False, 0)]
    capped = flow.trace_tree(seeds, small_edges(spark), 2, max_nodes=3).orderBy("position").collect()
    assert [(r["id"], r["count"]) for r in capped] == [("a", 0), ("b", 0), ("b::cap", 2), ("a::cap", 1)]
    with pytest.raises(ValueError):
        flow.trace_tree(seeds, small_edges(spark), 65)


def test_collapse_within_nodes(spark):
    symbols = spark.createDataFrame([(x, x) for x in "abcde"], "id string, qualname string")
    tree = flow.labels(flow.trace_tree(spark.createDataFrame([("a",)], "id string"), small_edges(spark), 3), symbols)
    got = [(r["label"], r["depth"], r["omitted"]) for r in flow.collapse(tree, 3, 4).orderBy("position").collect()]
    assert got == [("a", 0, 1), ("b", 1, 0), ("...3 more", 2, 0)]


def test_diagram_errors(spark):
    texts = ['graph TD\nn0["x"]\nn1["y"]\nn0 -->|if| n1', 'flowchart TD\nn0["x"]\nn0["y"]\nn0 ~~ n1\nn0 --> n2', "pie", "", "sequenceDiagram\nparticipant n0 as a b\nn0->>n0: again"]
    df = flow.diagram_errors(spark.createDataFrame(list(enumerate(texts)), "k int, diagram string"))
    got = {r["k"]: r["errors"] for r in df.collect()}
    assert got == {0: [], 1: ["Invalid line: n0 ~~ n1", "Duplicate node: n0", "Undefined arrow end"], 2: ["Unknown header"], 3: ["Unknown header"], 4: []}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in ((1, 2, 3), (7, 8, 9)) for a in g for b in g if a < b] + [(3, 7)]
    edges = spark.createDataFrame([(a, b, 0.9 if (a, b) != (3, 7) else 0.1) for a, b in pairs], "caller long, callee long, confidence double")
    got = {r["id"]: r["community"] for r in graph.communities(spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 9, 20)], "id long"), edges, 6).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and len({got[7], got[8], got[9]}) == 1 and got[1] != got[7] and got[20] == 20


# ---- lookups, evaluation, knowledge


def test_pages(spark):
    df = spark.range(10).filter("id <> 4")
    assert [[r["id"] for r in page] for page in lookup.pages(df, "id", 4)] == [[0, 1, 2, 3], [5, 6, 7, 8], [9]]
    assert list(lookup.pages(df.limit(0), "id", 4)) == []


def test_run_needs_all_references(spark):
    q = spark.createDataFrame([("q1", "a"), ("q2", "b")], "question string, reference string")
    known = spark.createDataFrame([("a",)], "reference string")
    with pytest.raises(ValueError, match="q2"):
        evaluation.checked_run(q, known)
    assert evaluation.checked_run(q, known.union(spark.createDataFrame([("b",)], "reference string"))).count() == 2


def test_quotes_of_documentation_are_no_proof():
    code = 'def f():\n    """Adds one."""\n    # adds one\n    return 1  # Adds one.\n'
    assert knowledge.quotes_implementation(code, "return 1") and knowledge.quotes_implementation(code, "Adds one.")
    assert not knowledge.quotes_implementation(code, "# adds one\n") and not knowledge.quotes_implementation(code, '"""Adds one."""')
    assert not knowledge.quotes_implementation(code, "absent") and not knowledge.quotes_implementation("not code (", "not")


def test_ranking_matrix_checks_vectors():
    assert retrieval.ranking_matrix([[1, 0]], [[0, 1], [2, 0], [1, 1], [0, 5]]) == [[1, 2, 0, 3]]
    for q, u in (([[1, 0]], [[1, 0, 0]]), ([[0, 0]], [[1, 0]]), ([[float("nan"), 1]], [[1, 0]])):
        with pytest.raises(ValueError):
            retrieval.ranking_matrix(q, u)


def test_dense_view_failure_is_its_own(spark):
    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "unit_id int, text string")
    cache = models.embedded(units.limit(0).select(F.col("text").alias("hash"), "text"), models.HashEmbedder(4))

    def broken(rows_):
        raise models.TransportError("away")

    assert retrieval.build_dense(units, cache, broken, "m") == (None, {"view": "dense", "status": "failed", "error": "away"})
    vectors, state = retrieval.build_dense(units, cache, lambda r: models.embedded(r, models.HashEmbedder(4)), "m")
    assert state["status"] == "fresh" and state["count"] == vectors.count() == 3


# ---- sources


def test_suites_are_validated(spark):
    good = "version: 1\nquestions:\n- {id: a, type: symbol, question: q, expected: {symbols: [x]}}\n"
    assert suites.read_suite(spark, good).count() == 1
    for bad in ("version: 2\nquestions: []\n", good + "- {id: a, type: symbol, question: q, expected: {symbols: [x]}}\n", good.replace("symbol,", "other,"), good.replace("symbols:", "names:"), good.replace("symbol,", "traversal,")):
        with pytest.raises(suites.SuiteError):
            suites.parse_suite(bad)


def test_settings_are_typed():
    got, origin = suites.load_settings("num_ctx = 10\n", {"CODELOOM_GRAPH_EXPANSION": "true"})
    assert got.num_ctx == 10 and got.graph_expansion is True and origin["rrf_k"] == "default"
    for toml, env in (("unknown = 1", {}), ("", {"CODELOOM_NUM_CTX": "many"}), ("", {"CODELOOM_GRAPH_EXPANSION": "maybe"})):
        with pytest.raises(ValueError):
            suites.load_settings(toml, env)


def test_snapshot_of_another_schema(spark, tmp_path):
    df = spark.range(3)
    suites.write_snapshot(df, str(tmp_path), "t", 1)
    assert suites.read_snapshot(spark, str(tmp_path), "t", df.schema).count() == 3
    with pytest.raises(ValueError):
        suites.read_snapshot(spark, str(tmp_path), "t", df.select(F.col("id").cast("int")).schema)


def test_retries():
    assert models.with_retries(lambda m=models.EchoGenerator(2, failures=2): m.generate("a b c")) == ("a b", 3)
    with pytest.raises(models.TransportError):
        models.with_retries(lambda m=models.EchoGenerator(2, failures=3): m.generate("a"))


def test_discovery_of_a_real_tree(spark, tmp_path):
    tree = {"a.py": "x = 1\n", ".git/b.py": "x", "k.pem": "x", "sub/poetry.lock": "x", "sub/c.toml": "a = 1\nb = 2", "bin.dat": "a\0b", "min.js": "y" * 2000, "skip.log": "x"}
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = files.discover(spark, str(tmp_path), ["*.log"])
    assert rows(got, "path", "language", "line_count") == Counter({("a.py", "python", 2): 1, ("sub/c.toml", "config", 2): 1})


def test_tree_fingerprint(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    one = maintenance.tree_fingerprint(df, "v")
    assert one == maintenance.tree_fingerprint(df.orderBy(F.desc("path")), "v") != maintenance.tree_fingerprint(df.limit(1), "v")


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[(0, "a"), (3600, "a")], [(36000, "a")], [(36050, "a")], [(100, "a"), (36100, "b")]]
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "s long, key string").select(F.timestamp_seconds("s").alias("ts"), "key")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = mb.windowed_counts(mb.table_stream(spark, str(tmp_path / "in"), "*.parquet"), "ts", "key", "1 hour", "30 minutes")
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(F.unix_timestamp("window_start").alias("s"), "key", "n"))
    assert got == Counter({(0, "a", 1): 1, (3600, "a", 1): 1})


def test_most_chars_is_the_longest_that_fits():
    for tokens in (1, 7, 60, 100, 999):
        n = T.most_chars(tokens)
        assert budget.estimate("x" * n) <= tokens < budget.estimate("x" * (n + 1))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_dense_blocks_give_what_one_block_gives(spark, small, metric):
    from codeloom.operators import search

    e = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    one = rows(search.dense_topk(q, e, 4, metric))
    assert sum(one.values()) > 20 and one == rows(search.dense_topk(q, e, 4, metric, query_block=5, unit_block=9))
    assert search.dense_topk(q.limit(0), e).count() == 0


def test_lexical_index_gives_what_units_give(spark, small):
    from codeloom.operators import search

    d = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    q = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    got = rows(search.lexical_topk(q, d, 5))
    assert got and got == rows(search.lexical_topk(q, None, 5, search.postings(d, "text")))


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    n = 40
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(55)})
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}
    assert len(set(want.values())) < n
    edges = spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "caller long, callee long, confidence double")
    got = graph.components_strong(spark.range(n), edges).collect()
    assert len(got) == n and {r["id"]: r["component"] for r in got} == want


def test_strong_components_without_edges(spark):
    edges = spark.createDataFrame([(1, 1, 0.9), (1, None, 0.0)], "caller long, callee long, confidence double")
    assert rows(graph.components_strong(spark.range(3), edges)) == Counter({(0, 0): 1, (1, 1): 1, (2, 2): 1})
    assert graph.components_strong(spark.range(0), edges).count() == 0


def test_global_numbers_over_many_ranges(spark):
    from codeloom.operators.order import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("t")).repartition(7)
    got = [(r["k"], r["n"]) for r in numbered(df, ["t", F.desc("k")], "n").collect()]
    want = sorted(((r["k"], r["t"]) for r in df.collect()), key=lambda x: (x[1], -x[0]))
    assert sorted(got, key=lambda x: x[1]) == [(k, i) for i, (k, _) in enumerate(want, 1)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0
