"""Queries of code extraction and call resolution, over a source tree that is generated from the tables.

A region is a module with a base class, a nation one with a class on top of it, a supplier one with a class on top of that;
a package file re-exports the regions' classes. The SQL states the expected rows from the same tables, rung by rung.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.code import extract, resolve
from codeloom.operators import graph
from codeloom.plans.catalog import query, table
from codeloom.sources.shared import kept

REGION = """class Region{r}:
    def rate(self, amount):
        return round(amount)

    def shut{r}(self):
        pass
"""
NATION = '''"""A nation."""
from geo.region{r} import Region{r}


class Nation{n}(Region{r}):
    def __init__(self, size):
        self.size = size

    def tax(self, amount):
        return self.rate(amount)

    def label(self):
        return self.size


def helper{n}(x):
    return Nation{n}(x)


def spare{n}():
    return Nation{n}
'''
SUPPLIER = """import geo.nation{n} as home
from geo import Region{r}
from ..geo.nation{n} import helper{n} as assist


class Supplier{s}(home.Nation{n}):
    def __init__(self, dep: "Region{r} | None"):
        super().__init__(3)
        self.dep = dep
        self.part = home.Nation{n}(1)

    def run(self, amount):
        self.tax(amount)
        self.dep.rate(amount)
        self.part.label()
        local{s}()
        assist(amount)
        missing(amount)
        amount.shut{r}()
        if amount:
            Region{r}().rate(2)
        return self.nothing()


def local{s}():
    thing = Supplier{s}(None)
    thing.run(1)


@assist
def main():
    return [local{s}() for _ in range(3)]
"""
BROKEN = "def broken(:\n    pass\n"
START = """from tree.firms.s0 import main

if __name__ == "__main__":
    main()
"""


def _filled(template: str, **columns) -> F.Column:
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.col(column).cast("string"))
    return out


def source_tree(spark, sf_dir: str) -> DataFrame:
    """path, language, source."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    both = nation.select("n_nationkey", F.col("n_regionkey").alias("r"))
    firms = supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(F.broadcast(both), "n_nationkey")
    path = lambda kind, key: F.concat(F.lit(f"tree/{kind}"), F.col(key).cast("string"), F.lit(".py"))
    files = region.select(path("geo/region", "r_regionkey").alias("path"), _filled(REGION, r="r_regionkey").alias("source"))
    files = files.union(both.select(path("geo/nation", "n_nationkey"), _filled(NATION, r="r", n="n_nationkey")))
    files = files.union(firms.select(path("firms/s", "s_suppkey"), _filled(SUPPLIER, r="r", n="n_nationkey", s="s_suppkey")))
    shown = region.agg(F.array_join(F.array_sort(F.collect_list(_filled("from .region{r} import Region{r}", r="r_regionkey"))), "\n").alias("source"))
    files = files.union(shown.select(F.lit("tree/geo/__init__.py"), "source"))
    more = [("tree/firms/__main__.py", START), ("tree/bad.py", BROKEN)]
    files = files.union(spark.createDataFrame(more, "path string, source string"))
    python = files.select(F.regexp_replace("path", "^tree/", "").alias("path"), F.lit("python").alias("language"), F.replace("source", F.lit("tree."), F.lit("")).alias("source"))
    return python.union(spark.createDataFrame([("notes.md", "other", "# notes")], "path string, language string, source string"))


#: Symbols of each kind of file: (qualname, kind, first line, last line, parent, trivial).
_SYMBOLS = {
    "geo/region{r}.py": [("Region{r}", "class", 1, 6, "", False), ("Region{r}.rate", "method", 2, 3, "Region{r}", True), ("Region{r}.shut{r}", "method", 5, 6, "Region{r}", True)],
    "geo/nation{n}.py": [("Nation{n}", "class", 5, 13, "", False), ("Nation{n}.__init__", "method", 6, 7, "Nation{n}", True), ("Nation{n}.tax", "method", 9, 10, "Nation{n}", True), ("Nation{n}.label", "method", 12, 13, "Nation{n}", True), ("helper{n}", "function", 16, 17, "", True), ("spare{n}", "function", 20, 21, "", False)],
    "firms/s{s}.py": [("Supplier{s}", "class", 6, 22, "", False), ("Supplier{s}.__init__", "method", 7, 10, "Supplier{s}", False), ("Supplier{s}.run", "method", 12, 22, "Supplier{s}", False), ("local{s}", "function", 25, 27, "", False), ("main", "function", 30, 32, "", False)],
}
_N, _R, _S = "geo/nation{n}.py::Nation{n}", "geo/region{r}.py::Region{r}", "firms/s{s}.py::Supplier{s}"
_H, _L, _M = "geo/nation{n}.py::helper{n}", "firms/s{s}.py::local{s}", "firms/s{s}.py::main"
#: Edges of each kind of file: (caller, callee, expr, line, kind, resolution, confidence, control).
_EDGES = {
    "r": [(f"{_R}.rate", None, "round", 3, "call", "external", 0.0, "")],
    "n": [
        (f"{_N}.tax", f"{_R}.rate", "self.rate", 10, "call", "self", 0.9, ""),
        (_H, _N, "Nation{n}", 17, "constructor", "local", 0.9, ""), (_H, f"{_N}.__init__", "Nation{n}", 17, "constructor", "local", 0.9, ""),
    ],
    "s": [
        (f"{_S}.__init__", f"{_N}.__init__", "super().__init__", 8, "call", "super", 0.9, ""), (f"{_S}.__init__", None, "super", 8, "call", "external", 0.0, ""),
        (f"{_S}.__init__", _N, "home.Nation{n}", 10, "constructor", "import", 0.95, ""), (f"{_S}.__init__", f"{_N}.__init__", "home.Nation{n}", 10, "constructor", "import", 0.95, ""),
        (f"{_S}.run", f"{_N}.tax", "self.tax", 13, "call", "self", 0.9, ""), (f"{_S}.run", f"{_R}.rate", "self.dep.rate", 14, "call", "typed", 0.8, ""),
        (f"{_S}.run", f"{_N}.label", "self.part.label", 15, "call", "typed", 0.8, ""), (f"{_S}.run", _L, "local{s}", 16, "call", "local", 0.9, ""),
        (f"{_S}.run", _H, "assist", 17, "call", "import", 0.95, ""), (f"{_S}.run", None, "missing", 18, "call", "external", 0.0, ""),
        (f"{_S}.run", f"{_R}.shut{{r}}", "amount.shut{r}", 19, "call", "name-unique", 0.75, ""), (f"{_S}.run", _R, "Region{r}", 21, "constructor", "import", 0.95, "if"),
        (f"{_S}.run", None, "self.nothing", 22, "call", "external", 0.0, ""),
        (_L, _S, "Supplier{s}", 26, "constructor", "local", 0.9, ""), (_L, f"{_S}.__init__", "Supplier{s}", 26, "constructor", "local", 0.9, ""),
        (_L, f"{_S}.run", "thing.run", 27, "call", "typed", 0.8, ""),
        (_M, _H, "assist", 30, "decorator", "import", 0.95, ""), (_M, _L, "local{s}", 32, "call", "local", 0.9, "comp"), (_M, None, "range", 32, "call", "external", 0.0, "comp"),
    ],
}
_FROM = {"r": "(SELECT r_regionkey AS r, NULL AS n, NULL AS s FROM region)", "n": "(SELECT n_regionkey AS r, n_nationkey AS n, NULL AS s FROM nation)", "s": "(SELECT n_regionkey AS r, n_nationkey AS n, s_suppkey AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey)"}


def _text(value: str | None) -> str:
    """A template as an SQL expression over r, n and s."""
    if value is None:
        return "NULL"
    out = "'" + value.replace("'", "''") + "'"
    for c in "rns":
        out = out.replace("{" + c + "}", f"' || {c} || '")
    return out


def _edges_sql() -> str:
    cols = "caller, callee, callee_expr, line, kind, resolution, confidence, control_ctx"
    row = lambda e: f"{_text(e[0])}, {_text(e[1])}, {_text(e[2])}, {e[3]}, '{e[4]}', '{e[5]}', {e[6]}::DOUBLE, '{e[7]}'"
    parts = [f"SELECT {row(e)} FROM {_FROM[k]}" for k, es in _EDGES.items() for e in es]
    parts.append(f"SELECT {_text(_S + '.run')}, 'geo/region' || r_regionkey || '.py::Region' || r_regionkey || '.rate', 'Region' || r || '().rate', 21, 'call', 'ambiguous', 0.4::DOUBLE, 'if' FROM {_FROM['s']} CROSS JOIN region")
    parts.append("SELECT 'firms/__main__.py::__main__::<module>', 'firms/s0.py::main', 'main', 4, 'call', 'import', 0.95::DOUBLE, 'if'")
    return f"code_edges({cols}) AS (" + " UNION ALL ".join(parts) + ")"


def _symbols_sql() -> str:
    parts = []
    for (path, rows), k in zip(_SYMBOLS.items(), "rns"):
        for q, kind, a, b, parent, trivial in rows:
            parts.append(f"SELECT {_text(path + '::' + q)}, {_text(path)}, '{kind}', {_text(q)}, {a}, {b}, {_text(path + '::' + parent) if parent else 'NULL'}, {trivial} FROM {_FROM[k]}")
    parts.append("SELECT 'firms/__main__.py::__main__::<module>', 'firms/__main__.py', 'module', '__main__::<module>', 3, 4, NULL, true")
    return "code_symbols(id, file_path, kind, qualname, start_line, end_line, parent_id, is_trivial) AS (" + " UNION ALL ".join(parts) + ")"


def _parsed(spark, sf_dir: str) -> DataFrame:
    return extract.parse_files(source_tree(spark, sf_dir))


def _code(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(parsed files, symbols), each made once for the many joins of the ladder."""
    parsed = kept(_parsed(spark, sf_dir))
    return parsed, kept(extract.symbol_table(parsed))


@query(f"WITH {_symbols_sql()} SELECT * FROM code_symbols")
def code_symbols(spark, sf_dir):
    found = extract.trivial(_code(spark, sf_dir)[1])
    return found.select("id", "file_path", "kind", "qualname", "start_line", "end_line", "parent_id", "is_trivial")


@query(
    """SELECT 'geo/region' || r_regionkey || '.py' AS path, 'parsed' AS parse_status, 0::BIGINT AS imports, 0::BIGINT AS exports, 3::BIGINT AS symbols FROM region
UNION ALL SELECT 'geo/nation' || n_nationkey || '.py', 'parsed', 1, 0, 6 FROM nation UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'parsed', 3, 0, 5 FROM supplier
UNION ALL SELECT 'geo/__init__.py', 'parsed', (SELECT count(*) FROM region), (SELECT count(*) FROM region), 0 UNION ALL SELECT 'firms/__main__.py', 'parsed', 1, 0, 1 UNION ALL SELECT 'bad.py', 'failed', 0, 0, 0 UNION ALL SELECT 'notes.md', 'unsupported', 0, 0, 0"""
)
def parse_status(spark, sf_dir):
    n = lambda c: F.size(c).cast("long").alias(c)
    return _parsed(spark, sf_dir).select("path", "parse_status", n("imports"), n("exports"), n("symbols"))


@query(
    """SELECT 'geo/region' || r_regionkey || '.py' AS path, 'class Region' || r_regionkey || '():' || chr(10) || 'def Region' || r_regionkey || '.rate(self, amount):' || chr(10) || 'def Region' || r_regionkey || '.shut' || r_regionkey || '(self):' AS skeleton FROM region
UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'class Supplier' || s_suppkey || '(home.Nation' || s_nationkey || '):' || chr(10) || 'def Supplier' || s_suppkey || '.__init__(self, dep: ''Region' || n_regionkey || ' | None''):' || chr(10) || 'def Supplier' || s_suppkey || '.run(self, amount):' || chr(10) || 'def local' || s_suppkey || '():' || chr(10) || 'def main():' FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
)
def file_skeletons(spark, sf_dir):
    return _parsed(spark, sf_dir).filter("path RLIKE '^(geo/region|firms/s)'").select("path", "skeleton")


_IMPORTS = """SELECT 'geo/__init__.py' AS file_path, 'Region' || r_regionkey AS alias, 'geo/region' || r_regionkey || '.py' AS target, 'Region' || r_regionkey AS exported FROM region
UNION ALL SELECT 'geo/nation' || n_nationkey || '.py', 'Region' || n_regionkey, 'geo/region' || n_regionkey || '.py', 'Region' || n_regionkey FROM nation
UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'home', 'geo/nation' || s_nationkey || '.py', NULL FROM supplier
UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'assist', 'geo/nation' || s_nationkey || '.py', 'helper' || s_nationkey FROM supplier
UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'Region' || n_regionkey, 'geo/__init__.py', 'Region' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'firms/__main__.py', 'main', 'firms/s0.py', 'main'"""


@query(_IMPORTS)
def import_maps(spark, sf_dir):
    return resolve.import_map(kept(_parsed(spark, sf_dir))).select("file_path", "alias", "target", "exported")


@query("SELECT 'firms/s' || s_suppkey || '.py' AS file, 'Region' || n_regionkey AS name, 'geo/region' || n_regionkey || '.py::Region' || n_regionkey AS target FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'firms/s' || s_suppkey || '.py', 'home.Nation' || s_nationkey || '.tax', 'geo/nation' || s_nationkey || '.py::Nation' || s_nationkey || '.tax' FROM supplier")
def reexport_chase(spark, sf_dir):
    """Names through a package's re-exports and through a module's alias to where they are defined."""
    parsed, symbols = _code(spark, sf_dir)
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("firms/s"), "s_suppkey", F.lit(".py")).alias("file"), F.explode(F.array(F.concat(F.lit("Region"), "n_regionkey"), F.concat(F.lit("home.Nation"), "s_nationkey", F.lit(".tax")))).alias("name"))
    got = resolve.defined(rows.withColumn("key", F.struct("file", "name")), symbols, resolve.import_map(parsed))
    return got.select("key.file", "key.name", "target")


@query(
    f"""WITH s AS {_FROM["s"]}, m(method, owner) AS (VALUES ('rate', 'r'), ('tax', 'n'), ('label', 'n'), ('__init__', 's'), ('run', 's'))
SELECT {_text(_S)} AS class_id, method, CASE owner WHEN 'r' THEN {_text(_R)} WHEN 'n' THEN {_text(_N)} ELSE {_text(_S)} END || '.' || method AS target FROM s CROSS JOIN m
UNION ALL SELECT {_text(_S)}, 'shut' || r, {_text(_R)} || '.shut' || r FROM s"""
)
def inherited_methods(spark, sf_dir):
    """What each method name means for a supplier's class: its own, or the first base's that has it."""
    parsed, symbols = _code(spark, sf_dir)
    above = resolve.ancestors(symbols, resolve.class_bases(symbols, resolve.import_map(parsed)))
    return resolve.methods(symbols, above).filter("class_id LIKE 'firms/%'")


@query(f"WITH {_edges_sql()} SELECT * FROM code_edges")
def code_edges(spark, sf_dir):
    return resolve.call_edges(*_code(spark, sf_dir)).drop("source")


@query(f"WITH {_edges_sql()} SELECT resolution, count(*) AS edges, CAST(count(DISTINCT caller) AS BIGINT) AS callers, round(avg(confidence), 6) AS mean_confidence FROM code_edges GROUP BY 1")
def resolution_counts(spark, sf_dir):
    e = resolve.call_edges(*_code(spark, sf_dir))
    return e.groupBy("resolution").agg(F.count("*").alias("edges"), F.count_distinct("caller").alias("callers"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    """SELECT 'firms/s' || s_suppkey || '.py::main' AS id, 'main' AS entry_kind FROM supplier UNION ALL SELECT 'firms/__main__.py::__main__::<module>', 'main_guard'
UNION ALL SELECT 'geo/region' || r_regionkey || '.py::Region' || r_regionkey, 'exported' FROM region"""
)
def entry_points(spark, sf_dir):
    return resolve.entry_points(*_code(spark, sf_dir))


_DEAD = f"""WITH {_symbols_sql()}, {_edges_sql()},
entry(id) AS (SELECT {_text(_M)} FROM {_FROM["s"]} UNION ALL SELECT 'firms/__main__.py::__main__::<module>' UNION ALL SELECT {_text(_R)} FROM {_FROM["r"]})
SELECT id, 'candidate' AS label FROM code_symbols s WHERE NOT EXISTS (SELECT 1 FROM code_edges e WHERE e.callee = s.id AND confidence >= 0.6) AND id NOT IN (SELECT id FROM entry)
AND NOT regexp_matches(qualname, '(^|[.])__.*__$') AND kind <> 'module'"""


@query(_DEAD)
def dead_code(spark, sf_dir):
    """Symbols that nothing calls, without entry points, tests, dunders, exported names and overrides of a base's method."""
    parsed, symbols = _code(spark, sf_dir)
    edges = resolve.call_edges(parsed, symbols)
    above = resolve.ancestors(symbols, resolve.class_bases(symbols, resolve.import_map(parsed)))
    return graph.dead_symbols(symbols, edges, resolve.entry_points(parsed, symbols), above, parsed)


_REFS = """SELECT 'geo.nation' || n_nationkey || '.Nation' || n_nationkey || '.tax' AS ref, 'found' AS outcome, 'geo/nation' || n_nationkey || '.py::Nation' || n_nationkey || '.tax' AS id FROM nation
UNION ALL SELECT 'helper' || n_nationkey, 'found', 'geo/nation' || n_nationkey || '.py::helper' || n_nationkey FROM nation
UNION ALL SELECT 'Region' || r_regionkey || '.rate', 'found', 'geo/region' || r_regionkey || '.py::Region' || r_regionkey || '.rate' FROM region
UNION ALL SELECT * FROM (VALUES ('rate', 'ambiguous', NULL), ('elper1', 'not found', NULL), ('firms/s0.py::main', 'found', 'firms/s0.py::main'), ('main', 'ambiguous', NULL))"""


@query(_REFS)
def strict_references(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    _, symbols = _code(spark, sf_dir)
    refs = n.select(F.expr("'geo.nation' || n_nationkey || '.Nation' || n_nationkey || '.tax'").alias("ref")).union(n.select(F.expr("'helper' || n_nationkey"))).union(r.select(F.expr("'Region' || r_regionkey || '.rate'")))
    refs = refs.union(spark.createDataFrame([("rate",), ("elper1",), ("firms/s0.py::main",), ("main",)], "ref string"))
    return resolve.strict_references(refs, symbols)


@query(
    """WITH c AS (SELECT s_suppkey AS s, unnest([(0, 2, 19), (1, 20, 37), (2, 38, 50)]) AS x FROM supplier) SELECT 'firms/s' || s || '.py::long' || s AS id, x[1] AS chunk, x[2] AS start_line, x[3] AS end_line FROM c"""
)
def split_symbols(spark, sf_dir):
    """A long function in chunks of whole statements, each led by its head."""
    return _long_functions(spark, sf_dir).select("id", "chunk", "start_line", "end_line")


def _long_functions(spark, sf_dir: str) -> DataFrame:
    body = "".join(f"    value = step({{s}}, {k + 10})\n" for k in range(49))
    s = table(spark, sf_dir, "supplier").filter("s_suppkey IS NOT NULL")
    code = _filled("def long(a):\n" + body, s="six")
    symbols = s.withColumn("six", F.lpad(F.col("s_suppkey").cast("string"), 6, "1")).select(F.expr("'firms/s' || s_suppkey || '.py::long' || s_suppkey").alias("id"), code.alias("raw_code"), F.lit(1).alias("start_line"))
    return extract.split_symbols(symbols, 200)


@query("WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') AS x FROM documents) SELECT doc_id, sha256('# -*- coding: latin-1 -*-' || chr(10) || x) AS text_hash FROM t")
def source_decode(spark, sf_dir):
    """Sources in latin-1 that say so in their first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# -*- coding: latin-1 -*-\n"), F.regexp_replace("text", r"[^\x00-\xff]", "?")).alias("x"))
    raw = d.select("doc_id", F.encode("x", "ISO-8859-1").alias("content"))
    return extract.decoded(raw, "content").select("doc_id", F.sha2("text", 256).alias("text_hash"))
