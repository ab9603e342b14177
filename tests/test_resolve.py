"""Name lookup and resolution against brute force: short names, dotted tails, ids and names of very many symbols."""

from pyspark.sql import functions as F

from codeloom.operators import search

SYMBOLS = [(1, "mod.id", "id"), (2, "mod.sub.run", "run"), (3, "other.sub.run", "run"), (4, "x", "x"), (5, "a.b.", ""), (6, "pkg.Id2", "Id2"), (7, "ab", "ab"), (7, "ab", "ab"), (8, "q.a.b", "b"), (12, "twelve.é", "é"), (13, None, "lone"), (14, "n.none", None)]
QUERIES = ["id", "ID", "x", "d", "", "run", "sub.run", "mod.sub.run", "b", "a.b", "ab", "é", "7", "12", "lone", "none", "missing", "o", None, "id"]


def rung(query, i, qualname, name):
    q = qualname or ""
    return 0 if str(i) == query else 1 if qualname == query else 2 if name == query else 3 if q.endswith("." + query) else 4


def test_resolve(spark):
    want = set()
    for q in set(QUERIES):
        hits = {(rung(q, *s), s[0]) for s in SYMBOLS if q is not None and rung(q, *s) < 4}
        r = min((h[0] for h in hits), default=None)
        ids = [i for k, i in hits if k == r]
        want.add((q, r, len(ids), ids[0] if len(ids) == 1 else None, "found" if len(ids) == 1 else "ambiguous" if ids else "not found"))
    df = search.resolve(spark.createDataFrame([(q,) for q in QUERIES], "query string"), spark.createDataFrame(SYMBOLS, "id long, qualname string, name string"))
    assert df.columns == ["query", "rung", "matches", "id", "outcome"]
    assert {tuple(r) for r in df.collect()} == want


def test_lookup_of_short_queries(spark):
    want = set()
    for q in set(QUERIES) - {None}:
        hits = sorted({(rung(q, *s), s[0]) for s in SYMBOLS if s[1] is not None and q.lower() in s[1].lower()})
        want |= {(q, i, r, n) for n, (r, i) in enumerate(hits, 1)}
    got = search.name_lookup(spark.createDataFrame([(q,) for q in QUERIES], "query string"), spark.createDataFrame(SYMBOLS, "id long, qualname string, name string"))
    assert {(r["query"], r["id"], r["rung"], r["rank"]) for r in got.collect()} == want


def test_a_name_of_more_than_a_million_symbols_is_counted_whole(spark):
    many = spark.range(1_200_000).select("id", F.concat(F.lit("m.run"), F.lit("")).alias("qualname"), F.lit("run").alias("name"))
    got = search.resolve(spark.createDataFrame([("run",)], "query string"), many).first()
    assert (got["rung"], got["matches"], got["id"], got["outcome"]) == (2, 1_200_000, None, "ambiguous")
