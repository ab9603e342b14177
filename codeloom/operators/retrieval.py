"""Retrieval beyond one ranked list: views, module scope, path evidence, target inference, expansion, rerank, text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph
from codeloom.operators.search import ranked
from codeloom.sources.shared import kept

# Verbs that stand for one another, and the question that asks for a path.
ACTIONS = [
    ["write", "save", "persist", "persistence", "store"],
    ["lookup", "get", "find", "read", "retrieve", "retrieval"],
    ["send", "deliver", "delivery", "email"],
    ["sign", "signing", "issue"],
]
PATH_QUESTION = r"(?i)^\s*(?:trace|path|flow)\s+(?:from\s+)?(.+?)\s+to\s+(.+?)\s*[.!?]*$"
DOTTED = r"[A-Za-z_]\w*(?:\.\w+)+"
NOTE = "This answer may be incomplete: it covers the indexed static graph within the depth and confidence that were set."


def lexical_view(symbols: DataFrame, shown: DataFrame) -> DataFrame:
    """id, search_text of symbols (id, file_path, qualname, docstring, raw_code) with the published summaries (id, summary)
    and no other; one projection to write as the view."""
    met = symbols.join(shown.select("id", F.col("summary").alias("__summary")), "id", "left")
    return met.select("id", T.search_text(F.col("file_path"), F.col("qualname"), F.col("__summary"), F.col("docstring"), F.col("raw_code")).alias("search_text"))


def scoped(questions: DataFrame, found: DataFrame, symbols: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, rank: candidates (query_id, id, score), but where a question (query_id, text) names an indexed module
    by its dotted path, the module's own symbols (id, file_path, start_line), by score and then by line."""
    tokens = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(DOTTED), F.lit(0))), lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py")))
    named = kept(questions.select("query_id", F.explode(tokens).alias("file_path")).join(symbols.select("file_path").distinct(), "file_path", "left_semi"))
    asked = named.select("query_id").distinct()
    points = found.join(asked.hint("merge"), "query_id", "left_semi").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    own = symbols.select("file_path", "id", "start_line")
    met = named.hint("merge").join(points, "query_id").join(own, ["file_path", "id"]).select("query_id", "id", "score", "start_line")
    # of what wasn't found, only a module's first k can be among the best, unless something found is worse than that
    below = points.filter("score < 0").select("query_id").distinct()
    first = ranked(own, "file_path", "start_line", "id", k=k).drop("rank")
    rest = named.join(below, "query_id", "left_anti").hint("merge").join(first, "file_path").unionByName(named.join(below, "query_id", "left_semi").hint("merge").join(own, "file_path"))
    rest = rest.join(points.select("query_id", "id").hint("merge"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"), "start_line")
    other = found.join(asked.hint("merge"), "query_id", "left_anti").select("query_id", "id", "score", F.lit(0).alias("start_line"))
    # no question is in both, so what was found stays where it was dealt
    best = (ranked(x, "query_id", F.desc("score"), "start_line", "id", k=k).select("query_id", "id", "rank") for x in (met.unionByName(rest), other))
    return reduce(DataFrame.unionByName, best)


def endpoints(questions: DataFrame) -> DataFrame:
    """query_id, source, target: the two ends, in the question's words, of those that ask for a path."""
    part = lambda k: F.regexp_replace(F.trim(F.replace(F.regexp_extract("text", PATH_QUESTION, k), F.lit("`"), F.lit(""))), r"[.?!]+$", "")
    return questions.filter(F.col("text").rlike(PATH_QUESTION)).select("query_id", part(1).alias("source"), part(2).alias("target"))


def inferred_targets(asked: DataFrame, candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """query_id, target, tied: what a phrase (asked: query_id, source, phrase) means, by its verbs and their synonyms.

    candidates (query_id, id, name, doc) come from a lexical search; a name counts twice for each shared verb, or else a
    doc once. Only what the source reaches (reach: source, id, hops) counts; at an equal score the longest way wins, and a
    tie of both gives no target but how many are tied.
    """
    verbs = F.array(*(F.array(*map(F.lit, g)) for g in ACTIONS))
    words = T.split_identifiers(F.col("phrase"))
    wanted = F.array_distinct(F.flatten(F.filter(verbs, lambda g: F.arrays_overlap(g, words))))
    a = asked.select("query_id", "source", wanted.alias("wanted")).filter(F.size("wanted") > 0)
    shared = lambda c: F.size(F.array_intersect(T.split_identifiers(F.coalesce(F.col(c), F.lit(""))), F.col("wanted")))
    score = F.when(shared("name") > 0, 2 * shared("name")).otherwise(shared("doc"))
    met = a.join(candidates, "query_id").withColumn("score", score).filter((F.col("score") > 0) & (F.col("id") != F.col("source")))
    met = met.join(reach, ["source", "id"])
    best = met.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hops")))).filter("r = 1")
    return best.groupBy("query_id").agg(F.when(F.count("*") == 1, F.min("id")).alias("target"), F.count("*").alias("tied"))


def path_evidence(ends: DataFrame, paths: DataFrame, lexical: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, id, retrieval_source, status, requires_batching of resolved path questions.

    ends: query_id, source, target, inferred (null source or target: unresolved, source_tied or target_tied: ambiguous);
    paths: source, target, path (an array, null if there is none); lexical: query_id, id, rank. A path is never cut, so it
    may be longer than the limit; what room it leaves goes to the lexical list.
    """
    met = ends.join(paths, ["source", "target"], "left")
    status = (
        F.when(F.coalesce("source_tied", F.lit(0)) > 1, "ambiguous_source")
        .when(F.col("source").isNull(), "unresolved_source")
        .when(F.coalesce("target_tied", F.lit(0)) > 1, "ambiguous_target")
        .when(F.col("target").isNull(), "unresolved_target")
        .when(F.col("path").isNull(), "no_path")
        .when(F.col("inferred"), "inferred_path")
        .otherwise("explicit_path")
    )
    met = met.withColumn("status", status).withColumn("n", F.when(F.col("status").endswith("_path") & (F.col("status") != "no_path"), F.size("path")).otherwise(0))
    own = met.filter("n > 0").select("query_id", "status", "n", F.posexplode("path").alias("at", "id"))
    own = own.select("query_id", "status", "n", F.lit(0).alias("part"), F.col("at").alias("place"), "id", F.lit("graph_path").alias("retrieval_source"))
    rest = lexical.join(met.select("query_id", "status", "n"), "query_id", "left").join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rest = rest.select("query_id", F.coalesce("status", F.lit("lexical")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("part"), F.col("rank").cast("int").alias("place"), "id", F.lit("lexical").alias("retrieval_source"))
    every = own.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "place", "id")))
    return every.filter(F.col("rank") <= F.greatest("n", F.lit(limit))).select("query_id", "rank", "id", "retrieval_source", "status", (F.col("n") > limit).alias("requires_batching"))


def expanded(found: DataFrame, edges: DataFrame, least: float = 0.6, top: int = 3) -> DataFrame:
    """query_id, id, rank: found (query_id, id, rank) with what the first few call, or are called by, behind it; each once."""
    w = graph.weighted(edges, least)
    both = w.select(F.col("caller").alias("id"), F.col("callee").alias("near"), F.lit(0).alias("way")).unionByName(w.select(F.col("callee").alias("id"), F.col("caller").alias("near"), F.lit(1).alias("way")))
    # merged: lists of questions are often exploded, and then far larger than the estimate by which they would be broadcast
    more = found.filter(F.col("rank") <= top).hint("merge").join(both, "id").select("query_id", F.col("near").alias("id"), F.struct("rank", "way", "near").alias("at"))
    more = more.join(found.select("query_id", "id").hint("merge"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min("at").alias("at"))
    every = found.select("query_id", "id", F.struct(F.lit(0).alias("part"), F.struct("rank", F.lit(0).alias("way"), F.col("id").alias("near")).alias("at")).alias("o")).unionByName(more.select("query_id", "id", F.struct(F.lit(1).alias("part"), "at").alias("o")))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).select("query_id", "id", "rank")


def reranked(found: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, id, rank: found in the order of a model's answer (query_id, ids), if that is a permutation of it; else as
    it was. A query's list is a top-k."""
    own = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("own"))
    met = own.join(answers, "query_id", "left")
    good = F.coalesce(F.array_sort("ids") == F.array_sort("own"), F.lit(False))
    out = met.select("query_id", F.posexplode(F.when(good, F.col("ids")).otherwise(F.col("own"))).alias("at", "id"))
    return out.select("query_id", "id", (F.col("at") + 1).alias("rank"))


def structural_text(rows: DataFrame, operation: str, least: float = 0.6, none: DataFrame | None = None) -> DataFrame:
    """target, answer: the text of a graph question without a model, from its rows (target, position, name, cite, line)."""
    line = F.concat(F.lit("- "), "name", F.lit(" "), "cite", F.when(F.col("line").isNotNull(), F.concat(F.lit("; call-site "), "line")).otherwise(""))
    listed = rows.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("text")))), lambda x: x["text"]), "\n").alias("lines"))
    head = f"{NOTE}\nGraph query: {operation}. Confidence >= {least}.\n"
    out = listed.select("target", F.concat(F.lit(head), "lines").alias("answer"))
    if none is not None:
        out = out.unionByName(none.join(listed, "target", "left_anti").select("target", F.lit(head + "No matching results within the limits.").alias("answer")))
    return out


def dense_view(units: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(unit_id, hash of every unit; new cache rows hash, vector): units (unit_id, text) by the hash of their text; only
    contents that the cache (hash, vector) lacks are embedded, each once."""
    keyed = units.withColumn("hash", F.sha2("text", 256))
    misses = keyed.groupBy("hash").agg(F.min("text").alias("text")).join(cache.select("hash"), "hash", "left_anti")
    return keyed.select("unit_id", "hash"), embed(misses)


def build_dense(units: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str) -> tuple[DataFrame | None, dict]:
    """(vectors by unit, status): a failure is the view's own, told in its status, and leaves the old view as it was."""
    try:
        keys, fresh = dense_view(units, cache, embed)
        vectors = keys.join(cache.select("hash", "vector").unionByName(fresh.select("hash", "vector")), "hash")
        return vectors, {"view": "dense", "status": "fresh", "model": model, "count": keys.count()}
    except Exception as e:  # whatever the model does must not take lexical search down
        return None, {"view": "dense", "status": "failed", "error": str(e)[:300]}


def ranking_matrix(queries: list[list[float]], units: list[list[float]]) -> list[list[int]]:
    """Unit places by cosine for each query, the best first; equal ones in order. For a bench of few vectors: vectors of
    unequal length, zeros and values that aren't finite are errors."""
    q, u = (np.array(x, np.float64) for x in (queries, units))
    if q.ndim != 2 or u.ndim != 2 or q.shape[1] != u.shape[1]:
        raise ValueError("vectors differ in length")
    if not (np.isfinite(q).all() and np.isfinite(u).all()) or not (np.linalg.norm(q, axis=1).all() and np.linalg.norm(u, axis=1).all()):
        raise ValueError("vectors must be finite and not zero")
    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    return np.argsort(-near, axis=1, kind="stable").tolist()


