"""Snapshots kept in step with a tree: files, symbols, edges, caches, sessions, states and what must be done again.

Tables are Parquet snapshots, so every upsert is a keyed join that gives the next snapshot.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What an answer depends on besides its question.
VERSION_KEYS = [
    "repo_root", "epoch", "parser_version", "resolve_fingerprint", "graph_version", "gen_model_tag", "gen_model_digest", "embed_model_tag", "embed_model_digest",
    "prompt_version", "schema_version", "summary_schema_version", "retrieval_version", "router_version", "verification_version", "guard_version", "verifier_model_digest", "generation_options",
]


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, sha256, language, parse_status) after a scan, with changed: a new path is open, a changed hash pending,
    an equal one keeps its status; what the scan lacks is gone."""
    was = old.select("path", F.col("sha256").alias("__sha"), F.col("parse_status").alias("__status"), F.lit(True).alias("__known"))
    met = new.select("path", "sha256", "language").join(was, "path", "left")
    same = F.coalesce(F.col("sha256") == F.col("__sha"), F.lit(False))
    return met.select("path", "sha256", "language", F.when(same, F.col("__status")).when(F.col("__known"), "pending").alias("parse_status"), (~same).alias("changed"))


def missing_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path"), "path", "left_anti")


def sync_symbols(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next symbols, changes by kind): old: id, code_hash, status and more; new: id, code_hash and all parsed fields.

    Every parsed field is the new one, also of unchanged code, as lines move; status and other fields of the old snapshot
    stay, and an inserted symbol is pending. changes has one row a kind, counted.
    """
    keep = [c for c in old.columns if c not in new.columns]
    was = old.select("id", F.col("code_hash").alias("__hash"), *keep)
    met = new.join(was, "id", "left")
    after = met.withColumn("status", F.coalesce("status", F.lit("pending"))) if "status" in keep else met
    every = old.select("id", F.col("code_hash").alias("a")).join(new.select("id", F.col("code_hash").alias("b")), "id", "full_outer")
    kind = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated")
    return after.drop("__hash"), every.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def index_version(meta: dict[str, str]) -> str:
    """The hash over everything that answers depend on; missing keys count as null."""
    fields = {"cache_version": 2} | {k: meta.get(k) for k in VERSION_KEYS}
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def bumped(meta: DataFrame, key: str = "epoch") -> DataFrame:
    """meta (key, value) with the counter one up, or 1 if there was none."""
    rest = meta.filter(F.col("key") != key)
    one = meta.filter(F.col("key") == key).agg((F.coalesce(F.max(F.col("value").cast("long")), F.lit(0)) + 1).cast("string").alias("value"))
    return rest.unionByName(one.select(F.lit(key).alias("key"), "value"))


def tree_fingerprint(files: DataFrame, *versions: str) -> str:
    """A hash over paths, file hashes and versions. Files are hashed into buckets by path first, so that what reaches the
    driver is 256 hashes, whatever the number of files."""
    row = F.concat("path", F.lit(":"), "sha256")
    buckets = files.groupBy(F.pmod(F.xxhash64("path"), F.lit(256)).alias("b")).agg(F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = buckets.orderBy("b").collect()
    return hashlib.sha256("\x1f".join([*(f"{r['b']}:{r['s']}:{r['n']}" for r in rows), *versions]).encode()).hexdigest()


def resolved_again(files: DataFrame, stored: str | None, resolve, *versions: str) -> tuple[DataFrame | None, str]:
    """(edges by resolve(), fingerprint); no edges if the stored fingerprint is still the tree's."""
    now = tree_fingerprint(files, *versions)
    return (None, now) if stored == now else (resolve(), now)


def reparse(files: DataFrame, language: str, stored_version: str, version: str) -> DataFrame:
    """files with those of the language pending if its parser is another one now."""
    if stored_version == version:
        return files
    return files.withColumn("parse_status", F.when(F.col("language") == language, "pending").otherwise(F.col("parse_status")))


def rippled(changed: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, step of all whose summary is out of date if those of changed (id) are: their callers, and theirs, and so on."""
    from codeloom.sources.shared import kept

    back = edges.select(F.col("callee").alias("at"), F.col("caller").alias("id")).distinct()
    seen = frontier = kept(changed.select("id").distinct().withColumn("step", F.lit(0)))
    for k in range(1, rounds + 1):
        step = frontier.select(F.col("id").alias("at")).join(back, "at").select("id").distinct().join(seen, "id", "left_anti")
        frontier = kept(step.withColumn("step", F.lit(k)))
        if frontier.isEmpty():
            return seen
        seen = kept(seen.unionByName(frontier))
    raise RuntimeError("rippled: the bound on rounds was met")


def cached_answers(asked: DataFrame, cache: DataFrame, current: DataFrame, revision: str) -> DataFrame:
    """query_hash, answer of asked (query_hash) from cache (query_hash, answer, index_version, verified, n_evidence): verified,
    of this revision, with evidence, all of it current (owner, is_current)."""
    good = cache.filter("verified AND n_evidence > 0").filter(F.col("index_version") == revision).join(current.filter("is_current").select(F.col("owner").alias("query_hash")), "query_hash", "left_semi")
    return asked.join(good.select("query_hash", "answer"), "query_hash")


def put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in, by key: the new row replaces the old one."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def session_state(turns: DataFrame, refs: DataFrame, sessions: DataFrame, current: DataFrame, revision: str, max_turns: int = 4, max_refs: int = 15) -> tuple[DataFrame, DataFrame]:
    """(turns, references) that a session may still use.

    turns: session, turn and more: the last ones, none if the session's index_version isn't the revision. refs: session, id,
    at: each id at its last mention, the last ones of those that are current (id). sessions: session, index_version.
    """
    live = sessions.filter(F.col("index_version") == revision).select("session")
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))
    kept_turns = turns.join(live, "session", "left_semi").withColumn("n", last).filter(F.col("n") <= max_turns).drop("n")
    once = refs.groupBy("session", "id").agg(F.max("at").alias("at"))
    bounded = once.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("n") <= max_refs).drop("n")
    return kept_turns, bounded.join(current.select("id"), "id", "left_semi").select("session", "id", "at")


def advanced(symbols: DataFrame, outcomes: DataFrame) -> DataFrame:
    """symbols (id, status, attempts, error, summary) after outcomes (id, outcome, text, counted): done and trivial set a
    summary, failed quarantines with the error and clears it; only counted outcomes add an attempt."""
    o = outcomes.select("id", "outcome", "text", F.coalesce(F.col("counted").cast("int"), F.lit(0)).alias("more"))
    met = symbols.join(o, "id", "left")
    status = F.when(F.col("outcome") == "done", "done").when(F.col("outcome") == "trivial", "skipped_trivial").when(F.col("outcome") == "failed", "failed").otherwise(F.col("status"))
    good = F.col("outcome").isin("done", "trivial")
    return met.select(
        "id",
        status.alias("status"),
        (F.col("attempts") + F.coalesce("more", F.lit(0))).alias("attempts"),
        F.when(F.col("outcome") == "failed", F.substring("text", 1, 2000)).when(good, None).otherwise(F.col("error")).alias("error"),
        F.when(good, F.col("text")).when(F.col("outcome") == "failed", None).otherwise(F.col("summary")).alias("summary"),
    )


def progress(symbols: DataFrame, expected: DataFrame, rate: float) -> DataFrame:
    """pending, done, failed, skipped_trivial, stale, eta_s in one row: stale ones have another key (id, key) than expected
    (id, key); eta at so many a second, null if the rate is 0."""
    met = symbols.join(expected.select("id", F.col("key").alias("__key")), "id", "left")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    stale = F.count_if(~F.col("key").eqNullSafe(F.col("__key")))
    eta = F.round(stale / F.lit(rate), 6) if rate > 0 else F.lit(None).cast("double")
    return met.agg(count("pending"), count("done"), count("failed"), count("skipped_trivial"), stale.alias("stale"), eta.alias("eta_s"))


def work_plan(order: DataFrame, members: DataFrame, symbols: DataFrame, expected: DataFrame, retry_failed: bool = False) -> DataFrame:
    """position, scc_id, mode, todo of each item in processing order: cached if nothing is out of date, failed if what is has
    failed before and isn't tried again, combined for a recursion group with several to do, single otherwise.

    members: id, scc_id; symbols: id, status, key, valid (its stored summary can be read).
    """
    e = expected.select("id", F.col("key").alias("__key"))
    rows = members.join(symbols, "id").join(e, "id", "left")
    fresh = F.coalesce((F.col("key") == F.col("__key")) & F.col("valid"), F.lit(False))
    held = (F.col("status") == "failed") & F.lit(not retry_failed) & ~fresh
    items = rows.groupBy("scc_id").agg(F.count_if(~fresh & ~held).alias("todo"), F.count_if(held).alias("held"))
    mode = F.when(F.col("todo") > 1, "combined").when(F.col("todo") == 1, "single").when(F.col("held") > 0, "failed").otherwise("cached")
    return order.join(items, "scc_id").select("position", "scc_id", mode.alias("mode"), "todo")


def invalidated(symbols: DataFrame) -> DataFrame:
    """symbols (id, key, summary, status, error) with nothing that counts as done."""
    none = F.lit(None).cast("string")
    return symbols.withColumns({"key": none, "summary": none, "status": F.lit("pending"), "error": none})


def reset_dense(units: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units without embedding keys, view states with dense as stale); the vectors' table starts anew, empty."""
    state = F.when(F.col("view") == "dense", "stale").otherwise(F.col("status"))
    return units.withColumn("embed_hash", F.lit(None).cast("string")), views.withColumn("status", state)


