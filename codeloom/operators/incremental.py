"""Snapshots: what changed, what is gone, caches by content, bounded sessions and last states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """key and change: inserted, updated, deleted or unchanged, by one full outer join on the key."""
    o, n = old.select(F.col(key), F.col(digest).alias("was")), new.select(F.col(key), F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def gone(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti")


def to_embed(units: DataFrame, cache: DataFrame) -> DataFrame:
    """digest, id, copies of contents that the cache (digest) lacks: each content once, for its least id."""
    once = units.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return once.join(cache.select("digest"), "digest", "left_anti")


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    """The last n turns (conv_id, turn and more) of each conversation, oldest first in place 1."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; a partial maximum of structs, so a hot key shrinks before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("l")).select(key, *(F.col(f"l.{c}").alias(c) for c in rest))


def replace_edges(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Edges of one source replaced; equal keys (caller, callee_expr, line, source, callee) once."""
    every = old.filter(F.col("source") != source).unionByName(new.filter(F.col("source") == source))
    return every.withColumn("__callee", F.coalesce("callee", F.lit(""))).dropDuplicates(["caller", "callee_expr", "line", "source", "__callee"]).drop("__callee")


def expired(items: DataFrame, calls: DataFrame) -> DataFrame:
    """id of items (id, context_hash, members) whose context, the hashes of what they call, has changed."""
    now = calls.groupBy(F.col("caller").alias("id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("callee_hash")), "\x1f"), 256).alias("now"))
    return items.join(now, "id").filter(F.col("context_hash") != F.col("now")).select("id")
