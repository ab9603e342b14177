"""Citations, interval joins, evidence currency and static claim rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T

#: Claims that are never taken without evidence: name and pattern.
CLAIM_RULES = [
    ("absolute", r"\b(always|never|guarantees?|impossible)\b"),
    ("hedge", r"\b(probably|might|perhaps|seems)\b"),
    ("number", r"\b\d+(\.\d+)?\s*(%|ms|s|mb|gb|x)(\b|\s|$)"),
    ("url", r"https?://"),
    ("address", r"[a-z0-9._]+@[a-z0-9.]+"),
    ("license", r"\blicen[cs]e"),
]


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (path, a, b) that overlap a row of right (path, a, b): equi-join on the path, range as residual."""
    r = right.select(F.col("path").alias("__p"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    return left.join(r, (left["path"] == r["__p"]) & (left["a"] <= r["__b"]) & (r["__a"] <= left["b"]), "left_semi")


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that lie within a row of right."""
    r = right.select(F.col("path").alias("__p"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    return left.join(r, (left["path"] == r["__p"]) & (r["__a"] <= left["a"]) & (left["b"] <= r["__b"]), "left_semi")


def cited(answers: DataFrame) -> DataFrame:
    """answer_id, position, path, a, b of each citation in answers (answer_id, text)."""
    return answers.select("answer_id", F.posexplode(T.citations(F.col("text"))).alias("position", "c")).select("answer_id", "position", "c.path", F.col("c.start").alias("a"), F.col("c.end").alias("b"))


def verified(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """answer_id, n_citations, n_valid, status: a citation holds if its span is well-formed and within a supplied block."""
    c = cited(answers)
    good = contained(c.filter("a >= 1 AND b >= a"), blocks).groupBy("answer_id").agg(F.count("*").alias("v"))
    every = c.groupBy("answer_id").agg(F.count("*").alias("n"))
    out = answers.select("answer_id").join(every, "answer_id", "left").join(good, "answer_id", "left")
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))
    return out.select("answer_id", n.alias("n_citations"), v.alias("n_valid"), F.when(n == 0, "abstained").when(v == n, "complete").when(v > 0, "partial").otherwise("abstained").alias("status"))


def current(evidence: DataFrame, state: DataFrame) -> DataFrame:
    """owner, is_current: every piece (owner, id, code_hash) still has its hash in state (id, code_hash)."""
    s = state.select("id", F.col("code_hash").alias("now"))
    return evidence.join(s, "id", "left").groupBy("owner").agg(F.every(F.coalesce(F.col("code_hash") == F.col("now"), F.lit(False))).alias("is_current"))


def claims(texts: DataFrame) -> DataFrame:
    """id, position, claim: sentences and lines, trimmed, empty ones left out."""
    parts = F.filter(F.transform(F.split("text", r"\n+|[.!?]+\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select("id", F.posexplode(parts).alias("position", "claim"))


def rule_hits(found: DataFrame) -> DataFrame:
    """id, position, rule of each rule that a claim breaks; one pass, no join with the rules."""
    broken = F.array(*(F.when(F.lower("claim").rlike(p), F.lit(n)) for n, p in CLAIM_RULES))
    return found.select("id", "position", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


NAMED = r"(?<!`)`([^`\n]+)`(?!`)"


def unknown_names(answers: DataFrame, symbols: DataFrame, builtins: list[str]) -> DataFrame:
    """answer_id, name: dotted names in single backquotes of answers (answer_id, text) that are no built-in, no file and no
    symbol by its full name, its name, its end, or its module's path in front. symbols: qualname, name, file_path."""
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAMED), F.lit(1)))).alias("name"))
    found = found.filter(F.col("name").rlike(r"^[A-Za-z_]\w*(\.\w+)*$") & ~F.col("name").isin(*builtins))
    own = F.split("qualname", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))
    module = F.replace(F.regexp_replace("file_path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    known = symbols.select(F.explode(F.concat(ends, F.array("name", "file_path", F.concat(module, F.lit("."), "qualname")))).alias("name")).distinct()
    return found.join(known, "name", "left_anti").select("answer_id", "name")


def fallback(answers: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """answer_id, sufficient, text: answers (answer_id, text, n_valid) without a valid citation give their first k hits
    (answer_id, position, line) instead of a text."""
    w = F.row_number().over(Window.partitionBy("answer_id").orderBy("position"))
    top = hits.withColumn("n", w).filter(F.col("n") <= k).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("top"))
    lines = F.array_join(F.transform(F.coalesce("top", F.array().cast("array<struct<n:int,line:string>>")), lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    out = answers.join(top, "answer_id", "left")
    enough = F.coalesce(F.col("n_valid") > 0, F.lit(False))
    return out.select("answer_id", enough.alias("sufficient"), F.when(enough, F.col("text")).otherwise(F.concat(F.lit("insufficient context\n\nTop hits:\n"), lines)).alias("text"))


def contexts(symbols: DataFrame, edges: DataFrame, digests: DataFrame) -> DataFrame:
    """id, callers, context of symbols (id): the hash over the sorted digests (id, digest) of what each calls. A symbol's
    callees are its own calls, so they are few; callers are only counted."""
    out = edges.join(digests.select(F.col("id").alias("callee"), "digest"), "callee").groupBy(F.col("caller").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("digest")), T.UNIT).alias("of"))
    back = edges.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("callers"))
    met = symbols.join(out, "id", "left").join(back, "id", "left")
    return met.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.sha2(F.coalesce("of", F.lit("")), 256).alias("context"))
