"""Retrieval and graph metrics, their summary and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.verify import contained, overlaps


def span_recall(questions: DataFrame, expected: DataFrame, returned: DataFrame, k: int = 5) -> DataFrame:
    """question, recall: distinct expected spans that the first k distinct returned spans overlap; nothing expected: 1.

    expected, returned: path (the question's), a, b; returned also has position.
    """
    first = returned.groupBy("path", "a", "b").agg(F.min("position").alias("position")).withColumn("n", F.row_number().over(_by("path", "position"))).filter(F.col("n") <= k)
    e = expected.select("path", "a", "b").distinct()
    hit = overlaps(e, first).groupBy("path").agg(F.count("*").alias("hits"))
    out = questions.join(e.groupBy("path").agg(F.count("*").alias("n")), "path", "left").join(hit, "path", "left")
    return out.select("path", F.when(F.col("n").isNull(), 1.0).otherwise(F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6)).alias("recall"))


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def citation_validity(questions: DataFrame, citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, validity: citations within a block over all; malformed ones count as invalid, none at all as 0."""
    good = contained(citations.filter("a >= 1 AND b >= a"), blocks).groupBy("path").agg(F.count("*").alias("v"))
    out = questions.join(citations.groupBy("path").agg(F.count("*").alias("n")), "path", "left").join(good, "path", "left")
    return out.select("path", F.round(F.coalesce(F.coalesce("v", F.lit(0)) / F.col("n"), F.lit(0.0)), 6).alias("validity"))


def same_set(pairs: DataFrame) -> DataFrame:
    """Adds exact: 1 if the arrays expected and returned are equal as sets."""
    s = lambda c: F.array_sort(F.array_distinct(c))
    return pairs.withColumn("exact", (s("expected") == s("returned")).cast("double"))


def summary(metrics: DataFrame) -> DataFrame:
    """type, metric, mean, n over rows (type, metric, value) that have the metric."""
    return metrics.filter("value IS NOT NULL").groupBy("type", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, value_a, value_b, delta, side (both, only_a, only_b) of two runs (key, value)."""
    joined = a.select(key, F.col("value").alias("value_a")).join(b.select(key, F.col("value").alias("value_b")), key, "full_outer")
    side = F.when(F.col("value_a").isNull(), "only_b").when(F.col("value_b").isNull(), "only_a").otherwise("both")
    return joined.select(key, "value_a", "value_b", F.round(F.col("value_b") - F.col("value_a"), 6).alias("delta"), side.alias("side"))


def same_order(pairs: DataFrame) -> DataFrame:
    """Adds exact: 1 if the arrays expected and returned are equal as ordered lists."""
    return pairs.withColumn("exact", F.col("expected").eqNullSafe(F.col("returned")).cast("double"))


def tokens_per_answer(calls: DataFrame, key: str, answers: int | None = None) -> DataFrame:
    """key, mean_tokens over calls (tokens, ok) that succeeded, per_answer with a given number of answers as the divisor;
    null where there is none."""
    good = F.when(F.col("ok"), F.col("tokens"))
    per = F.round(F.sum(good) / F.lit(float(answers)), 6) if answers else F.lit(None).cast("double")
    return calls.groupBy(key).agg(F.round(F.avg(good), 6).alias("mean_tokens"), per.alias("per_answer"))


def span(raw: Column) -> Column:
    """valid, path, start_line, end_line of a citation in text, in brackets or not: lines from 1, the end not before the
    start, back slashes as slashes; one bracket alone is malformed."""
    opened, closed = raw.startswith("["), raw.endswith("]")
    inner = F.when(opened & closed, F.substr(raw, F.lit(2), F.char_length(raw) - 2)).when(opened | closed, F.lit("")).otherwise(raw)
    part = lambda k: F.regexp_extract(inner, r"^(.+?):(\d+)-(\d+)$", k)
    a, b = part(2).try_cast("long"), part(3).try_cast("long")
    good = F.coalesce((part(1) != "") & (a >= 1) & (b >= a), F.lit(False))
    return F.struct(good.alias("valid"), F.when(good, F.replace(part(1), F.lit("\\"), F.lit("/"))).alias("path"), F.when(good, a).alias("start_line"), F.when(good, b).alias("end_line"))


def unresolved(questions: DataFrame, known: DataFrame) -> DataFrame:
    """References of questions (question, reference) that known (reference) lacks; a run needs this to be empty."""
    return questions.join(known, "reference", "left_anti").select("question", "reference")


def checked_run(questions: DataFrame, known: DataFrame) -> DataFrame:
    """questions as they are, or an error that names the first reference that can't be resolved."""
    missing = unresolved(questions, known).orderBy("question", "reference").first()
    if missing is not None:
        raise ValueError(f"question {missing['question']}: {missing['reference']} isn't indexed")
    return questions


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """type, metric, mean_a, mean_b, delta of two runs (type, metric, value)."""
    mean = lambda df, name: df.filter("value IS NOT NULL").groupBy("type", "metric").agg(F.avg("value").alias(name))
    met = mean(a, "a").join(mean(b, "b"), ["type", "metric"], "full_outer")
    return met.select("type", "metric", F.round("a", 6).alias("mean_a"), F.round("b", 6).alias("mean_b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def rates(calls: DataFrame, key: str) -> DataFrame:
    """key, calls, valid, valid_rate, tokens_per_second, mean_tokens of calls (valid, tokens, seconds); no division by 0."""
    good = F.count_if("valid")
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        good.alias("valid"),
        F.round(good / F.count("*"), 6).alias("valid_rate"),
        F.round(F.sum("tokens") / F.nullif(F.sum("seconds"), F.lit(0)), 6).alias("tokens_per_second"),
        F.round(F.avg(F.when(F.col("valid"), F.col("tokens"))), 6).alias("mean_tokens"),
    )
