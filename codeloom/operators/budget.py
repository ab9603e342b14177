"""Token budgets: batches in order, greedy block rendering, priority assembly and limits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

#: A fold's state: tokens in the open batch, its number, and the batches so far.
_STATE = "struct<used:bigint,batch:int,out:array<int>>"


def batches(sizes: Column, limit: int) -> Column:
    """Batch number of each size, in order: a batch is closed when the next size doesn't fit; an oversized one is alone."""
    start = F.expr(f"cast(named_struct('used', 0, 'batch', 0, 'out', array()) as {_STATE})")

    def step(state: Column, size: Column) -> Column:
        full = (state["used"] > 0) & (state["used"] + size > limit)
        batch = state["batch"] + F.when(full, 1).otherwise(0)
        return F.struct((F.when(full, F.lit(0)).otherwise(state["used"]) + size).cast("bigint").alias("used"), batch.cast("int").alias("batch"), F.concat(state["out"], F.array(batch.cast("int"))).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def batched(rows: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """key, order, size, batch: rows of a key (a session, a prompt: bounded) in order, dealt to batches."""
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(size).cast("bigint").alias(size)))).alias("r"))
    numbered = gathered.withColumn("b", batches(F.transform("r", lambda x: x[size]), limit))
    return numbered.select(key, F.explode(F.arrays_zip("r", "b")).alias("z")).select(key, F.col(f"z.r.{order}").alias(order), F.col(f"z.r.{size}").alias(size), F.col("z.b").alias("batch"))


def rendered(sizes: Column, limit: int, overhead: int = 8, most: int = 8) -> Column:
    """Places (from 0) of the blocks taken: greedy in order; one that doesn't fit is skipped, not the rest."""
    start = F.expr("cast(named_struct('used', 0, 'at', 0, 'out', array()) as struct<used:bigint,at:int,out:array<int>>)")

    def step(s: Column, size: Column) -> Column:
        fits = (s["used"] + size + overhead <= limit) & (F.size(s["out"]) < most)
        return F.struct((s["used"] + F.when(fits, size + overhead).otherwise(F.lit(0))).cast("bigint").alias("used"), (s["at"] + 1).cast("int").alias("at"), F.when(fits, F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def assert_fits(prompt: Column, output: Column, context: int) -> Column:
    """The prompt's tokens, or an error if prompt and output don't fit the context."""
    return F.when(prompt + output <= context, prompt).otherwise(F.raise_error(F.concat(F.lit("over budget by "), (prompt + output - context).cast("string"))))


def fits(prompt: Column, output: Column, context: int) -> Column:
    return prompt + output <= context


class BudgetExceeded(ValueError):
    """A part that must stay doesn't fit."""


def estimate(text: str) -> int:
    """tokens_by_ratio for a Python string."""
    return math.ceil(len(text) / T.CHARS_PER_TOKEN * T.TOKEN_MARGIN)


def truncated(text: str, most: int, pointer: str = "") -> str:
    """The text within `most` tokens: as many whole lines of its head and tail as fit, or if fewer than two do, characters
    of both ends. Empty if not even the marker fits. The number of lines is searched, as the estimate never falls with it."""
    if estimate(text) <= most:
        return text
    lines, end = text.splitlines(keepends=True), f"\n{pointer}" if pointer else ""

    def by_lines(n: int) -> str:
        return "".join(lines[: n - n // 2]).rstrip() + f"\n...[{len(lines) - n} lines omitted]\n" + "".join(lines[len(lines) - n // 2 :]).lstrip() + end

    def by_chars(n: int) -> str:
        return text[: n - n // 2] + f"\n...[{max(1, len(lines) - 2)} lines omitted]\n" + text[len(text) - n // 2 :] + end

    for cut, least, top in ((by_lines, 2, len(lines) - 1), (by_chars, 2, max(2, len(text) - 1))):
        low, high = least - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if estimate(cut(mid)) <= most else (low, mid - 1)
        if low >= least:
            return cut(low)
    return ""


def assemble(prefix: str, parts: list[dict], room: int) -> tuple[str, list[str], list[str]]:
    """(prompt, dropped names, truncated names) of parts (name, text, priority, truncatable, least) within `room` tokens.

    Parts give way from the largest priority number on: a truncatable one is cut to what is left, unless that is under
    its least tokens; else it is dropped. Priority 1 is never dropped: BudgetExceeded.
    """
    texts, gone, cut = [p["text"] for p in parts], [], []

    def prompt() -> str:
        return "\n\n".join(x for x in (prefix, *texts) if x)

    if estimate(prefix) > room:
        raise BudgetExceeded("the prefix alone is over the budget")
    for k in sorted(range(len(parts)), key=lambda k: -parts[k]["priority"]):
        if estimate(prompt()) <= room:
            break
        p, texts[k] = parts[k], ""
        if p["truncatable"]:
            left = room - estimate(prompt())
            while left > 0 and (short := truncated(p["text"], left)):
                texts[k] = short
                if estimate(prompt()) <= room:
                    break
                texts[k], left = "", left - 1
            if texts[k] and estimate(texts[k]) >= max(int(p["priority"] == 1), p["least"]):
                cut.append(p["name"])
                continue
            texts[k] = ""
        if p["priority"] == 1:
            raise BudgetExceeded(f"{p['name']} must stay and doesn't fit")
        gone.append(p["name"])
    return prompt(), gone, cut


def assembled(parts: DataFrame, prefix: str, context: int, output: int, overhead: int = 0) -> DataFrame:
    """prompt, text, tokens, n_kept, n_dropped, n_cut, error of each prompt from its parts (prompt, name, text, priority,
    truncatable, least): assemble() within what context, output and overhead leave. A prompt's parts are gathered: they
    are bounded by nature, and beyond the context most are dropped."""
    room = context - output - overhead

    def run(key, rows):
        given = rows.sort_values(["priority", "name"], kind="stable").to_dict("records")
        try:
            text, gone, cut = assemble(prefix, given, room)
            row = (key[0], text, estimate(text) + overhead, len(given) - len(gone), len(gone), len(cut), None)
        except BudgetExceeded as e:
            row = (key[0], None, None, None, None, None, str(e))
        return pd.DataFrame([row], columns=["prompt", "text", "tokens", "n_kept", "n_dropped", "n_cut", "error"]).astype({c: "Int64" for c in ("tokens", "n_kept", "n_dropped", "n_cut")})

    kind = parts.schema["prompt"].dataType.simpleString()
    return parts.groupBy("prompt").applyInPandas(run, f"prompt {kind}, text string, tokens long, n_kept long, n_dropped long, n_cut long, error string")


def capped(rows: DataFrame, column: str, most: int, pointer: str = "") -> DataFrame:
    """rows with the column's texts truncated(); an error where not even the marker and the pointer fit."""

    def cut(text: str | None) -> str | None:
        out = text and truncated(text, most, pointer)
        if text and not out:
            raise BudgetExceeded("the cap doesn't hold a head, a tail and the pointer")
        return out

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return rows.withColumn(column, F.when(T.tokens_by_ratio(F.col(column)) <= most, F.col(column)).otherwise(run(column)))


def line_parts(files: DataFrame, key: str, column: str, limit: int, overhead: int = 4) -> DataFrame:
    """key, part, start_line, end_line: a file's lines in order, dealt to contiguous parts of at most `limit` tokens; a line
    costs its estimate and `overhead`. One row a file goes in, so nothing is shuffled."""
    sizes = F.transform(F.split(column, "\n", -1), lambda x: T.tokens_by_ratio(x) + overhead)
    numbered = files.select(key, F.posexplode(batches(sizes, limit)).alias("i", "part"))
    return numbered.groupBy(key, "part").agg((F.min("i") + 1).cast("long").alias("start_line"), (F.max("i") + 1).cast("long").alias("end_line"))


def calibrated(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, ratio: characters a token, from calls (chars, tokens) in order, each weighing a tenth; calls without tokens or
    under 0.6 of their estimate (a prompt cache) don't count. A key's calls are folded in the JVM."""
    rows = calls.filter("chars > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("chars").cast("double").alias("chars"), F.col("tokens").cast("double").alias("tokens")))).alias("r"))

    def step(ratio: Column, c: Column) -> Column:
        skip = (c["tokens"] <= 0) | (c["tokens"] < 0.6 * F.ceil(c["chars"] / ratio * F.lit(T.TOKEN_MARGIN)))
        return F.when(skip, ratio).otherwise(0.9 * ratio + 0.1 * (c["chars"] / c["tokens"]))

    return rows.select(key, F.round(F.aggregate("r", F.lit(T.CHARS_PER_TOKEN), step), 6).alias("ratio"))
