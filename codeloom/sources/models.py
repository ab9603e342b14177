"""Models behind two small protocols, with deterministic stand-ins, budget checks and retries; and the log of calls."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.budget import BudgetExceeded, estimate

EMBED_BATCH = 32
CALL = "ts timestamp, task string, symbol_id string, est_prompt_tokens long, actual_prompt_tokens long, output_tokens long, latency_s double, validation string, attempt int"


class TransportError(RuntimeError):
    """The model could not be reached; worth another try."""


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class EchoGenerator:
    """Gives back the first words of a prompt; the first `failures` calls fail."""

    words: int = 25
    failures: int = 0

    def generate(self, prompt: str) -> str:
        if self.failures:
            self.failures -= 1
            raise TransportError("not reachable")
        return " ".join(prompt.split()[: self.words])


@dataclass
class HashEmbedder:
    """Vectors of numbers from 0 to 1, four hex digits of the text's SHA-256 each; at most 16 dimensions."""

    dim: int = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return [[int(d[4 * k : 4 * k + 4], 16) / 65535 for k in range(self.dim)] for d in digests]


def with_retries(call: Callable[[], str], attempts: int = 3) -> tuple[str, int]:
    """(result, attempts used); only transport errors are tried again."""
    for k in range(1, attempts + 1):
        try:
            return call(), k
        except TransportError:
            if k == attempts:
                raise
    raise ValueError("attempts must be positive")


def replies(prompts: DataFrame, model: Generator, context: int, output: int, attempts: int = 3) -> DataFrame:
    """prompts (id, prompt) with reply, prompt_tokens, attempt, error: a prompt that doesn't leave room for the output is
    never sent; a model that stays away gives an error in its row, not a failed job. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, prompt in zip(batch["id"], batch["prompt"]):
                n = estimate(prompt)
                try:
                    if n + output > context:
                        raise BudgetExceeded(f"{n} tokens don't leave room for {output}")
                    reply, k = with_retries(lambda: model.generate(prompt), attempts)
                    rows.append((id_, reply, n, k, None))
                except (BudgetExceeded, TransportError) as e:
                    rows.append((id_, None, n, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", "reply", "prompt_tokens", "attempt", "error"]).astype({"attempt": "Int32"})

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, reply string, prompt_tokens long, attempt int, error string")


def embedded(rows: DataFrame, model: Embedder, batch_size: int = EMBED_BATCH) -> DataFrame:
    """rows (hash, text) with vector, by batches of texts; a vector of another length, or with values that aren't finite,
    is an error. Nothing is cut: callers cap texts first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                vectors = model.embed(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != model.dim or not all(map(math.isfinite, v)) for v in vectors):
                    raise ValueError("the model gave wrong vectors")
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "vector": vectors})

    return rows.select("hash", "text").mapInPandas(run, "hash string, vector array<double>")


def append_calls(calls: DataFrame, folder: str, name: str) -> None:
    """Appends call records, without any prompt text, as JSON lines in a folder `calls-<name>`."""
    calls.select(*(c.split()[0] for c in CALL.split(", "))).write.mode("append").json(f"{folder.rstrip('/')}/calls-{name}.jsonl")


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """All call records of a folder."""
    return spark.read.schema(CALL).json(f"{folder.rstrip('/')}/calls-*.jsonl")

