"""Question suites in YAML, typed configuration, snapshots with versions, and result sinks."""

from __future__ import annotations

import dataclasses
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.sources.shared import scratch

# The question types of a suite, each with what must be expected of it.
QUESTION_TYPES = {"symbol": ["symbols"], "module": ["symbols"], "behavioral": ["symbols"], "traversal": ["ordered_symbols"], "structural": ["callers"], "reasoning": ["symbols"]}
QUESTION = "id string, type string, question string, verified boolean, source string, target string, symbols array<string>, callers array<string>, ordered_symbols array<string>, keywords array<string>"


class SuiteError(ValueError):
    """A suite that can't be run as it is."""


def parse_suite(text: str) -> list[dict]:
    """Questions of a suite: version 1, ids once each, a known type, and what the type must expect; else SuiteError."""
    import yaml

    suite = yaml.safe_load(text)
    if not isinstance(suite, dict) or suite.get("version") != 1 or not isinstance(suite.get("questions"), list):
        raise SuiteError("a suite has version 1 and a list of questions")
    seen, out = set(), []
    for q in suite["questions"]:
        name = q.get("id") if isinstance(q, dict) else None
        if not isinstance(name, str) or not name or name in seen:
            raise SuiteError(f"id missing or repeated: {name!r}")
        seen.add(name)
        needs = QUESTION_TYPES.get(q.get("type"))
        if needs is None or not q.get("question"):
            raise SuiteError(f"{name}: a known type and a question are wanted")
        expected = q.get("expected") or {}
        if missing := [n for n in needs if not isinstance(expected.get(n), list)]:
            raise SuiteError(f"{name}: expected {missing[0]} is missing")
        if q["type"] == "traversal" and not (q.get("source") and q.get("target")):
            raise SuiteError(f"{name}: source and target are wanted")
        lists = {k: expected.get(k) for k in ("symbols", "callers", "ordered_symbols", "keywords")}
        out.append({k: q.get(k) for k in ("id", "type", "question", "source", "target")} | {"verified": bool(q.get("verified"))} | lists)
    return out


def read_suite(spark: SparkSession, text: str) -> DataFrame:
    """A suite's questions as rows of QUESTION."""
    fields = [c.split()[0] for c in QUESTION.split(", ")]
    return spark.createDataFrame([tuple(q[f] for f in fields) for q in parse_suite(text)], QUESTION)


@dataclasses.dataclass(frozen=True)
class Settings:
    """Typed settings with their defaults."""

    num_ctx: int = 8192
    max_file_bytes: int = 500_000
    edge_conf_threshold: float = 0.6
    retrieval_top_k: int = 5
    rrf_k: int = 60
    graph_expansion: bool = False
    embed_model: str = "nomic-embed-text"


def load_settings(toml: str = "", env: dict[str, str] | None = None, prefix: str = "CODELOOM_") -> tuple[Settings, dict[str, str]]:
    """(settings, origin of each): the environment before the file before the defaults; values that don't fit their type
    and unknown names in the file are errors."""
    env = dict(os.environ) if env is None else env
    file = tomllib.loads(toml)
    fields = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    if unknown := set(file) - set(fields):
        raise ValueError(f"unknown setting {min(unknown)}")
    values, origin = {}, {}
    for name, kind in fields.items():
        raw, origin[name] = (env[prefix + name.upper()], "env") if prefix + name.upper() in env else (file[name], "file") if name in file else (None, "default")
        if raw is None:
            continue
        if kind is bool:
            low = str(raw).lower()
            if low not in ("true", "false", "1", "0"):
                raise ValueError(f"{name}: {raw!r} is no boolean")
            values[name] = low in ("true", "1")
        else:
            values[name] = kind(raw)
    return Settings(**values), origin


def write_snapshot(df: DataFrame, folder: str, name: str, version: int) -> str:
    """Writes a version of a table next to its older ones; nothing that is being read is overwritten."""
    path = f"{folder.rstrip('/')}/{name}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """The latest version of a table; with a schema, one of other columns or types is an error."""
    base = f"{folder.rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    latest = max(int(x.getPath().getName().partition("=")[2]) for x in found)
    df = spark.read.parquet(f"{base}/version={latest}")
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{name} version {latest} has another schema: {df.schema.simpleString()}")
    return df


def migrate(df: DataFrame, done: int, migrations: dict[int, object]) -> tuple[DataFrame, list[int]]:
    """(df after all migrations over `done` in order, their numbers); a migration is a function of a DataFrame."""
    applied = [k for k in sorted(migrations) if k > done]
    for k in applied:
        df = migrations[k](df)
    return df, applied


def result_lines(df: DataFrame) -> DataFrame:
    """value: each row as a line of JSON, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def doctor(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """check, ok of what a session needs: version, adaptive execution, a shared folder, and every table's schema readable."""
    checks = [("spark 4", spark.version.startswith("4.")), ("adaptive execution", spark.conf.get("spark.sql.adaptive.enabled") == "true")]
    try:
        scratch(spark, "doctor")
        checks.append(("shared folder", True))
    except RuntimeError:
        checks.append(("shared folder", False))
    for t in tables:
        try:
            checks.append((f"table {t}", len(spark.read.parquet(f"{folder}/{t}.parquet").columns) > 0))
        except Exception:  # a missing or broken table is what is looked for
            checks.append((f"table {t}", False))
    return spark.createDataFrame(checks, "check string, ok boolean")
