"""File discovery and filters as Columns over Spark's binary file source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders, names and suffixes that are never read.
EXCLUDED = (".git", ".hg", ".svn", ".tox", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist")
LOCKFILES = ("poetry.lock", "uv.lock", "Pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock")
SECRET = r"(^|/)\.env(\.[^/]*)?$|\.(pem|key|env|p12|pfx|jks|keystore|crt)$"
MAX_BYTES = 500_000


def is_binary(content: Column) -> Column:
    """A NUL within the first 8192 bytes."""
    return F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


def is_minified(text: Column) -> Column:
    """Mean line length over 1000; an empty text isn't."""
    return F.when(text == "", False).otherwise(F.char_length(text) / F.size(F.split(text, "\n", -1)) > 1000)


def is_secret(path: Column) -> Column:
    return F.lower(path).rlike(SECRET)


def is_lockfile(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES)


def language_of(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.py$"), "python").when(low.rlike(r"\.(toml|ya?ml|json|ini|cfg|conf)$"), "config").otherwise("other")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression over relative paths, negated); None for blanks and comments."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    rooted = "/" in line.rstrip("/")
    folder, line = line.endswith("/"), line.strip("/")
    out, i = "", 0
    while i < len(line):
        if line[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif line[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i])), i + 1
    return ("^" if rooted else "(^|/)") + out + ("/" if folder else "(/|$)"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a relative path is ignored: the last matching line decides."""
    out = F.lit(False)
    for found in filter(None, map(ignore_pattern, lines)):
        out = F.when(path.rlike(found[0]), not found[1]).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, ignore: list[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (relative), content, sha256, size_bytes, language, line_count of the files of a tree that are to be read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return selected(raw.select(path.alias("path"), "content", F.col("length").alias("size_bytes")), list(ignore), max_bytes)


def selected(rows: DataFrame, ignore: list[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows (path, content, size_bytes) to be read, with sha256, language and line_count. Paths and sizes are tested
    before contents."""
    rows = rows.filter(F.col("size_bytes") <= max_bytes)
    parts = F.split("path", "/")
    rows = rows.filter(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*EXCLUDED)))
    rows = rows.filter(~is_secret(F.col("path")) & ~is_lockfile(F.col("path")) & ~ignored(F.col("path"), list(ignore)))
    text = F.decode("content", "UTF-8")
    rows = rows.filter(~is_binary(F.col("content"))).filter(~is_minified(text))
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"), "size_bytes", language_of(F.col("path")).alias("language"), F.size(F.split(text, "\n", -1)).alias("line_count"))
