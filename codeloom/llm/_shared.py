"""Shared folders, written intermediates and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: The ASCII white space that the contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset on a local master.
    A cluster without one is an error, as its machines share no local folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return f"file://{LOCAL_CHECKPOINTS}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/codeloom-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path.rpartition("/")[0]))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that new_path() named."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            return


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_hash(column: str | Column = "text") -> Column:
    """64 bits of the whole text: with the id, it tells rows apart whose ids are null or repeat."""
    return F.xxhash64(whole_text(column))


def matching(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) to found (doc_id, text_hash) by both; the columns of docs stay as they are."""
    keys = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (text_hash(docs["text"]) == F.col("__hash"))
    return docs.join(keys, same, how)


def one_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that match found (one row for each that stays) as in matching(), but one of those that share doc_id
    and text.

    Keys are counted first, without texts. Only rows whose key comes more than once are deduplicated, so other texts are
    shuffled for the match alone; each task drops its own repeats before that shuffle, and a key with very many rows
    doesn't meet in one task.
    """
    keys = written(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept-keys")
    tied = keys.filter("n > 1")
    if tied.isEmpty():
        return matching(docs, keys, "left_semi")
    several = matching(docs, tied, "left_semi").withColumn("__own", F.sha2(whole_text("text"), 256))
    return matching(docs, keys.filter("n = 1"), "left_semi").unionByName(several.dropDuplicates(["doc_id", "__own"]).drop("__own"))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def vocabulary(name: str) -> str:
    """The file of a tokenizer: a path as it is, any other name within the installed collection."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, evaluated once: a plain alias may be copied into a lambda and run again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A table may be broadcast if it has at most so many rows; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast df if it has been counted to have at most so many (short) rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
