"""Structured Streaming forms of the incremental operators: file sync, counts by window, call logs and session memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from codeloom.operators import maintenance


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder whose names match, as a stream with the schema that they have now."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """window_start, key, n, of a stream with a watermark: rows later than that are not counted any more."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), key, "n")


def latest_output(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream in complete mode over what is there; each batch writes the whole result anew, the last is given back.
    A batch that runs again after a failure overwrites its own output, so results come exactly once."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    every = spark.read.parquet(f"{path}/batch=*/rows")
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")


def synced_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The files table (path, sha256, language, parse_status) after a stream of file versions (path, sha256, language,
    scanned_at): each batch is one upsert on the snapshot of the batch before it, so a batch that runs again gives the
    same. Within a batch, the last version of a path counts; files that a batch doesn't name stay."""
    spark = stream.sparkSession
    schema = "path string, sha256 string, language string, parse_status string"

    def snapshot(batch: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{batch}") if batch >= 0 else spark.createDataFrame([], schema)

    def merge(df: DataFrame, batch: int) -> None:
        old = snapshot(batch - 1)
        new = df.groupBy("path").agg(F.max_by(F.struct("sha256", "language"), "scanned_at").alias("v")).select("path", "v.*")
        after = maintenance.upsert_files(old, new).drop("changed")
        after.unionByName(old.join(new.select("path"), "path", "left_anti")).write.mode("overwrite").parquet(f"{path}/{batch}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return snapshot(-1)
    last = max(int(x.getPath().getName()) for x in fs.listStatus(at))
    assert progress is None or progress["batchId"] >= last
    return snapshot(last)


def session_memory(turns: DataFrame, most: int = 4) -> DataFrame:
    """session, turns, last_turn, kept of a stream (session, turn, role): the state holds the last `most` turns of a session
    and no more, so it doesn't grow with the session; every batch that has a session gives its memory anew."""

    def update(key, batches, state):
        seen, held = state.get if state.exists else (0, "")
        rows = [tuple(x.split(":", 1)) for x in held.split(",") if x]
        for batch in batches:
            rows += [(str(t), r) for t, r in zip(batch["turn"], batch["role"])]
            seen += len(batch)
        rows = sorted(rows, key=lambda x: int(x[0]))[-most:]
        kept = ",".join(f"{t}:{r}" for t, r in rows)
        state.update((seen, kept))
        yield pd.DataFrame({"session": [key[0]], "turns": [seen], "last_turn": [int(rows[-1][0])], "kept": [kept]})

    return turns.groupBy("session").applyInPandasWithState(update, "session long, turns long, last_turn long, kept string", "turns long, kept string", "append", GroupStateTimeout.NoTimeout)


def last_of_each(stream: DataFrame, key: str, order: str, path: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Runs an appending stream over what is there into a table, and gives the last row of each key."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(path)
    return then(rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("l")).select(key, "l.*"))
