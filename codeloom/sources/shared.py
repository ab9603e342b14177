"""The folder that driver and executors share, and tables that are cut from their lineage there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the session's own, or a local one on a local master. A cluster without one is an
    error, as its executors share no local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(at or LOCAL_CHECKPOINTS)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Rows that a task sorts or sums, about, whatever the size of a table.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows dealt by keys to tasks of about TASK_ROWS each, so that a task's memory doesn't grow with a table;
    what groups, joins or ranks by these keys afterwards needs no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    import uuid

    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
