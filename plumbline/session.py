"""Session helpers: where lineage is cut and where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_CELLS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where every task sees the
    same disk, may fall back to a folder of its own; on a cluster an unset folder is an error, because a
    machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``cut_lineage``, for large narrow tables that are read several times: as Parquet, so a reader takes the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table or a stream checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch_path`` gave; anything outside the shared folder is refused."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path!r} is not below the shared folder")
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def rocksdb_state(spark: SparkSession) -> None:
    """State of the session's streams that start from now on lives in RocksDB; running and restarted ones keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def broadcast_if_small(df: DataFrame, cells: Column | None = None, limit: int = BROADCAST_CELLS) -> DataFrame:
    """``df`` marked for broadcast when its counted size allows it, else unchanged for a shuffle join.

    ``cells`` is the size of one row (1 by default). Meant for written tables, where counting is cheap.
    """
    size = df.agg(F.coalesce(F.sum(F.lit(1) if cells is None else cells), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df
