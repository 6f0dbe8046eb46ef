"""What operators need of a session: folders that all its machines share, reliable checkpoints, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slim table (some dozens of bytes each) up to which it may be broadcast, after it was counted.
BROADCAST_ROWS = 500_000

#: Bytes of an Arrow batch of long rows, where the session has the default of 64 MB: batches are held outside the heap, several at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def slim_batches(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session asks for a size of its own."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one beside the warehouse on a local master, and an error on a cluster."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in shared_dir."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: computed once, and not lost with an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, counted now; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files come in fewer parts than that, for work that is heavier than the move; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
