"""What the training-data operators share: tables, checkpoints and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Rows up to which a slim table (a few dozen bytes a row) may be broadcast after it was counted.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch on its way to Python or back, where the session has the default of 64 MB: batches are held outside the heap, several at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Code on the executors, and small Arrow batches unless the session asks for a size of its own."""
    ship(spark)
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one beside the warehouse where that is unset (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder; lost executors don't lose it."""
    prepare(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than limit rows; else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
