"""Structured Streaming over run logs: ingestion, confirmed growth, running accuracy, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_logs(spark: SparkSession, folder: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON lines as files arrive in a folder."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(folder)


def confirmed(fetched: DataFrame, outcomes: DataFrame, wait: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Fetched articles (session_id, question_text, title, ts) that a correct outcome (session_id, question_text, correct, ts) confirms within wait.

    A join of two streams; what is never confirmed leaves the state when the
    watermark has passed.  Null outcomes don't confirm.
    """
    f = fetched.withWatermark("ts", late).select(F.col("session_id").alias("f_session"), F.col("question_text").alias("f_question"), "title", F.col("ts").alias("fetched_at"))
    o = outcomes.where("correct").withWatermark("ts", late).select("session_id", "question_text", F.col("ts").alias("confirmed_at"))
    within = (F.col("confirmed_at") >= F.col("fetched_at")) & (F.col("confirmed_at") <= F.col("fetched_at") + F.expr(f"interval {wait}"))
    joined = f.join(o, (F.col("f_session") == F.col("session_id")) & (F.col("f_question") == F.col("question_text")) & within)
    return joined.select("title", "session_id", "question_text", "fetched_at", "confirmed_at")


def grow(learned: DataFrame, path: str, checkpoint: str, chunks: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> StreamingQuery:
    """Appends chunks of confirmed articles whose title is new to an index; each micro-batch is written once.

    Of a batch's articles of one title the first by order (else by the least of
    all columns) stays.  A batch goes to a folder of its own number, so one that
    is run again after a failure replaces itself.  Titles are kept beside the
    chunks, by a hash, so a batch reads the parts that its own titles fall in
    and no chunk.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = order or sorted(batch.columns)
        first = batch.groupBy("title").agg(F.min_by(F.struct(*batch.columns), F.struct(*columns)).alias("a")).select("a.*").withColumn("part",
            F.pmod(F.xxhash64("title"), F.lit(TITLE_PARTS)).cast("int"))
        first = first.persist()
        try:
            parts = [r[0] for r in first.select("part").distinct().collect()]
            known = spark.read.schema("title string, batch long, part int").option("pathGlobFilter", "*.parquet").option("ignoreMissingFiles", True)
            have = known.parquet(f"{path}/titles").where(F.col("part").isin(parts) & (F.col("batch") != number)).select("title")
            new = first.join(have, "title", "left_anti").drop("part")
            new.select("title", F.lit(number).cast("long").alias("batch"),
                F.pmod(F.xxhash64("title"),
                F.lit(TITLE_PARTS)).cast("int").alias("part")).write.mode("append").partitionBy("part").parquet(f"{path}/titles")
            chunks(new).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}.d")
        finally:
            first.unpersist()

    spark = learned.sparkSession
    spark.createDataFrame([], "title string, batch long, part int").write.mode("append").partitionBy("part").parquet(f"{path}/titles")  # a folder to read at first
    return learned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of an index's titles.
TITLE_PARTS = 64


def grown(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a grown index."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/chunks")


def running_accuracy(rows: DataFrame) -> DataFrame:
    """By session, for complete or update mode; a null outcome counts as not correct."""
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"),
        F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"))


def sessions(rows: DataFrame, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions.  An added capability: the engine rebuilt here has no event time."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user,
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only file sink whose checkpoint makes it safe against crashes."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
