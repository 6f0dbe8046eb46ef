"""Readers and writers: JSON lines, run logs, corpora, indexes, gold sets, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import corpus


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Blank lines are skipped.  strict: a line that isn't JSON fails the read; else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, line, value) of text files, lines counted from 1.

    A file may be read in several splits: each begins at a known byte, within
    it lines keep their order, and the lines of the splits before are added.
    """
    raw = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file_name", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file_name", "block", "first", before.alias("before"))
    return raw.join(placed, ["file_name", "block"]).select("file_name", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_run_logs(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Question rows and manifests of a folder of logs, with file_name, the line's number in it and the typed extras.

    The order is that of file name and line, on which keep-first operators rely.
    Blank lines are skipped.  A line that isn't JSON fails the read with its
    file and line; if not strict, it is left out.
    """
    lines = numbered_lines(spark, folder).where("trim(value) <> ''").withColumn("ok", F.try_parse_json("value").isNotNull())
    if strict:
        said = F.concat("file_name", F.lit(":"), F.col("line").cast("string"), F.lit(": invalid JSON"))
        lines = lines.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error(said)))
    row = F.from_json("value", schemas.QUESTION)
    typed = F.from_json(F.get_json_object("value", "$.extras"), schemas.EXTRAS)
    return (lines if strict else lines.where("ok")).withColumn("row", row).select("file_name", "line", "row.*", typed.alias("known"))


def questions(rows: DataFrame, lacking: bool = False) -> DataFrame:
    """Rows of questions; lacking: also rows that don't say what they are, as calibration takes them."""
    kind = F.col("run_kind") == "question"
    return rows.where(kind | (F.coalesce("run_kind", F.lit("")) == "") if lacking else kind)


def calibration_rows(rows: DataFrame) -> DataFrame:
    """Questions with a confidence and a known outcome."""
    return questions(rows, lacking=True).where("confidence is not null and correct is not null")


def model_of(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, model) of each log whose first line that isn't blank is a manifest: extra.model_id, extra.model or what stands in strategy[...]; null without one."""
    lines = numbered_lines(spark, folder).where("trim(value) <> ''")
    head = lines.groupBy("file_name").agg(F.min_by("value", "line").alias("value")).where(F.get_json_object("value", "$.run_kind") == "manifest")
    strategy = F.regexp_extract(F.get_json_object("value", "$.extra.strategy"), r"\[([^|\]]+)", 1)
    model = F.coalesce(F.get_json_object("value", "$.extra.model_id"), F.get_json_object("value", "$.extra.model"), F.nullif(strategy, F.lit("")))
    return head.select("file_name", model.alias("model"))


def only_models(rows: DataFrame, models: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of files whose model contains one of include and none of exclude; files without a manifest pass if include is empty."""
    name = F.lower(F.coalesce("model", F.lit("")))
    cond = F.lit(True)
    if include:
        cond = cond & F.exists(F.array(*[F.lit(x.lower()) for x in include]), lambda m: F.contains(name, m))
    if exclude:
        cond = cond & ~F.exists(F.array(*[F.lit(x.lower()) for x in exclude]), lambda m: F.contains(name, m))
    return rows.join(models, "file_name", "left").where(cond).drop("model")


def latest_log(rows: DataFrame, part: str) -> DataFrame:
    """The last file by name that contains part."""
    return rows.where(F.col("file_name").contains(part)).agg(F.max("file_name").alias("file_name"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles; what older files lack has its default."""
    raw = read_jsonl(spark, path, schemas.ARTICLE)
    return raw.select("title", "text", "category", F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("competition", F.lit("")).alias("competition"))


def write_corpus(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; empty fields are left out."""
    slim = articles.withColumns({"url": F.nullif("url", F.lit("")), "competition": F.nullif("competition", F.lit("")), "aliases": F.when(F.size("aliases") > 0, F.col("aliases"))})
    slim.write.mode(mode).option("ignoreNullFields", "true").json(path)


def append_corpus(incoming: DataFrame, path: str, order: list[str]) -> int:
    """Appends articles with new titles, the first of each; returns how many."""
    spark = incoming.sparkSession
    new = corpus.append_new(read_corpus(spark, path), incoming, "title", order).persist()
    try:
        n = new.count()
        if n:
            write_corpus(new, path, "append")
        return n
    finally:
        new.unpersist()


def write_index(chunks: DataFrame, manifest: dict, path: str, mode: str = "overwrite") -> None:
    """Chunks with their vectors as Parquet and the manifest beside them."""
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    chunks.sparkSession.createDataFrame([tuple(manifest.get(c.split()[0]) for c in schemas.MANIFEST.split(", "))],
        schemas.MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, expect: dict) -> tuple[DataFrame, list[str]]:
    """Chunks of an index, and warnings.  Another embedder, dimension or prefix is an error; other differences are warnings."""
    have = spark.read.schema(schemas.MANIFEST).json(f"{path}/manifest").first().asDict()
    hard = [k for k in ("embedder", "dim", "query_prefix", "passage_prefix") if k in expect and have[k] != expect[k]]
    if hard:
        raise ValueError(f"the index was built with other {', '.join(hard)}")
    return spark.read.parquet(f"{path}/chunks"), [f"{k}: {have[k]} in the index, {v} expected" for k, v in expect.items() if k not in hard and have.get(k) != v]


def extend_index(articles: DataFrame, path: str, encode: Callable[[Column], Column], manifest: dict, order: list[str], size: int = 300, overlap: int = 50) -> int:
    """Adds articles (title, text, category, url, aliases) whose title the index at path lacks: chunked, embedded, appended, with the manifest anew; returns how many chunks.

    An index that another embedder built is refused before anything is written.
    """
    spark = articles.sparkSession
    named = articles.withColumnRenamed("title", "source")
    try:
        have = read_index(spark, path, manifest)[0].select("source")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = spark.createDataFrame([], "source string")
    chunks = corpus.chunk(corpus.append_new(have, named, "source", order), size, overlap)
    chunks = chunks.withColumn("embedding", encode(corpus.embedding_text(F.col("source"), F.col("aliases"), F.col("section_title"), F.col("text")))).persist()
    try:
        n = chunks.count()
        if n:
            write_index(chunks, manifest | {"chunk_size": size, "overlap": overlap}, path, "append")
        return n
    finally:
        chunks.unpersist()


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row) as JSON; samples are left out, for they are large."""
    report.drop("samples").coalesce(1).write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row per report of a folder that has the required keys; reports are files of the folder or folders in it."""
    raw = spark.read.schema(schemas.REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(folder)
    named = raw.withColumn("file_name", F.col("_metadata.file_name"))
    return named.where("strategy_name is not null and accuracy is not null and n_total is not null")


def write_set(items: DataFrame, path: str) -> None:
    """A gold, wrong or retrieval set as JSON lines."""
    items.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_set(spark: SparkSession, path: str, schema: str = schemas.GOLD) -> DataFrame:
    return read_jsonl(spark, path, schema)


def leaderboard(reports: DataFrame) -> DataFrame:
    """Reports by accuracy, rounded for display; equal ones by file name."""
    return reports.select(
        F.col("strategy_name").alias("strategy"), F.bround("accuracy", 4).alias("accuracy"), F.bround("ece", 4).alias("ece"),
            F.bround("latency_p50", 2).alias("latency_p50_s"), F.bround("latency_p95", 2).alias("latency_p95_s"),
        F.col("n_total").alias("n"), "file_name",
    ).orderBy(F.desc("accuracy"), "file_name")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def overlay_labels(rows: DataFrame, labels: DataFrame, order: str = "line") -> DataFrame:
    """rows with labels' gold title where there is one (by question_text); of several labels of a question the last by order counts, and one that is empty counts as none."""
    own = labels.groupBy("question_text").agg(F.max_by(F.struct(F.nullif("gold_article_title", F.lit("")).alias("t")), order).alias("_label"))
    out = rows.join(own, "question_text", "left")
    return out.withColumn("gold_article_title", F.coalesce("_label.t", "gold_article_title")).drop("_label")


def cache_put(responses: DataFrame, path: str) -> None:
    """Appends responses (key, response: JSON text, cached_at) to a cache."""
    responses.select("key", "response", "cached_at").write.mode("append").parquet(path)


def cache_get(spark: SparkSession, path: str, wanted: DataFrame, now: Column, ttl_seconds: int | None = None, empty_ttl_seconds: int = 900) -> DataFrame:
    """(key, response) of wanted keys that are cached and fresh, each key's latest.

    What has no results grows stale after empty_ttl_seconds, what has some after
    ttl_seconds or never; what has no time never.
    """
    latest = spark.read.parquet(path).join(wanted.select("key").distinct(), "key",
        "left_semi").groupBy("key").agg(F.max_by(F.struct("response", "cached_at"), F.coalesce("cached_at", F.lit(0).cast("timestamp"))).alias("r"))
    results = F.from_json(F.get_json_object("r.response", "$.results"), "array<string>")
    age = F.unix_timestamp(now) - F.unix_timestamp("r.cached_at")
    ttl = F.when(F.size(F.coalesce(results, F.array().cast("array<string>"))) == 0, F.lit(empty_ttl_seconds)).otherwise(F.lit(ttl_seconds).cast("int"))
    return latest.where(F.coalesce(age <= ttl, F.lit(True))).select("key", "r.response")


def cache_key(params: Column) -> Column:
    """A map's SHA-1 over its sorted entries as JSON, without the entry 'api-key'."""
    kept = F.map_filter(params, lambda k, v: k != "api-key")
    return F.sha1(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))))


def discard(df: DataFrame) -> None:
    """Runs df and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
