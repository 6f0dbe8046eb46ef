"""Retrieval as a whole, multi-query retrieval, and the decision whether and with what to answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieve as R
from .decide import score_gate


def pool_size(k: int, rerank: bool, spread: bool, oversearch: int = 5) -> int:
    """How many passages each ranking has to give: k * oversearch to be reranked, k * 2 to be diversified, else k."""
    return k * oversearch if rerank else k * 2 if spread else k


def retrieve(
    dense: DataFrame | None, lexical: DataFrame | None, sources: DataFrame, k: int = 3, *, hybrid: bool | None = None, rerank: bool | None = None,
        scorer: Column | None = None, oversearch: int = 5, spread: bool = True, weights: DataFrame | None = None
) -> DataFrame:
    """Rankings (query, rank, key) of one or both kinds to the k passages of each query, with score.

    hybrid fuses both rankings, rerank scores the pool anew by scorer, an
    expression over query and sources' columns (key, source, ...); each is an
    error where its part is missing, and done if its part is there when it
    isn't said.  Then each source's best comes before any second of a source.
    """
    if rerank and scorer is None:
        raise ValueError("rerank needs a scorer")
    if hybrid and lexical is None:
        raise ValueError("hybrid needs a lexical ranking")
    if hybrid and dense is None:
        raise ValueError("hybrid needs a dense ranking")
    scored, both = scorer is not None and rerank is not False, dense is not None and lexical is not None and hybrid is not False
    pool = pool_size(k, scored, spread, oversearch)
    lists = [x.where(F.col("rank") <= pool).select("query", F.lit(i).alias("list_id"), "rank", "key") for i, x in enumerate((dense, lexical)) if x is not None]
    if not lists:
        raise ValueError("a ranking is needed")
    merged = R.fuse(lists[0].unionByName(lists[1]), pool, weights=weights) if both else lists[0].select("query", "key", (1.0 / (60 + F.col("rank"))).alias("score"), "rank")
    joined = merged.join(sources, "key")
    if scored:
        joined = R.rerank(joined, scorer, pool).drop("pool_rank")
    return R.diversify(joined, k).drop("pool_rank") if spread else joined.where(F.col("rank") <= k)


def multi_query(per_query: DataFrame, sources: DataFrame, k: int, scorer: Column | None = None, oversearch: int = 5) -> DataFrame:
    """Rankings (query, list_id, rank, key) of a question's variants, the question's first: fused, reranked once by the question, cut to k and not diversified again."""
    pool = k * oversearch if scorer is not None else k
    fused = R.fuse(per_query.where(F.col("rank") <= pool), pool).join(sources, "key")
    return R.rerank(fused, scorer, k).drop("pool_rank") if scorer is not None else fused.where(F.col("rank") <= k)


def hypothetical(queries: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """(query, qv, text): the dense query is the hypothesis where there is one, the lexical one stays the question."""
    return queries.select("query", encode(F.coalesce("hypothesis", "question")).alias("qv"), F.col("question").alias("text"))


def labeling_template(gold: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """gold with the distinct titles of its k best hits (question_text, rank, title), in rank order, and an empty gold title."""
    firsts = hits.where(F.col("rank") <= k).groupBy("question_text", "title").agg(F.min("rank").alias("at"))
    lists = firsts.groupBy("question_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda s: s["title"]).alias("candidates"))
    return gold.join(lists, "question_text", "left").withColumn("candidates",
        F.coalesce("candidates", F.array().cast("array<string>"))).withColumn("gold_article_title", F.lit(None).cast("string"))


def decide(passages: DataFrame, live: DataFrame, questions: DataFrame, threshold: Column, floor: float = 0.3) -> DataFrame:
    """(query, gated, context_source, n_passages, top_score): which passages a question is answered with.

    The offline passages (query, rank, score) unless their best is under the
    threshold (a column over questions; null never gates); then the live ones
    (query, score) that reach the floor; else none.
    """
    off = passages.groupBy("query").agg(F.max("score").alias("off_top"), F.count(F.lit(1)).alias("off_n"))
    on = live.where(F.col("score") >= floor).groupBy("query").agg(F.max("score").alias("live_top"), F.count(F.lit(1)).alias("live_n"))
    joined = questions.join(off, "query", "left").withColumn("gated", F.col("off_n").isNull() | score_gate(F.col("off_top"), threshold)).join(on, "query", "left")
    source = F.when(~F.col("gated"), "offline").when(F.col("live_n") > 0, "live").otherwise("none")
    pick = lambda a, b, none: F.when(F.col("context_source") == "offline", F.col(a)).when(F.col("context_source") == "live", F.col(b)).otherwise(F.lit(none))
    return joined.withColumn("context_source", source).select("query", "gated", "context_source", pick("off_n", "live_n", 0).alias("n_passages"),
        pick("off_top", "live_top", None).alias("top_score"))


def answered(decided: DataFrame, offline: DataFrame, live: DataFrame, most: int, reader: Callable[[Column], Column], floor: float = 0.3) -> DataFrame:
    """decided (query, context_source, options, ...) with context, answer and trace.

    The passages are those that decide() chose: offline ones (query, rank, score,
    source, text), or live ones (query, score, source, text) of at least floor by
    score, then source and text.  context has them as '[rank] source', a line break and
    the text, an empty line between two, up to the first that would exceed most
    characters; it is '' without passages.  reader gives the answer's index from
    a struct of decided's columns and the context; null abstains.  trace lists
    source, score to four places, and whether the passage is in the context.
    """
    best = R.top_k(live.where(F.col("score") >= floor).select("query", "score", "source", "text"), 1 << 30, [F.desc("score"), F.asc("source"), F.asc("text")])
    both = offline.select("query", "rank", "score", "source", "text", F.lit("offline").alias("of")).unionByName(best.select("query", "rank", "score", "source", "text", F.lit("live").alias("of")))
    own = both.join(decided.select("query", F.col("context_source").alias("of")), ["query", "of"])
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit("\n"), "text")
    place = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = own.withColumn("entry", entry).withColumn("_in", F.sum(F.char_length("entry")).over(place) <= most)
    one = F.struct("rank", "entry", "_in", "source", F.bround("score", 4).alias("score"))
    lists = used.groupBy("query").agg(F.array_sort(F.collect_list(one)).alias("_p"))
    joined = decided.join(lists, "query", "left")
    context = F.array_join(F.transform(F.filter("_p", lambda p: p["_in"]), lambda p: p["entry"]), "\n\n")
    trace = F.transform("_p", lambda p: F.struct(p["source"].alias("source"), p["score"].alias("score"), p["_in"].alias("used")))
    shown = joined.withColumn("context", F.coalesce(context, F.lit(""))).withColumn("trace", F.coalesce(trace, F.array().cast("array<struct<source:string,score:double,used:boolean>>")))
    return shown.drop("_p").withColumn("answer", reader(F.struct(*[c for c in shown.columns if c not in ("_p", "trace")])))


def merged_pool(offline: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(query, source, origin, score, rank): the k best live passages of each query by score, then the offline ones in their order, 2 k at most."""
    best = R.top_k(live.select("query", "source", "score"), k, [F.desc("score"), F.asc("source")]).withColumn("o", F.lit(0))
    both = best.unionByName(offline.select("query", "source", "score", "rank").withColumn("o", F.lit(1)))
    placed = R.top_k(both.withColumnRenamed("rank", "own"), 2 * k, [F.asc("o"), F.asc("own")])
    return placed.select("query", "source", F.when(F.col("o") == 0, "live").otherwise("offline").alias("origin"), "score", "rank")


def skips_offline(threshold: float | None, has_live: bool) -> bool:
    """Whether the offline search needn't be planned: with a threshold of 1 or more every score is gated, if there are live passages to turn to."""
    return threshold is not None and threshold >= 1.0 and has_live
