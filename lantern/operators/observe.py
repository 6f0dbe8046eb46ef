"""What live search and the gate before it bring, from logged questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import accuracy

# Providers of the news source; all others, and unknown ones, are the encyclopedia's.
NEWS_PROVIDERS = ("guardian_window", "guardian_broad")


def live_label(provider: Column) -> Column:
    """Where a live passage came from, for people."""
    return F.when(provider.isin(*NEWS_PROVIDERS), "Guardian").otherwise("Wikipedia")


def live_report(log: DataFrame) -> DataFrame:
    """One row from log (source, gated, fired, all_below, provider, live_latency, live_top_score, correct): counts of each step, counts of what fired by provider, means, accuracies and the live source's lead in percentage points.

    Latencies are those of attempts, scores those of rows whose context is live;
    means and accuracies of no rows are null.
    """
    live, none = F.col("source") == "live", F.col("source") == "none"
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    a_live, a_none = F.avg(F.when(live, hit)), F.avg(F.when(none, hit))
    fired = F.coalesce("fired", F.lit(False))
    return log.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("gated"), F.count_if(fired).alias("fired"), F.count_if(live).alias("above"), F.count_if("all_below").alias("wasted"),
        F.count_if(fired & F.col("provider").isin(*NEWS_PROVIDERS)).alias("guardian"), F.count_if(fired & (F.col("provider") == "wikipedia")).alias("wikipedia"),
        F.round(F.avg("live_latency"), 6).alias("latency"), F.round(F.avg(F.when(live, F.col("live_top_score"))), 6).alias("live_score"),
        F.round(a_live, 9).alias("acc_live"), F.round(a_none, 9).alias("acc_none"), F.round(100 * (a_live - a_none), 6).alias("boost_pp"),
    )


def gate_report(log: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, n_gated, gate_rate, acc_gated, acc_ungated, score_correct, score_wrong) of log (gated, correct, top_score, n_passages) by
    category and of 'all'; rows without n_passages didn't retrieve and are left out, a null category is 'unknown', accuracies of no rows are
    null.
    """
    rows = log.where("n_passages is not null").select("gated", "correct", "top_score", F.explode(F.array(F.coalesce(category, F.lit("unknown")), F.lit("all"))).alias("category"))
    gated, right = F.coalesce("gated", F.lit(False)), F.coalesce("correct", F.lit(False))
    of = lambda cond: F.round(F.avg(F.when(cond, F.when(right, 1.0).otherwise(0.0))), 9)
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gated).alias("n_gated"), accuracy(gated).alias("gate_rate"), of(gated).alias("acc_gated"), of(~gated).alias("acc_ungated"),
        F.round(F.avg(F.when(right, F.col("top_score"))), 9).alias("score_correct"), F.round(F.avg(F.when(~right, F.col("top_score"))), 9).alias("score_wrong"),
    )
