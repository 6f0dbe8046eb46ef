"""Decisions over the outputs of arms: gates, tiers, tool chains, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_gate(top_score: Column, threshold: Column) -> Column:
    """Whether retrieval is too weak; a null threshold never gates, a null score is 0."""
    return F.coalesce(F.coalesce(top_score, F.lit(0.0)) < threshold, F.lit(False))


def confidence_gate(margin: Column, category: Column, tau: float = 0.20, forced: tuple[str, ...] = ()) -> Column:
    """Whether the primary's answer is committed: not a forced category, and no margin or one of tau or more."""
    open_ = margin.isNull() | (margin >= tau)
    return F.coalesce(~category.isin(*forced), F.lit(True)) & open_ if forced else open_


def gated(primary: DataFrame, fallback: DataFrame, commit: Column) -> DataFrame:
    """primary where commit, else the fallback's answer, which is joined for gated rows only; where there is none the primary's stays."""
    marked = primary.withColumn("_commit", commit)
    kept = marked.where("_commit").select("question_id", "chosen_index", F.lit("primary").alias("arm"), F.lit(False).alias("disagree"))
    f = fallback.select("question_id", F.col("chosen_index").alias("f_index"), F.lit(True).alias("_there"))
    other = marked.where("not _commit").join(f, "question_id", "left").select("question_id", F.when(F.col("_there"), F.col("f_index")).otherwise(F.col("chosen_index")).alias("chosen_index"),
        F.when(F.col("_there"), "fallback").otherwise("primary").alias("arm"), F.coalesce(F.col("f_index") != F.col("chosen_index"), F.lit(False)).alias("disagree"))
    return kept.unionByName(other)


def tier(level: Column, category: Column, overrides: dict[str, str], easy: int = 5, medium: int = 10) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, to in overrides.items():
        out = out.when(category == name, F.lit(to))
    return out.when(level <= easy, "easy").when(level <= medium, "medium").otherwise("hard")


def escalates(tier_: Column, margin: Column, abstain: Column, tau: float) -> Column:
    """To the next tier, once: from easy and medium only, when the margin is low and it didn't abstain."""
    return tier_.isin("easy", "medium") & F.coalesce(margin < tau, F.lit(False)) & ~abstain


def tiered(questions: DataFrame, answers: DataFrame, overrides: dict[str, str], tau: float | None, easy: int = 5, medium: int = 10) -> DataFrame:
    """(question_id, chosen_index, confidence, tier_originally, tier_selected, escalated) of every question (question_id, level, category).

    answers (question_id, tier, chosen_index, confidence, margin, is_abstain): a
    row for each question and tier.  An uncertain answer of the easy or medium
    tier gives way to the next tier's, which may abstain; one of an override
    doesn't.  A question that its tier, or the next one, has no answer to keeps a
    null, or the first answer.
    """
    first = questions.select("question_id", tier(F.col("level"), F.col("category"), overrides, easy, medium).alias("tier"))
    own = answers.select(F.col("question_id").alias("_q"), F.col("tier").alias("_t"), "chosen_index", "confidence", "margin", "is_abstain")
    routed = first.join(own, (F.col("question_id") == F.col("_q")) & (F.col("tier") == F.col("_t")), "left").drop("_q", "_t")
    up = F.coalesce(escalates(F.col("tier"), F.col("margin"), F.coalesce("is_abstain", F.lit(True)), tau), F.lit(False)) if tau is not None else F.lit(False)
    after = F.when(F.col("tier") == "easy", "medium").when(F.col("tier") == "medium", "hard")
    routed = routed.withColumn("_next", F.when(up, after))
    more = answers.select(F.col("question_id").alias("_q"), F.col("tier").alias("_t"), F.struct("chosen_index", "confidence").alias("_more"))
    both = routed.join(more, (F.col("question_id") == F.col("_q")) & (F.col("_next") == F.col("_t")), "left")
    went = F.col("_more").isNotNull()
    pick = lambda c: F.when(went, F.col("_more")[c]).otherwise(F.col(c)).alias(c)
    return both.select("question_id", pick("chosen_index"), pick("confidence"), F.col("tier").alias("tier_originally"), F.when(went, F.col("_next")).otherwise(F.col("tier")).alias("tier_selected"), went.alias("escalated"))


def tool_chain(tools: list[Column], fallback: Column) -> Column:
    return F.coalesce(*tools, fallback)


def confidence_or_tools(chosen: Column, confidence: Column, tools: list[Column], least: float = 0.70) -> Column:
    return F.when(confidence >= least, chosen).otherwise(F.coalesce(*tools, chosen))


def rewrite_chain(tools: list[Column], pinned: Column, confidence: Column, rewritten: Column, category: Column, least: float = 0.70) -> Column:
    """The first tool's answer; else the pinned one if it is confident; else, in maths, what the rewritten question gave; else the pinned one."""
    return F.coalesce(*tools, F.when(confidence >= least, pinned), F.when(category == "maths", rewritten), pinned)


def ensemble_weighted(arms: DataFrame, weights: DataFrame) -> DataFrame:
    """arms (question_id, arm, chosen_index, confidence, is_abstain, probs array<double>) -> (question_id, chosen_index, confidence): weighted mean of probs, abstainers left out, weights renormalised; the lowest index wins ties.

    Where all arms abstain it is what the first arm says.
    """
    live = arms.where("not is_abstain").join(F.broadcast(weights), "arm").select("question_id", "weight", F.posexplode("probs").alias("idx", "p"))
    fused = live.groupBy("question_id", "idx").agg(F.round(F.sum(F.col("weight") * F.col("p")) / F.sum("weight"), 9).alias("p"))
    best = fused.groupBy("question_id").agg(F.max(F.struct("p", (-F.col("idx")).alias("neg"))).alias("best"))
    said = best.select("question_id", (-F.col("best.neg")).cast("bigint").alias("chosen_index"), F.col("best.p").alias("confidence"))
    return said.unionByName(_all_abstain(arms).select("question_id", F.col("first.chosen_index").cast("bigint").alias("chosen_index"), F.col("first.confidence").alias("confidence")))


def _all_abstain(arms: DataFrame) -> DataFrame:
    """(question_id, first: the first arm's output) of questions on which every arm abstains."""
    first = F.min_by(F.struct("chosen_index", "confidence"), "arm").alias("first")
    return arms.groupBy("question_id").agg(first, F.bool_and("is_abstain").alias("none")).where("none").drop("none")


def ensemble_vote(arms: DataFrame, weights: DataFrame) -> DataFrame:
    """arms as above without probs -> (question_id, chosen_index, votes): the index with the most weight, the lowest wins ties; where all arms
    abstain the first one's, with null votes.
    """
    votes = arms.where("not is_abstain").join(F.broadcast(weights), "arm").groupBy("question_id", "chosen_index").agg(F.round(F.sum("weight"), 9).alias("votes"))
    w = Window.partitionBy("question_id").orderBy(F.desc("votes"), F.asc("chosen_index"))
    said = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    none = _all_abstain(arms).select("question_id", F.col("first.chosen_index").alias("chosen_index"), F.lit(None).cast("double").alias("votes"))
    return said.unionByName(none)


def clamp_choice(chosen: Column, abstain: Column, fallback: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.when(chosen.isNull() | abstain, fallback).otherwise(chosen), n - 1))


def random_pick(key: Column, seed: int, n: int = 4) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n))


def safe_amount(pyramid: Column, level: Column) -> Column:
    """Amount of the highest level below the current one; 0 if there is none."""
    below = F.filter(pyramid, lambda m: m["level"] < level)
    best = F.array_max(F.transform(below, lambda m: F.struct(m["level"].alias("level"), m["amount"].alias("amount"))))
    return F.coalesce(best["amount"], F.lit(0.0))


def fresh(cached_at: Column, now: Column, empty: Column, ttl_seconds: int = 900) -> Column:
    """A cached answer: one with content stays, an empty one for ttl seconds; without a time it stays."""
    return ~empty | cached_at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(cached_at) <= ttl_seconds)


def source_counters(calls: DataFrame) -> DataFrame:
    """One row from calls (cached, failed, found: booleans) of a news source: calls, hits of its cache and their share, failures, calls that found nothing."""
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cache_hits"),
            F.round(F.coalesce(F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)), F.lit(0.0)), 9).alias("hit_rate"),
            F.count_if("failed").alias("failures"),
        F.count_if(~F.col("found") & ~F.col("failed")).alias("empty"),
    )
