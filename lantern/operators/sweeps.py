"""Sweeps of tiered strategies: every setting evaluated from one count of the rows.

A setting has two breakpoints of the level and an escalation threshold.  A row
adds to a setting what its tier's answer gives, or the next tier's if the tier's
margin is under the threshold.  Each row is counted once into the cells (tier,
level, place of its margin among the thresholds); sums along the thresholds and
then along the levels make a summed-area table, in which any setting is five
look-ups.  Neither passes over the rows nor joins with them grow with the number
of settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

BINS = 10


def _cells(rows: DataFrame, thresholds: list[float], latency_step: float) -> DataFrame:
    """(tier, level, place, kept, bin, slow, n, hits, conf): rows by cell; place: thresholds that the margin reaches, kept: whether the tier's
    own answer or the next one's counts.
    """
    reached = lambda m: F.when(m.isNull(), len(thresholds)).otherwise(sum((m >= t).cast("int") for t in thresholds) if thresholds else F.lit(0))

    def outcome(tier: int, kept: bool, arm: str, place):
        a = F.col(arm)
        b = F.least(F.floor(a["confidence"] * BINS), F.lit(BINS - 1)).cast("int")
        return F.struct(F.lit(tier).alias("tier"), place.cast("int").alias("place"), F.lit(kept).alias("kept"), b.alias("bin"),
            F.bround(a["latency"] / latency_step).cast("bigint").alias("slow"), F.coalesce(a["correct"], F.lit(False)).cast("int").alias("hit"), a["confidence"].alias("conf"))

    every = [outcome(1, True, "easy", reached(F.col("easy.margin"))), outcome(1, False, "medium", reached(F.col("easy.margin"))),
        outcome(2, True, "medium", reached(F.col("medium.margin"))), outcome(2, False, "hard", reached(F.col("medium.margin"))), outcome(3, True, "hard", F.lit(len(thresholds)))]
    each = rows.select("level", F.explode(F.array(*every)).alias("o")).select("level", "o.*")
    return each.groupBy("tier", "level", "place", "kept", "bin", "slow").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("conf").alias("conf"))


def tier_sweep(rows: DataFrame, easy: list[int], medium: list[int], thresholds: list[float | None], latency_step: float = 0.1) -> DataFrame:
    """An evaluation of each setting: (easy_max, medium_max, threshold, n, accuracy, ece, latency_p50, latency_p95).

    rows: (level, easy, medium, hard), the arms structs of correct, confidence,
    margin and latency.  Settings whose easy_max isn't under medium_max are left
    out; a null threshold never escalates, nor does a null margin; a null level
    counts as hard, a null correct as wrong.  Percentiles are of latencies
    rounded to latency_step, at the index round((n - 1) p), halves to even.
    """
    spark, said = rows.sparkSession, sorted({t for t in thresholds if t is not None})
    top = max(medium) + 1
    level = F.coalesce(F.greatest(F.least(F.col("level"), F.lit(top)), F.lit(-1)), F.lit(top)).cast("int").alias("level")
    cells = cut(_cells(rows.select(level, "easy", "medium", "hard"), said, latency_step))
    # along the thresholds: an answer is kept by threshold number i (from 1) if its margin reaches it, so i <= place; number 0 keeps all
    numbers = F.when(F.col("kept"), F.sequence(F.lit(0), F.col("place"))).otherwise(
        F.when(F.col("place") < len(said), F.sequence(F.col("place") + 1, F.lit(len(said)))).otherwise(F.array().cast("array<int>")))
    sums = [F.sum(c).alias(c) for c in ("n", "hits", "conf")]
    flat = cells.select("tier", "level", "bin", "slow", "n", "hits", "conf", F.explode(numbers).alias("number")).groupBy("tier", "level", "number", "bin", "slow").agg(*sums)
    # along the levels: one row for each level at which a sum changes, valid up to the next
    up = Window.partitionBy("tier", "number", "bin", "slow").orderBy("level")
    table = flat.select("tier", "number", "bin", "slow", "level", *[F.sum(c).over(up).alias(c) for c in ("n", "hits", "conf")], (F.coalesce(F.lead("level").over(up), F.lit(top + 1)) - 1).alias("until"))
    settings = [(e, m, t, said.index(t) + 1 if t is not None else 0) for e in sorted(set(easy)) for m in sorted(set(medium)) for t in dict.fromkeys(thresholds) if e < m]
    looks = [(*s, tier, number, at, sign) for s in settings for tier, number, at, sign in
        ((1, s[3], s[0], 1), (2, s[3], s[1], 1), (2, s[3], s[0], -1), (3, 0, top, 1), (3, 0, s[1], -1))]
    asked = spark.createDataFrame(looks, "easy_max int, medium_max int, threshold double, k int, tier int, number int, at int, sign int")
    by = ["easy_max", "medium_max", "threshold"]
    held = table.withColumn("at", F.explode(F.sequence("level", "until")))
    found = held.join(F.broadcast(asked), ["tier", "number", "at"])
    parts = found.groupBy(*by, "bin", "slow").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "hits", "conf")]).where("n > 0")
    bins = parts.groupBy(*by, "bin").agg(*sums).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(F.abs(F.col("hits") - F.col("conf"))).alias("off"))
    slow = parts.groupBy(*by, "slow").agg(F.sum("n").alias("c"))
    ends = slow.withColumn("end", F.sum("c").over(Window.partitionBy(*by).orderBy("slow"))).withColumn("all", F.sum("c").over(Window.partitionBy(*by)))
    index = lambda p: F.bround((F.col("all") - 1) * F.lit(p), 0)
    late = ends.groupBy(*by).agg(*[F.round(F.min(F.when(F.col("end") > index(p), F.col("slow"))) * latency_step, 6).alias(c) for c, p in (("latency_p50", 0.5), ("latency_p95", 0.95))])
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    both = bins.alias("b").join(late.alias("l"), same)
    return both.select(*[F.col(f"b.{c}") for c in by], "n", F.round(F.col("hits") / F.col("n"), 9).alias("accuracy"), F.round(F.col("off") / F.col("n"), 6).alias("ece"), "latency_p50", "latency_p95")
