"""Evaluation: gold and wrong sets, accuracy, calibration, percentiles, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

KEY = ["competition_id", "question_text"]


def gold_harvest(log: DataFrame) -> DataFrame:
    """(key, correct_index, how, level): the first confirmed answer, else by elimination when all options but one were wrong: of n_options, if log has it, or of four."""
    key = log.where("question_text is not null and question_text <> ''")
    grouped = key.groupBy(*KEY).agg(
        F.min_by(F.struct("chosen_index", "level"), F.when(F.col("correct"), F.col("event_id"))).alias("hit"),
        F.array_sort(F.collect_set(F.when(~F.col("correct"), F.col("chosen_index")))).alias("wrong"), F.min("level").alias("level"),
        (F.coalesce(F.max("n_options"), F.lit(4)) if "n_options" in log.columns else F.lit(4)).cast("bigint").alias("n"),
    )
    left = F.array_except(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")), "wrong")
    how = F.when(F.col("hit").isNotNull(), "confirmed").when((F.size("wrong") == F.col("n") - 1) & (F.size(left) == 1), "elimination")
    return grouped.withColumn("how", how).where("how is not null").select(*KEY,
        F.when(F.col("how") == "confirmed", F.col("hit.chosen_index")).otherwise(F.get(left, F.lit(0))).alias("correct_index"), "how", "level")


def wrong_harvest(log: DataFrame, gold: DataFrame) -> DataFrame:
    """(key, wrong_index, first_event, correct_index): each wrong answer once, with the confirmed one or -1; not those that are also confirmed."""
    wrong = log.where(~F.col("correct")).groupBy(*KEY, F.col("chosen_index").alias("wrong_index")).agg(F.min("event_id").alias("first_event"))
    confirmed = gold.where("how = 'confirmed'").select(*KEY, "correct_index")
    joined = wrong.join(confirmed, KEY, "left")
    return joined.where("correct_index is null or correct_index <> wrong_index").withColumn("correct_index", F.coalesce("correct_index", F.lit(-1).cast("bigint")))


def set_union(left: DataFrame, right: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows by key; the right side's values win, of several rows of a side those of the least order (without one: of the least values).

    The order column, if named, keeps the left side's place of a key that both have.
    """
    rest = [c for c in left.columns if c not in keys]
    rank = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    both = left.select(*keys, *rest, F.lit(1).alias("_side")).unionByName(right.select(*keys, *rest, F.lit(0).alias("_side")))
    best = both.groupBy(*keys).agg(F.min(F.struct("_side", rank.alias("_row"))).alias("_best"), F.max("_side").alias("_in_left"),
        *([F.min(F.when(F.col("_side") == 1, F.col(order))).alias("_place")] if order else []))
    out = [F.when(F.col("_in_left") == 1, F.col("_place")).otherwise(F.col("_best._row")[c]).alias(c) if c == order else F.col("_best._row")[c].alias(c) for c in rest]
    return best.select(*keys, *out).select(*left.columns)


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def set_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def stratified(df: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    """At most n rows of each stratum, by an order that is drawn from a hash."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def accuracy(correct: Column) -> Column:
    """Share of true; null counts as not correct; 0 for no rows."""
    return F.round(F.coalesce(F.avg(F.when(correct, 1.0).otherwise(0.0)), F.lit(0.0)), 9)


def bins_floor(df: DataFrame, n: int = 10) -> DataFrame:
    """(bin, cnt, conf, acc) with bin = min(int(confidence n), n - 1)."""
    b = F.least(F.floor(F.col("confidence") * n).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.avg("confidence").alias("conf"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("acc"))


def bins_edges(df: DataFrame, n: int = 10) -> DataFrame:
    """Every bin [i/n, (i+1)/n), the last one closed, empty ones with their middle as confidence."""
    spark = df.sparkSession
    step = 1.0 / n
    edges = [1.0 if i == n else i * step for i in range(n + 1)]
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    bin_ = F.size(F.filter(inner, lambda e: e <= F.col("confidence"))).cast("bigint")
    placed = df.where(F.col("confidence").between(0.0, 1.0)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"),
        F.avg("confidence").alias("conf"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("acc"))
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)], "bin long, lo double, hi double")
    joined = bins.join(placed, "bin", "left")
    return joined.select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.round(F.coalesce("conf", (F.col("lo") + F.col("hi")) / 2), 9).alias("conf"), F.round(F.coalesce("acc", F.lit(0.0)), 9).alias("acc"))


def ece(bins: DataFrame, total: Column) -> DataFrame:
    return bins.agg(F.coalesce(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("cnt") / total), F.lit(0.0)).alias("ece"))


def recall(found: DataFrame, ks: tuple[int, ...], by: list[str]) -> DataFrame:
    """Recall at each k and MRR of (by..., found_at); not found counts as a miss."""
    out = [F.round(F.avg(F.when(F.col("found_at") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_{k}") for k in ks]
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out, F.bround(F.avg(F.coalesce(1.0 / F.col("found_at"), F.lit(0.0))), 4).alias("mrr"))


def cumulative(rows: DataFrame, by: list[str], at: str, sums: dict[str, str], descending: bool = False, parts: int = 64) -> DataFrame:
    """rows with running sums (new name: column) within by, up to and with equal values of at.

    Approximate quantiles cut each group into parts that are summed up for
    themselves; what comes before a part is added.  So no group, nor all rows
    where by is empty, is ordered in one task.  rows are computed once.
    """
    rows = cut(rows)
    edges = rows.groupBy(*by).agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000).alias("_edges"))
    if by:
        edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in by], "_edges")
        same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by]
        joined = rows.join(edges, same).drop(*[f"_e_{c}" for c in by])
    else:
        joined = rows.crossJoin(F.broadcast(edges))  # one row
    before = (lambda e: e > F.col(at)) if descending else (lambda e: e < F.col(at))
    cut_up = joined.withColumn("_part", F.size(F.filter("_edges", before))).drop("_edges")
    totals = cut_up.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # parts + 1 rows a group
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_part").alias("_o"),
        *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy(*by, "_part").orderBy(F.desc(at) if descending else F.asc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut_up.join(offsets, [F.col("_part") == F.col("_o"), *[F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by]])
    return placed.select(*rows.columns, *[(F.col(f"_b_{k}") + F.sum(c).over(within)).alias(k) for k, c in sums.items()])


def calibrate_threshold(pairs: DataFrame, base: float) -> DataFrame:
    """For each candidate tau (scores rounded to 3 places, 0 and 1): rows at or above it, their share and accuracy, and the accuracy to expect.

    Scores are first summed up by value; the cumulative sums then run over
    distinct scores, in parts.
    """
    scores = cut(pairs.groupBy(F.col("top_score").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("c")))
    taus = scores.select(F.bround("s", 3).alias("tau")).union(pairs.sparkSession.createDataFrame([(0.0,), (1.0,)], "tau double")).distinct()
    none = F.lit(0).cast("bigint")
    points = scores.select(F.col("s").alias("at"), F.lit(0).alias("is_tau"), "n",
        "c").unionByName(taus.select(F.col("tau").alias("at"), F.lit(1).alias("is_tau"), none.alias("n"), none.alias("c")))
    summed = cumulative(points, [], "at", {"n_ungated": "n", "hits": "c"}, descending=True).where("is_tau = 1")
    total = scores.agg(F.sum("n").alias("t")).scalar()
    p = F.col("n_ungated") / total
    acc = F.when(F.col("n_ungated") > 0, F.col("hits") / F.col("n_ungated")).otherwise(0.0)
    return summed.select(F.col("at").alias("tau"), "n_ungated", F.round(p, 9).alias("p_ungated"), F.round(acc, 9).alias("acc_ungated"),
        F.round(acc * p + base * (1 - p), 9).alias("expected"))


def best_thresholds(calibrated: DataFrame, k: int) -> DataFrame:
    """The k rows of calibrate_threshold with the highest expected accuracy, equal ones by ascending tau."""
    return calibrated.orderBy(F.desc("expected"), F.asc("tau")).limit(k)


def percentiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float], dashboard: bool = False) -> DataFrame:
    """(by..., a column for each of ps): sorted values at index round((n - 1) p), halves to even, or for the dashboard at min(int(n p), n - 1).

    Equal values are counted before anything is ordered, and running sums over
    distinct values, in parts, tell where an index lies; no group's values are
    gathered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = cut(counted)
    placed = cumulative(counted, by, "_v", {"_end": "_c"})
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], "_n")
        placed = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by])
    else:
        placed = placed.crossJoin(F.broadcast(sizes))  # one row

    def index(p: float) -> Column:
        return F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1) if dashboard else F.bround((F.col("_n") - 1) * F.lit(p), 0).cast("bigint")

    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_end") > index(p), F.col("_v"))).alias(name) for name, p in ps.items()])


def report(outputs: DataFrame, gold: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """An offline evaluation: outputs (keys, chosen_index, confidence, latency_seconds, tool) of gold's questions (keys, correct_index, category).

    One row for each category and one, 'all', for the whole: n, correct,
    accuracy, ece, latency_p50, latency_p95, n_tool.  Outputs without a gold
    question are left out; a null category is 'unknown'.
    """
    joined = outputs.join(gold.select(*keys, "correct_index", F.coalesce(category, F.lit("unknown")).alias("own")), keys)
    rows = joined.withColumn("correct", F.coalesce(F.col("chosen_index") == F.col("correct_index"), F.lit(False)))
    rows = rows.select("correct", "confidence", "latency_seconds", "tool", F.explode(F.array("own", F.lit("all"))).alias("category"))
    b = F.least(F.floor(F.col("confidence") * 10).cast("bigint"), F.lit(9).cast("bigint"))
    bins = rows.groupBy("category", b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("confidence").alias("conf"),
        F.count_if("correct").alias("hit"), F.count("tool").alias("fired"))
    whole = bins.groupBy("category").agg(
        F.sum("cnt").alias("n"), F.sum("hit").alias("correct"), F.round(F.sum("hit") / F.sum("cnt"), 9).alias("accuracy"),
            F.round(F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("cnt"), 6).alias("ece"), F.sum("fired").alias("n_tool"),
    )
    return whole.join(percentiles(rows, ["category"], "latency_seconds", {"latency_p50": 0.5, "latency_p95": 0.95}), "category")


def recall_from_runs(log: DataFrame, gold: DataFrame, ks: tuple[int, ...], by: list[str]) -> DataFrame:
    """Recall at each k and MRR from logged passages: log (question_text, passages array<struct<source, ...>>), gold (question_text, gold_article_title, by...).

    Rows without passages, and questions without a gold title, are left out; a
    title counts once, at its first place.
    """
    titled = gold.select("question_text", F.trim("gold_article_title").alias("_gold"), *by).where("_gold <> ''")
    rows = log.where(F.size("passages") > 0).join(titled, "question_text")
    titles = F.array_distinct(F.filter(F.transform("passages", lambda p: F.trim(p["source"])), lambda t: t != ""))
    found = rows.select(*by, F.nullif(F.array_position(titles, F.col("_gold")), F.lit(0)).alias("found_at"))
    return recall(found, ks, by)


def delta_table(before: DataFrame, after: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """(key, before, after, delta, mark): both sides of a key that either has; the mark says whether the delta reaches least, null where a side lacks."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 9)
    return a.join(b, key, "full").select(key, "before", "after", delta.alias("delta"), F.when(delta >= least, "✓").when(delta < least, "✗").alias("mark"))


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of both, with totals (null) by each and of all."""
    return df.cube(rows, columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


def running_accuracy(df: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order))).withColumn("running",
        F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).over(w), 9))


def streaks(df: DataFrame, by: str, order: str, failed: Column) -> DataFrame:
    """Length of the run of failures that ends at each row (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    runs = df.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    return runs.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(by, "_run").orderBy(order))).drop("_run")


def standings(scores: DataFrame, player: str, score: str, limit: int = 10) -> DataFrame:
    """The best players (limit is held between 1 and 100), equal ones by name, with their place."""
    best = scores.orderBy(F.desc(score), F.asc(player)).limit(min(max(limit, 1), 100))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), F.asc(player))))  # 100 rows at most


def of_player(scores: DataFrame, player: str, name: str) -> DataFrame:
    """Rows of a player, whatever the letter case."""
    return scores.where(F.lower(player) == name.lower())


def traces(log: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    """n wrong answers to look at: the most confident (or the least), equal ones by event; no confidence counts as 0."""
    at = F.coalesce("confidence", F.lit(0.0))
    return log.where(~F.col("correct")).orderBy(at.asc() if ascending else at.desc(), "event_id").limit(n)
