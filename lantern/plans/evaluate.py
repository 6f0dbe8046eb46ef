"""Queries over the run log: gold and wrong sets, metrics, dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import observe as O
from .common import CAT_SQL, LOG, categories, query, runlog, table

_CAT = f"LEFT JOIN {CAT_SQL} AS cat(cid, category) ON cat.cid = competition_id"
_GAP = "category NOT IN ('news', 'maths') AND (correct = FALSE OR top_score < 0.5)"


def _with_category(spark, d):
    return runlog(spark, d).join(F.broadcast(categories(spark)), "competition_id", "left")


_ACC = "round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 9)"
_GOLD = (
    LOG + ", g AS (SELECT competition_id, question_text, arg_min(chosen_index, event_id) FILTER (WHERE correct) AS hit, list(DISTINCT chosen_index) FILTER (WHERE NOT correct) AS wrong, min(level) AS level"
        " FROM runlog GROUP BY ALL),"
    " gold AS (SELECT competition_id, question_text, CASE WHEN hit IS NOT NULL THEN hit"
        " ELSE list_filter([0, 1, 2, 3], lambda x: NOT list_contains(wrong, x))[1] END AS correct_index,"
    " CASE WHEN hit IS NOT NULL THEN 'confirmed' WHEN len(wrong) = 3 THEN 'elimination' END AS how, level FROM g WHERE hit IS NOT NULL OR len(wrong) = 3)"
)


@query(_GOLD + " SELECT * FROM gold")
def gold_harvest(spark, d):
    """A-16: answers confirmed or left over by elimination."""
    return E.gold_harvest(runlog(spark, d))


@query(_GOLD + " SELECT question_text, correct_index FROM gold WHERE how = 'elimination'")
def gold_elimination(spark, d):
    """A-16, U-03: those by elimination."""
    return E.gold_harvest(runlog(spark, d)).where("how = 'elimination'").select("question_text", "correct_index")


_WRONG = (
    ", w AS (SELECT competition_id, question_text, chosen_index AS wrong_index, min(event_id) AS first_event FROM runlog WHERE NOT correct GROUP BY ALL),"
    " wrong AS (SELECT w.*, coalesce(c.correct_index, -1) AS correct_index FROM w LEFT JOIN (SELECT * FROM gold"
        " WHERE how = 'confirmed') c ON c.competition_id = w.competition_id AND c.question_text = w.question_text"
        " WHERE c.correct_index IS NULL OR c.correct_index <> w.wrong_index)"
)


@query(_GOLD + _WRONG + " SELECT * FROM wrong")
def wrong_harvest(spark, d):
    """A-17, J-10, J-11: wrong answers with the confirmed one or -1."""
    log = runlog(spark, d)
    return E.wrong_harvest(log, E.gold_harvest(log))


@query(_GOLD + _WRONG + " SELECT count(*) AS n, round(avg(CASE WHEN correct_index >= 0 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM wrong")
def recovery_rate(spark, d):
    """A-12, F-05."""
    log = runlog(spark, d)
    return E.wrong_harvest(log, E.gold_harvest(log)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("correct_index") >= 0, 1.0).otherwise(0.0)), 9).alias("rate"))


@query(
    _GOLD + " SELECT coalesce(b.competition_id, a.competition_id) AS competition_id, coalesce(b.question_text, a.question_text) AS question_text, CASE"
        " WHEN b.question_text IS NOT NULL THEN 'right' ELSE 'left' END AS side, coalesce(a.level, b.level + 100) AS place"
    " FROM (SELECT * FROM gold WHERE level <= 10) a FULL JOIN (SELECT * FROM gold WHERE level >= 6) b ON a.competition_id = b.competition_id AND a.question_text = b.question_text"
)
def goldset_union(spark, d):
    """U-01: union by key; the right side wins, the left side's place is kept."""
    g = E.gold_harvest(runlog(spark, d)).select("competition_id", "question_text", "level")
    left, right = (g.where(c).select("competition_id", "question_text", F.lit(s).alias("side"), (F.col("level") + more).alias("place")) for c, s,
        more in (("level <= 10", "left", 0), ("level >= 6", "right", 100)))
    return E.set_union(left, right, E.KEY, "place")


_INDEX = "CAST(round_even((max(n) - 1) * {}, 0) AS BIGINT)"


@query(
    _GOLD
    + f", o AS (SELECT runlog.*, g.correct_index, coalesce(category, 'unknown') AS own, CASE WHEN event_id % 3 = 0 THEN 'calc' END AS tool FROM runlog"
        f" JOIN gold g ON g.competition_id = runlog.competition_id AND g.question_text = runlog.question_text LEFT"
        f" JOIN {CAT_SQL} AS c(cid, category) ON cid = runlog.competition_id),"
    " r AS (SELECT own AS category, chosen_index = correct_index AS hit, confidence, latency_seconds, tool FROM o UNION ALL"
        " SELECT 'all', chosen_index = correct_index, confidence, latency_seconds, tool FROM o),"
    " b AS (SELECT category, least(CAST(floor(confidence * 10) AS BIGINT), 9) AS bin, count(*) AS cnt, sum(confidence) AS conf"
        ", count(*) FILTER (WHERE hit) AS hit, count(tool) AS fired FROM r GROUP BY ALL),"
    " w AS (SELECT category, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(hit) AS BIGINT) AS correct, round(sum(hit) / sum(cnt), 9) AS accuracy"
        ", round(sum(abs(hit - conf)) / sum(cnt), 6) AS ece, CAST(sum(fired) AS BIGINT) AS n_tool FROM b GROUP BY category),"
    " l AS (SELECT category, latency_seconds AS v, row_number() OVER (PARTITION BY category ORDER BY latency_seconds) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM r),"
    " p AS (SELECT category, max(v) FILTER (WHERE i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS latency_p50, max(v) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS latency_p95"
        " FROM l GROUP BY category)"
    " SELECT w.*, latency_p50, latency_p95 FROM w JOIN p USING (category)"
)
def evaluation_report(spark, d):
    """R-34, A-01..A-08: outputs joined with the gold set, by category and as a whole."""
    log = _with_category(spark, d).withColumn("tool", F.when(F.col("event_id") % 3 == 0, "calc"))
    named = E.gold_harvest(runlog(spark, d)).join(F.broadcast(categories(spark)), "competition_id", "left")
    return E.report(log.drop("category"), named, E.KEY)


_PASSAGES = "[(event_id % 60 + (event_id // 60 + j * j) % 5) % 60 for j in range(0, 6)]"


@query(
    LOG + f", x AS (SELECT question_text, event_id % 60 AS q, event_id, {_PASSAGES} AS s FROM runlog WHERE event_id % 7 <> 0 AND event_id % 3 <> 0)"
        f", e AS (SELECT event_id, q, unnest(s) AS t, unnest(range(1, 7)) AS i FROM x),"
    " f AS (SELECT event_id, q, t, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS place FROM f),"
    " g AS (SELECT event_id, q, max(place) FILTER (WHERE t = (q + 1) % 60) AS found_at FROM r GROUP BY ALL)"
    " SELECT q % 2 = 0 AS even, count(*) AS n, round(avg(CASE WHEN found_at <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_1, round(avg(CASE"
        " WHEN found_at <= 3 THEN 1.0 ELSE 0.0 END), 9) AS recall_3, round_even(avg(coalesce(1.0 / found_at, 0)), 4) AS mrr FROM g GROUP BY 1"
)
def recall_from_runs(spark, d):
    """R-35, J-08: recall from passages that runs have logged; every seventh run has none, every third question no label."""
    q = F.col("event_id") % 60
    place = lambda j: (q + (F.floor(F.col("event_id") / 60) + j * j) % 5) % 60
    passages = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.struct(F.concat(F.lit(" q"), place(j).cast("string")).alias("source")))
    log = runlog(spark, d).withColumn("passages", F.when(F.col("event_id") % 7 != 0, passages))
    gold = log.select("question_text", F.when(F.col("event_id") % 3 != 0,
        F.concat(F.lit("q"), ((q + 1) % 60).cast("string"))).alias("gold_article_title"), (q % 2 == 0).alias("even")).distinct()
    return E.recall_from_runs(log, gold, (1, 3), ["even"])


@query(LOG + f", t AS (SELECT DISTINCT round_even(top_score, 3) AS tau FROM runlog UNION SELECT 0.0 UNION SELECT 1.0), j AS (SELECT tau"
    f", count(event_id) AS n, count(*) FILTER (WHERE correct) AS c FROM t LEFT JOIN runlog ON top_score >= tau GROUP BY tau), e AS (SELECT tau"
    f", round(CASE WHEN n > 0 THEN c / n ELSE 0 END * n / (SELECT count(*) FROM runlog) + 0.25 * (1 - n / (SELECT count(*)"
    f" FROM runlog)), 9) AS expected FROM j) SELECT * FROM e ORDER BY expected DESC, tau LIMIT 5")
def best_thresholds(spark, d):
    """T-06: thresholds by expected accuracy."""
    return E.best_thresholds(E.calibrate_threshold(runlog(spark, d).select("top_score", "correct"), 0.25), 5).select("tau", "expected")


@query(LOG + " SELECT count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS cache_hits, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0"
    " ELSE 0.0 END), 9) AS hit_rate, count(*) FILTER (WHERE event_id % 11 = 0) AS failures"
    ", count(*) FILTER (WHERE NOT (top_score >= 0.2) AND event_id % 11 <> 0) AS empty FROM runlog")
def source_counters(spark, d):
    """A-30: what a news source's calls came to."""
    k = F.col("event_id")
    return D.source_counters(runlog(spark, d).select((k % 3 == 0).alias("cached"), (k % 11 == 0).alias("failed"), (F.col("top_score") >= 0.2).alias("found")))


@query(
    LOG + f", g AS (SELECT event_id, event_id % 60 AS q FROM runlog {_CAT} WHERE {_GAP}), p AS (SELECT event_id, 'Book ' || q AS phrase FROM g"
        f" UNION ALL SELECT event_id, 'Roman Empire' || q FROM g)"
    " SELECT phrase, count(*) AS n, min(event_id) AS first_event FROM p WHERE phrase NOT IN (SELECT 'Book ' || doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY phrase"
)
def gap_mining(spark, d):
    """R-36: phrases of questions that went wrong or found little, without those that the corpus has; titles are compared in any letter case."""
    q = (F.col("event_id") % 60).cast("string")
    log = _with_category(spark, d).where(_GAP)
    asked = log.withColumn("question_text", F.concat(F.lit('Who wrote "Book '), q, F.lit('" about Roman Empire'), q, F.lit("?"))).withColumn("options", F.array(F.lit("x")))
    known = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("BOOK "), F.col("doc_id")).alias("title"))
    return C.gap_phrases(asked, known)


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def inventory(spark, d):
    """A-11, A-32: documents by kind, as views by category and source."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(LOG + f", a AS (SELECT category, {_ACC} AS acc FROM runlog {_CAT} WHERE event_id % 2 = 0 AND category <> 'news' GROUP BY category)"
    f", b AS (SELECT category, {_ACC} AS acc FROM runlog {_CAT} WHERE event_id % 2 = 1 AND category <> 'maths' GROUP BY category)"
    f" SELECT coalesce(a.category, b.category) AS category, a.acc AS before, b.acc AS after, round(b.acc - a.acc, 9) AS delta, CASE"
    f" WHEN round(b.acc - a.acc, 9) >= 0.01 THEN '✓' WHEN round(b.acc - a.acc, 9) < 0.01 THEN '✗' END AS mark FROM a FULL"
    f" JOIN b ON a.category = b.category")
def delta_table(spark, d):
    """A-34: accuracy of two runs by category, with a mark for gains of a hundredth."""
    log = _with_category(spark, d)
    side = lambda c: log.where(c).groupBy("category").agg(E.accuracy(F.col("correct")).alias("acc"))
    return E.delta_table(side("event_id % 2 = 0 and category <> 'news'"), side("event_id % 2 = 1 and category <> 'maths'"), "category", "acc", 0.01)


@query(LOG + f" SELECT event_id, CASE WHEN event_id % 4 = 0 THEN question_text WHEN category IS NOT NULL AND event_id % 5 > 0 THEN category"
    f" ELSE '' END AS gold_source FROM runlog {_CAT}")
def gold_source_overlay(spark, d):
    """J-09, J-03: a gold source where a run lacks one, '' where there is none."""
    log = _with_category(spark, d).withColumn("own", F.when(F.col("event_id") % 4 == 0, F.col("question_text")).when(F.col("event_id") % 2 == 0, ""))
    known = log.select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("category")).alias("label")).where("label is not null")
    return log.join(known, "event_id", "left").select("event_id", F.coalesce(F.nullif("own", F.lit("")), "label", F.lit("")).alias("gold_source"))


@query(_GOLD + " SELECT competition_id, question_text, correct_index FROM gold WHERE level <= 10 AND question_text NOT IN (SELECT question_text"
    " FROM gold WHERE level BETWEEN 6 AND 15)")
def goldset_difference(spark, d):
    """U-02, F-03: difference by key."""
    g = E.gold_harvest(runlog(spark, d))
    return E.set_difference(g.where("level <= 10"), g.where(F.col("level").between(6, 15)), E.KEY).select("competition_id", "question_text", "correct_index")


@query(_GOLD + _WRONG + " SELECT competition_id, question_text, wrong_index FROM wrong WHERE (competition_id, question_text) IN (SELECT competition_id, question_text FROM gold)")
def gold_wrong_overlap(spark, d):
    """U-08, J-23: wrong items whose question is in the gold set."""
    log = runlog(spark, d)
    g = E.gold_harvest(log)
    return E.set_overlap(E.wrong_harvest(log, g), g, E.KEY).select("competition_id", "question_text", "wrong_index")


@query(LOG + ", s AS (SELECT event_id, level, row_number() OVER (PARTITION BY level ORDER BY (event_id * 7919 + 104729) % 1000003, event_id) AS r"
    " FROM runlog) SELECT event_id, level FROM s WHERE r <= 5")
def stratified_sample(spark, d):
    """W-06, T-10: five rows of each level, in an order drawn by arithmetic."""
    draw = (F.col("event_id") * 7919 + 104729) % 1000003
    return E.stratified(runlog(spark, d).select("event_id", "level"), "level", 5, [draw, F.col("event_id")])


@query(LOG + f" SELECT category, level, count(*) AS n, CAST(grouping(category) * 2 + grouping(level) AS BIGINT) AS gid FROM runlog {_CAT} GROUP BY CUBE (category, level)")
def crosstab_totals(spark, d):
    """A-09, A-10: counts by category and level with all totals."""
    return E.crosstab(_with_category(spark, d), "category", "level")


@query(LOG + f", a AS (SELECT level, category, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS c FROM runlog {_CAT})"
    f" SELECT level, " + ", ".join(f"round(avg(c) FILTER (WHERE category = '{c}'), 9) AS {c}" for c in ("history", "maths", "science")) + " FROM a"
    " GROUP BY level")
def accuracy_pivot(spark, d):
    """A-31: accuracy by level and category."""
    log = _with_category(spark, d).withColumn("c", F.when(F.col("correct"), 1.0).otherwise(0.0))
    names = ["history", "maths", "science"]
    return log.groupBy("level").pivot("category", names).agg(F.round(F.avg("c"), 9))


_BF = "b AS (SELECT *, least(CAST(floor(confidence * 10) AS BIGINT), 9) AS bin FROM {src}), k AS (SELECT {by} bin, count(*) AS cnt, avg(confidence) AS conf, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc FROM b GROUP BY ALL)"


@query(LOG + ", " + _BF.format(src=f"(SELECT *, coalesce(category, 'unknown') AS cat2 FROM runlog {_CAT})",
    by="cat2,") + f" SELECT t.category, t.n, t.correct, t.accuracy, e.ece FROM (SELECT coalesce(category, 'unknown') AS category, count(*) AS n"
    f", count(*) FILTER (WHERE correct) AS correct, {_ACC} AS accuracy FROM runlog {_CAT} GROUP BY 1) t"
    f" JOIN (SELECT cat2, round_even(sum(abs(acc - conf) * cnt) / sum(cnt), 6) AS ece FROM k GROUP BY cat2) e ON e.cat2 = t.category")
def accuracy_by_category(spark, d):
    """A-01, A-04: count, correct, accuracy and ECE by category."""
    log = _with_category(spark, d).withColumn("category", F.coalesce("category", F.lit("unknown")))
    b = F.least(F.floor(F.col("confidence") * 10).cast("bigint"), F.lit(9).cast("bigint"))
    per = log.groupBy("category", b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.avg("confidence").alias("conf"),
        F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("acc"), F.count_if("correct").alias("hit"))
    return per.groupBy("category").agg(F.sum("cnt").alias("n"), F.sum("hit").alias("correct"),
        F.round(F.sum("hit") / F.sum("cnt"), 9).alias("accuracy"), F.bround(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("cnt")) / F.sum("cnt"),
        6).alias("ece"))


@query(LOG + ", " + _BF.format(src="runlog", by="") + " SELECT round_even(sum(abs(acc - conf) * cnt) / sum(cnt), 6) AS ece FROM k")
def ece_floor(spark, d):
    """A-02: bins by floor."""
    bins = E.bins_floor(runlog(spark, d))
    return bins.agg(F.bround(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("cnt")) / F.sum("cnt"), 6).alias("ece"))


_EDGES = ", ".join(f"({i}, CAST({i * (1.0 / 10)!r} AS DOUBLE), CAST({1.0 if i == 9 else (i + 1) * (1.0 / 10)!r} AS DOUBLE))" for i in range(10))
_BE = LOG + f", e(bin, lo, hi) AS (VALUES {_EDGES}), k AS (SELECT e.bin, any_value(lo) AS lo, any_value(hi) AS hi, count(confidence) AS cnt, avg(confidence) AS conf, avg(CASE WHEN correct THEN 1.0 WHEN confidence IS NOT NULL THEN 0.0 END) AS acc FROM e LEFT JOIN runlog ON confidence >= lo AND (confidence < hi OR (bin = 9 AND confidence = hi)) GROUP BY e.bin), r AS (SELECT CAST(bin AS BIGINT) AS bin, cnt, round(coalesce(conf, (lo + hi) / 2), 9) AS conf, round(coalesce(acc, 0), 9) AS acc FROM k)"


@query(_BE + " SELECT * FROM r")
def reliability_bins(spark, d):
    """A-03: half-open bins, the last closed, empty ones shown."""
    return E.bins_edges(runlog(spark, d))


@query(_BE + " SELECT round(sum(abs(acc - conf) * cnt) / (SELECT count(*) FROM runlog), 7) AS ece FROM r")
def ece_edges(spark, d):
    """A-03: its ECE."""
    log = runlog(spark, d)
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return E.ece(E.bins_edges(log), total).select(F.round("ece", 7).alias("ece"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i"
    ", count(*) OVER (PARTITION BY event_type) AS n FROM events)"
    " SELECT event_type, max(value) FILTER (WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (WHERE i = round_even((n - 1) * 0.95, 0)) AS p95"
    ", round(avg(value), 6) AS mean FROM r GROUP BY event_type")
def latency_percentiles(spark, d):
    """A-06, A-08: nearest rank, halves to even."""
    e = table(spark, d, "events")
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return E.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).join(mean, "event_type")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i"
    ", count(*) OVER (PARTITION BY event_type) AS n FROM events)"
    " SELECT event_type, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1)) AS p95"
    " FROM r GROUP BY event_type")
def latency_percentiles_dashboard(spark, d):
    """A-07: the dashboard's ranks."""
    return E.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, dashboard=True)


@query(LOG + ", t AS (SELECT DISTINCT round_even(top_score, 3) AS tau FROM runlog UNION SELECT 0.0 UNION SELECT 1.0), j AS (SELECT tau"
    ", count(event_id) AS n, count(event_id) FILTER (WHERE correct) AS c FROM t LEFT JOIN runlog ON top_score >= tau GROUP BY tau)"
    ", x AS (SELECT tau, n AS n_ungated, n / (SELECT count(*) FROM runlog) AS p, CASE WHEN n > 0 THEN c / n ELSE 0 END AS a FROM j)"
    " SELECT CAST(tau AS DOUBLE) AS tau, n_ungated, round(p, 9) AS p_ungated, round(a, 9) AS acc_ungated, round(a * p + 0.25 * (1 - p), 9) AS expected"
    " FROM x")
def threshold_calibration(spark, d):
    """A-18, J-17, W-08, U-04: what each threshold lets through, by a cumulative sum over distinct scores."""
    return E.calibrate_threshold(runlog(spark, d).select("top_score", "correct"), 0.25)


@query(LOG + ", c AS (SELECT top_score, count(*) AS n, count(*) FILTER (WHERE correct) AS k FROM runlog GROUP BY top_score) SELECT top_score"
    ", CAST(sum(n) OVER w AS BIGINT) AS n_ungated, round(sum(k) OVER w / sum(n) OVER w, 9) AS acc FROM c WINDOW w AS (ORDER BY top_score DESC)")
def cumulative_gate(spark, d):
    """W-08: accuracy of all rows with at least a score."""
    c = runlog(spark, d).groupBy("top_score").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))
    summed = E.cumulative(c, [], "top_score", {"n_ungated": "n", "hits": "k"}, descending=True)
    return summed.select("top_score", "n_ungated", F.round(F.col("hits") / F.col("n_ungated"), 9).alias("acc"))




@query(LOG + f" SELECT category, count(*) AS gaps, count(DISTINCT question_text) AS questions FROM runlog {_CAT} WHERE {_GAP} GROUP BY category")
def gap_predicate(spark, d):
    """F-08, R-36, J-02: rows that point to a gap in the corpus."""
    log = runlog(spark, d).join(F.broadcast(categories(spark)), "competition_id")
    gap = ~F.col("category").isin("news", "maths") & ((F.col("correct") == F.lit(False)) | (F.col("top_score") < 0.5))
    return log.where(gap).groupBy("category").agg(F.count(F.lit(1)).alias("gaps"), F.count_distinct("question_text").alias("questions"))


_SRC = "CASE WHEN top_score >= 0.3 THEN 'offline' WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 'live' ELSE 'none' END"


def _sourced(log):
    source = F.when(F.col("top_score") >= 0.3, "offline").when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 5 != 0), "live").otherwise("none")
    return log.withColumn("source", source)


@query(LOG + f" SELECT {_SRC} AS source, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, {_ACC} AS accuracy FROM runlog GROUP BY 1")
def context_source_breakdown(spark, d):
    """A-26, F-19: accuracy by where the context came from."""
    return _sourced(runlog(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), E.accuracy(F.col("correct")).alias("accuracy"))


@query(LOG + f" SELECT CASE WHEN level <= 5 THEN '1-5' WHEN level <= 10 THEN '6-10' ELSE '11-15' END AS band, count(*) AS n, {_ACC} AS accuracy"
    f", round(avg(top_score), 9) AS top_score FROM runlog GROUP BY 1")
def level_bands(spark, d):
    """A-26, A-33: by bands of levels."""
    band = F.when(F.col("level") <= 5, "1-5").when(F.col("level") <= 10, "6-10").otherwise("11-15")
    return runlog(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), E.accuracy(F.col("correct")).alias("accuracy"),
        F.round(F.avg("top_score"), 9).alias("top_score"))


@query(LOG + f", s AS (SELECT *, {_SRC} AS source FROM runlog) SELECT count(*) FILTER (WHERE top_score < 0.3) AS gated"
    f", count(*) FILTER (WHERE top_score < 0.3 AND event_id % 3 <> 0) AS fired, count(*) FILTER (WHERE source = 'live') AS above"
    f", round(avg(latency_seconds) FILTER (WHERE source = 'live'), 6) AS latency, round(100 * (avg(CASE WHEN correct THEN 1.0"
    f" ELSE 0.0 END) FILTER (WHERE source = 'live') - avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE source = 'none')), 6) AS boost_pp"
    f" FROM s")
def live_efficiency(spark, d):
    """A-27: what live search brings, in short."""
    s = _sourced(runlog(spark, d))
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    live, none = F.col("source") == "live", F.col("source") == "none"
    weak = F.col("top_score") < 0.3
    return s.agg(F.count_if(weak).alias("gated"), F.count_if(weak & (F.col("event_id") % 3 != 0)).alias("fired"), F.count_if(live).alias("above"),
        F.round(F.avg(F.when(live, F.col("latency_seconds"))), 6).alias("latency"),
        F.round(100 * (F.avg(F.when(live, hit)) - F.avg(F.when(none, hit))), 6).alias("boost_pp"))


_PROVIDER = "CASE WHEN top_score >= 0.3 OR event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'guardian_window' WHEN event_id % 7 = 1 THEN 'guardian_broad' WHEN event_id % 7 < 6 THEN 'wikipedia' END"
_LIVE = (
    f", v AS (SELECT *, {_SRC} AS source, top_score < 0.3 AS gated, top_score < 0.3 AND event_id % 3 <> 0 AS fired, top_score < 0.3 AND event_id % 3 <> 0 AND event_id % 5 = 0 AS all_below, {_PROVIDER} AS provider,"
    " CASE WHEN top_score < 0.3 THEN latency_seconds / 2 END AS live_latency, CASE WHEN event_id % 3 <> 0 THEN top_score + 0.25 END AS live_top_score FROM runlog)"
)


def _lived(spark, d):
    i, weak = F.col("event_id"), F.col("top_score") < 0.3
    fired = weak & (i % 3 != 0)
    provider = F.when(fired, F.when(i % 7 == 0, "guardian_window").when(i % 7 == 1, "guardian_broad").when(i % 7 < 6, "wikipedia"))
    return _sourced(runlog(spark, d)).withColumns({"gated": weak, "fired": fired, "all_below": fired & (i % 5 == 0), "provider": provider,
        "live_latency": F.when(weak, F.col("latency_seconds") / 2), "live_top_score": F.when(i % 3 != 0, F.col("top_score") + 0.25)})


@query(LOG + _LIVE + " SELECT count(*) AS n, count(*) FILTER (WHERE gated) AS gated, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE source = 'live') AS above, count(*) FILTER (WHERE all_below) AS wasted,"
    " count(*) FILTER (WHERE provider LIKE 'guardian%') AS guardian, count(*) FILTER (WHERE provider = 'wikipedia') AS wikipedia, round(avg(live_latency), 6) AS latency,"
    " round(avg(live_top_score) FILTER (WHERE source = 'live'), 6) AS live_score, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE source = 'live'), 9) AS acc_live,"
    " round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE source = 'none'), 9) AS acc_none, round(100 * (avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE source = 'live')"
    " - avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE source = 'none')), 6) AS boost_pp FROM v")
def live_report(spark, d):
    """A-27: live search step by step, with its providers and the scores of what it kept."""
    return O.live_report(_lived(spark, d))


@query(LOG + _LIVE + " SELECT CASE WHEN provider LIKE 'guardian%' THEN 'Guardian' ELSE 'Wikipedia' END AS provider, count(*) AS n, count(*) FILTER (WHERE correct) AS correct FROM v WHERE fired GROUP BY 1")
def live_providers(spark, d):
    """F-20: who served the live passages, as people are told."""
    return _lived(spark, d).where("fired").groupBy(O.live_label(F.col("provider")).alias("provider")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))


_GATES = (
    "count(*) AS n, count(*) FILTER (WHERE gated) AS n_gated, round(avg(CASE WHEN gated THEN 1.0 ELSE 0.0 END), 9) AS gate_rate,"
    " round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE gated), 9) AS acc_gated, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT gated), 9) AS acc_ungated,"
    " round(avg(top_score) FILTER (WHERE correct), 9) AS score_correct, round(avg(top_score) FILTER (WHERE correct IS NOT TRUE), 9) AS score_wrong"
)


@query(LOG + _LIVE + f", g AS (SELECT v.*, coalesce(category, 'unknown') AS category FROM v LEFT JOIN {CAT_SQL} AS c(cid, category) ON cid = competition_id WHERE event_id % 4 <> 0)"
    f" SELECT category, {_GATES} FROM g GROUP BY category UNION ALL SELECT 'all', {_GATES} FROM g")
def gate_report(spark, d):
    """A-28: gate rates by category, accuracy and scores with and without the gate, over questions that retrieved."""
    log = _lived(spark, d).join(F.broadcast(categories(spark)), "competition_id", "left")
    return O.gate_report(log.withColumn("n_passages", F.when(F.col("event_id") % 4 != 0, 3)))


@query(LOG + " SELECT correct, count(*) AS n, round(min(top_score), 9) AS lo, round(avg(top_score), 9) AS mean, round(max(top_score), 9) AS hi"
    ", round(avg(CASE WHEN top_score < 0.3 THEN 1.0 ELSE 0.0 END), 9) AS gate_rate FROM runlog GROUP BY correct")
def retrieval_dashboard(spark, d):
    """A-28: scores and gate rate by outcome, unknown ones apart."""
    return runlog(spark, d).groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("top_score"), 9).alias("lo"),
        F.round(F.avg("top_score"), 9).alias("mean"), F.round(F.max("top_score"), 9).alias("hi"),
        F.round(F.avg(F.when(F.col("top_score") < 0.3, 1.0).otherwise(0.0)), 9).alias("gate_rate"))


@query(LOG + " SELECT session_id, count(*) AS n_questions, count(*) FILTER (WHERE correct) AS n_correct, arg_max(level, event_id) AS final_level FROM runlog GROUP BY session_id")
def session_summary(spark, d):
    """A-25: by session."""
    return runlog(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("correct").alias("n_correct"),
        F.max_by("level", "event_id").alias("final_level"))


@query(LOG + f" SELECT session_id, {_ACC} AS accuracy"
    f", round(avg(confidence), 9) AS confidence, row_number() OVER (ORDER BY {_ACC} DESC, session_id) AS place FROM runlog"
    f" GROUP BY session_id QUALIFY place <= 20")
def leaderboard(spark, d):
    """T-07, T-12: the twenty best sessions."""
    g = runlog(spark, d).groupBy("session_id").agg(E.accuracy(F.col("correct")).alias("accuracy"), F.round(F.avg("confidence"), 9).alias("confidence"))
    best = g.orderBy(F.desc("accuracy"), "session_id").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "session_id")).cast("bigint"))


@query(LOG + f", a AS (SELECT category, {_ACC} AS acc FROM runlog {_CAT} WHERE event_id % 2 = 0 AND level <= 9 AND category <> 'news'"
    f" GROUP BY category), b AS (SELECT category, {_ACC} AS acc FROM runlog {_CAT} WHERE event_id % 2 = 1 AND category <> 'maths' GROUP BY category)"
    f" SELECT coalesce(a.category, b.category) AS category, a.acc AS base, b.acc AS improved, round(b.acc - a.acc, 9) AS delta FROM a FULL"
    f" JOIN b ON a.category = b.category WHERE coalesce(a.category, b.category) IS NOT NULL")
def delta_full_outer(spark, d):
    """J-16, A-34, U-06: two runs by category, either side may lack one."""
    log = _with_category(spark, d).where("category is not null")
    a = log.where("event_id % 2 = 0 and level <= 9 and category <> 'news'").groupBy("category").agg(E.accuracy(F.col("correct")).alias("base"))
    b = log.where("event_id % 2 = 1 and category <> 'maths'").groupBy("category").agg(E.accuracy(F.col("correct")).alias("improved"))
    return a.join(b, "category", "full").select("category", "base", "improved", F.round(F.col("improved") - F.col("base"), 9).alias("delta"))


@query(LOG + ", g AS (SELECT k, t, h FROM (VALUES (1), (3), (5)) a(k), (VALUES (0.0), (0.3), (0.6)) b(t), (VALUES (TRUE), (FALSE)) c(h)"
    " WHERE NOT (h AND k = 1)), s AS (SELECT k, t, h, round(avg(CASE WHEN correct AND (h OR chosen_index < k) THEN 1.0 ELSE 0.0 END), 9) AS acc FROM g"
    " JOIN runlog ON top_score >= t GROUP BY ALL) SELECT k, CAST(t AS DOUBLE) AS t, h, acc FROM s QUALIFY row_number() OVER (PARTITION BY h"
    " ORDER BY acc DESC, k, t) = 1")
def hyper_grid_top1(spark, d):
    """J-20, W-05, R-37, T-13: the best cell of a grid of settings, by path."""
    cells = [(k, t, h) for k in (1, 3, 5) for t in (0.0, 0.3, 0.6) for h in (True, False) if not (h and k == 1)]
    grid = spark.createDataFrame(cells, "k int, t double, h boolean")
    hit = F.when(F.col("correct") & (F.col("h") | (F.col("chosen_index") < F.col("k"))), 1.0).otherwise(0.0)
    s = runlog(spark, d).join(F.broadcast(grid), F.col("top_score") >= F.col("t")).groupBy("k", "t", "h").agg(F.round(F.avg(hit), 9).alias("acc"))
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("acc"), "k", "t"))).where("_r = 1").drop("_r")


@query("WITH q(id, day) AS (VALUES (1, DATE '2024-01-05'), (2, DATE '2024-01-28'), (3, DATE '2025-01-01')) SELECT q.id, count(*) AS n"
    ", CAST(min(e.event_id) AS BIGINT) AS first_event FROM q JOIN events e ON CAST(e.ts AS DATE) BETWEEN q.day - 2 AND q.day + 2 GROUP BY q.id")
def date_window_join(spark, d):
    """J-18, D-03: events within two days of a question's date; the window is exploded to days, so the join is by equality."""
    q = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-28"), (3, "2025-01-01")], "id int, day string").select("id",
        F.explode(F.sequence(F.date_sub(F.to_date("day"), 2), F.date_add(F.to_date("day"), 2))).alias("day"))
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return e.join(F.broadcast(q), "day").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(LOG + ", r AS (SELECT session_id, event_id, row_number() OVER w AS i, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) OVER w, 9) AS running"
    " FROM runlog WINDOW w AS (PARTITION BY session_id ORDER BY event_id)) SELECT session_id, i, running FROM r WHERE i % 10 = 0")
def running_accuracy(spark, d):
    """W-07: every tenth row of a session."""
    return E.running_accuracy(runlog(spark, d), ["session_id"], "event_id").where("i % 10 = 0").select("session_id", F.col("i").cast("bigint").alias("i"), "running")


@query(LOG + ", p AS (SELECT question_text, session_id, min(event_id) AS fetched FROM runlog WHERE top_score < 0.3 GROUP BY ALL)"
    ", c AS (SELECT p.question_text, p.session_id, p.fetched, min(r.event_id) AS confirmed FROM p"
    " JOIN runlog r ON r.question_text = p.question_text AND r.session_id = p.session_id AND r.correct AND r.event_id >= p.fetched GROUP BY ALL)"
    " SELECT question_text, count(*) AS confirmations, min(confirmed) AS first FROM c GROUP BY question_text")
def growth_confirm(spark, d):
    """J-22, R-22: fetched articles that a correct answer confirms; the batch form of the stream."""
    log = runlog(spark, d)
    p = log.where("top_score < 0.3").groupBy("question_text", "session_id").agg(F.min("event_id").alias("fetched"))
    hit = log.where("correct").select("question_text", "session_id", "event_id")
    c = p.join(hit, ["question_text", "session_id"]).where("event_id >= fetched").groupBy("question_text", "session_id").agg(F.min("event_id").alias("confirmed"))
    return c.groupBy("question_text").agg(F.count(F.lit(1)).alias("confirmations"), F.min("confirmed").alias("first"))


@query(LOG + f", h AS (SELECT competition_id, count(*) AS n FROM runlog WHERE competition_id NOT IN (3) GROUP BY 1)"
    f" SELECT CAST(c.cid AS BIGINT) AS competition_id, c.category, coalesce(h.n, 0) AS n FROM {CAT_SQL} AS c(cid, category) LEFT"
    f" JOIN h ON h.competition_id = c.cid")
def competition_coverage(spark, d):
    """J-24, J-01: every competition, with zero where nothing was harvested."""
    n = runlog(spark, d).where("competition_id <> 3").groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"))
    return categories(spark).join(n, "competition_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(LOG + ", f AS (SELECT session_id, event_id, CASE WHEN correct IS NOT TRUE THEN 1 ELSE 0 END AS bad FROM runlog)"
    ", r AS (SELECT *, sum(1 - bad) OVER (PARTITION BY session_id ORDER BY event_id) AS run FROM f)"
    ", s AS (SELECT session_id, sum(bad) OVER (PARTITION BY session_id, run ORDER BY event_id) AS streak FROM r) SELECT session_id"
    ", CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (WHERE streak >= 8) AS cooling FROM s GROUP BY session_id")
def failure_streaks(spark, d):
    """W-10: the longest run of failures, and rows in a cooldown after eight."""
    s = E.streaks(runlog(spark, d), "session_id", "event_id", ~F.coalesce("correct", F.lit(False)))
    return s.groupBy("session_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") >= 8).alias("cooling"))


@query(LOG + " SELECT event_id, question_text, confidence FROM runlog WHERE NOT correct ORDER BY coalesce(confidence, 0) DESC, event_id LIMIT 5")
def worst_misses(spark, d):
    """T-08, T-14: the most confident wrong answers."""
    return E.traces(runlog(spark, d)).select("event_id", "question_text", "confidence")


@query(LOG + f", a AS (SELECT session_id, count(*) FILTER (WHERE correct) AS score FROM runlog GROUP BY session_id) SELECT session_id, score"
    f", CAST(row_number() OVER (ORDER BY score DESC, session_id) AS INTEGER) AS place FROM a ORDER BY place LIMIT 100")
def player_standings(spark, d):
    """T-12: the best of all sessions; a limit of 1,000 is held at 100."""
    scores = runlog(spark, d).groupBy("session_id").agg(F.count_if("correct").alias("score"))
    return E.standings(scores, "session_id", "score", 1000)
