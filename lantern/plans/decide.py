"""Queries of decisions over arms that are projected from the run log, and of parsing and closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import decide as D
from ..operators.corpus import top_by_priority
from .common import CAT_SQL, LOG, categories, query, runlog, table

# Three arms a row: choices, confidences and abstentions by arithmetic; on every 29th question all abstain.
_ARMS_SQL = (
    ", arms AS (SELECT event_id AS question_id, arm, (chosen_index + CASE WHEN event_id % (arm + 3) = 0 THEN arm ELSE 0 END) % 4 AS chosen_index,"
    " 0.25 + 0.75 * ((event_id * (arm + 7)) % 100) / 100.0 AS confidence, ((event_id + arm) % 11 = 0 OR event_id % 29 = 3) AS is_abstain, level, competition_id"
        " FROM runlog, (VALUES (0), (1), (2)) a(arm))"
)


def _arms(spark, d):
    arm = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("arm")
    log = runlog(spark, d).select(F.col("event_id").alias("question_id"), "chosen_index", "level", "competition_id", arm)
    shift = F.when(F.col("question_id") % (F.col("arm") + 3) == 0, F.col("arm")).otherwise(0)
    return log.select("question_id", "arm", ((F.col("chosen_index") + shift) % 4).alias("chosen_index"),
        (0.25 + 0.75 * ((F.col("question_id") * (F.col("arm") + 7)) % 100) / F.lit(100.0)).alias("confidence"),
        (((F.col("question_id") + F.col("arm")) % 11 == 0) | (F.col("question_id") % 29 == 3)).alias("is_abstain"), "level", "competition_id")


def _with_probs(arms):
    return arms.withColumn("probs", N.soft_one_hot(F.col("chosen_index"), F.col("confidence")))


_WEIGHTS = [(0, 1.0), (1, 0.7), (2, 0.5)]
_W_SQL = "(VALUES (0, CAST(1.0 AS DOUBLE)), (1, 0.7), (2, 0.5)) w(arm, weight)"


@query(
    LOG + _ARMS_SQL + f", p AS (SELECT question_id, idx, round(sum(weight * CASE WHEN idx = chosen_index THEN confidence"
        f" ELSE (1 - confidence) / 3 END) / sum(weight), 9) AS p FROM arms JOIN {_W_SQL} USING (arm), (VALUES (0), (1), (2), (3)) i(idx)"
        f" WHERE NOT is_abstain GROUP BY ALL)"
    " SELECT * FROM (SELECT question_id, CAST(idx AS BIGINT) AS chosen_index, p AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY p DESC, idx) = 1)"
    " UNION ALL SELECT question_id, min_by(chosen_index, arm), min_by(confidence, arm) FROM arms GROUP BY question_id HAVING bool_and(is_abstain)"
)
def ensemble_weighted(spark, d):
    """R-29, A-19, T-11: weighted mean of probabilities without abstainers."""
    return D.ensemble_weighted(_with_probs(_arms(spark, d)), spark.createDataFrame(_WEIGHTS, "arm int, weight double"))


@query(LOG + _ARMS_SQL + f", v AS (SELECT question_id, chosen_index, round(sum(weight), 9) AS votes FROM arms JOIN {_W_SQL} USING (arm)"
    f" WHERE NOT is_abstain GROUP BY ALL) SELECT * FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, chosen_index) = 1)"
    " UNION ALL SELECT question_id, min_by(chosen_index, arm), NULL FROM arms GROUP BY question_id HAVING bool_and(is_abstain)")
def ensemble_vote(spark, d):
    """R-29, A-20: weighted votes."""
    return D.ensemble_vote(_arms(spark, d), spark.createDataFrame(_WEIGHTS, "arm int, weight double"))


@query(LOG + _ARMS_SQL + f", p AS (SELECT a.*, category, CASE WHEN question_id % 17 = 0 THEN NULL ELSE confidence - 0.5 END AS margin FROM arms a LEFT"
    f" JOIN {CAT_SQL} AS c(cid, category) ON cid = competition_id WHERE arm = 0), f AS (SELECT question_id, chosen_index AS fi FROM arms"
    f" WHERE arm = 1 AND question_id % 13 <> 4), x AS (SELECT p.*, fi, (category IS NULL OR category <> 'news') AND (margin IS NULL OR margin >= 0.2) AS com FROM p"
    f" LEFT JOIN f USING (question_id)) SELECT question_id, CASE WHEN com THEN chosen_index ELSE coalesce(fi, chosen_index) END AS chosen_index, CASE WHEN com OR fi IS NULL THEN 'primary'"
    f" ELSE 'fallback' END AS arm, NOT com AND coalesce(fi <> chosen_index, false) AS disagree FROM x")
def confidence_gate(spark, d):
    """R-26, J-21: the primary's answer where its margin suffices and the category isn't forced, else the fallback's; some questions have none."""
    arms = _arms(spark, d)
    margin = F.when(F.col("question_id") % 17 == 0, F.lit(None)).otherwise(F.col("confidence") - 0.5)
    primary = arms.where("arm = 0").join(F.broadcast(categories(spark)), "competition_id", "left").withColumn("margin", margin)
    return D.gated(primary, arms.where("arm = 1 and question_id % 13 <> 4"), D.confidence_gate(F.col("margin"), F.col("category"), 0.20, ("news",)))


_TIER = "CASE WHEN category = 'maths' THEN 'tools' WHEN level <= 5 THEN 'easy' WHEN level <= 10 THEN 'medium' ELSE 'hard' END"


@query(LOG + _ARMS_SQL + f" SELECT {_TIER} AS tier, count(*) AS n"
    f", count(*) FILTER (WHERE {_TIER} IN ('easy', 'medium') AND confidence - 0.5 < 0.1 AND NOT is_abstain) AS escalated FROM arms LEFT"
    f" JOIN {CAT_SQL} AS c(cid, category) ON cid = competition_id WHERE arm = 0 GROUP BY 1")
def tier_route(spark, d):
    """R-25, A-29: questions by tier, and how many are escalated."""
    arms = _arms(spark, d).where("arm = 0").join(F.broadcast(categories(spark)), "competition_id", "left").withColumn("tier",
        D.tier(F.col("level"), F.col("category"), {"maths": "tools"}))
    return arms.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(D.escalates(F.col("tier"), F.col("confidence") - 0.5, F.col("is_abstain"), 0.1)).alias("escalated"))


_TIERS = (
    ", t AS (SELECT question_id, CASE arm WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS tier, chosen_index, confidence, CASE WHEN question_id % 17 <> 0 THEN confidence - 0.5 END AS margin, is_abstain"
    " FROM arms WHERE question_id % 19 <> 2 OR arm = 0 UNION ALL SELECT question_id, 'tools', (chosen_index + 1) % 4, confidence, confidence - 0.5, is_abstain FROM arms WHERE arm = 2),"
    f" q AS (SELECT question_id, {_TIER} AS tier FROM arms LEFT JOIN {CAT_SQL} AS c(cid, category) ON cid = competition_id WHERE arm = 0),"
    " o AS (SELECT q.question_id, q.tier, t.chosen_index, t.confidence, coalesce(q.tier IN ('easy', 'medium') AND t.margin < 0.1 AND NOT t.is_abstain, false) AS up"
        " FROM q LEFT JOIN t ON t.question_id = q.question_id AND t.tier = q.tier)"
)


@query(LOG + _ARMS_SQL + _TIERS + " SELECT o.question_id, CASE WHEN n.tier IS NOT NULL THEN n.chosen_index ELSE o.chosen_index END AS chosen_index,"
    " CASE WHEN n.tier IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, o.tier AS tier_originally, coalesce(n.tier, o.tier) AS tier_selected, n.tier IS NOT NULL AS escalated"
    " FROM o LEFT JOIN t n ON o.up AND n.question_id = o.question_id AND n.tier = CASE o.tier WHEN 'easy' THEN 'medium' ELSE 'hard' END")
def tier_answers(spark, d):
    """R-25: each question's answer by its tier, or the next one's where the tier is uncertain; some questions lack answers."""
    arms = _arms(spark, d)
    named = F.when(F.col("arm") == 0, "easy").when(F.col("arm") == 1, "medium").otherwise("hard")
    margin = F.col("confidence") - 0.5
    own = arms.where("question_id % 19 <> 2 or arm = 0").select("question_id", named.alias("tier"), "chosen_index", "confidence",
        F.when(F.col("question_id") % 17 != 0, margin).alias("margin"), "is_abstain")
    tools = arms.where("arm = 2").select("question_id", F.lit("tools").alias("tier"), ((F.col("chosen_index") + 1) % 4).alias("chosen_index"), "confidence", margin.alias("margin"), "is_abstain")
    questions = arms.where("arm = 0").join(F.broadcast(categories(spark)), "competition_id", "left").select("question_id", "level", "category")
    return D.tiered(questions, own.union(tools), {"maths": "tools"}, 0.1)


@query(LOG + _ARMS_SQL + " SELECT arm, count(*) AS n, count(*) FILTER (WHERE a.chosen_index = b.chosen_index) AS agree FROM arms a"
    " JOIN (SELECT question_id, chosen_index FROM arms WHERE arm = 0) b USING (question_id) GROUP BY arm")
def arm_agreement(spark, d):
    """A-29: how often each arm agrees with the first."""
    arms = _arms(spark, d)
    first = arms.where("arm = 0").select("question_id", F.col("chosen_index").alias("own"))
    return arms.join(first, "question_id").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chosen_index") == F.col("own")).alias("agree"))


@query(LOG + _ARMS_SQL + ", p AS (SELECT question_id, max(chosen_index) FILTER (WHERE arm = 0) AS c, max(confidence) FILTER (WHERE arm = 0) AS f, max(chosen_index) FILTER (WHERE arm = 1 AND question_id % 4 = 1) AS t1, max(chosen_index) FILTER (WHERE arm = 2 AND question_id % 3 = 1) AS t2"
    " FROM arms GROUP BY question_id) SELECT question_id, coalesce(t1, t2, c) AS chain, CASE WHEN f >= 0.7 THEN c"
    " ELSE coalesce(t1, t2, c) END AS gated FROM p")
def tool_coalesce(spark, d):
    """R-27, R-28, R-30: the first tool with an answer; tools only where confidence is low."""
    q = F.col("question_id")
    at = lambda i, c, cond=F.lit(True): F.max(F.when((F.col("arm") == i) & cond, F.col(c)))
    p = _arms(spark, d).groupBy("question_id").agg(at(0, "chosen_index").alias("c"), at(0, "confidence").alias("f"),
        at(1, "chosen_index", q % 4 == 1).alias("t1"), at(2, "chosen_index", q % 3 == 1).alias("t2"))
    tools = [F.col("t1"), F.col("t2")]
    return p.select("question_id", D.tool_chain(tools, F.col("c")).alias("chain"), D.confidence_or_tools(F.col("c"), F.col("f"), tools).alias("gated"))


@query(
    LOG + _ARMS_SQL + f", p AS (SELECT question_id, max(competition_id) AS cid, max(chosen_index) FILTER (WHERE arm = 0) AS c, max(confidence) FILTER (WHERE arm = 0) AS f, max(chosen_index) FILTER (WHERE arm = 1 AND question_id % 4 = 1) AS t, max(chosen_index) FILTER (WHERE arm = 2) AS r"
        f" FROM arms GROUP BY question_id)"
    f" SELECT question_id, coalesce(t, CASE WHEN f >= 0.7 THEN c WHEN category = 'maths' THEN r ELSE c END) AS choice FROM p LEFT JOIN {CAT_SQL} AS x(xid, category) ON xid = cid"
)
def rewrite_chain(spark, d):
    """R-30: tools, a confident answer, the rewritten question's in maths, the answer at hand."""
    at = lambda i, c, cond=F.lit(True): F.max(F.when((F.col("arm") == i) & cond, F.col(c)))
    p = _arms(spark, d).groupBy("question_id").agg(F.max("competition_id").alias("competition_id"), at(0, "chosen_index").alias("c"),
        at(0, "confidence").alias("f"), at(1, "chosen_index", F.col("question_id") % 4 == 1).alias("t"), at(2, "chosen_index").alias("r"))
    named = p.join(F.broadcast(categories(spark)), "competition_id", "left")
    return named.select("question_id", D.rewrite_chain([F.col("t")], F.col("c"), F.col("f"), F.col("r"), F.col("category")).alias("choice"))


@query(LOG + " SELECT CASE WHEN question_text LIKE '%7' THEN 'tool' ELSE 'llm' END AS tool, count(*) AS fired"
    ", count(*) FILTER (WHERE correct) AS correct, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM runlog GROUP BY 1")
def tool_split(spark, d):
    """A-05: accuracy with and without a tool."""
    log = runlog(spark, d).withColumn("tool", F.when(F.col("question_text").endswith("7"), "tool").otherwise("llm"))
    return log.groupBy("tool").agg(F.count(F.lit(1)).alias("fired"), F.count_if("correct").alias("correct"),
        F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


@query(LOG + " SELECT CASE WHEN level <= 5 THEN top_score < 0.3 WHEN level <= 10 THEN top_score < 0.5 ELSE FALSE END AS gated, count(*) AS n FROM runlog GROUP BY 1")
def score_gate(spark, d):
    """F-10: a threshold by path; none for the hardest."""
    tau = F.when(F.col("level") <= 5, 0.3).when(F.col("level") <= 10, 0.5)
    return runlog(spark, d).groupBy(D.score_gate(F.col("top_score"), tau).alias("gated")).agg(F.count(F.lit(1)).alias("n"))


@query(LOG + ", s(question_text, source, priority) AS (SELECT DISTINCT question_text, s, p"
    " FROM runlog, (VALUES ('window', 0, 5), ('broad', 1, 3), ('wiki', 2, 2)) t(s, p, m) WHERE event_id % 60 % m = 1) SELECT question_text, source"
    " FROM s QUALIFY priority = min(priority) OVER (PARTITION BY question_text)")
def priority_fallback(spark, d):
    """R-24, S-23: the first source that has something, by question."""
    sources = spark.createDataFrame([("window", 0, 5), ("broad", 1, 3), ("wiki", 2, 2)], "source string, priority int, m int")
    hits = runlog(spark, d).select("event_id", "question_text").join(F.broadcast(sources),
        F.col("event_id") % 60 % F.col("m") == 1).select("question_text", "source", "priority").distinct()
    return top_by_priority(hits, "question_text", "priority").select("question_text", "source")


_LETTERS = "['A', 'B', 'C', 'D']"


@query("SELECT event_id, CAST(CASE WHEN event_id % 9 < 7 THEN event_id % 4 END AS BIGINT) AS answer FROM events")
def parse_answer(spark, d):
    """X-10: the letter a model's output settles on, by each pattern and by the last bare letter."""
    n = F.col("event_id")
    right, other = (F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), ((n + k) % 4 + 1).cast("int")) for k in (0, 1))
    forms = [
        F.concat(F.lit("so \\boxed{"), F.lower(right), F.lit("} or "), other), F.concat(F.lit("Answer: ("), right, F.lit(") and not "), other),
            F.concat(F.lit("the final answer is "), right), F.concat(F.lit("I pick option "), F.lower(right), F.lit(".")),
        F.concat(F.lit("Let "), other, F.lit(" be x.\n"), right, F.lit(") no")), F.concat(F.lit("Let "), other, F.lit(" be the area, so "), right),
            F.concat(other, F.lit(" then "), right), F.lit("nothing"), F.lit(None).cast("string"),
    ]
    said = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        said = F.when(n % 9 == i, form).otherwise(said)
    return table(spark, d, "events").select("event_id", T.parse_answer(said).alias("answer"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Title ' || doc_id WHEN 2 THEN 'Empire of ' || lang WHEN 3 THEN source ELSE 'Q' || doc_id END AS title FROM documents")
def distill_title(spark, d):
    """X-09: a title from a model's output, or else the question."""
    k, lang, source = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")
    forms = [
        F.concat(F.lit("<think>hm "), lang, F.lit("</think>\nTitle "), k), F.concat(F.lit("<think>cut off in "), source),
            F.concat(F.lit('Thinking Process:\nTitle: "Empire of '), lang, F.lit('"')),
            F.concat(F.lit("Okay, the user wants\n**"), source, F.lit("**")),
        F.concat(F.lit("one two three four five six "), lang), F.lit(None).cast("string"),
    ]
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(F.col("doc_id") % 6 == i, form).otherwise(raw)
    return table(spark, d, "documents").select("doc_id", T.distill_title(raw, F.concat(F.lit("Q"), k)).alias("title"))


@query("SELECT event_id"
    ", CAST(m AS BIGINT) AS remainder, n * (n + 1) * (2 * n + 1) // 6 AS squares, 1440 // lcm(a, b) AS meetings, greatest(0, a + b - 30) AS both_sets"
    ", round(n * n / 2.0, 6) AS area"
    " FROM (SELECT event_id, event_id % 20 + 1 AS n, event_id % 13 + 2 AS a, event_id % 7 + 3 AS b, [1, 3, 2, 6, 4, 5][event_id % 6 + 1] AS m"
    " FROM events)")
def closed_form_maths(spark, d):
    """§2.8.1, rows 8, 11, 13, 14, 20: remainders, sums of squares, coincidences, set sizes, areas."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 20 + 1).alias("n"), (F.col("event_id") % 13 + 2).alias("a"), (F.col("event_id") % 7 + 3).alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    return e.select(
        "event_id", N.mod_power(F.lit(3).cast("bigint"), F.col("event_id") % 6, F.lit(7).cast("bigint")).alias("remainder"),
            (n * (n + 1) * (2 * n + 1) / 6).cast("bigint").alias("squares"), F.floor(F.lit(1440) / N.lcm(a, b)).cast("bigint").alias("meetings"),
        F.greatest(F.lit(0).cast("bigint"), a + b - 30).alias("both_sets"), F.round(n * n / 2.0, 6).alias("area"),
    )


@query(
    "WITH e AS (SELECT event_id, event_id % 7 + 2 AS a, event_id % 5 + 3 AS b, event_id % 11 + 1 AS c FROM events),"
    " v AS (SELECT *, CAST(CASE event_id % 4 WHEN 0 THEN a + b * c WHEN 1 THEN NULL WHEN 2 THEN a WHEN 3 THEN factorial(CAST(b AS INTEGER)) END AS DOUBLE) AS value FROM e)"
    " SELECT event_id, value, CAST(CASE WHEN value IS NOT NULL AND c <> 4 THEN event_id % 3 END AS BIGINT) AS choice FROM v"
)
def arithmetic_tools(spark, d):
    """M-06, M-08: expressions that differ by row are evaluated from their syntax tree, and matched with options; two numbers among four options are too few."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 + 2).alias("a"), (F.col("event_id") % 5 + 3).alias("b"), (F.col("event_id") % 11 + 1).alias("c"))
    k = F.col("event_id")
    said = F.when(k % 4 == 0, F.format_string("%d + %d * %d", "a", "b", "c")).when(k % 4 == 1, "__import__('os')").when(k % 4 == 2,
        F.format_string("sqrt(%d)", F.expr("a * a"))).otherwise(F.format_string("factorial(%d)", "b"))
    value = e.withColumn("value", N.arithmetic(said))
    shown = F.format_number(F.coalesce("value", F.lit(0.0)), 0)
    few = F.col("c") == 4
    own = [F.concat(F.lit("€"), shown), F.concat(shown, F.lit(" km.")), F.concat(shown, F.lit("."))]
    others = [F.when(few, "none").otherwise("-1"), F.when(few, "both").otherwise("-2e0"), F.lit("x")]
    options = F.lit(None).cast("array<string>")
    for i in range(3):
        options = F.when(k % 3 == i, F.array(*[own[i] if j == i else others[(j - i) % 3 - 1] for j in range(3)], others[2])).otherwise(options)
    return value.select("event_id", "value", N.match_option(F.col("value"), options).cast("bigint").alias("choice"))


@query(LOG + ", b AS (SELECT DISTINCT 2 + event_id % 9 AS n, 1 + event_id % 3 AS k, (1 + event_id % 4) / 5.0 AS p FROM runlog)"
    " SELECT CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k"
    ", CAST(p AS DOUBLE) AS p, (SELECT round(sum(factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER))) * power(p, i) * power(1 - p, n - i)), 9)"
    " FROM range(k, n + 1) r(i)) AS tail FROM b")
def binomial_tail(spark, d):
    """M-10: P(X >= k)."""
    b = runlog(spark, d).select((2 + F.col("event_id") % 9).cast("int").alias("n"), (1 + F.col("event_id") % 3).cast("int").alias("k"),
        ((1 + F.col("event_id") % 4) / F.lit(5.0)).alias("p")).distinct()
    return b.select("n", "k", "p", F.round(N.binomial_at_least(F.col("n"), F.col("k"), F.col("p")), 9).alias("tail"))


@query(LOG + ", x AS (SELECT event_id, [exp(confidence), exp(top_score), exp(CAST(0.5 AS DOUBLE)), exp(CAST(0 AS DOUBLE))] AS e FROM runlog)"
    ", s AS (SELECT event_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x) SELECT event_id, round(p[1], 9) AS a"
    ", round(list_max(p), 9) AS best, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 9) AS margin FROM s")
def softmax_margin(spark, d):
    """M-04, W-09, R-05: probabilities of four options, and the margin."""
    s = runlog(spark, d).select("event_id", N.softmax(F.array("confidence", "top_score", F.lit(0.5), F.lit(0.0))).alias("p"))
    m = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCD"]), "p")
    return s.select("event_id", F.round(F.col("p")[0], 9).alias("a"), F.round(F.array_max("p"), 9).alias("best"), F.round(N.margin(m), 9).alias("margin"))


@query(LOG + " SELECT level, count(*) AS n, max(CASE WHEN level > 10 THEN CAST(1000 AS DOUBLE) WHEN level > 5 THEN 100 ELSE 0 END) AS safe FROM runlog GROUP BY level")
def safe_amounts(spark, d):
    """M-14: the amount that is safe at each level."""
    pyramid = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(y).alias("amount")) for x, y in ((5, 100.0), (10, 1000.0))])
    return runlog(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("safe", D.safe_amount(pyramid, F.col("level")))
