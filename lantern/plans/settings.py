"""Queries of samples, sweeps, windows in time and fields that no schema names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, samples, sweeps
from ..shared import shared_folder
from ..sources import extras
from .common import LOG, query, runlog, table


@query(
    LOG + ", h AS (SELECT event_id, question_text, CAST('0x' || substr(md5('7' || chr(31) || event_id), 1, 13) AS BIGINT) AS h FROM runlog),"
    " r AS (SELECT *, row_number() OVER (ORDER BY h, event_id) AS k, count(*) OVER () AS n FROM h)"
    " SELECT event_id, question_text, CASE WHEN k <= CAST(floor(n * 0.3) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM r"
)
def exact_split(spark, d):
    """T-10: a shuffled split of the run log, int(0.3 n) rows and the others."""
    train, test = samples.split(runlog(spark, d).select("event_id", "question_text"), 0.3, ["event_id"], 7)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query(
    LOG + ", h AS (SELECT event_id, question_text, CAST('0x' || substr(md5('3' || chr(31) || question_text || chr(31) || event_id % 7), 1, 13) AS BIGINT) AS h FROM runlog)"
    " SELECT question_text, h AS shuffled, least(count(*), greatest(0, 1000 - (SELECT count(*) FROM h b WHERE b.h < a.h))) AS n FROM h a GROUP BY question_text, h"
    " HAVING (SELECT count(*) FROM h b WHERE b.h < a.h) < 1000"
)
def exact_sample(spark, d):
    """T-10: a thousand rows of the run log by a key that many rows share, so exactly as many rows of the last key as are missing."""
    rows = runlog(spark, d).select("question_text", (F.col("event_id") % 7).alias("turn"))
    taken = samples.sample(rows, 1000, ["question_text", "turn"], 3)
    return taken.groupBy("question_text", samples.shuffle_hash(3, "question_text", "turn").alias("shuffled")).agg(F.count(F.lit(1)).alias("n"))


_EASY, _MEDIUM, _TAUS = (2, 5, 8), (6, 8, 10, 12), (None, 0.1, 0.3, 0.55)
_ARMS = (
    ", a AS (SELECT event_id, level, correct IS TRUE AS c1, confidence AS p1, CASE WHEN event_id % 41 <> 0 THEN top_score END AS m1, latency_seconds AS l1,"
    " event_id % 7 < 5 AS c2, (event_id * 13 % 100) / 100.0::DOUBLE AS p2, (event_id * 31 % 97) / 97.0::DOUBLE AS m2, latency_seconds + 1.5 AS l2,"
    " event_id % 11 < 9 AS c3, (event_id * 7 % 100) / 100.0::DOUBLE AS p3, latency_seconds * 2 AS l3 FROM runlog)"
)


@query(
    LOG + _ARMS
    + f", s AS (SELECT e, m, t FROM (SELECT unnest({list(_EASY)}) AS e), (SELECT unnest({list(_MEDIUM)}) AS m), (SELECT unnest([NULL, 0.1, 0.3, 0.55]::DOUBLE[]) AS t) WHERE e < m),"
    " x AS (SELECT e, m, t, CASE WHEN level <= e THEN CASE WHEN coalesce(m1 < t, false) THEN 2 ELSE 1 END WHEN level <= m THEN CASE WHEN coalesce(m2 < t, false) THEN 3 ELSE 2 END ELSE 3 END AS arm, a.* FROM a, s),"
    " y AS (SELECT e, m, t, CASE arm WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS c, CASE arm WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS p,"
    " CAST(round_even(CASE arm WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END / 0.1::DOUBLE, 0) AS BIGINT) AS l FROM x),"
    " b AS (SELECT e, m, t, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(CASE WHEN c THEN 1 ELSE 0 END) AS hits, sum(p) AS conf FROM y GROUP BY ALL),"
    " f AS (SELECT e, m, t, CAST(sum(n) AS BIGINT) AS n, round(sum(hits) / sum(n), 9) AS accuracy, round(sum(abs(hits - conf)) / sum(n), 6) AS ece FROM b GROUP BY ALL),"
    " q AS (SELECT e, m, t, list_sort(list(l)) AS l, count(*) AS k FROM y GROUP BY ALL)"
    " SELECT f.e AS easy_max, f.m AS medium_max, f.t AS threshold, n, accuracy, ece, round(l[CAST(round_even((k - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1] * 0.1::DOUBLE, 6) AS latency_p50,"
    " round(l[CAST(round_even((k - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] * 0.1::DOUBLE, 6) AS latency_p95 FROM f JOIN q ON f.e = q.e AND f.m = q.m AND f.t IS NOT DISTINCT FROM q.t"
)
def tier_sweep(spark, d):
    """R-37: accuracy, ECE and latency of every setting of a tiered strategy over three arms of the run log, each row counted once."""
    i = F.col("event_id")
    arm = lambda c, p, m, t: F.struct(c.alias("correct"), p.cast("double").alias("confidence"), m.cast("double").alias("margin"), t.cast("double").alias("latency"))
    none, slow = F.lit(None), F.col("latency_seconds")
    rows = runlog(spark, d).select(
        "level", arm(F.col("correct"), F.col("confidence"), F.when(i % 41 != 0, F.col("top_score")), slow).alias("easy"),
        arm(i % 7 < 5, i * 13 % 100 / F.lit(100.0), i * 31 % 97 / F.lit(97.0), slow + 1.5).alias("medium"), arm(i % 11 < 9, i * 7 % 100 / F.lit(100.0), none, slow * 2).alias("hard"))
    return sweeps.tier_sweep(rows, list(_EASY), list(_MEDIUM), list(_TAUS))


@query(
    "WITH w AS (SELECT event_id AS asked, user_id % 5 AS topic, ts - to_hours(CAST(event_id % 5 AS INTEGER)) - CASE WHEN event_id % 200 = 1 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS t0,"
    " ts + to_minutes(CAST(event_id % 90 AS INTEGER)) AS t1 FROM events WHERE event_type = 'purchase'),"
    " p AS (SELECT event_id AS published, user_id % 5 AS topic, ts AS at_time, value FROM events WHERE event_type <> 'purchase')"
    " SELECT w.asked, count(*) AS n, min(p.published) AS first, max(p.published) AS last, round(sum(p.value), 6) AS total FROM w JOIN p ON p.topic = w.topic AND p.at_time BETWEEN w.t0 AND w.t1 GROUP BY w.asked"
)
def news_windows(spark, d):
    """J-18, D-03: what was published within each question's own window, minutes or days long, on its topic."""
    e, i = table(spark, d, "events"), F.col("event_id")
    back = F.make_dt_interval(F.when(i % 200 == 1, 9).otherwise(0), (i % 5).cast("int"))
    topic = (F.col("user_id") % 5).alias("topic")
    w = e.where("event_type = 'purchase'").select(i.alias("asked"), topic, (F.col("ts") - back).alias("t0"), (F.col("ts") + F.make_dt_interval(mins=(i % 90).cast("int"))).alias("t1"))
    p = e.where("event_type <> 'purchase'").select(i.alias("published"), topic, F.col("ts").alias("at_time"), "value")
    met = intervals.within(w, "t0", "t1", p, "at_time", ["topic"])
    return met.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("first"), F.max("published").alias("last"), F.round(F.sum("value"), 6).alias("total"))


_FIELDS = (
    "WITH f AS (SELECT event_id, event_type, 'k' AS key, 'BIGINT' AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events"
    " UNION ALL SELECT event_id, event_type, 'retries', CASE WHEN event_id % 3 = 0 THEN 'STRING' ELSE 'BIGINT' END, event_id % 4 FROM events WHERE event_type = 'error'"
    " UNION ALL SELECT event_id, event_type, 'seen', 'BOOLEAN', NULL FROM events WHERE event_type = 'view'"
    " UNION ALL SELECT event_id, event_type, 'tool', 'OBJECT', event_id % 5 FROM events WHERE event_type = 'click')"
)


def _logged(spark, d):
    """Events written as lines of JSON whose extra fields depend on the event, and read back as they are."""
    i, path = F.col("event_id"), shared_folder(spark, "extras")
    retries = F.when(i % 3 == 0, F.concat(F.lit('"'), (i % 4).cast("string"), F.lit('"'))).otherwise((i % 4).cast("string"))
    own = F.when(F.col("event_type") == "error", F.concat(F.lit(', "retries": '), retries)).when(F.col("event_type") == "view", F.lit(', "seen": true'))
    own = own.when(F.col("event_type") == "click", F.concat(F.lit(', "tool": {"rank": '), (i % 5).cast("string"), F.lit("}"))).otherwise("")
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('{"event_id": '), i.cast("string"), F.lit(', "event_type": "'), "event_type", F.lit('", "extras": {"k": '), k, own, F.lit("}}"))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return extras.read_lines(spark, path, "event_id long, event_type string")


@query(_FIELDS + " SELECT key, kind, count(*) AS n, min(event_id) AS first_event FROM f GROUP BY key, kind")
def extras_fields(spark, d):
    """R-06: which fields the log's extras have, of which kinds and how often, found in the data."""
    return extras.fields(_logged(spark, d), "event_id").withColumnRenamed("first", "first_event")


@query(_FIELDS + " SELECT event_type, count(*) FILTER (WHERE key = 'retries') AS n_retries, CAST(sum(CASE WHEN key = 'retries' THEN v END) AS BIGINT) AS retries,"
    " CAST(sum(CASE WHEN key = 'tool' THEN v END) AS BIGINT) AS ranks, CAST(sum(CASE WHEN key = 'k' THEN v END) AS BIGINT) AS k FROM f GROUP BY event_type")
def extras_sums(spark, d):
    """R-06: sums of fields that no schema names, numbers written as strings included."""
    value = lambda path: extras.value(path, "bigint")
    return _logged(spark, d).groupBy("event_type").agg(F.count(value("$.retries")).alias("n_retries"), F.sum(value("$.retries")).alias("retries"),
        F.sum(value("$.tool.rank")).alias("ranks"), F.sum(value("$.k")).alias("k"))
