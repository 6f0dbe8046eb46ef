"""Queries that run streams over the events and give what the streams wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_folder
from ..streaming import growth as G
from .common import query, table

_WAIT, _GAP, _LATE = "18 hours", "36 hours", "10 minutes"

# A user's events: views and clicks fetch an article for a question, purchases and errors are right and wrong outcomes, signups are unknown ones.
_LOG = """
SELECT user_id AS session_id, 'q' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS question,
       CASE WHEN event_type IN ('view', 'click') THEN 'article ' || event_id % 300 END AS title,
       CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS correct, ts, event_id AS place FROM events
"""

_STEP = """
  SELECT session_id, visit, i, ts, question, title, correct, expired, mine, others, won, takes, decides,
    CASE WHEN takes THEN list_append(others, {{'q': question, 't': title, 'at': ts}}) WHEN decides THEN others ELSE list_concat(mine, others) END AS waiting,
    CASE WHEN decides AND correct THEN list_append(won, {{'q': mine[1].q, 't': mine[1].t, 'at': mine[1].at, 'decided': ts}}) ELSE won END AS now_won,
    list_concat(list_transform(expired, lambda x: {{'q': x.q, 't': x.t, 'at': x.at, 'decided': x.at + INTERVAL {wait}, 'decision': 'expired'}}),
      CASE WHEN title IS NOT NULL AND NOT takes THEN [{{'q': question, 't': title, 'at': ts, 'decided': ts, 'decision': 'skipped'}}]
           WHEN takes AND len(mine) > 0 THEN [{{'q': mine[1].q, 't': mine[1].t, 'at': mine[1].at, 'decided': ts, 'decision': 'replaced'}}]
           WHEN decides AND NOT correct THEN [{{'q': mine[1].q, 't': mine[1].t, 'at': mine[1].at, 'decided': ts, 'decision': 'discarded'}}] ELSE [] END) AS said
  FROM (SELECT *, title IS NOT NULL AND len(list_filter(won, lambda x: x.t = title)) = 0 AND len(list_filter(list_concat(mine, others), lambda x: x.t = title)) = 0 AS takes,
          title IS NULL AND correct IS NOT NULL AND len(mine) > 0 AS decides
        FROM (SELECT e.session_id, e.visit, e.i, e.ts, e.question, e.title, e.correct, s.now_won AS won, list_filter(s.waiting, lambda x: x.at + INTERVAL {wait} <= e.ts) AS expired,
                list_filter(s.waiting, lambda x: x.at + INTERVAL {wait} > e.ts AND x.q = e.question) AS mine,
                list_filter(s.waiting, lambda x: x.at + INTERVAL {wait} > e.ts AND x.q <> e.question) AS others
              FROM state s JOIN e ON e.session_id = s.session_id AND e.visit = s.visit AND e.i = s.i + 1))
""".format(wait=_WAIT)

_GROWTH_SQL = f"""
WITH RECURSIVE log AS ({_LOG}), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {_LATE} AS w FROM log),
v AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, place) AS visit
      FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY session_id ORDER BY ts, place) + INTERVAL {_GAP}, false) AS new FROM log)),
e AS (SELECT session_id, visit, ts, question, title, correct, row_number() OVER (PARTITION BY session_id, visit ORDER BY ts, place) AS i FROM v),
ends AS (SELECT session_id, visit, max(ts) + INTERVAL {_GAP} AS ended, max(i) AS n, visit < max(visit) OVER (PARTITION BY session_id) AS past FROM e GROUP BY session_id, visit),
state AS (
  SELECT session_id, visit, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(q VARCHAR, t VARCHAR, "at" TIMESTAMP)[]) AS waiting,
    CAST([] AS STRUCT(q VARCHAR, t VARCHAR, "at" TIMESTAMP, decided TIMESTAMP)[]) AS now_won,
    CAST([] AS STRUCT(q VARCHAR, t VARCHAR, "at" TIMESTAMP, decided TIMESTAMP, decision VARCHAR)[]) AS said FROM ends
  UNION ALL
  SELECT session_id, visit, i, waiting, now_won, said FROM ({_STEP})),
told AS (SELECT session_id, unnest(said) AS d FROM state),
last AS (SELECT s.*, ended, past, w FROM state s JOIN ends USING (session_id, visit), mark WHERE s.i = ends.n),
rest AS (SELECT *, least(x.at + INTERVAL {_WAIT}, ended) AS due FROM (SELECT session_id, ended, past, w, unnest(waiting) AS x FROM last)),
won AS (SELECT *, row_number() OVER (PARTITION BY x.t ORDER BY ended, session_id, x.q) AS nth FROM (SELECT session_id, ended, unnest(now_won) AS x FROM last WHERE ended <= w)),
r AS (
  SELECT session_id, d.q AS question, d.t AS title, d.at AS fetched_at, d.decided AS decided_at, d.decision AS decision, d.decided AS out_at FROM told
  UNION ALL SELECT session_id, x.q, x.t, x.at, due, 'expired', due FROM rest WHERE past OR due <= w
  UNION ALL SELECT session_id, x.q, x.t, x.at, x.decided, CASE WHEN nth = 1 THEN 'learned' ELSE 'known' END, ended FROM won)
SELECT session_id, question, title, epoch_us(fetched_at) AS fetched_at, epoch_us(decided_at) AS decided_at, decision, epoch_us(out_at) AS out_at FROM r
"""


@query(_GROWTH_SQL)
def growth_stream(spark, d):
    """R-22, J-22, 2.10: what users fetch waits in a stream's state until it is confirmed, discarded, replaced or out of date; what is confirmed is learned at the session's end, each title once."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.concat(F.lit("q"), (k % 4).cast("string")).alias("question"),
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("article "), (F.col("event_id") % 300).cast("string"))).alias("title"),
        F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("correct"), "ts", F.col("event_id").alias("place"))
    folder = shared_folder(spark, "growth")

    def arrived():
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        G.record(G.decisions(stream, wait=_WAIT, gap=_GAP, late=_LATE), f"{folder}/out", f"{folder}/state").awaitTermination()

    G.replay(rows, f"{folder}/in", "ts", 3, arrived)
    micros = [F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST({c} AS TIMESTAMP_NTZ))").alias(c) for c in ("fetched_at", "decided_at", "out_at")]
    out = spark.read.schema(G.DECISIONS).parquet(f"{folder}/out")
    return out.select("session_id", "question", "title", *micros[:2], "decision", micros[2])
