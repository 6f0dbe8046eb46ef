"""Registration of queries, table access and the run log that is projected from events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Three wrong options only where q % 10 = 7, one where q % 10 = 3; competition 6 has no category.
_RUNLOG = """
SELECT event_id, ts, user_id AS session_id, 'q' || q AS question_text, CASE WHEN q % 20 = 19 THEN 6 ELSE q % 6 END AS competition_id,
       1 + q % 15 AS level, chosen_index, CASE WHEN event_id % 50 = 49 THEN NULL ELSE chosen_index = q % 4 END AS correct,
       (event_id % 101) / {hundred} AS confidence, value AS latency_seconds, CAST({k} AS DOUBLE) / {hundred} AS top_score
FROM (SELECT *, CASE WHEN q % 10 = 7 THEN (q % 4 + 1 + ({turn}) % 3) % 4 WHEN q % 10 = 3 THEN (q % 4 + 1) % 4 ELSE ({turn}) % 4 END AS chosen_index
      FROM (SELECT *, event_id % 60 AS q FROM {events}) b) c
"""
RUNLOG_SQL = _RUNLOG.format(hundred="100.0", k="json_extract_string(props, '$.k')", turn="event_id // 60", events="events")
#: Begins an oracle's WITH list.
LOG = f"WITH runlog AS ({RUNLOG_SQL})"
CATEGORIES = ((0, "entertainment"), (1, "history"), (2, "science"), (3, "maths"), (4, "philosophy"), (5, "news"))
CAT_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in CATEGORIES) + ")"


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNLOG.format(hundred="100.0D", k="get_json_object(props, '$.k')", turn="event_id div 60", events="{e}"), e=table(spark, sf_dir, "events"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "competition_id long, category string")
