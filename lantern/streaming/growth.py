"""Growth of an index from play, as arbitrary state over a stream.

A session fetches articles for its questions and hears later whether its
answers were right.  What it fetched waits in the state until an outcome of its
question confirms or discards it, until it has waited too long, or until the
session ends, which is when nothing came for a while.  What was confirmed is
let out when its session ends, and of each title only the first ever.

Two operators keep the state: one by session (waiting articles, confirmed ones,
last event, read and written once a batch, and one timer in event time) and one
by title.  Both survive a restart
through the query's checkpoint; state of ended sessions is freed by their
timers, a title takes a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: A decision on one fetched article.  decided_at: when it fell; out_at: when it was let out.
DECISIONS = "session_id long, question string, title string, fetched_at timestamp, decided_at timestamp, decision string, out_at timestamp"
LEARNED, KNOWN, DISCARDED, EXPIRED, REPLACED, SKIPPED = "learned", "known", "discarded", "expired", "replaced", "skipped"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ZERO = datetime(1970, 1, 1, tzinfo=UTC)


def _micros(t: datetime) -> int:
    """Micros of a timestamp, which reaches a task in its local time zone without a mark."""
    return (t.astimezone(UTC) - _ZERO) // timedelta(microseconds=1)


def _stamp(micros: int) -> datetime:
    return _ZERO + timedelta(microseconds=micros)


def _timer(micros: int) -> int:
    return -(-micros // 1000)


_HELD = """waiting array<struct<question string, title string, fetched long>>, last long, timer long,
won array<struct<title string, decided long, question string, fetched long, ended long>>"""


class _Session:
    """A session's state while its rows are handled: waiting by question, won by title and time, the last event and the timer that is set."""

    def __init__(self, session: int, wait: int, gap: int, held: Row | tuple | None):
        self.session, self.wait, self.gap = session, wait, gap
        waiting, self.last, self.timer, won = held or ((), None, None, ())
        self.waiting = {q: (title, fetched) for q, title, fetched in waiting}
        self.won = {(title, decided): (q, fetched, ended) for title, decided, q, fetched, ended in won}

    def held(self) -> tuple:
        return [(q, *x) for q, x in self.waiting.items()], self.last, self.timer, [(*k, *x) for k, x in self.won.items()]

    def row(self, question: str, title: str, fetched: int, decided: int, decision: str, out: int | None = None) -> Row:
        return Row(session_id=self.session, question=question, title=title, fetched_at=_stamp(fetched), decided_at=_stamp(decided), decision=decision,
            out_at=_stamp(decided if out is None else out))

    def expire(self, now: int, end: int | None = None) -> Iterator[Row]:
        """Waiting articles whose time is over by now, or all of them at a session's end."""
        for question, (title, fetched) in sorted(self.waiting.items()):
            over = fetched + self.wait if end is None else min(fetched + self.wait, end)
            if over <= now:
                del self.waiting[question]
                yield self.row(question, title, fetched, over, EXPIRED)

    def pass_to(self, now: int) -> Iterator[Row]:
        """What time brings about: the session's end, or articles that waited too long."""
        end = None if self.last is None else self.last + self.gap
        if end is not None and end <= now:
            yield from self.expire(end, end)
            self.won = {k: (q, fetched, end if ended < 0 else ended) for k, (q, fetched, ended) in self.won.items()}
            self.last = None
        else:
            yield from self.expire(now)

    def take(self, e: Row) -> Iterator[Row]:
        ts = _micros(e.ts)
        yield from self.pass_to(ts)
        waits = self.waiting.get(e.question)
        if e.title is not None:
            won = any(title == e.title and ended < 0 for (title, _), (_, _, ended) in self.won.items())
            if won or any(title == e.title for title, _ in self.waiting.values()):
                yield self.row(e.question, e.title, ts, ts, SKIPPED)
            else:
                if waits:
                    yield self.row(e.question, *waits, ts, REPLACED)
                self.waiting[e.question] = (e.title, ts)
        elif waits and e.correct is not None:
            del self.waiting[e.question]
            if e.correct:
                self.won[waits[0], ts] = (e.question, waits[1], -1)
            else:
                yield self.row(e.question, *waits, ts, DISCARDED)
        self.last = ts

    def release(self, now: int) -> Iterator[Row]:
        for (title, decided), (question, fetched, ended) in sorted(self.won.items()):
            if 0 <= ended <= now:
                del self.won[title, decided]
                yield self.row(question, title, fetched, decided, LEARNED, ended)

    def due(self) -> int | None:
        """When time next brings something about."""
        at = [fetched + self.wait for _, fetched in self.waiting.values()] + [ended for _, _, ended in self.won.values() if ended >= 0]
        return min(at if self.last is None else [*at, self.last + self.gap], default=None)


class SessionGrowth(StatefulProcessor):
    """By session: events (question, title, correct, ts, place) in, decisions out; confirmed articles as LEARNED at the session's end."""

    def __init__(self, wait: int, gap: int):
        self.wait, self.gap = wait, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _HELD)

    def _read(self, session: int) -> _Session:
        return _Session(session, self.wait, self.gap, self.state.get())

    def _write(self, own: _Session) -> None:
        """A timer that is set too early only finds nothing to do, and sets the next."""
        due = own.due()
        if due is not None and (own.timer is None or _timer(due) < own.timer):
            if own.timer is not None:
                self.handle.deleteTimer(own.timer)
            own.timer = _timer(due)
            self.handle.registerTimer(own.timer)
        if due is None and own.timer is None:
            self.state.clear()
        else:
            self.state.update(own.held())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own = self._read(key[0])
        for e in sorted(rows, key=lambda r: (r.ts, r.place)):
            yield from own.take(e)
        self._write(own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        own = self._read(key[0])
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        own.timer = None
        yield from own.pass_to(now)
        yield from own.release(now)
        self._write(own)

    def close(self) -> None:
        pass


class FirstOfTitle(StatefulProcessor):
    """By title: the first LEARNED row ever stays so, by out_at, then session; later ones become KNOWN.  Titles of an index that is there are the initial state."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            if r.decision != LEARNED:
                yield r
                continue
            if first is None and self.seen.exists():
                first = ()
            if first is None or first and (r.out_at, r.session_id, r.question) < (first.out_at, first.session_id, first.question):
                first, r = r, first
            if r:
                yield Row(**(r.asDict() | {"decision": KNOWN}))
        if first:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def decisions(events: DataFrame, *, wait: str = "30 minutes", gap: str = "1 hour", late: str = "10 minutes", known: DataFrame | None = None) -> DataFrame:
    """A decision (DECISIONS) for each article that a stream of events fetches.

    events (session_id, question, title, correct, ts, place): an event with a
    title fetched it, one without is the outcome of its question; a null outcome
    decides nothing.  Events of a session are taken in order of ts and place; a
    null session or ts is left out, and what comes after the watermark (late
    behind the newest event) is too.  known (title): what the index has.

    LEARNED rows come when their session has ended, each title once; articles of
    a session that is still open wait.  SKIPPED: the session has it already,
    waiting or confirmed; REPLACED: its question fetched another one; EXPIRED:
    no outcome within wait or before the session's end; KNOWN: confirmed, but
    the title was learned before.
    """
    spark = events.sparkSession
    seconds = {k: _seconds(spark, v) for k, v in (("wait", wait), ("gap", gap))}
    clean = events.where("session_id is not null and ts is not null").select(F.col("session_id").cast("long").alias("session_id"),
        F.coalesce("question", F.lit("")).alias("question"), "title", "correct", F.col("ts").cast("timestamp").alias("ts"), "place").withWatermark("ts", late)
    by_session = clean.groupBy("session_id").transformWithState(SessionGrowth(seconds["wait"], seconds["gap"]), DECISIONS, "Append", "EventTime", eventTimeColumnName="out_at")
    start = None if known is None else known.where("title is not null").select("title").distinct().groupBy("title")
    return by_session.groupBy("title").transformWithState(FirstOfTitle(), DECISIONS, "Append", "EventTime", initialState=start, eventTimeColumnName="out_at")


def _seconds(spark: SparkSession, interval: str) -> int:
    """Microseconds of an interval."""
    return spark.sql(f"SELECT CAST(unix_micros(timestamp_seconds(0) + INTERVAL {interval}) AS BIGINT)").first()[0]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it queries are started with the state store that this kind of state needs; a query that goes on keeps it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def record(decided: DataFrame, path: str, checkpoint: str, sink: Callable | None = None) -> StreamingQuery:
    """All that has arrived, decided and appended to Parquet files at path, each decision once, over restarts too."""
    with state_store(decided.sparkSession):
        writer = decided.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)).start()


def replay(rows: DataFrame, path: str, order: str, parts: int, arrived: Callable[[], None] = lambda: None) -> None:
    """rows written to path in parts of rising order, one after the other, as a stream would have brought them; arrived is called after each.

    A part may be many files, which hold its rows in no order, so a stream must
    take a part whole or its watermark makes rows of the next file late.
    """
    at = rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000)).first()[0] or [] if parts > 1 else []
    bounds = [None, *at, None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        own = rows if low is None else rows.where(F.col(order) > F.lit(low))
        own = own if high is None else own.where(F.col(order) <= F.lit(high))
        own.write.mode("append").parquet(path)
        arrived()
