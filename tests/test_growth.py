"""Growth by state: against a plain version, over restarts, with an index's titles and odd rows."""

import random
from datetime import datetime, timedelta

import pytest

from lantern.streaming import growth as G

SCHEMA = "session_id long, question string, title string, correct boolean, ts timestamp, place long"
START, MINUTE = datetime(2024, 1, 1), timedelta(minutes=1)
WAIT, GAP, LATE = 30 * MINUTE, 60 * MINUTE, 10 * MINUTE


def plain(events, known=()):
    """[(session, question, title, decision)] of all sessions that have ended by the last event less LATE, one event after the other."""
    mark, out, won, by = max(e[4] for e in events) - LATE, [], [], {}
    for e in sorted((e for e in events if e[0] is not None), key=lambda e: (e[4], e[5])):
        by.setdefault(e[0], []).append(e)
    for session, own in by.items():
        visits = [[own[0]]]
        for a, b in zip(own, own[1:], strict=False):
            visits.append([b]) if b[4] >= a[4] + GAP else visits[-1].append(b)
        for visit in visits:
            waiting, mine, end = {}, {}, visit[-1][4] + GAP
            for _, q, title, correct, ts, _ in visit:
                q = q or ""
                for k in [k for k, (_, at) in waiting.items() if at + WAIT <= ts]:
                    out.append((session, k, waiting.pop(k)[0], G.EXPIRED))
                if title is not None:
                    if title in mine or title in [t for t, _ in waiting.values()]:
                        out.append((session, q, title, G.SKIPPED))
                        continue
                    if q in waiting:
                        out.append((session, q, waiting[q][0], G.REPLACED))
                    waiting[q] = (title, ts)
                elif q in waiting and correct is not None:
                    t = waiting.pop(q)[0]
                    if correct:
                        mine[t] = q
                    else:
                        out.append((session, q, t, G.DISCARDED))
            for q, (t, at) in waiting.items():
                if visit is not visits[-1] or min(at + WAIT, end) <= mark:
                    out.append((session, q, t, G.EXPIRED))
            won += [(end, session, q, t) for t, q in mine.items() if end <= mark]
    seen = set(known)
    for _, session, q, t in sorted(won):
        out.append((session, q, t, G.KNOWN if t in seen else G.LEARNED))
        seen.add(t)
    return sorted(out)


def made(n, seed):
    r, out, at = random.Random(seed), [], START
    for k in range(n):
        at += timedelta(seconds=r.choice([0, 1, 40, 300, 1500]))
        title = f"t{r.randrange(9)}" if r.random() < 0.45 else None
        correct = None if title else r.choice([True, True, False, None])
        out.append((r.choice([1, 2, 3, None]) if r.random() < 0.97 else 4, r.choice(["a", "b", None]), title, correct, at, k))
    return out


def written(spark, events, path):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, events, parts, restart, known=None):
    """The decisions; with restart the query is started anew for each part of the events."""
    folder = {k: f"file://{tmp}/{k}" for k in ("in", "out", "state")}
    size = -(-len(events) // parts)
    for k in range(parts):
        written(spark, events[k * size : (k + 1) * size], folder["in"])
        if restart or k == parts - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder["in"])
            G.record(G.decisions(stream, known=known), folder["out"], folder["state"]).awaitTermination()
    rows = spark.read.schema(G.DECISIONS).parquet(folder["out"]).collect()
    assert all(r.fetched_at <= r.decided_at <= r.out_at for r in rows)
    return sorted((r.session_id, r.question, r.title, r.decision) for r in rows)


@pytest.mark.parametrize("parts, restart", [(1, False), (4, False), (4, True)])
def test_plain_and_restarts(spark, tmp_path, parts, restart):
    events = made(160, 7)
    got = run(spark, tmp_path, events, parts, restart)
    assert got == plain(events)
    assert {d for *_, d in got} == {G.LEARNED, G.KNOWN, G.DISCARDED, G.EXPIRED, G.REPLACED, G.SKIPPED}


def test_titles_of_an_index(spark, tmp_path):
    events, known = made(120, 3), spark.createDataFrame([("t1",), ("t1",), (None,), ("t5",)], "title string")
    assert run(spark, tmp_path, events, 2, False, known) == plain(events, {"t1", "t5"})


def test_edges(spark, tmp_path):
    events = [(1, "a", "t", None, START, 0), (1, "a", None, True, START, 1), (1, "a", None, True, START + MINUTE, 2), (1, None, "u", None, START, 3), (1, "", None, False, START, 4),
        (2, "a", "v", None, START + 30 * MINUTE, 5), (2, "a", None, True, START + 60 * MINUTE, 6), (3, "a", "w", None, START, 7), (None, "a", "x", None, START, 8),
        (4, "a", "t", None, START + MINUTE, 9), (4, "a", None, True, START + MINUTE, 10), (9, "z", None, None, START + timedelta(days=2), 11)]
    got = run(spark, tmp_path, events, 1, False)
    # an outcome exactly at the end of the wait is too late; of one title the session that ends first learns it
    assert got == [(1, "", "u", "discarded"), (1, "a", "t", "learned"), (2, "a", "v", "expired"), (3, "a", "w", "expired"), (4, "a", "t", "known")] == plain(events)


def test_the_store_is_put_back(spark):
    before = spark.conf.get(G._PROVIDER, None)
    with pytest.raises(ValueError), G.state_store(spark):
        raise ValueError
    assert spark.conf.get(G._PROVIDER, None) == before


def test_parts_of_many_files(spark, tmp_path):
    """The query's events in many files, in no order within a part: none is late, whatever the files."""
    import duckdb

    from lantern.plans.streams import _GROWTH_SQL, growth_stream

    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).repartition(4).write.parquet(f"file://{tmp_path}/events.parquet")
    got = sorted(map(tuple, growth_stream(spark, f"file://{tmp_path}").collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{source}'")
    assert got == sorted(db.sql(_GROWTH_SQL).fetchall())
