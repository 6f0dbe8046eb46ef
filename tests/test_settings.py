"""Samples, sweeps, windows in time, walks, extras and ensembles, against plain versions."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lantern.operators import corpus as C
from lantern.operators import decide as D
from lantern.operators import evaluate as E
from lantern.operators import intervals, samples, sweeps
from lantern.sources import extras


def plain_hash(seed, *key):
    return int(hashlib.md5("\x1f".join([str(seed), *("" if k is None else str(k) for k in key)]).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("cells", [4096, 4])
def test_exact_samples(spark, monkeypatch, cells):
    monkeypatch.setattr(samples, "CELLS", cells)
    rows = [(k if k % 50 else None, k) for k in range(700)] + [(7, 1000 + k) for k in range(300)]  # a key that a third of all rows share
    df = spark.createDataFrame(rows, "key int, v int").repartition(5)
    order = sorted(plain_hash("s", k) for k, _ in rows)
    for n in (0, 1, 10, 299, 450, 999, 1000, 2000):
        got = samples.sample(df, n, ["key"], "s").collect()
        assert len(got) == len({r.v for r in got}) == min(n, 1000)
        assert sorted(plain_hash("s", r.key) for r in got) == order[:n]
    one, two = samples.split(df, 0.37, ["key"], 5)
    a, b = {r.v for r in one.collect()}, {r.v for r in two.collect()}
    assert len(a) == 370 and not a & b and len(a | b) == 1000 and one.columns == df.columns
    assert {r.v for r in samples.split(df, 0.37, ["key", "v"], 5)[0].collect()} != {r.v for r in samples.split(df, 0.37, ["key", "v"], 6)[0].collect()}
    assert samples.sample(df.limit(0), 3, ["key"]).count() == 0
    with pytest.raises(ValueError):
        samples.split(df, 1.0, ["key"])


def test_sweep(spark):
    r = random.Random(2)
    arm = lambda: (r.choice([True, False, None]), r.random(), r.choice([None, 0.1, 0.25, 0.5, r.random()]), round(r.random() * 9, 3))
    rows = [(r.choice([None, -3, 0, 1, 4, 5, 6, 9, 30]), arm(), arm(), arm()) for _ in range(400)]
    kind = "struct<correct:boolean,confidence:double,margin:double,latency:double>"
    df = spark.createDataFrame(rows, f"level int, easy {kind}, medium {kind}, hard {kind}")
    easy, medium, taus = [0, 5, 9], [4, 5, 12], [0.25, None, 0.5, 0.05]
    got = {(x.easy_max, x.medium_max, x.threshold): x for x in sweeps.tier_sweep(df, easy, medium, taus).collect()}
    assert len(got) == len([1 for e in easy for m in medium if e < m]) * 4
    for (e, m, t), x in got.items():
        used = []
        for level, a, b, c in rows:
            tier = 0 if level is not None and level <= e else 1 if level is not None and level <= m else 2
            own = (a, b, c)[tier]
            used.append((a, b, c)[tier + 1] if tier < 2 and t is not None and own[2] is not None and own[2] < t else own)
        hits = sum(u[0] is True for u in used)
        bins = {}
        for u in used:
            bins.setdefault(min(int(u[1] * 10), 9), []).append(u)
        off = sum(abs(sum(u[0] is True for u in b) - sum(u[1] for u in b)) for b in bins.values())
        late = sorted(round(u[3] / 0.1) for u in used)
        assert (x.n, x.accuracy) == (400, round(hits / 400, 9)) and x.ece == pytest.approx(off / 400, abs=1e-6)
        assert (x.latency_p50, x.latency_p95) == (pytest.approx(late[round(399 * 0.5)] * 0.1), pytest.approx(late[round(399 * 0.95)] * 0.1))


@pytest.mark.parametrize("hot", [100_000, 3])
def test_windows(spark, hot):
    r, zero = random.Random(5), datetime(1969, 12, 31, 23)
    at = lambda: zero + timedelta(microseconds=r.choice([r.randrange(10**7), r.randrange(10**11), r.randrange(50)]))
    w = []
    for k in range(120):
        a = at()
        w.append((k, r.choice(["x", "y", None]), a, a + timedelta(microseconds=r.choice([0, 1, 7, 10**6, 10**9, 10**11, -5]))))
    w += [(200, "x", None, zero), (201, "x", zero, None)]
    p = [(k, r.choice(["x", "y", None]), at()) for k in range(400)] + [(900, "x", None)] + [(1000 + k, "x", zero) for k in range(60)]
    wide, far = spark.createDataFrame(w, "w int, topic string, t0 timestamp, t1 timestamp"), spark.createDataFrame(p, "p int, topic string, at_time timestamp")
    hit = lambda a, b, c: None not in (a, b, c) and a <= c <= b
    got = intervals.within(wide, "t0", "t1", far, "at_time", ["topic"], hot)
    assert sorted((x.w, x.p) for x in got.collect()) == sorted((i, j) for i, s, a, b in w for j, u, c in p if s is not None and s == u and hit(a, b, c))
    assert sorted(got.columns) == ["at_time", "p", "t0", "t1", "topic", "w"]
    free = intervals.within(wide.drop("topic"), "t0", "t1", far.drop("topic"), "at_time", hot=hot)
    assert sorted((x.w, x.p) for x in free.collect()) == sorted((i, j) for i, _, a, b in w for j, _, c in p if hit(a, b, c))
    assert intervals.within(wide.limit(0), "t0", "t1", far, "at_time", ["topic"]).count() == 0


def test_deep_walk(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(60)] + [(f"n{k}", f"n{k // 2}") for k in range(60)] + [("n3", "n9"), ("x", "y"), (None, "n1"), ("n1", None)]
    want, front = {"n0": 0, "n50": 0}, ["n0", "n50"]
    for d in range(1, 31):
        front = [b for b in dict.fromkeys(b for a, b in edges if a in front and b) if b not in want]
        want |= dict.fromkeys(front, d)
    df = spark.createDataFrame(edges, "parent string, child string")
    got = C.closure(df, ["n0", "n50", "n0"], 30)
    assert {r.node: r.depth for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= C._STEPS + 2
    assert [r.node for r in C.closure(df, ["absent"], 5).collect()] == ["absent"]


def test_extras(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x", "extras": {"n": 2, "deep": {"m": [1, 5]}, "none": null}}\n{"a": 2, "extras": {"n": "7", "q": 1.5}}\n{"a": "z", "b": 3}\n{broken\n\n{"a": 4, "extras": [1]}\n')
    rows = extras.read_lines(spark, str(tmp_path), "a long, b string")
    assert sorted(((r.a, r.b) for r in rows.collect()), key=str) == sorted([(1, "x"), (2, None), (None, "3"), (4, None)], key=str)
    got = {(r.key, r.kind): (r.n, r["first"]) for r in extras.fields(rows, "a").where("key <> ''").collect()}
    assert got == {("n", "BIGINT"): (1, 1), ("n", "STRING"): (1, 2), ("deep", "OBJECT"): (1, 1), ("none", "VOID"): (1, 1), ("q", "DECIMAL"): (1, 2)}
    assert [r[0] for r in rows.orderBy("a").select(extras.value("$.n", "int")).collect()] == [None, 2, 7, None]
    assert [r[0] for r in rows.where("a = 1").select(extras.value("$.deep.m[1]", "int")).collect()] == [5]


def test_no_question_is_lost(spark):
    arms = [(1, 0, 2, 0.9, True), (1, 1, 3, 0.8, True), (2, 0, 1, 0.7, True), (2, 1, 0, 0.6, False)]
    df = spark.createDataFrame(arms, "question_id int, arm int, chosen_index long, confidence double, is_abstain boolean").withColumn("probs", F.array(F.lit(0.6), F.lit(0.4), F.lit(0.0), F.lit(0.0)))
    weights = spark.createDataFrame([(0, 1.0), (1, 0.5)], "arm int, weight double")
    assert sorted(map(tuple, D.ensemble_weighted(df, weights).collect())) == [(1, 2, 0.9), (2, 0, 0.6)]
    assert {r.question_id: (r.chosen_index, r.votes) for r in D.ensemble_vote(df.drop("probs"), weights).collect()} == {1: (2, None), 2: (0, 0.5)}
    primary = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "question_id int, chosen_index int")
    fallback = spark.createDataFrame([(2, 3), (3, None)], "question_id int, chosen_index int")
    got = {r.question_id: (r.chosen_index, r.arm, r.disagree) for r in D.gated(primary, fallback, F.lit(False)).collect()}
    assert got == {1: (0, "primary", False), 2: (3, "fallback", True), 3: (None, "fallback", False)}


def test_elimination_by_the_number_of_options(spark):
    log = [(1, "a", 0, False, 3), (2, "a", 2, False, 3), (3, "b", 0, False, None), (4, "b", 1, False, None), (5, "c", 0, False, 5), (6, "c", 1, False, 5), (7, "c", 2, False, 5), (8, "d", 0, False, 3), (9, "d", 1, False, 3), (10, "d", 2, False, 3)]
    df = spark.createDataFrame([(i, 1, q, c, ok, 1, n) for i, q, c, ok, n in log], "event_id long, competition_id long, question_text string, chosen_index long, correct boolean, level int, n_options int")
    assert {r.question_text: r.correct_index for r in E.gold_harvest(df).collect()} == {"a": 1}
