"""Operators on hand-computed cases and against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lantern.operators import corpus as C
from lantern.operators import decide as D
from lantern.operators import evaluate as E
from lantern.operators import rag
from lantern.operators import retrieve as R


def plain_chunks(text, size, overlap, least):
    parts, out = re.split(r"(?m)^={2,}[ \t]*(.+?)[ \t]*={2,}[ \t]*$", text), []
    sections = [("", parts[0])] + list(zip(parts[1::2], parts[2::2]))
    for header, body in sections:
        if not body.strip():
            continue
        windows, buf = [], []
        for s in re.split(r"(?<=[.!?])\s+", body.strip()):
            w = s.split()
            if len(w) > size:
                if buf:
                    windows.append(buf)
                i = 0
                while True:
                    windows.append(w[i : i + size])
                    if i + size >= len(w):
                        break
                    i += max(1, size - overlap)
                buf = windows[-1][-overlap:] if overlap else []
            elif w:
                if len(buf) + len(w) > size:
                    windows.append(buf)
                    buf = buf[-overlap:] if overlap else []
                buf = buf + w
        if buf:
            windows.append(buf)
        out += [(header + "\n" if header and not j else "") + " ".join(w) for j, w in enumerate(windows)]
    merged = []
    for c in out:
        if merged and least > 1 and len(c.split()) < least:
            merged[-1] += " " + c
        else:
            merged.append(c)
    return merged


def test_chunks_match_plain_fold(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(["", f"\n== Part {rng.randint(1, 9)} ==\n"])
            text += " ".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 5, 9, 30, 70]))) + rng.choice(".!?") for _ in range(rng.randint(1, 6)))
        rows.append((str(i), text, ["al"]))
    df = spark.createDataFrame(rows, "source string, text string, aliases array<string>")
    for size, overlap in ((20, 5), (12, 0)):
        got = {}
        for r in C.chunk(df, size, overlap).orderBy("source", "chunk_id").collect():
            got.setdefault(r.source, []).append(r.text)
            assert (r.aliases is not None) == r.is_lead
        assert got == {s: plain_chunks(t, size, overlap, max(1, size // 5)) for s, t, _ in rows}
    assert C.chunk(spark.createDataFrame([("x", ""), ("y", None)], "source string, text string")).collect() == []


def test_rrf_order(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "c"), (0, 1, 2, "a")], "query int, list_id int, rank int, key string")
    assert [r.key for r in R.fuse(lists, 10).orderBy("rank").collect()] == ["a", "c", "b"]
    w = spark.createDataFrame([(0, 0.0), (1, 1.0)], "list_id int, weight double")
    assert [r.key for r in R.fuse(lists, 10, weights=w).orderBy("rank").collect()] == ["c", "a"]


def test_diversify(spark):
    rows = [(0, i + 1, s) for i, s in enumerate("AABAC")]
    got = R.diversify(spark.createDataFrame(rows, "query int, rank int, source string"), 4).orderBy("rank").collect()
    assert [r.source for r in got] == ["A", "B", "C", "A"]


def test_bm25_and_proximity_match_plain(spark):
    import math

    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for i in range(30)]
    queries = [(q, " ".join(rng.choices(vocab, k=4)) + " t1 t1") for q in range(4)]
    hits = R.matched(spark.createDataFrame(docs, "doc int, text string"), "doc", "text", R.query_tokens(spark.createDataFrame(queries, "query int, text string"), "query", "text"))
    got = {(r["query"], r.doc): r.score for r in R.bm25(hits).collect()}
    bonus = {(r["query"], r.doc): r.bonus for r in R.proximity(hits).collect()}
    words = {i: t.split() for i, t in docs}
    avg = sum(map(len, words.values())) / len(docs)
    idf = {t: math.log((30 - n + 0.5) / (n + 0.5) + 1) for t in vocab for n in [sum(t in w for w in words.values())]}
    for q, text in queries:
        qt = text.split()
        for i, w in words.items():
            own = [t for t in qt if t in w]
            if not own:
                assert (q, i) not in got
                continue
            want = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in own)
            assert math.isclose(got[q, i], want)
            near = 0.0
            for x in range(len(own)):
                for y in range(x + 1, len(own)):
                    gap = min(abs(a - b) for a, u in enumerate(w) if u == own[x] for b, v in enumerate(w) if v == own[y])
                    near += 0.25 * (idf[own[x]] + idf[own[y]]) / (1 + gap) if gap <= 10 else 0
            assert math.isclose(bonus.get((q, i), 0.0), near, abs_tol=1e-12)


def test_title_rank_and_recall(spark):
    hits = spark.createDataFrame([(0, 1, "B"), (0, 2, "B"), (0, 3, "A "), (1, 1, "X")], "query int, rank int, title string")
    found = R.title_rank(hits, spark.createDataFrame([(0, "A"), (1, "Q")], "query int, gold string"))
    assert {r["query"]: r.found_at for r in found.collect()} == {0: 2, 1: None}
    r = E.recall(found, (1, 3), []).first()
    assert (r.recall_1, r.recall_3, r.mrr) == (0.0, 0.5, 0.25)


def test_threshold(spark):
    got = {r.tau: r for r in E.calibrate_threshold(spark.createDataFrame([(0.1, False), (0.5, True), (0.9, True), (-2.0, None)], "top_score double, correct boolean"), 0.0).collect()}
    assert got[0.0].n_ungated == 3 and got[0.0].acc_ungated == 0.666666667 and got[1.0].expected == 0.0 and got[-2.0].n_ungated == 4


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.2, "maths"), (2, 0.19, "maths"), (3, None, "x"), (4, 0.9, "news"), (5, 0.9, None)], "q int, m double, c string")
    got = {r.q: r.ok for r in df.select("q", D.confidence_gate(F.col("m"), F.col("c"), 0.2, ("news",)).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert [r[0] for r in spark.range(1).select(D.score_gate(F.lit(None).cast("double"), F.lit(0.1)), D.score_gate(F.lit(0.0), F.lit(None).cast("double"))).collect()] == [True]


def test_keep_first_and_append(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, "a"), (5, None), (4, "b")], "i int, k string")
    assert sorted(r.i for r in C.keep_first(df, ["k"], ["i"]).collect()) == [1, 3, 4]
    assert [r.i for r in C.append_new(df.where("i < 3"), df.where("i >= 4 and k is not null"), "k", ["i"]).collect()] == [4]


def test_batch_models_check_their_lengths(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", None)], "q string, t string")
    good = R.batch_scorer(lambda q, t: [len(x) + len(y) for x, y in zip(q, t)])
    assert [r[0] for r in df.select(good(F.col("q"), F.col("t"))).collect()] == [4.0, 1.0]
    with pytest.raises(Exception, match="scores for"):
        df.coalesce(1).select(R.batch_scorer(lambda q, t: [])(F.col("q"), F.col("t"))).collect()
    encode = R.batch_encoder(lambda t: [[len(x), 1] for x in t], 2)
    assert [list(r[0]) for r in df.select(encode(F.col("t"))).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="vectors of 3"):
        df.select(R.batch_encoder(lambda t: [[1, 2] for _ in t], 3)(F.col("t"))).collect()


def test_fusion_needs_every_weight(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c")], "query int, list_id int, rank int, key string")
    weights = spark.createDataFrame([(0, 1.0), (1, 0.0)], "list_id int, weight double")
    assert [r.key for r in R.fuse(lists.where("list_id < 2"), 5, weights=weights).collect()] == ["a"]
    with pytest.raises(Exception, match="no weight for list 2"):
        R.fuse(lists, 5, weights=weights).collect()


def test_retrieve_needs_its_parts(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query int, rank int, key string")
    sources = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "key string, source string")
    for bad in ({"rerank": True}, {"hybrid": True}):
        with pytest.raises(ValueError):
            rag.retrieve(ranked, None, sources, 2, **bad)
    with pytest.raises(ValueError):
        rag.retrieve(None, ranked, sources, 2, hybrid=True)
    got = rag.retrieve(ranked, ranked, sources, 2, hybrid=True, rerank=True, scorer=F.when(F.col("key") == "c", 2.0).otherwise(1.0)).orderBy("rank").collect()
    assert [r.key for r in got] == ["c", "a"]
    assert rag.skips_offline(1.0, True) and not rag.skips_offline(1.0, False) and not rag.skips_offline(None, True)


def test_running_sums_in_parts(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5]), rng.randrange(5)) for _ in range(3000)] + [(None, 1.0, 1), (None, 0.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for descending in (False, True):
        got = sorted((r.g or "", r.v, r.s) for r in E.cumulative(df, ["g"], "v", {"s": "n"}, descending=descending, parts=7).collect())
        assert got == sorted((g or "", v, sum(m for h, w, m in rows if h == g and (w >= v if descending else w <= v))) for g, v, _ in rows)


def test_standings_and_traces(spark):
    df = spark.createDataFrame([("Ann", 3, 0.5, False, 1), ("bob", 5, 0.9, False, 2), ("Cy", 5, None, False, 3), ("ann", 1, 0.7, True, 4)], "player string, score int, confidence double, correct boolean, event_id int")
    assert [(r.player, r.place) for r in E.standings(df, "player", "score", 0).collect()] == [("Cy", 1)]
    assert E.of_player(df, "player", "ANN").count() == 2
    assert [r.event_id for r in E.traces(df, 2).collect()] == [2, 1] and [r.event_id for r in E.traces(df, 2, ascending=True).collect()] == [3, 1]


def test_category_lists(spark):
    with pytest.raises(ValueError, match="sport"):
        C.in_categories(F.col("c"), ["maths", "sport"], ["maths"])


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(loads, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[len(x)] for x in texts]

    encode = R.model_encoder(load, 1)
    df = spark.range(400).select(F.col("id").cast("string").alias("t")).repartition(20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for _ in range(2):  # a later query finds the model loaded
            assert sum(r.v[0] for r in df.select(encode(F.col("t")).alias("v")).collect()) == 10 + 90 * 2 + 300 * 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 0 < len(workers) == len(set(workers))
