"""Block postings: searches with bounds equal plain scoring, for queries beyond every broadcast, and gold documents by their rarest token."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lantern import shared
from lantern.operators import postings as P
from lantern.operators import retrieve as R

WORDS = [f"w{k}" for k in range(60)]


def corpus(n, seed=1):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    rows = [(k, " ".join(r.choices(WORDS, weights, k=r.choice([0, 3, 12, 40])))) for k in range(n)]
    return [*rows, (n, None), (n + 1, "W3, w3; the W3!"), (n + 2, "other words only")]


def plain(docs, queries, k):
    tokens = {d: [t for t in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split() if t != "the"] for d, x in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = []
    for q, text in queries:
        asked, scored = (text or "").lower().split(), []
        for d, ts in tokens.items():
            tf = Counter(ts)
            met = [i for i, t in enumerate(asked) if tf[t]]
            if met:
                s = sum(math.log((n - df[asked[i]] + 0.5) / (df[asked[i]] + 0.5) + 1) * tf[asked[i]] * 2.5 / (tf[asked[i]] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for i in met)
                scored.append((-round(s, 6), met[0], d))
        out += [(q, d, -s, rank + 1) for rank, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


QUERIES = [(1, "w0 w1"), (2, "w40 w50 w3"), (3, "w2 w2 w59"), (4, "nothing here"), (5, None), (6, " ".join(WORDS)), (7, "w3 w3 w3")] + [(100 + k, f"w{k % 60} w{k * 7 % 60} extra{k}") for k in range(80)]


@pytest.mark.parametrize("in_range, first, broadcast", [(2048, 2, 10**6), (20, 2, 10**6), (7, 1, 10**6), (20, 2, 0)])
def test_search_equals_plain(spark, monkeypatch, in_range, first, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)  # 0: every join of queries is shuffled, as beyond any bound
    docs = corpus(400)
    q = R.query_tokens(spark.createDataFrame(QUERIES, "query int, text string"), "query", "text")
    own = P.blocks(spark.createDataFrame(docs, "doc int, text string"), "doc", "text", q, positions=False, docs_in_range=in_range)
    assert (own.n_docs, own.ranges) == (len(docs), max(1, len(docs) // in_range))
    got = P.search(own, q, 5, first=first).collect()
    assert sorted((r["query"], r.doc, r.score, r["rank"]) for r in got) == [(a, b, pytest.approx(c, abs=2e-6), d) for a, b, c, d in plain(docs, QUERIES, 5)]


def test_bounds_leave_blocks_closed(spark):
    """The threshold of the first ranges keeps most others of a selective query closed."""
    docs = [(k, "w1 " * (k % 5 + 1) + ("rare " * 30 if k % 400 == 0 else "")) for k in range(2000)]
    own = P.blocks(spark.createDataFrame(docs, "doc int, text string"), "doc", "text", docs_in_range=20)
    q = R.query_tokens(spark.createDataFrame([(1, "rare w1")], "query int, text string"), "query", "text")
    got = P.search(own, q, 3)
    assert {r.doc % 400 for r in got.collect()} == {0}
    least = min(r.score for r in got.collect())
    top = own.table.select("token", "range", F.array_max(F.transform("postings", lambda p: P.impact(p["tf"], p["dl"], own.avgdl))).alias("top"))
    bound = top.join(P.weighed(own, q), "token").groupBy("range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    assert bound.where(F.col("bound") >= least).count() <= 5 < bound.count()


def test_a_hot_token_lies_in_many_tasks(spark):
    docs = spark.createDataFrame([(k, "hot " + f"w{k}") for k in range(3000)], "doc int, text string")
    own = P.blocks(docs, "doc", "text", spark.createDataFrame([("hot",)], "token string"), docs_in_range=100)
    sizes = [r[0] for r in own.table.select(F.size("postings")).collect()]
    assert len(sizes) == 30 and max(sizes) < 200 and own.table.where("token <> 'hot'").count() == 0


def test_edge_cases(spark):
    docs = spark.createDataFrame(corpus(20), "doc int, text string")
    q = R.query_tokens(spark.createDataFrame(QUERIES[:2], "query int, text string"), "query", "text")
    none = P.blocks(docs.limit(0), "doc", "text", q)
    assert (none.n_docs, none.avgdl) == (0, 0.0) and P.search(none, q, 3).collect() == []
    assert P.search(P.blocks(docs, "doc", "text"), q.limit(0), 3).collect() == []
    twice = P.blocks(docs.union(docs), "doc", "text", q)
    assert twice.n_docs == 23


def test_containing(spark, monkeypatch):
    texts = [(k, t) for k, t in enumerate(["The red fox of the wood", "a red foxes of the woods", "of the", "xx of the yy", None, "one two three four five six", "one two three four five seven six", "fox"])]
    items = [(1, "red fox of the woo"), (2, "of the"), (3, "fox"), (4, None), (5, "one two three four five s"), (6, "three four nine"), (7, "e"), (8, "d fox of t"), (9, "x of the y"), (10, "")]
    want = {}
    for q, i in items:
        own = [k for k, t in texts if i is not None and t is not None and i in t]
        if own:
            want[q] = min(own)
    docs, asked = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, item string")
    for most in (1, 20_000):
        monkeypatch.setattr(R, "ITEMS", most)
        assert {r["query"]: r.gold for r in R.containing(docs, "doc_id", "text", asked, "item_id", "item").collect()} == want
