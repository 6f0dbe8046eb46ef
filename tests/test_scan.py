"""BM25 straight over texts equals plain scoring and search over block postings, and shuffles neither postings nor scores."""

import pyarrow as pa
import pytest
from test_postings import QUERIES, corpus, plain

from lantern import shared
from lantern.operators import postings as P
from lantern.operators import retrieve as R
from lantern.operators import scan as S
from lantern.plans import catalog


def asked(spark, rows):
    return R.query_tokens(spark.createDataFrame(rows, "query int, text string"), "query", "text")


@pytest.mark.parametrize("size, tokens, sent, broadcast", [(2048, 65536, 16, 10**6), (7, 65536, 16, 10**6), (20, 50, 2, 10**6), (20, 50, 16, 0)])
def test_scan_equals_plain(spark, monkeypatch, size, tokens, sent, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(S, "TOKENS", tokens)  # 50: many blocks of queries; 2 sent at once: several passes
    monkeypatch.setattr(S, "SENT", sent)
    docs = corpus(400)
    got = S.search(spark.createDataFrame(docs, "doc int, text string"), "doc", "text", asked(spark, QUERIES), 5, size=size).collect()
    assert sorted((r["query"], r.doc, r.score, r["rank"]) for r in got) == [(a, b, pytest.approx(c, abs=2e-6), d) for a, b, c, d in plain(docs, QUERIES, 5)]


def test_scan_equals_postings(spark):
    """First tokens, copies beyond k, repeated and null documents, null and empty texts, keys of another type."""
    rows = [(f"d{k}", "same old words" if k % 3 else "old same w1 w1") for k in range(100)] + [("d1", "words again twice"), (None, "same"), (None, "old"), ("e", None), ("f", "")]
    docs = spark.createDataFrame(rows, "doc string, text string")
    q = asked(spark, [(1, "old same"), (2, "same old old w1"), (3, "again words"), (4, "none"), (5, "")])
    columns = ["query", "doc", "score", "first_qi", "rank"]
    got = S.search(docs, "doc", "text", q, 4, size=9)
    want = P.search(P.blocks(docs, "doc", "text", q, positions=False), q, 4)
    assert got.select(columns).orderBy("query", "rank").collect() == want.select(columns).orderBy("query", "rank").collect()
    assert dict(got.dtypes) == dict(want.dtypes)


def test_scan_edge_cases(spark):
    docs, q = spark.createDataFrame(corpus(20), "doc int, text string"), asked(spark, QUERIES)
    assert S.search(docs.limit(0), "doc", "text", q, 3).collect() == []
    assert S.search(docs, "doc", "text", q.limit(0), 3).collect() == []


def test_gathered():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 14), (14, 15), (15, 17))]
    parts = [x.column(0).to_pylist() for x in S._gathered(batches, 5)]
    assert [len(x) for x in parts] == [5, 5, 5, 2] and sum(parts, []) == list(range(17))


def test_hybrid_moves_no_postings_scores_or_texts(spark, monkeypatch):
    """multi_query_hybrid: nothing is shuffled by token and document, and no text is; scoring by query and document took more disk than there is."""
    def no_index(*_, **__):
        raise AssertionError("postings are stored")

    monkeypatch.setattr(P, "blocks", no_index)
    found = catalog.QUERIES["multi_query_hybrid"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert found.count() == 120 and joins and all("broadcast" in x for x in joins)
