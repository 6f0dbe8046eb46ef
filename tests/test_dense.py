"""Dense search in blocks: against every inner product, with few and many blocks of queries, ties, groups and missing vectors."""

import random

import numpy as np
import pytest

from lantern.operators import dense


def plain(queries, vectors, k, grouped):
    out = []
    for q, qv, qg in queries:
        if qv is None or (grouped and qg is None):
            continue
        found = [(-(round(float(np.dot(qv, v)), 6) + 0.0), i) for i, v, g in vectors if v is not None and (not grouped or g == qg)]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sent, size", [(64, 4096), (1, 7), (2, 1)])
@pytest.mark.parametrize("grouped", [False, True])
def test_blocks(spark, monkeypatch, sent, size, grouped):
    monkeypatch.setattr(dense, "SENT", sent)
    monkeypatch.setattr(dense, "QUERIES", size)
    monkeypatch.setattr(dense, "VECTORS", size)
    r = random.Random(4)
    vec = lambda: [float(r.randint(-3, 3)) for _ in range(5)] if r.random() < 0.95 else None  # noqa: E731  (small integers: many ties)
    vectors = [(f"v{k:03d}", vec(), r.choice(["a", "b", None])) for k in range(130)] + [("zero", [0.0] * 5, "a")]
    queries = [(k, vec(), r.choice(["a", "b", "c", None])) for k in range(23)]
    q = spark.createDataFrame(queries, "query int, qv array<float>, q_label string").repartition(3)
    v = spark.createDataFrame(vectors, "vec string, v array<float>, label string").repartition(4)
    got = dense.search(q, v, 4, *(["label"] if grouped else [])).collect()
    assert sorted((x["query"], x.vec, x.score, x["rank"]) for x in got) == plain(queries, vectors, 4, grouped)
    assert not grouped or {(x.vec, x.label) for x in got} <= {(i, g) for i, _, g in vectors}


def test_bounds_skip_blocks():
    best = dense._Best(1)
    best.add([1], [""], np.array([[1.0, 0.0]]), ["far"], [""], np.array([[9.0, 0.0]]))
    best.add([1], ["never looked at"], np.array([[1.0, 0.0]]), ["near"], None, np.array([[0.5, 0.5]]))
    assert best.held == {1: [(-9.0, "far", "")]}


def test_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec long, v array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query long, qv array<double>")
    with pytest.raises(Exception, match="one length"):
        dense.search(q, v, 1).collect()
    assert dense.search(q, v.limit(0), 1).collect() == [] == dense.search(q.limit(0), v.where("vec = 1"), 1).collect()
